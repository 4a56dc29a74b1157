"""Spelling variants: words of a corpus that differ by one edit, found by composing finite-state machines.

The vocabulary's minimised acceptor is composed with a transducer of exactly one edit and with the acceptor
again. Until the edit both acceptors are in the same state; at the edit they part; after it both must accept the
same rest. The composed machine is dealt by its initial states: an edit lies in one half of a word, and all words
that agree in the other half (and in length class) start in one state, which one task enumerates. Where too
many words share a state, it is split by halving the part that holds the edit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import Scratch
from ..operators.graph import followed
from .common import cut, table

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def corpus_words(docs: DataFrame, drop_one_in: int = 199, least_length: int = 6, least: int = 5, held: int = 200_000) -> DataFrame:
    """word, n of the runs of Latin letters (A-Z lower-cased) with ``least_length`` code points and ``least`` occurrences.

    A run loses a code point where ``drop_one_in`` divides the crc32 of ``<doc_id>:<run>`` (null ids: empty text).
    Tasks count ``held`` words before they hand them on, so frequent words are few rows.
    """

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), seed)
                    if not h % drop_one_in:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > held:
                    yield _counted(total)
                    total.clear()
        if total:
            yield _counted(total)

    rows = docs.filter(docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """The word cut into ``parts`` (fewer where it is short): from, to of each."""
    ends = sorted({length * k // parts for k in range(parts + 1)})
    return list(zip(ends[:-1], ends[1:], strict=True))


def states(words: DataFrame, parts: int) -> DataFrame:
    """The initial states a word takes part in: state, longer, part, word, n.

    A pair belongs to the length class of its shorter word and to the segment of that word that holds its first
    difference. ``state`` names class, segment and the letters outside, ``part`` those within; a word is in the class of its own length,
    and as ``longer`` in the one below.
    """

    def run(batches):
        for batch in batches:
            out = []
            for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for more in (0, 1):
                    length = len(word) - more
                    for a, b in segments(length, parts):
                        out.append((f"{length}.{a}.{b}.{word[:a]}.{word[b + more :]}", bool(more), word[a : b + more], word, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)

    return words.mapInArrow(run, "state string, longer boolean, part string, word string, n long")


_NAMES, _KINDS = ["state", "longer", "part", "word", "n"], [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64()]


class Acceptor:
    """The minimal acyclic acceptor of strings that come in order: states by their arcs and finality, 0 is the empty end."""

    def __init__(self, strings: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict = {}
        open_states: list[tuple[dict, bool]] = [({}, False)]
        last = ""
        for s in strings:
            same = 0
            while same < min(len(s), len(last)) and s[same] == last[same]:
                same += 1
            self._close(open_states, last, same)
            open_states += [({}, False) for _ in s[same:]]
            open_states[-1] = (open_states[-1][0], True)
            last = s
        self._close(open_states, last, 0)
        self.start = self._state(*open_states[0])
        self._both: dict[tuple[int, int], bool] = {}

    def _close(self, open_states: list, last: str, depth: int) -> None:
        for k in range(len(last), depth, -1):
            open_states[k - 1][0][last[k - 1]] = self._state(*open_states.pop())

    def _state(self, arcs: dict, final: bool) -> int:
        key = (final, tuple(arcs.items()))
        if (state := self._known.get(key)) is None:
            state = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return state

    def meets(self, p: int, q: int) -> bool:
        """Whether some string leads to acceptance from both states."""
        if p == q:
            return True
        first = (p, q) if p < q else (q, p)
        todo = [first]
        while todo:  # without recursion, as words may be long
            pair = todo[-1]
            found, open_pairs = self._both.get(pair), []
            if found is None and self.final[pair[0]] and self.final[pair[1]]:
                found = True
            if found is None:
                other = self.arcs[pair[1]]
                for c, t in self.arcs[pair[0]].items():
                    u = other.get(c)
                    if u is None:
                        continue
                    known = t == u or self._both.get(key := (t, u) if t < u else (u, t))
                    if known:
                        found = True
                        break
                    if known is None:
                        open_pairs.append(key)
                if found is None and not open_pairs:
                    found = False
            if found is None:
                todo.append(open_pairs[0])
            else:
                self._both[pair] = found
                todo.pop()
        return self._both[first]

    def common(self, p: int, q: int) -> Iterator[str]:
        """The strings that are accepted from both."""
        todo: list[tuple] = [(p, q, None)]
        while todo:
            p, q, path = todo.pop()
            if self.final[p] and self.final[q]:
                yield _spelled(path)
            todo += [(t, self.arcs[q][c], (path, c)) for c, t in self.arcs[p].items() if c in self.arcs[q] and self.meets(t, self.arcs[q][c])]

    def one_edit(self) -> Iterator[tuple[str, str]]:
        """All pairs of the composition: (x, y) with a letter of x replaced, or with one put in; the edit is at their first difference.

        Replacements come out once, the smaller string first.
        """
        todo: list[tuple] = [(self.start, None)]
        while todo:
            state, path = todo.pop()
            arcs = self.arcs[state]
            for a, p in arcs.items():
                todo.append((p, (path, a)))
                for b, q in arcs.items():
                    if a < b and self.meets(p, q):
                        head = _spelled(path)
                        yield from ((head + a + s, head + b + s) for s in self.common(p, q))
                # a put in: the shorter string goes on from here with another letter, or ends here
                if self.meets(state, p):
                    head = _spelled(path)
                    yield from ((head + s, head + a + s) for s in self.common(state, p) if not s.startswith(a))


def _spelled(path: tuple | None) -> str:
    """The letters on a path of (path before, letter)."""
    letters = []
    while path is not None:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def near_pairs(words: DataFrame, parts: int = 2, most: int = 50_000) -> DataFrame:
    """word, n, other, other_n of all words (word, n; distinct) that one inserted, deleted or replaced code point makes equal; both directions.

    A state of over ``most`` words is split into states whose words agree in more letters, and at last in all but the
    edited one: then it has as many words as there are letters, or pairs of them.
    """

    def enumerate_states(batches):
        own, state = [], None

        def pairs():
            by_part = {False: {}, True: {}}
            for longer, part, word, n in own:
                by_part[longer][part] = (word, n)
            short, long = by_part[False], by_part[True]
            if not short or len(short) + len(long) < 2:
                return
            length, a, b = state.split(".", 3)[:3]
            for x, y in Acceptor(sorted({*short, *long})).one_edit():
                if x not in short or y not in (short if len(x) == len(y) else long):
                    continue
                if len(x) < len(y) and y.startswith(x) and b != length:
                    continue  # they first differ behind this segment
                u, v = short[x], (short if len(x) == len(y) else long)[y]
                yield (*u, *v)
                yield (*v, *u)

        out = []
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != state:
                    if state is not None:
                        out += pairs()
                    own, state = [], key
                own.append(row)
                if len(out) > 50_000:
                    yield _paired(out)
                    out = []
        if state is not None:
            out += pairs()
        if out:
            yield _paired(out)

    scratch = Scratch(words.sparkSession)
    found, todo = None, states(words, parts)
    longest = words.agg(F.max(F.length("word")).alias("m")).first()["m"] or 0
    while True:
        every = scratch.put(f"states{parts}", todo)
        large = every.groupBy("state").agg(F.count("*").alias("_n")).filter(F.col("_n") > most) if parts < longest else None
        split = large is not None and not (large := scratch.put(f"large{parts}", large.select("state"))).isEmpty()
        rows = every.join(large, "state", "left_anti") if split else every
        done = rows.repartition("state").sortWithinPartitions("state").mapInArrow(enumerate_states, "word string, n long, other string, other_n long")
        found = done if found is None else found.unionByName(done)
        if not split:
            return found
        # words of the large states again, in segments of half the size that lie within those of the state
        again = every.join(large, "state", "left_semi")
        parts *= 2
        within = again.select(F.split("state", r"\.", 4).alias("_s"), "longer", "word", "n")
        finer = states(within.select("word", "n").distinct(), parts).withColumn("_t", F.split("state", r"\.", 4))
        outer = within.select(F.col("_s")[0].alias("_l"), F.col("_s")[1].cast("int").alias("_a"), F.col("_s")[2].cast("int").alias("_b"), "word").distinct()
        met = finer.join(outer, (finer["word"] == outer["word"]) & (F.col("_t")[0] == F.col("_l")) & (F.col("_t")[1].cast("int") >= F.col("_a")) & (F.col("_t")[2].cast("int") <= F.col("_b")))
        todo = met.select("state", "longer", "part", finer["word"], "n").distinct()


def _paired(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["word", "n", "other", "other_n"])


def spelling_variants(docs: DataFrame, ratio: int = 5, **how) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``corpus_words``.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that has ``ratio`` times its n; the root is where
    the forms lead at last (n grows, so they never go round). Null texts have no words, null ids count as empty in the
    crc32; texts of any length are read whole; repeated rows count each; other columns take no part, whatever their names;
    an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.put("words", corpus_words(docs, **how))
    near = near_pairs(words)
    # the smallest of equal n: max_by over n alone would leave ties open, so n comes first and then the reverse order of words
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("o"))).alias("b"))
    out = words.join(best, "word", "left")
    strong = -F.col("b.m") >= ratio * F.col("n")
    out = cut(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("b.o")).alias("form"), F.when(strong, -F.col("b.m")).alias("form_n")))
    last = followed(out.filter("form IS NOT NULL").select(F.col("word").alias("old"), F.col("form").alias("new")))
    found = out.join(last.select(F.col("old").alias("word"), F.col("new").alias("_root")), "word", "left")
    return found.select("word", "n", "n_near", "form", "form_n", F.coalesce("_root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spelling_variants`` over ``documents``; nulls, ties and odd rows as there."""
    return spelling_variants(table(spark, sf_dir, "documents"))
