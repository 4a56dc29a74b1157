"""Toxicity from a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps look-alike letters, digits and signs to the letters they stand for, one character to one. The
lexicon, its weights and the exception phrases (harmless uses of its words, with the word before or behind)
come from labelled documents; phrases are patterns of the same automaton that void the matches inside them. Weights are summed, normalised by length and mapped
to a probability by a logistic curve.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .quality_crf import _logistic, class_weights, sample_ids

#: Characters read as others, in pairs.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l"}
_FROM = "".join([*LOOKALIKES, *(chr(0xFF21 + k) for k in range(26)), *(chr(0xFF41 + k) for k in range(26))])
_TO = "".join([*LOOKALIKES.values(), *(chr(97 + k % 26) for k in range(52))])
_TABLE = str.maketrans(_FROM, _TO)
_WORD = re.compile(rf"(?:[^\W_]|[{re.escape(''.join(c for c in LOOKALIKES if not c.isalnum()))}])+")


def fold(text: str) -> str:
    """Lower case, look-alikes replaced; the text keeps its length unless lower-casing changes it."""
    return text.lower().translate(_TABLE)


def _joined(text: str, at: int, step: int) -> bool:
    """Does the word that ends before ``at`` (``step`` 1) or begins behind it (-1) go on there?

    A letter or digit goes on; a sign that is read as a letter does if a letter or digit follows the run of signs.
    """
    while 0 <= at < len(text) and not text[at].isalnum() and text[at] in LOOKALIKES:
        at += step
    return 0 <= at < len(text) and text[at].isalnum()


def words_in(text: str) -> list[tuple[int, int]]:
    """Spans of the words of a text: letters, digits, and between them signs that are read as letters."""
    found = []
    for m in _WORD.finditer(text):
        a, b = m.span()
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            found.append((a, b))
    return found


class Lexicon:
    """Weighted words, exceptions and the curve from (sum, density, distinct) to a probability."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), curve: np.ndarray | None = None):
        self.weights, self.exceptions, self.curve, self._auto = weights, tuple(fold(x) for x in exceptions), curve, None

    def __getstate__(self):
        return {**self.__dict__, "_auto": None}

    def automaton(self):
        import ahocorasick

        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for word, weight in self.weights.items():
                self._auto.add_word(word, (len(word), weight, word))
            for phrase in self.exceptions:
                self._auto.add_word(phrase, (len(phrase), None, phrase))
            self._auto.make_automaton()
        return self._auto

    def matches(self, text: str) -> list[tuple[int, int, str, float]]:
        """Spans (start, end, word, weight) in the folded text that stand as words and in no exception phrase."""
        found, voided = [], []
        if not self.weights:
            return found
        text = text.lower()
        for last, (n, weight, word) in self.automaton().iter(text.translate(_TABLE)):
            start, end = last - n + 1, last + 1
            if not _joined(text, start - 1, -1) and not _joined(text, end, 1):
                (voided if weight is None else found).append((start, end, word, weight))
        if not voided:
            return found
        voided.sort()
        starts, reach = [v[0] for v in voided], list(accumulate((v[1] for v in voided), max))
        return [m for m in found if not (k := bisect_right(starts, m[0])) or reach[k - 1] < m[1]]

    def features(self, text: str) -> tuple[float, float, float]:
        found = self.matches(text)
        total = sum(m[3] for m in found)
        words = len(text.split())
        return math.log1p(max(0.0, total)), 100 * total / (words + 20), float(len({m[2] for m in found}))

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return 0.0
        z = float(self.curve @ np.array([1.0, *self.features(text or "")]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _counts(rows: DataFrame, find) -> DataFrame:
    """word, toxic, clean: in how many documents of either label ``find`` (text -> set of words) finds it."""

    def run(batches):
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(find(text.lower()))
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(found, pa.string())], names=["label", "word"])

    return rows.select("label", "text").mapInArrow(run, "label int, word string").groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def train(docs: DataFrame, labels: DataFrame, most: int = 5000, words: int = 500, support: int = 3) -> Lexicon:
    """Learn at most ``words`` weighted words from at most ``most`` documents of either class, crc32 remainder by 5 not 0.

    A word's weight is its smoothed log odds between toxic and other documents; words need ``support`` toxic
    documents and a lower confidence bound of the log odds above 1. Exceptions are such words with the word before
    or behind that ``support`` other documents hold and whose upper bound is below 0, at most ``words`` of them. Without
    toxic documents all score 0.
    """
    ids = sample_ids(labels, "toxic", crc_mod(F.col("doc_id"), 5) != 0, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").join(F.broadcast(ids), "doc_id").select("label", "text", "of")
    n = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon({}, curve=None)
    odds = F.log((F.col("toxic") + 0.5) / (n[1] - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (n[0] - F.col("clean") + 0.5))
    error = 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    seen = _counts(rows, lambda text: {text[a:b].translate(_TABLE) for a, b in words_in(text)})
    top = seen.filter(F.col("toxic") >= support).select("word", (odds - error).alias("low")).filter("low > 1").orderBy(F.desc("low"), "word").limit(words).collect()
    weights = {r["word"]: float(r["low"]) for r in top}

    def uses(text: str) -> set[str]:
        spans = words_in(text)
        folded = text.translate(_TABLE)
        own = [k for k, (a, b) in enumerate(spans) if folded[a:b] in weights]
        return {folded[spans[k][0] : spans[k + 1][1]] for i in own for k in (i - 1, i) if 0 <= k < len(spans) - 1}

    harmless = _counts(rows, uses).filter(F.col("clean") >= support).select("word", (odds + error).alias("high")).filter("high < 0").orderBy("high", "word").limit(words)
    lexicon = Lexicon(weights, tuple(r["word"] for r in harmless.collect()))

    def features(batches):
        for batch in batches:
            x = np.array([lexicon.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in x.T), batch.column(2)], names=["label", "a", "b", "c", "of"])

    got = rows.mapInArrow(features, "label int, a double, b double, c double, of long").toPandas().to_numpy(float)
    if not len(got):
        return Lexicon({}, curve=None)
    lexicon.curve = _logistic(np.concatenate([np.ones((len(got), 1)), got[:, 1:4]], 1), got[:, 0], weight=class_weights(got[:, 0], got[:, 4]))
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of every row.

    Null texts are scored as empty ones; whole texts are read, in time linear in their length and matches. Null
    ids, repeated rows and ties are scored alike; other columns take no part, whatever their names; an empty
    table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.score(t) for t in texts], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``toxicity`` of ``documents``, learnt from ``labels`` not held out; nulls, ties and odd rows as there."""
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
