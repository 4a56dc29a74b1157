"""Packing of tokenized documents into fixed windows by non-negative least squares on the histogram of lengths.

A document's full windows are sequences of their own. The rests are dealt to shards; in each, lengths are counted
in units, every shallow combination of lengths that fills the window is a column of a matrix, and non-negative
least squares finds how often to repeat each so that the histogram is used up. Rounded counts are realised with
the documents there are, what is left over is packed greedily (best fit, longest first), and the gaps of all
sequences are filled by cutting up a small share of the documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: How byte-level BPE cuts a text into pieces, each of which is merged for itself (a fixed value of the format).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokens:
    """Token ids of texts as bytes of unsigned 32-bit numbers, by the vocabulary of a byte-level BPE file of the tokenizers library.

    Ids stand in the order of the merges, so the vocabulary is all that is needed. tiktoken merges by it several times as
    fast as the library itself does and gives the same ids; special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes are written as themselves
        letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
        special = {t.content for t in own.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in token): k for token, k in own.get_vocab().items() if token not in special}
        self.merges = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        return np.array(self.merges.encode_ordinary(text), "<u4").tobytes()


@lru_cache(1)
def _tokens(path: str) -> Tokens:
    """One per Python worker, which Spark uses for many tasks."""
    return Tokens(path)


def tokenized(docs: DataFrame, path: str, window: int, end_id: int, spare: int, with_ids: bool) -> DataFrame:
    """Full windows and rests of each row's ids (those of its text, then ``end_id``): doc_id, start, length, ids_crc32,
    doc_tokens, spare (the rest of about one row in ``spare``, which may be cut) and ids (of these, or of all)."""

    def run(batches):
        tokens = _tokens(path)
        for batch in batches:
            out, size = [], 0
            for doc, text, fills in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = tokens.of(text) + end_id.to_bytes(4, "little")
                n = len(ids) // 4
                for start in range(0, n, window):
                    own = ids[4 * start : 4 * min(n, start + window)]
                    free = fills and len(own) < 4 * window
                    out.append((doc, start, len(own) // 4, zlib.crc32(own), n, free, own if free or with_ids else None))
                size += n
                if size > 1 << 20:
                    yield _batch(out, _TOKENIZED)
                    out, size = [], 0
            if out:
                yield _batch(out, _TOKENIZED)

    fills = F.pmod(F.xxhash64(F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)), F.length(docs["text"])), F.lit(spare)) == 0
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), F.coalesce(fills, F.lit(False)).alias("fills"))
    return rows.mapInArrow(run, _PIECE + ", spare boolean, ids binary")


_TOKENIZED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("spare", pa.bool_()), ("ids", pa.binary())])
_PACKED = pa.schema([*list(_TOKENIZED)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def combinations(units: int) -> np.ndarray:
    """Columns of counts of lengths 1 to ``units`` that fill the window: up to three lengths, or one repeated and what it leaves."""
    found = {(units,)}
    for a in range(1, units + 1):
        found.update(tuple(sorted(x for x in (a, b, units - a - b) if x)) for b in range(a, units - a + 1))
        found.update(tuple(sorted([a] * m + [units - m * a] * (m * a < units))) for m in range(2, units // a + 1))
    out = np.zeros((units, len(found)))
    for k, combination in enumerate(sorted(found)):
        for length in combination:
            out[length - 1, k] += 1
    return out


@lru_cache(4)
def _problem(units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The combinations, the same with each length weighted by its tokens, and the weighted normal matrix."""
    columns = combinations(units)
    weighted = columns * np.arange(1, units + 1)[:, None]
    return columns, weighted, weighted.T @ weighted


def nonnegative_least_squares(gram: np.ndarray, target: np.ndarray, most: int | None = None) -> np.ndarray:
    """x >= 0 with least |A x - b|, given A'A and A'b: the active-set method of Lawson and Hanson."""
    n = len(target)
    x, free, stuck = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, np.abs(target).max(initial=0.0))
    for _ in range(most or 3 * n):
        gain = np.where(free | stuck, -np.inf, target - gram @ x)
        best = int(gain.argmax())
        if gain[best] <= slack:
            break
        free[best] = True
        while len(at := np.flatnonzero(free)):
            own = gram[np.ix_(at, at)]
            s = np.linalg.solve(own + np.eye(len(at)) * (1e-12 * own.trace() / len(at)), target[at])
            if (low := s <= 0).any():
                step = (x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)).min()
                x[at] += step * (s - x[at])
                out = at[low & (x[at] <= 1e-12)]
                x[out], free[out] = 0.0, False
                continue
            x[at] = s
            break
        # a column that rounding keeps out waits until another one has come in
        stuck[:] = stuck & ~free[best]
        stuck[best] = not free[best]
    return x


def pack_lengths(lengths: np.ndarray, window: int, units: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sequence and offset of each length (1 to ``window``), and the tokens in each sequence."""
    unit = -(-window // units)
    cell = -(-lengths // unit)
    columns, weighted, gram = _problem(-(-window // unit))
    histogram = np.bincount(cell, minlength=len(columns) + 1)[1:]
    repeats = np.rint(nonnegative_least_squares(gram, weighted.T @ (histogram * np.arange(1, len(columns) + 1)))).astype(np.int64)
    order = np.argsort(lengths, kind="stable")
    stacks = [s.tolist() for s in np.split(order, np.cumsum(histogram)[:-1])]  # items of each cell, the longest last
    sequence, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []

    def put(item: int, s: int) -> None:
        sequence[item], offset[item] = s, used[s]
        used[s] += int(lengths[item])

    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] <= 0:
            break
        need = [(int(c), int(columns[c, k])) for c in np.flatnonzero(columns[:, k])]
        for _ in range(min(int(repeats[k]), *(len(stacks[c]) // m for c, m in need))):
            used.append(0)
            for c, m in need:
                for _ in range(m):
                    put(stacks[c].pop(), len(used) - 1)
    room = sorted((window - n, s) for s, n in enumerate(used) if n < window)
    for item in (i for stack in reversed(stacks) for i in reversed(stack)):  # the rest, longest first, where it fits best
        at = bisect_left(room, (int(lengths[item]), -1))
        if at < len(room):
            left, s = room.pop(at)
        else:
            left, s = window, len(used)
            used.append(0)
        put(item, s)
        if left > lengths[item]:
            insort(room, (left - int(lengths[item]), s))
    return sequence, offset, used


def fill_up(spare: list[int], used: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, from, to, sequence, offset) of the ``spare`` lengths: first in the gaps of ``used``, which grows, then in
    sequences of their own. The last tokens go to sequences whose lengths are powers of two, which need no padding."""
    out, item, at = [], 0, 0

    def take(n: int, s: int) -> None:
        nonlocal item, at
        while n and item < len(spare):
            m = min(n, spare[item] - at)
            out.append((item, at, at + m, s, used[s]))
            used[s] += m
            n, at = n - m, at + m
            if at == spare[item]:
                item, at = item + 1, 0

    for s in range(len(used)):
        if used[s] & (used[s] - 1):  # a power of two is complete
            take(window - used[s], s)
    rest = sum(spare[item:]) - at
    sizes = [window] * (rest // window) + [1 << b for b in range((rest % window).bit_length()) if rest % window >> b & 1]
    for n in sizes:
        used.append(0)
        take(n, len(used) - 1)
    return out


def pack_tokens(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, units: int = 128, shard_rows: int = 20_000, spare: int = 16, with_ids: bool = False) -> DataFrame:
    """Pack the tokens of ``docs`` (doc_id, text) into sequences of at most ``window``: a row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the piece's ids
    (little-endian unsigned 32-bit). ``path``: a file of the tokenizers library; every document ends in ``end_id``. Lengths are counted in
    ``units`` a window; a shard has about ``shard_rows`` rests. One row in about ``spare`` may be cut to fill gaps; only
    its ids travel (all with ``with_ids``). Null and empty texts have one token. Rows with null ids, equal ids or equal
    texts are packed each; texts of any length are read whole; ties in length go in order of the rows. Other columns
    take no part, whatever their names; an empty table gives an empty result.
    """
    pieces = cut(tokenized(docs, path, window, end_id, spare, with_ids).withColumn("piece", F.monotonically_increasing_id()))
    whole = pieces.filter(F.col("length") == window).withColumn("sequence_id", F.col("piece") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    rests = pieces.filter(F.col("length") < window)
    shards = max(1, -(-rests.count() // shard_rows))
    names = _PACKED.names

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("piece")
        cuttable = np.array(rows["spare"].to_pylist(), bool)
        fixed, free = rows.filter(pa.array(~cuttable)), rows.filter(pa.array(cuttable)).to_pylist()
        sequence, offset, used = pack_lengths(fixed["length"].to_numpy(), window, units)
        first = key[0].as_py() << 32
        kept = {n: fixed[n] for n in names if n in fixed.column_names} | {"sequence_id": pa.array((first + sequence) * 2), "offset": pa.array(offset)}
        if not with_ids:
            kept["ids"] = pa.nulls(len(fixed), pa.binary())
        cuts = []
        for item, a, b, s, at in fill_up([r["length"] for r in free], used, window):
            r = free[item]
            own = r["ids"][4 * a : 4 * b]
            cuts.append((r["doc_id"], r["start"] + a, b - a, zlib.crc32(own), r["doc_tokens"], (first + s) * 2, at, own if with_ids else None))
        parts = [pa.table([kept[n] for n in names], schema=_PACKED)] + ([pa.Table.from_batches([_batch(cuts, _PACKED)])] if cuts else [])
        return pa.concat_tables(parts)

    packed = rests.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards))).groupBy("shard").applyInArrow(pack, _PIECE + ", sequence_id long, offset long, ids binary")
    return packed.unionByName(whole.select(*names)).select(*(names if with_ids else names[:-1]))


def op11_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack_tokens`` over ``documents`` with the public byte-level vocabulary; nulls, ties and odd rows as there."""
    import public_tokenizers

    return pack_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
