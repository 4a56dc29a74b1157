"""Exact candidate pairs of near copies by prefixes of their shingle sets.

All sets are ordered alike, rare shingles first. Two sets of Jaccard t or more share a shingle among the first ones of
both: among |x| - ceil(t |x|) + 1 of the larger one and |x| - ceil(2 t |x| / (1 + t)) + 1 of the smaller one. Any order gives
every pair; which shingles count as frequent (text that many documents share) only decides how few others come with them.
A sketch of each set, whether it has an odd number of shingles in each of 512 classes, bounds from below in how many shingles
two sets differ, so that most pairs that are too far apart are never proposed (sets of up to about a thousand shingles).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import join_skewed
from ..functions.storage import Scratch


def probes(size: int, t: float) -> int:
    """How many first shingles of a set can be the first that it shares with a smaller or equal one."""
    return size - math.ceil(t * size - 1e-9) + 1


def indexed(size: int, t: float) -> int:
    """The same with a larger or equal one."""
    return size - math.ceil(2 * t / (1 + t) * size - 1e-9) + 1


SKETCH = [f"p{k}" for k in range(8)]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Eight words of 64 bits: which classes of the (distinct) shingles have an odd number of them."""
    odd = np.bincount((shingles & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def frequent_shingles(counts: DataFrame, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent shingles, sorted, and the logarithm of their number; ``counts``: array of shingle, number, shingle, ...

    A bounded table, as only an order of shingles comes of it.
    """
    pairs = F.transform(F.sequence(F.lit(0), F.size("frequent") - 2, F.lit(2)), lambda k: F.struct(F.element_at("frequent", k + 1).alias("h"), F.element_at("frequent", k + 2).alias("n")))
    each = counts.filter(F.size("frequent") > 1).select(F.explode(pairs).alias("p")).groupBy("p.h").agg(F.sum("p.n").alias("n"))
    top = each.orderBy(F.desc("n"), "h").limit(most).toArrow()
    hashes, number = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], np.log2(number[order].astype(float)).astype(np.int64) + 1


def ordered(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Distinct shingles, rare ones first; ties by value."""
    hashes, weight = frequent
    if not len(hashes):
        return np.sort(shingles)
    at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
    return shingles[np.lexsort((shingles, np.where(hashes[at] == shingles, weight[at], 0)))]


def first_shingles(texts: DataFrame, shingles_of, node_of, frequent: tuple[np.ndarray, np.ndarray], t: float) -> DataFrame:
    """key (shingle), node, size, pos of the first shingles of each row's set (column text, binary), empty sets left out.

    ``shingles_of``: text -> distinct shingles, sorted; ``node_of``: their digest.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    names = ["key", "node", "size", "pos"]

    def run(batches):
        for batch in batches:
            out, seen = [], set()
            for text in batch.column(0).to_pylist():
                shingles = shingles_of(text or b"")
                node = node_of(shingles)
                if not len(shingles) or node in seen:
                    continue
                seen.add(node)
                first = ordered(shingles, shared.value)[: probes(len(shingles), t)]
                k = len(first)
                out.append((first.view(np.int64), np.full(k, node, np.uint64).view(np.int64), np.full(k, len(shingles), np.int64), np.arange(k)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return texts.mapInArrow(run, "key long, node long, size long, pos long")


def _shared(batches):
    """Rows key, node, ... sorted by both in; each node of a key once, and only of keys that two nodes have."""
    last, told = None, False  # the last row, and whether it has come out
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        if not len(rows):
            continue
        rows = rows if last is None else np.concatenate([last, rows])
        rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))]
        same = rows[1:, 0] == rows[:-1, 0]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        out = keep.copy()
        out[0] &= not told  # the row that was carried here
        last, told = rows[-1:], bool(keep[-1]) or (told and len(rows) == 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows[out].T], names=batch.schema.names)


def cross_pairs(rows: np.ndarray, t: float, block: int = 32):
    """Pairs of rows (key, node, size, pos, root, sketch) of one key whose roots differ and whose sets may share enough.

    As far as the shingles behind the key and the classes that are odd in one set only tell (sketch: any number of words).
    Yields a, b (nodes, a < b) and the largest possible share, in blocks of rows.
    """
    size, pos, root = rows[:, 2], rows[:, 3], rows[:, 4]
    index = np.flatnonzero(pos < size - np.ceil(2 * t / (1 + t) * size - 1e-9) + 1)
    order = np.argsort(size, kind="stable")
    for at in range(0, len(index), block):
        x = index[at : at + block]
        # partners: as large or larger, as far as t allows
        y = order[np.searchsorted(size[order], size[x].min(), "left") : np.searchsorted(size[order], size[x].max() / t + 1e-9, "right")]
        sx, sy = size[x][:, None], size[y][None, :]
        need = np.ceil(t / (1 + t) * (sx + sy) - 1e-9)
        most = np.minimum(sx - pos[x][:, None], sy - pos[y][None, :])
        ok = (sx <= sy) & (sx >= t * sy - 1e-9) & (most >= need) & (root[x][:, None] != root[y][None, :])
        i, j = np.nonzero(ok)
        if len(i) and rows.shape[1] > 5:
            odd = rows[:, 5:].view(np.uint64)
            differ = np.bitwise_count(odd[x[i]] ^ odd[y[j]]).sum(1, dtype=np.int64)
            near = differ <= (sx + sy - 2 * need)[i, j]
            i, j = i[near], j[near]
        if len(i):
            a, b = rows[x[i], 1], rows[y[j], 1]
            share = (1000 * most[i, j] / (sx + sy - most)[i, j]).astype(np.int64)
            yield np.minimum(a, b), np.maximum(a, b), share


def _pairs(t: float):
    names = ["a", "b", "share"]

    def run(batches):
        rest, found, held = None, [], 0

        def of(group):
            nonlocal held
            if len(group) > 1 and (group[:, 4] != group[0, 4]).any():
                for a, b, share in cross_pairs(group, t):
                    found.append(np.stack([a, b, share], 1))
                    held += len(a)
                    if held > 1 << 18:  # within a key too, as unlike sets of one key can propose many
                        yield out()

        def out():
            nonlocal held
            rows = np.concatenate(found)
            rows = rows[np.lexsort((-rows[:, 2], rows[:, 1], rows[:, 0]))]
            new = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))
            found.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows[new].T], names=names)

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            rest = rows if rest is None else np.concatenate([rest, rows])
            if not len(rest):
                continue
            ends = np.flatnonzero(rest[1:, 0] != rest[:-1, 0]) + 1
            for a, b in zip([0, *ends[:-1]], ends, strict=False):
                yield from of(rest[a:b])
            rest = rest[ends[-1] :] if len(ends) else rest
        if rest is not None and len(rest):
            yield from of(rest)
        if held:
            yield out()

    return run


def candidates(first: DataFrame, roots: DataFrame, t: float, scratch: Scratch, block: int = 8192, sketches: DataFrame | None = None) -> DataFrame:
    """Pairs a, b, share of nodes with unlike roots (``roots``: node, root; others stand alone) that may have Jaccard ``t``.

    ``first``: rows of ``first_shingles``. A shingle whose sets are all connected has nothing to propose, and one of many
    sets is dealt to pairs of blocks, so that no task holds it whole. ``sketches``: node and its ``parities`` as p0, p1, ...,
    which join only the rows of shingles that have something to propose.
    """
    met = first.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, first.schema)
    rows = scratch.put("first", met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed = rows.groupBy("key").agg(F.count("*").alias("_n"), F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select("key", "_n")
    met = join_skewed(rows, scratch.put("mixed", mixed), ["key"], "_n", "node")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks)
    pair = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(mine, k).alias("i"), F.greatest(mine, k).alias("j"))))
    dealt = met.withColumn("_pair", pair).withColumn("key", F.when(F.col("_n") > block, F.xxhash64("key", "_pair.i", "_pair.j")).otherwise(F.col("key")))
    cols = ["key", "node", "size", "pos", "root"]
    if sketches is not None:
        dealt, cols = dealt.join(sketches, "node"), [*cols, *SKETCH]
    found = dealt.select(cols).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_pairs(t), "a long, b long, share long")
    return found.groupBy("a", "b").agg(F.max("share").alias("share"))
