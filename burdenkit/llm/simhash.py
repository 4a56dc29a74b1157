"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every fingerprint emits its ball of half the radius: the bits under a mask, and these with any one bit
flipped. Two fingerprints that differ there in at most two bits share a variant, meet in the task that owns
it, and are verified. ``simhash_components`` (radius 3) uses three masks that each leave out a third of the
64 bits: of three differing bits at most two are left under some mask, so no link is lost with 131 variants
where whole balls of one and two flips would be 2081. ``near_copies`` decides by Jaccard on word shingles;
it has as many masks as its recall asks for, on 192-bit fingerprints of the distinct shingles.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import Scratch
from ..operators.graph import components
from .common import any_names, cut, join_skewed, table, unused
from .prefixes import SKETCH, candidates, first_shingles, frequent_shingles, parities

_SALTS = np.random.default_rng(0).integers(0, 1 << 63, 64, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (multiply and xor-shift, wrapping)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; fewer words: of the whole sequence; none: empty."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    h, view = xxhash.xxh64_intdigest, memoryview(line)
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((h(view[a:b], 42) for a, b in spans), np.uint64, len(parts) - words + 1)


def fingerprint(hashes: np.ndarray, width: int = 1) -> list[int]:
    """``width`` 64-bit words: a bit is 1 if it is set in over half the hashes (word 2 on: of rehashes)."""
    out = []
    for k in range(width):
        h = hashes if not k else _mix(hashes ^ _SALTS[k])
        count = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 15):
            part = h[at : at + (1 << 15)].astype("<u8")
            count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0]))
    return out


def _words(width: int) -> list[str]:
    return [f"f{k}" for k in range(width)]


def fingerprints(docs: DataFrame, words: int, width: int = 1) -> DataFrame:
    """doc_id and the fingerprint's words f0, f1, ... (as signed longs) of each row."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(shingle_hashes(t or b"", words), width) for t in batch.column(1).to_pylist()]
            cols = np.array(found, np.uint64).reshape(-1, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in cols.T)], names=["doc_id", *_words(width)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _words(width)))


def masks_leaving_out(radius: int, bits: int = 64) -> list[list[int]]:
    """Masks for which no pair within ``radius`` is lost: each leaves out one of ``radius`` stripes of bits."""
    if radius > 3:
        raise ValueError("leaving out one stripe is exact up to radius 3")
    return [[b for b in range(bits) if b % 3 != k] for k in range(3)]


def masks_for(similarity: float, recall: float, nodes: int, width: int = 3, seed: int = 42) -> tuple[list[list[int]], int]:
    """Random masks with which a pair of Jaccard ``similarity`` meets with probability ``recall``, and a radius of all bits.

    A bit differs with probability arccos(cosine) / pi; of the number of bits that differ follows how likely at most
    two of them lie under a mask. Masks get longer with the logarithm of the number of fingerprints, so that
    unlike ones meet by chance equally rarely in tables of all sizes. The radius, 2.5 deviations above the mean
    distance of such a pair, keeps unlike ones from being verified; pairs beyond it count as missed.
    """
    size, bits = max(26, math.ceil(math.log2(max(nodes, 1))) + 9), 64 * width
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    apart = [math.comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in range(bits + 1)]
    missed = [1 - sum(math.comb(d, k) * math.comb(bits - d, size - k) for k in range(3)) / math.comb(bits, size) for d in range(bits + 1)]
    radius, count = math.floor(bits * p + 2.5 * math.sqrt(bits * p * (1 - p))), 1
    while sum(a * (m**count if d <= radius else 1) for d, (a, m) in enumerate(zip(apart, missed, strict=True))) > 1 - recall:
        count += 1
    rng = np.random.default_rng(seed)
    masks = [np.sort(rng.choice(bits, size, replace=False)).tolist() for _ in range(count)]
    return masks, radius


def _emit(masks: list[list[int]], span: int, first: int = 0):
    """number and fingerprint words in; key and number out, a row for each variant of each mask; masks have up to ``span`` bits and are numbered from ``first``."""
    place = [np.int64(1) << np.arange(len(m), dtype=np.int64) for m in masks]
    flips = [np.concatenate((np.zeros(1, np.int64), p)) for p in place]

    def run(batches):
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            for at in range(0, len(rows), 1024):
                part = rows[at : at + 1024]
                bits = np.unpackbits(np.ascontiguousarray(part[:, 1:]).view(np.uint8), axis=1, bitorder="little")
                cells = [(bits[:, m] @ p)[:, None] ^ f for m, p, f in zip(masks, place, flips, strict=True)]
                key = np.concatenate([(k << span) + c for k, c in enumerate(cells, first)], 1)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.repeat(part[:, 0], key.shape[1]))], names=["key", "number"])

    return run


def _shared(batches):
    """Rows key, number sorted by key in; those whose key another row has out."""
    last, known = None, False  # the last row so far, and whether it has come out
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        if not len(rows):
            continue
        like = np.concatenate(([False], rows[1:, 0] == rows[:-1, 0]))  # like the row before
        keep = like.copy()
        keep[:-1] |= like[1:]
        if last is not None and last[0] == rows[0, 0]:
            keep[0] = True
            if not known:
                rows, keep = np.concatenate([last[None], rows]), np.concatenate(([True], keep))
        last, known = rows[-1], keep[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows[keep].T], names=["key", "number"])


def _runs(batches, most: int | None = None):
    """Rows of longs sorted by their first column -> rows, starts, ends and which runs of a key are parts of a long one.

    Without ``most`` every run is a whole key; else runs have ``most`` rows or fewer and parts share a row.
    """
    rest, going = None, None

    def split(rows: np.ndarray, more: bool):
        change = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
        starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(rows)]))
        long = np.zeros(len(starts), bool)
        if most is None:
            return rows, starts, ends, long
        long = (ends - starts > most) | (rows[starts, 0] == going if going is not None else False)
        long[-1] |= more
        parts = [(a, b, x) if b - a <= most else (k, min(k + most, b), True) for a, b, x in zip(starts.tolist(), ends.tolist(), long.tolist(), strict=True) for k in range(a, max(a + 1, b - 1), most - 1)]
        return rows, *(np.array(c) for c in zip(*parts, strict=True))

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        rest = rows if rest is None else np.concatenate([rest, rows])
        change = np.flatnonzero(rest[1:, 0] != rest[:-1, 0])
        if len(change):  # the last key may go on in the next batch
            at = change[-1] + 1
            yield split(rest[:at], False)
            rest, going = rest[at:], None
        if most is not None and len(rest) > 4 * most:
            yield split(rest, True)
            rest, going = rest[-1:], rest[0, 0]
    if rest is not None and len(rest):
        yield split(rest, False)


def _forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which fingerprints have another within the radius, each one's parent in a minimum spanning forest (Prim; -1: root) and its distance.

    Its trees are exactly the components of all links within the radius, in one row of distances at a time.
    """
    n = len(prints)
    best, parent, left, partner = np.full(n, 1000), np.full(n, -1), np.ones(n, bool), np.zeros(n, bool)
    at = 0
    for _ in range(n):
        left[at] = False
        distance = np.bitwise_count(prints ^ prints[at]).sum(1)
        partner[at] = (distance <= radius).sum() > 1
        closer = left & (distance <= radius) & (distance < best)
        best[closer], parent[closer] = distance[closer], at
        at = int(np.where(left, best, 10_000).argmin())
    return partner, parent, best


def _meet(width: int, radius: int, most: int):
    """Rows key, node and words sorted by key in; those with a partner within the radius out.

    ``parent`` is the node that a forest of the key's rows links them to at distance ``apart``, null at its roots;
    ``long`` marks the rows of keys that were taken in parts, which come out all.
    """
    names = ["key", "node", *_words(width), "parent", "apart", "long"]

    def run(batches):
        for rows, starts, ends, long in _runs(batches, most):
            size, out = ends - starts, []
            two = np.flatnonzero((size == 2) & ~long)
            a, b = rows[starts[two]], rows[starts[two] + 1]
            apart = np.bitwise_count(a[:, 2:].view(np.uint64) ^ b[:, 2:].view(np.uint64)).sum(1)
            near = apart <= radius
            out.append((a[near], np.zeros(near.sum(), np.int64), np.ones(near.sum(), bool), apart[near], False))
            out.append((b[near], a[near, 1], np.zeros(near.sum(), bool), apart[near], False))
            for k in np.flatnonzero((size > 2) | long):
                g = rows[starts[k] : ends[k]]
                partner, parent, apart = _forest(np.ascontiguousarray(g[:, 2:]).view(np.uint64), radius)
                if (keep := partner | long[k]).any():
                    out.append((g[keep], np.where(parent >= 0, g[parent, 1], 0)[keep], parent[keep] < 0, apart[keep], bool(long[k])))
            if sum(len(x[0]) for x in out):
                g, parent, root, apart = (np.concatenate([x[k] for x in out]) for k in range(4))
                many = np.repeat([x[4] for x in out], [len(x[0]) for x in out])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in g.T), pa.array(parent, pa.int64(), mask=root), pa.array(apart.astype(np.int32)), pa.array(many)], names=names)

    return run


def _nearest_outside(radius: int, tries: int, most: int = 1 << 18):
    """Rows key, node, root and words sorted by key in; node, other and their distance out, within the radius and in unlike roots.

    Every node but those of a key's largest piece gives its ``tries`` nearest: their number is linear in the rows.
    """

    def pairs(found: list[np.ndarray]):
        out = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], names=["node", "other", "apart"])

    def run(batches):
        found, size = [], 0
        for rows, starts, ends, _ in _runs(batches):
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                node, root, prints = rows[a:b, 1], rows[a:b, 2], np.ascontiguousarray(rows[a:b, 3:]).view(np.uint64)
                _, piece, count = np.unique(root, return_inverse=True, return_counts=True)
                for i in np.flatnonzero(piece != count.argmax()):
                    distance = np.where(piece != piece[i], np.bitwise_count(prints ^ prints[i]).sum(1), 1000)
                    near = np.argsort(distance, kind="stable")[:tries]
                    near = near[distance[near] <= radius]
                    if len(near):
                        found.append(np.stack([np.full(len(near), node[i]), node[near], distance[near].astype(np.int64)], 1))
                        size += len(near)
                if size >= most:
                    yield pairs(found)
                    found, size = [], 0
        if found:
            yield pairs(found)

    return run


def _named(width: int) -> str:
    return ", ".join(f"{c} long" for c in ["key", "node", *_words(width)])


def meetings(nodes: DataFrame, masks: list[list[int]], radius: int, width: int, most: int = 512, scratch: Scratch | None = None, at_once: int = 4) -> DataFrame:
    """Of ``nodes`` (node, f0, ...; distinct): the rows of all variants that meet others, see ``_meet``.

    Variants travel with the node's number alone; fingerprints join those that two nodes or more share. A forest takes in ``most`` rows of a variant; a longer one goes on in pieces that share a row.
    The variants of ``at_once`` masks are shuffled together, and those of earlier ones are gone by then: only what nodes share is kept. With ``scratch`` the result
    is its table met, which can be dropped, instead of a checkpoint.
    """
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() // 50_000)
    # numbers of nodes, written once, are short where digests don't compress
    named = cut(nodes.repartition(parts, "node").withColumn("number", F.monotonically_increasing_id()))
    own, parts = scratch or Scratch(nodes.sparkSession), []
    for k in range(0, len(masks), at_once):
        variants = named.select("number", *_words(width)).mapInArrow(_emit(masks[k : k + at_once], max(map(len, masks)), k), "key long, number long")
        shared = variants.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, number long")
        parts.append(own.put(f"shared{k}", shared) if len(masks) > at_once else shared)
    shared = reduce(DataFrame.union, parts).join(named, "number")
    met = shared.select("key", "node", *_words(width)).repartition("key").sortWithinPartitions("key", *_words(width))
    met = met.mapInArrow(_meet(width, radius, most), _named(width) + ", parent long, apart int, long boolean")
    met = scratch.put("met", met) if scratch else cut(met)
    own.drop(*[f"shared{k}" for k in range(0, len(masks), at_once)])
    return met


def forest_links(met: DataFrame) -> DataFrame:
    """The links a, b of the forests."""
    return met.filter("parent IS NOT NULL").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b")).distinct()


def links_between(met: DataFrame, roots: DataFrame, tested: DataFrame, radius: int, width: int, tries: int = 4, block: int = 8192) -> DataFrame:
    """Pairs a, b not ``tested`` that meet within the radius and whose pieces (``roots``: node, root) differ: ``tries`` a node, the nearest.

    Variants whose rows are all connected (every large group of true copies) end here. Rows of long variants
    are dealt to pairs of blocks of about ``block`` rows, so that no task holds one whole.
    """
    cols = ["key", "node", "root", *_words(width)]
    pieces = met.select("key", "node", *_words(width), "long").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    long = pieces.filter("long").select(cols).distinct()
    size = long.groupBy("key").agg(F.count("*").alias("_n"))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks)
    pair = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(mine, k).alias("i"), F.greatest(mine, k).alias("j"))))
    dealt = long.join(size, "key").withColumn("_pair", pair).withColumn("key", F.xxhash64("key", "_pair.i", "_pair.j")).select(cols)
    rows = pieces.filter("NOT long").select(cols).union(dealt)
    found = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_nearest_outside(radius, tries), "node long, other long, apart long")
    a, b = F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
    # a pair meets under many variants: it becomes one row, with the ends that propose it, before it is compared with those tested
    pairs = found.groupBy(a, b).agg(F.min("apart").alias("apart"), F.collect_set("node").alias("by"))
    fresh = pairs.join(tested, ["a", "b"], "left_anti").select("apart", "a", "b", F.explode("by").alias("node"))
    best = fresh.withColumn("other", F.when(F.col("node") == F.col("a"), F.col("b")).otherwise(F.col("a"))).groupBy("node").agg(F.sort_array(F.collect_set(F.struct("apart", "other"))).alias("by"))
    return best.select("node", F.explode(F.slice("by.other", 1, tries)).alias("other")).select(a, b).distinct()


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links a, b of nodes: only the pieces that these touch are worked on."""
    new = links
    for end in ("a", "b"):
        new = new.join(roots.select(F.col("node").alias(end), F.col("root").alias("_root")), end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    moved = components(new).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    old = roots.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return old.unionByName(moved.select(F.col("root").alias("node"), F.col("_to").alias("root")).join(roots, "node", "left_anti"))


def rounds(met: DataFrame, roots: DataFrame, tested: DataFrame, verify, radius: int, width: int, least: float = 0.02, **how) -> DataFrame:
    """``roots`` after the links that ``verify`` lets pass of the nearest pairs between the pieces that they leave.

    As in Boruvka's forests, rounds go on until none has new pairs, or one in which ``least`` of the pairs or fewer pass:
    the next ones lie farther apart. Where all pairs within the radius are links, no connection is left out.
    """
    scratch = Scratch(met.sparkSession)
    while True:
        more = scratch.put("more", links_between(met, roots, tested, radius, width, **how))
        if more.isEmpty():
            return roots
        passed = scratch.put("passed", verify(more))
        roots, tested = scratch.put("roots", joined(roots, passed)), scratch.put("tested", tested.union(more))
        if passed.count() <= least * more.count():
            return roots


def connected(met: DataFrame, verify, scratch: Scratch, tries: int = 4) -> tuple[DataFrame, DataFrame]:
    """node, root by the links that ``verify`` lets pass of each node's ``tries`` nearest in all forests, and the links a, b tried."""
    nearest = met.filter("parent IS NOT NULL").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("apart", "parent"))).alias("by"))
    links = nearest.select("node", F.explode(F.slice("by.parent", 1, tries)).alias("other"))
    links = scratch.put("links", links.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    return scratch.put("roots", components(verify(links))), links


def _unlike(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` (a, b, share) with ra, rb, the roots of their ends, where these differ."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    return pairs.filter("ra <> rb")


def completed(roots: DataFrame, pairs: DataFrame, verify, scratch: Scratch, rounds: int = 2) -> DataFrame:
    """``roots`` after all links among ``pairs`` (a, b, share) that ``verify`` lets pass.

    First the likeliest pair between any two pieces is verified, for ``rounds`` rounds while some pass, so that large groups
    come together by few pairs; then every pair that still lies between two pieces. No pair is left out.
    """
    left = scratch.put("pairs", pairs)
    for k in range(rounds + 1):
        open_ = _unlike(left, roots)
        left = scratch.put("pairs", open_.select("a", "b", "share"))
        if left.isEmpty():
            return roots
        if k < rounds:
            low, high = F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high")
            best = _unlike(left, roots).groupBy(low, high).agg(F.max(F.struct("share", "a", "b")).alias("p")).select("p.a", "p.b")
            chosen = scratch.put("chosen", best)
            left = scratch.put("pairs", left.join(chosen, ["a", "b"], "left_anti"))
        else:
            chosen = left.select("a", "b")
        passed = scratch.put("passed", verify(chosen))
        if not passed.isEmpty():
            roots = scratch.put("roots", joined(roots, passed))
        elif k < rounds:  # nothing comes together: what is left is verified at once
            passed = scratch.put("passed", verify(left.select("a", "b")))
            return roots if passed.isEmpty() else scratch.put("roots", joined(roots, passed))
    return roots


def with_components(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (doc_id, node, ...) with component_id, the smallest doc_id of all rows whose nodes have one root (none: their own)."""
    each = rows.groupBy("node").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_rows"))
    named = cut(each.join(roots, "node", "left").withColumn("_root", F.coalesce("root", "node")).drop("root"))
    top = cut(named.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_nodes")))
    groups = cut(join_skewed(named, top, ["_root"], "_nodes", "node").select("node", "_rows", "component_id"))
    return join_skewed(rows, groups, ["node"], "_rows", "doc_id").drop("_rows")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    Fingerprints at ``radius`` (up to 3) or fewer differing bits are linked, equal ones too; component_id is
    the smallest doc_id reachable. Null and empty texts have fingerprint zero, linked like any other; texts of
    any length are read whole. Rows with a null id share their fingerprint's component, which is null only if it
    has no other id. Repeated rows come out repeatedly; ties cannot arise; other columns take no part, whatever
    their names; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, words).withColumn("node", F.col("f0")))
    met = meetings(prints.select("node", "f0").distinct(), masks_leaving_out(radius), radius, 1)
    links = cut(forest_links(met))
    roots = components(links)
    if not (long := met.filter("long")).isEmpty():
        roots = rounds(long, cut(roots), links, lambda x: x, radius, 1)
    out = with_components(prints, roots)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def _node_id(shingles: np.ndarray) -> int:
    """A document's identity for near copies: the digest of its distinct shingles, which come sorted."""
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), 7)


def _signatures(docs: DataFrame, words: int, width: int) -> DataFrame:
    """doc_id, node (digest of the distinct shingles), their fingerprint f0, f1, ... and parities p0, p1, ... of each row, and frequent.

    ``frequent``, at the last row of a batch, lists the shingles of three or more of its texts, each with their number.
    """

    def run(batches):
        for batch in batches:
            found, every = [], []
            for text in batch.column(1).to_pylist():
                shingles = np.unique(shingle_hashes(text or b"", words))
                found.append((_node_id(shingles), *fingerprint(shingles, width), *parities(shingles).tolist()))
                every.append(shingles)
            if not found:
                continue
            cols = np.array(found, np.uint64).view(np.int64)
            hashes, number = np.unique(np.concatenate(every), return_counts=True)
            often = np.stack([hashes[number > 2].view(np.int64), number[number > 2]], 1).reshape(-1)
            frequent = pa.array([None] * (len(found) - 1) + [often], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in cols.T), frequent], names=["doc_id", "node", *_words(width), *SKETCH, "frequent"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, node long, " + ", ".join(f"{c} long" for c in [*_words(width), *SKETCH]) + ", frequent array<long>")


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node and the sorted distinct shingles of each row's text."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or b"", words)) for t in batch.column(0).to_pylist()]
            nodes = np.array([_node_id(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, shingles array<long>")


def _alike(docs: DataFrame, nodes: DataFrame, links: DataFrame, words: int, similarity: float, scratch: Scratch, most: int = 1_000_000) -> DataFrame:
    """The links a, b whose shingle sets have Jaccard ``similarity`` or more; ``nodes`` has node and its smallest doc_id.

    One document of each linked node is read again: up to ``most`` ids are broadcast, more are joined by shuffling.
    """
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    first = scratch.put("ends", nodes.filter("doc_id IS NOT NULL").join(ends, "node", "left_semi").select("doc_id"))
    some = docs.join(F.broadcast(first) if first.count() <= most else first, "doc_id", "left_semi").union(docs.filter("doc_id IS NULL"))
    sets = scratch.put("sets", _shingle_sets(some, words).join(ends, "node", "left_semi").dropDuplicates(["node"]))
    pairs = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.filter(shared + 1e-9 >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.9, width: int = 3) -> DataFrame:
    """doc_id and component_id over documents whose ``words``-word shingle sets have Jaccard ``similarity`` or more.

    Documents of one shingle set are one node (by a 64-bit digest). First fingerprints are linked by ball hashing, under as
    many masks as let a pair at exactly ``similarity`` meet with probability ``recall``, and the nearest of each node verified
    on the sets. That joins most copies; then pairs between the pieces left are proposed by the prefixes of their sets, which
    miss no pair, and verified, so all links are found however many texts share a template. Fewer words than
    ``words`` are one shingle; null and empty texts are one group. Null ids, repeated rows, long texts, other
    columns and empty tables as in ``simhash_components``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(_signatures(docs, words, width))
    nodes = cut(rows.groupBy("node", *_words(width), *SKETCH).agg(F.min("doc_id").alias("doc_id")))
    masks, radius = masks_for(similarity, recall, nodes.count(), width)
    scratch = Scratch(docs.sparkSession)
    met = meetings(nodes.select("node", *_words(width)), masks, radius, width, scratch=scratch)

    def verify(links: DataFrame) -> DataFrame:
        return _alike(docs, nodes, links, words, similarity, scratch)

    roots, tried = connected(met, verify, scratch)
    scratch.drop("met", "ends", "sets")
    frequent = frequent_shingles(rows.select("frequent"))
    first = first_shingles(docs.select(F.col("text").cast("binary").alias("text")), lambda t: np.unique(shingle_hashes(t, words)), _node_id, frequent, similarity)
    pairs = candidates(first, roots, similarity, scratch, sketches=nodes.select("node", *SKETCH)).join(tried, ["a", "b"], "left_anti")
    pairs = scratch.put("proposed", pairs)
    scratch.drop("first", "mixed", "links")
    roots = completed(roots, pairs, verify, scratch)
    scratch.drop("proposed", "first", "ends", "sets", "links", "mixed", "pairs", "chosen", "passed")
    return with_components(rows.select("doc_id", "node"), roots).select("doc_id", "component_id")


@any_names
def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each group of near copies, the smallest doc_id; columns as before, whatever their names.

    Rows without id stay, and so do all rows that repeat the smallest id; see ``near_copies`` for the rest.
    """
    gone = unused(docs, "gone")
    groups = near_copies(docs, **how).filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(groups, docs["doc_id"].cast("long") == F.col(gone), "left_anti").select(*docs.columns)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``simhash_components`` (three words, three bits) over ``documents``; nulls, ties and odd rows as there."""
    return simhash_components(table(spark, sf_dir, "documents"))
