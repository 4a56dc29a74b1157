"""Approximate nearest neighbours on shifted Hilbert curves.

Each curve projects the unit vectors on a few random directions, shifts them and orders them by their
place on a Hilbert curve. Spark sorts every curve by range; a query looks at the vectors within a window of
ranks about its own, on every curve, and the windows' best are merged and scored again on the original
vectors. Windows are runs of equally long blocks, so no key is hot; equal vectors are one entry.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, d) with ``bits`` bits a dimension; d x bits up to 62.

    Walks the bits from the top: each level reads its cell in Gray-code order and reflects and swaps the
    axes of the bits below, as the curve's recursive definition says.
    """
    x = grid.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        top, below = np.int64(1 << level), np.int64((1 << level) - 1)
        for axis in range(len(x)):
            flipped = (x[axis] & top) != 0
            exchange = np.where(flipped, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(flipped, below, exchange)
            x[axis] ^= exchange
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    parity = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        parity ^= np.where((x[-1] >> level) & 1, np.int64((1 << level) - 1), 0)
    x ^= parity
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


def _curve_keys(dim: int, kind: str, curves: int, axes: int, bits: int, seed: int):
    """id and vector in; curve, key, id and vector out, a row per curve."""

    def run(batches):
        frames = []
        for c in range(curves):
            rng = np.random.default_rng([seed, c])
            frames.append((np.linalg.qr(rng.normal(size=(dim, min(axes, dim))))[0] * math.sqrt(dim), rng.random(min(axes, dim))))
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.frombuffer(b"".join(batch.column(1).to_pylist()), kind).astype(np.float64).reshape(-1, dim)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            for c, (basis, shift) in enumerate(frames):
                even = 1 / (1 + np.exp(-1.702 * (unit @ basis)))  # about uniform for isotropic vectors
                grid = np.minimum((even + shift) / 2 * (1 << bits), (1 << bits) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), c, np.int32)), pa.array(hilbert_keys(grid, bits)), batch.column(0), batch.column(1)], names=["curve", "key", "entry", "vec"])

    return run


def _best(k: int, kind: str):
    """Top ``k`` of a block for the queries whose windows touch it; products first, then exact cosines of the best."""

    def run(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "entry": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        v = np.frombuffer(b"".join(block["vec"]), kind).astype(np.float64).reshape(len(block), -1)
        ranks, entries = block["rank"].to_numpy(), block["entry"].to_numpy()
        norms = np.linalg.norm(v, axis=1)
        unit = v / norms[:, None]
        ids, found, scores = [], [], []
        for at in range(0, len(queries), 512):
            part = queries.iloc[at : at + 512]
            q = np.frombuffer(b"".join(part["vec"]), kind).astype(np.float64).reshape(len(part), -1)
            near = (q / np.linalg.norm(q, axis=1)[:, None]) @ unit.T
            low, high = part["low"].to_numpy(), part["high"].to_numpy()
            near[(ranks[None, :] < low[:, None]) | (ranks[None, :] > high[:, None])] = -np.inf
            take = min(k + 4, near.shape[1])
            least = -np.partition(-near, take - 1, axis=1)[:, take - 1]
            for i, query in enumerate(part["query_id"].tolist()):
                own = np.flatnonzero((near[i] >= least[i] - 1e-12) & np.isfinite(near[i]))  # with all that tie with the last
                exact = (v[own] * q[i]).sum(1) / (norms[own] * np.linalg.norm(q[i]))
                first = np.lexsort((entries[own], -exact))[: k + 4]
                own, exact = own[first], exact[first]
                ids += [query] * len(own)
                found += entries[own].tolist()
                scores += exact.tolist()
        return pd.DataFrame({"query_id": np.array(ids, np.int64), "entry": np.array(found, np.int64), "score": np.array(scores, float)})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = 6, axes: int = 6, bits: int = 6, window: float = 0.3, least: int = 1024, block: int = 4096, seed: int = 42) -> DataFrame:
    """The ``k`` nearest by cosine that the curves find: query_id, rank, vec_id, score.

    ``window``: share of all entries that a query's window on one curve holds, at least ``least`` entries.
    Vectors without direction need such shares; for clustered ones a small share and a large ``least`` do.
    Null ids, null, empty or zero vectors and vectors with null or non-finite components take no part, nor do those
    of another length than most (ties: the shorter). Rows that repeat an id are separate candidates; a query
    is never its own neighbour, nor is a row of the same id. Ties go to the smaller id. Vectors of any magnitude
    keep their cosine; other columns take no part, whatever their names; an empty table gives an empty result.
    """
    v = F.col(vec_col).cast("array<double>")
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("q")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)")
    dims = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    spark = vectors.sparkSession
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims["d"]
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    pack_bytes = _packer(kind)
    packed = usable.filter(F.size("v") == dim).mapInArrow(pack_bytes, "id long, vec binary, q boolean")
    # equal vectors are one entry with their k + 1 smallest ids, enough for any query
    order = Window.partitionBy("vec").orderBy("id")
    first = packed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    entries = cut(first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("entry")))
    total = entries.count()
    half = max(least, math.ceil(window * total)) // 2
    keyed = entries.select("entry", "vec").mapInArrow(_curve_keys(dim, kind, curves, axes, bits, seed), "curve int, key long, entry long, vec binary")
    parts = max(1, -(-total * curves // 20_000))
    sorted_ = cut(keyed.repartitionByRange(parts, "curve", "key", "entry").sortWithinPartitions("curve", "key", "entry").withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).cast("int")
    runs = sorted_.groupBy("curve", part.alias("part")).agg(F.count("*").alias("n"), F.min("_place").alias("begin")).orderBy("curve", "part").collect()
    ahead, seen = [], {}
    for r in runs:  # a row per curve and sorted partition
        ahead.append((r["curve"], r["part"], seen.get(r["curve"], 0) - r["begin"]))
        seen[r["curve"]] = seen.get(r["curve"], 0) + r["n"]
    offsets = spark.createDataFrame(ahead, "curve int, part int, ahead long")
    ranked = sorted_.withColumn("part", part).join(F.broadcast(offsets), ["curve", "part"]).withColumn("rank", F.col("_place") + F.col("ahead")).select("curve", "rank", "entry", "vec")
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block))
    asking = packed.filter("q").select(F.col("id").alias("query_id"), "vec").distinct()
    named = asking.join(entries.select("vec", "entry"), "vec")
    low = F.least(F.greatest(F.col("rank") - half, F.lit(0)), F.greatest(F.lit(0), F.lit(total - 2 * half - 1)))
    high = F.least(F.greatest(F.col("rank") + half, F.lit(2 * half)), F.lit(total - 1))
    queries = named.join(ranked.select("entry", "curve", "rank"), "entry").select("query_id", "vec", F.col("curve").alias("on_curve"), low.alias("low"), high.alias("high"))
    # queries of a block are dealt to so many copies of it that none has over about 4,000 of them
    copies = max(1, -(-(2 * half + block) // (50 * 4000)))
    queries = queries.withColumn("near_block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor(F.col("high") / block)))).withColumn("copy", F.pmod(F.xxhash64("query_id"), F.lit(copies)).cast("int"))
    blocks = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    found = queries.groupBy("on_curve", "near_block", "copy").cogroup(blocks.groupBy("curve", "block", "copy")).applyInPandas(_best(k + 1, kind), "query_id long, entry long, score double")
    merged = found.groupBy("query_id", "entry").agg(F.max("score").alias("score"))
    best = merged.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry"))).filter(F.col("n") <= 2 * k + 6)
    ids = best.join(entries.select("entry", "ids"), "entry").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ids.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packer(kind: str):
    """Vectors as bytes, scaled by a power of two (which changes no cosine) so that the largest component is about 1."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            width = len(flat) // max(1, batch.num_rows)
            rows = flat.reshape(batch.num_rows, width) if batch.num_rows else flat.reshape(0, 1)
            if rows.size:
                rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(1))[1][:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in (rows + 0.0).astype(kind)], pa.binary()), batch.column(2)], names=["id", "vec", "q"])

    return run


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nearest`` over ``embeddings`` for ids divisible by 50; nulls, ties and odd rows as there."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))
