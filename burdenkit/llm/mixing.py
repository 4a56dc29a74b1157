"""Mixing sources to target weights over fixed-length blocks of words.

A source's documents, in a fixed order, form a stream that is cut into blocks. Output shards draw how many
of their slots each source fills: a multinomial draw given the sources' exact totals, made by halving the
range of shards again and again, so that a task finds its shard's counts and offsets from the seed alone.
A slot's number goes through the source's pseudorandom permutation of block numbers; slots and blocks are
then joined by block number, which no source can skew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import any_names, cut, table, unused, word_count


def weights_for(sources: list[str | None], cycle: tuple[float, ...] = (3, 1, 2)) -> dict[str | None, float]:
    """Weights dealt in turn to the sources by code point, null last."""
    order = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(order)}


def targets_for(sizes: dict[str | None, int], weights: dict[str | None, float], share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Targets by weight of ``share`` times all sizes; none above ``most`` times its source, the excess reshared."""
    left, target, open_ = share * sum(sizes.values()), {}, {s for s in sizes if weights[s] > 0}
    target = dict.fromkeys(sizes, 0.0)
    while open_ and left > 0:
        total = sum(weights[s] for s in open_)
        above = {s for s in open_ if left * weights[s] / total > most * sizes[s]}
        if not above:
            for s in open_:
                target[s] = left * weights[s] / total
            break
        for s in above:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in above)
        open_ -= above
    return target


def draw(rng: np.random.Generator, counts: np.ndarray, number: int) -> np.ndarray:
    """How many of each kind are among ``number`` drawn at random, without replacement, from ``counts`` of each.

    Exact for counts of any size: if every one is taken by a coin of its own and the surplus or shortage (about a
    root of the number) is then made good by a uniform draw, all sets of that size are equally likely.
    """
    total = int(counts.sum())
    if 2 * number > total:
        return counts - draw(rng, counts, total - number)
    if number <= 32:
        out = np.zeros_like(counts)
        for k in range(number):
            out[np.searchsorted(np.cumsum(counts - out), rng.integers(total - k), "right")] += 1
        return out
    part = rng.binomial(counts, number / total)
    over = int(part.sum()) - number
    return part - draw(rng, part, over) if over > 0 else part + draw(rng, counts - part, -over)


def shard_counts(slots: np.ndarray, shards: int, size: int, shard: int, seed: int, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of one shard of ``size`` slots: each source's first slot number and its number of slots.

    ``known`` keeps the halves drawn so far, of use to a task with many shards.
    """
    known = {} if known is None else known
    low, high, counts, first = 0, shards, slots.astype(np.int64), np.zeros(len(slots), np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        if (low, high) not in known:
            known[low, high] = draw(np.random.default_rng([seed, low, high]), counts, min((mid - low) * size, int(counts.sum())))
        left = known[low, high]
        if shard < mid:
            high, counts = mid, left
        else:
            low, first, counts = mid, first + left, counts - left
    return first, counts


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 at ``index``: a four-round Feistel network with cycle walking."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(1, 1 << 62, 4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & low
        for k in keys:
            with np.errstate(over="ignore"):
                mixed = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            a, b = b, a ^ ((mixed >> np.uint64(64 - half)) & low)
        return (a << np.uint64(half)) | b

    out = once(index.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _draws(slots: list[int], blocks: list[int], shards: int, size: int, seed: int):
    def run(batches):
        count, known = np.array(slots, np.int64), {}
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, own = shard_counts(count, shards, size, shard, seed, known)
                src = np.repeat(np.arange(len(own)), own)
                block = np.empty(len(src), np.int64)
                at = 0
                for s in np.flatnonzero(own):
                    block[at : at + own[s]] = permuted((first[s] + np.arange(own[s])) % blocks[s], blocks[s], seed + 1 + int(s))
                    at += int(own[s])
                yield pa.RecordBatch.from_arrays([pa.array(src.astype(np.int32)), pa.array(block)], names=["src", "block"])

    return run


def mix(docs: DataFrame, cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 32, shard_slots: int = 4096, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of each row: doc_id, source, size, source_size, target, taken, pieces (and ``carry``).

    ``size``: words (null and empty text: 0; long texts count whole). ``pieces``: of the taken blocks, structs of
    first word, words and times. A source of n blocks takes round(target / (size / n)) slots, at most ``most`` (a
    whole number here) times n, so no row is taken more than ``most`` times. Null sources are a source of their own;
    sources without words and empty tables take nothing. Null ids are ids like others; rows that repeat share
    their place among them in any order. Other columns take no part, whatever their names. One row per source
    is held on the driver.
    """
    # narrow rows are written once
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]))
    stats = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    sizes = {r["source"]: r["size"] for r in stats}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = targets_for(sizes, weights_for(order, cycle), share, most)
    blocks = [-(-sizes[s] // block) for s in order]
    slots = [min(int(most) * n, round(target[s] * n / sizes[s])) if n else 0 for s, n in zip(order, blocks, strict=True)]
    spark = docs.sparkSession
    rows = {r["source"]: r["rows"] for r in stats}
    info = spark.createDataFrame([(s, i, sizes[s], target[s], rows[s] // 1000 + 1) for i, s in enumerate(order)], "_s string, src int, source_size long, target double, _buckets long")
    sized = sized.join(F.broadcast(info), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    # offsets in the source's stream: within buckets of about 1,000 of its rows, and of buckets by the small table of their sums
    sized = sized.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size"), "_buckets"))
    sums = sized.groupBy("src", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("src", "_bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["src", "_bucket"])
    placed = placed.withColumn("_at", F.col("_ahead") + F.col("_within"))

    shards = max(1, -(-sum(slots) // shard_slots))
    drawn = spark.range(shards, numPartitions=max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInArrow(_draws(slots, blocks, shards, shard_slots, seed), "src int, block long")
    times = drawn.groupBy("src", "block").agg(F.count("*").alias("_times"))

    last = F.col("_at") + F.col("size")
    spread = placed.filter("size > 0").select("src", "_at", "size", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((last - 1) / block))).alias("block"))
    met = spread.join(times.hint("merge"), ["src", "block"])  # drawn from a range, its size is estimated far too low
    begin = F.greatest(F.col("_at"), F.col("block") * block)
    words = F.least(last, (F.col("block") + 1) * block) - begin
    piece = F.struct((begin - F.col("_at")).alias("start"), words.alias("words"), F.col("_times").alias("times"))
    taken = met.groupBy("src", "_at").agg(F.sum(words * F.col("_times")).alias("taken"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    # an offset names one row with words; rows without words share offsets but take nothing
    out = placed.withColumn("_has", F.col("size") > 0).join(taken.withColumn("_has", F.lit(True)), ["src", "_at", "_has"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "pieces", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def _rewrite(epoch: int):
    """text and pieces -> the words taken at least ``epoch`` times, as they stand in the text; whole texts unchanged."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def of(text: str, pieces: list[dict]) -> str | None:
        spans = [(p["start"], p["start"] + p["words"]) for p in pieces if p["times"] >= epoch]
        if not spans:
            return None
        runs = [list(spans[0])]
        for a, b in spans[1:]:
            if a == runs[-1][1]:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        at = [(m.start(), m.end()) for m in word.finditer(text)]
        if runs == [[0, len(at)]]:
            return text
        return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in runs)

    return of


@any_names
def mixed_documents(docs: DataFrame, most: float = 2.0, **how) -> DataFrame:
    """The mix as documents: per document and pass (``most`` at most), the words that the mix takes; columns as in ``docs``.

    A document whose blocks are all taken comes out unchanged; others keep the taken runs of words, one
    run per line, and n_chars (if there) follows. Later passes repeat the doc_id. Rows of no words leave.
    Nulls, repeats and empty tables as in ``mix``; other columns may have any names. The mix is planned on
    narrow rows; texts are shuffled once, to meet their pieces by id and hash (and, among equal rows, number).
    """
    key, copy, found, one = (unused(docs, x) for x in ("text_hash", "copy_number", "found", "one_pass"))
    hashed = docs.withColumn(key, F.xxhash64("text"))
    taken = mix(hashed, most=most, carry=(key,), **how).filter("taken > 0")
    # of rows alike in id and text, each takes one of the lists of pieces
    lists = taken.groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col(key).alias("_hash")).agg(F.sort_array(F.collect_list("pieces")).alias("_lists"))
    left = docs.select(F.struct(*docs.columns).alias("_row")).select("_row", F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("_row.doc_id").isNull().alias("_none"), F.xxhash64("_row.text").alias("_hash"))
    same = Window.partitionBy("_id", "_none", "_hash").orderBy("_id")
    met = left.join(lists, ["_id", "_none", "_hash"]).withColumn("_copy", F.row_number().over(same)).filter(F.col("_copy") <= F.size("_lists"))
    names = [c for c in docs.columns if c not in ("text", "n_chars")]
    pieces = F.get("_lists", F.col("_copy") - 1)
    read = met.select(*[F.col("_row")[c].alias(c) for c in names], F.col("_row.text").alias(key), pieces.alias(copy))

    def cut_text(batches):
        ways = {e: _rewrite(e) for e in range(1, int(most) + 1)}
        for batch in batches:
            rows = zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            texts = [[x for e in range(1, max(p["times"] for p in pieces) + 1) if (x := ways[e](text, pieces)) is not None] for text, pieces in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.list_(pa.string()))], names=[*batch.schema.names[:-2], found])

    out = StructType([*[StructField(c, read.schema[c].dataType) for c in names], StructField(found, ArrayType(StringType()))])
    done = read.mapInArrow(cut_text, out).withColumn(one, F.explode(found))
    as_text = {"text": F.col(one), "n_chars": F.length(one).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*[(as_text[c] if c in as_text else F.col(c)).alias(c) for c in docs.columns])


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` over ``documents``: words taken of each; nulls, ties and odd rows as there."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
