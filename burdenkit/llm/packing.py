"""Best-fit packing of documents into bins of several permitted sequence lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, word_count

CAPACITIES = (512, 1024, 2048, 4096)


def pack_group(sizes: np.ndarray, capacities: tuple[int, ...], overhead: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing with a choice of bin sizes: bin, offset within it and final capacity of each item.

    An item goes to the open bin that it fills best. If none has room, the bin size is opened that costs
    least for a token it is likely to hold: capacity plus ``overhead``, over the item and what still fits
    behind it of the items to come. At last each bin shrinks to the smallest capacity for its contents.
    """
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order]
    behind = np.concatenate((np.cumsum(falling[::-1])[::-1], [0]))  # tokens of this and all later items
    rising = -falling
    free: list[tuple[int, int]] = []  # room left, bin
    bin_of, offset, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for k, (item, s) in enumerate(zip(order.tolist(), falling.tolist(), strict=True)):
        at = bisect_left(free, (s, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            best = None
            for c in capacities:
                if c >= s:
                    later = max(k + 1, int(np.searchsorted(rising, -(c - s), "left")))
                    price = (c + overhead) / max(1, s + min(c - s, int(behind[later])))
                    if best is None or price < best[0]:
                        best = (price, c)
            room, b = best[1], len(used)
            used.append(0)
        bin_of[item], offset[item] = b, used[b]
        used[b] += s
        if room > s:
            insort(free, (room - s, b))
    fits = np.array(sorted(capacities))
    return bin_of, offset, fits[np.searchsorted(fits, np.array(used, np.int64), "left")][bin_of] if len(sizes) else bin_of


def pack(sized: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: float = 64.0, shard_rows: int = 20_000) -> DataFrame:
    """Pack rows (doc_id, size) into bins: a row per piece with its bin, capacity and places.

    Documents longer than the largest capacity are cut into full pieces, each a bin of its own, and a rest.
    Rests are dealt by hash of id, size and row to shards of about ``shard_rows`` rows and packed there. Returns
    doc_id, size, piece, doc_start, tokens, bin_id, bin_start, capacity. Rows of no tokens (null sizes too) come
    out once, without bin (null bin_id, bin_start and capacity). Null ids and repeated rows are packed like
    others; equal sizes go in order of doc_id. Other columns take no part, whatever their names; an empty table
    gives an empty result.
    """
    most = max(capacities)
    rows = cut(sized.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")))
    shards = max(1, -(-rows.count() // shard_rows))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / most)))
    cut_up = rows.withColumn("piece", F.explode(pieces)).withColumn("doc_start", F.col("piece") * most)
    cut_up = cut_up.withColumn("tokens", F.least(F.lit(most).cast("long"), F.col("size") - F.col("doc_start")))
    cols = ["doc_id", "size", "piece", "doc_start", "tokens", "bin_id", "bin_start", "capacity"]
    whole = cut_up.filter(F.col("tokens") == most).withColumn("bin_id", F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("."), F.col("piece").cast("string"), F.lit("."), F.hex(F.monotonically_increasing_id())))
    whole = whole.withColumn("bin_start", F.lit(0).cast("long")).withColumn("capacity", F.lit(most).cast("long")).select(cols)
    none = cut_up.filter("tokens = 0").withColumn("bin_id", F.lit(None).cast("string")).withColumn("bin_start", F.lit(None).cast("long")).withColumn("capacity", F.lit(None).cast("long")).select(cols)
    rest = cut_up.filter((F.col("tokens") > 0) & (F.col("tokens") < most)).withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "row"), F.lit(shards)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins, offset, capacity = pack_group(pdf["tokens"].to_numpy(np.int64), tuple(capacities), overhead)
        return pdf.assign(bin_id=[f"s{pdf['shard'][0]}.{b}" for b in bins], bin_start=offset, capacity=capacity)[cols]

    kinds = "doc_id long, size long, piece long, doc_start long, tokens long, bin_id string, bin_start long, capacity long"
    return rest.groupBy("shard").applyInPandas(fill, kinds).unionByName(whole).unionByName(none)


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """``pack`` with a document's words as its tokens (null text: none); long texts count whole, odd rows as in ``pack``."""
    return pack(docs.select("doc_id", word_count(F.col("text")).alias("size")), **how)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack_documents`` over ``documents``; nulls, ties and odd rows as in ``pack``."""
    return pack_documents(table(spark, sf_dir, "documents"))
