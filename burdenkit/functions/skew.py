"""Joins that don't depend on how rows are spread over keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_skewed(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """Join ``rows`` with ``groups`` (one row per key, ``size`` = its number of rows) however skewed the keys are.

    Keys that hold over a thousandth of all rows are fewer than a thousand, so the list of them is
    broadcast; their rows are dealt by the hash of ``spread`` to ``salts`` copies of the group's row.
    ``groups`` is read three times and should be cut first.
    """
    least = groups.agg((F.coalesce(F.sum(size), F.lit(0)) / 1000).alias("least")).first()["least"]
    heavy = groups.filter(F.col(size) > max(float(least), 1000.0)).select(*keys, F.lit(True).alias("_heavy"))
    dealt = F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    right = groups.join(F.broadcast(heavy), keys, "left").withColumn("_salt", dealt).drop("_heavy")
    left = rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_heavy")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
