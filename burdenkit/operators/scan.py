"""Ordered scans over long keys: running sums, maxima, ranks and neighbours without one task per key.

Rows are dealt to bands by range of (keys, order) and written once. A function works within (band, keys), folds each band
to one summary row per key, scans the summaries (as many as there are bands, not rows) and carries what came
before into the band. So a chromosome is as many tasks as it has bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut

BAND = "_band"


def banded(df: DataFrame, keys: tuple[str, ...], order: str, bands: int | None = None) -> DataFrame:
    """``df`` with its band; rows equal in keys and ``order`` share one. Written, as sampled ranges may differ from run to run."""
    n = bands or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *keys, order).withColumn(BAND, F.spark_partition_id()))


def _within(keys: tuple[str, ...], order: list[str]):
    return Window.partitionBy(BAND, *keys).orderBy(*order)


def _carried(x: DataFrame, keys: tuple[str, ...], name: str, summary: Column, fold: Column) -> DataFrame:
    """``x`` with column ``name``: ``fold`` (over column ``_s``) of the ``summary`` of the key's earlier bands."""
    earlier = Window.partitionBy(*keys).orderBy(BAND).rowsBetween(Window.unboundedPreceding, -1)
    before = x.groupBy(*keys, BAND).agg(summary.alias("_s")).select(*keys, BAND, fold.over(earlier).alias(name))
    return x.join(before, [*keys, BAND])


def running_sum(x: DataFrame, keys: tuple[str, ...], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` (no nulls) over the key's rows up to and including each."""
    own = F.sum("_v").over(_within(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    out = _carried(x.withColumn("_v", value), keys, "_before", F.sum("_v"), F.sum("_s"))
    return out.withColumn(name, own + F.coalesce("_before", F.lit(0))).drop("_v", "_before")


def row_numbers(x: DataFrame, keys: tuple[str, ...], order: list[str], name: str) -> DataFrame:
    """Adds the row's place in its key, from 1; ``order`` should leave no ties."""
    return running_sum(x, keys, order, F.lit(1).cast("long"), name)


def maximum_before(x: DataFrame, keys: tuple[str, ...], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the largest ``value`` of the key's rows before each, null for the first."""
    own = F.max(value).over(_within(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    out = _carried(x, keys, "_before", F.max(value), F.max("_s"))
    return out.withColumn(name, F.greatest(own, "_before")).drop("_before")


def dense_ranks(x: DataFrame, keys: tuple[str, ...], order: str, name: str) -> DataFrame:
    """Adds the place of ``order`` among the key's different values, from 1. Equal values share a band."""
    out = _carried(x, keys, "_before", F.count_distinct(order), F.sum("_s"))
    return out.withColumn(name, F.dense_rank().over(_within(keys, [order])) + F.coalesce("_before", F.lit(0))).drop("_before")


def previous(x: DataFrame, keys: tuple[str, ...], order: list[str], columns: list[str], name: str) -> DataFrame:
    """Adds a struct of ``columns`` of the key's row before each, null for the first."""
    value, place = F.struct(*columns), F.struct(*order)
    own = F.lag(value).over(_within(keys, order))
    out = _carried(x, keys, "_before", F.max_by(value, place), F.last("_s"))
    return out.withColumn(name, F.coalesce(own, "_before")).drop("_before")
