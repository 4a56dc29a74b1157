"""Which sources to load again, in batch and over a stream of manifest files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

MANIFEST = "source string, version string, digest string"


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Sources of ``now`` (source, version, digest) that ``before`` hasn't with the same version and digest."""
    known = before.select(*[F.col(c).alias(f"_{c}") for c in ("source", "version", "digest")])
    return now.join(known, F.expr("source <=> _source AND version <=> _version AND digest <=> _digest"), "left_anti")


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of manifest rows from the JSON files that arrive in ``folder``; a row seen before is dropped.

    State is one entry per (source, version, digest), which grows with the number of loads, not of rows loaded.
    """
    reader: DataStreamReader = spark.readStream.schema(MANIFEST)
    return reader.json(folder).dropDuplicates(["source", "version", "digest"])
