"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import join_skewed  # noqa: F401
from ..functions.storage import cut  # noqa: F401

#: A word is a run of anything but space and the control characters 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables below ``sf_dir`` (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it a name that no column of ``df`` has (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Columns that the operators read by name.
CORE = ("doc_id", "text", "lang", "source", "n_chars")


def any_names(operator: Callable) -> Callable:
    """For operators that return the columns of ``docs``: other columns have plain names inside, so theirs may hold dots, backticks or spaces."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **how) -> DataFrame:
        plain = docs.toDF(*[c if c in CORE else f"extra_{k}" for k, c in enumerate(docs.columns)])
        return operator(plain, *args, **how).toDF(*docs.columns)

    return run


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty. One pass, without an array of words."""
    marks = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), _SPACES, "")
    return F.length(marks).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def hash_share(key: str) -> Column:
    """A number in [0, 1) from the key's hash, the same in every run."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))
