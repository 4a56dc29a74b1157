"""Substring deduplication by hashing lines.

A unit is a line, or a line cut further behind the ends of sentences, so that passages pasted into the middle of a
line still align. Units are normalised and hashed; digests are grouped over the corpus; the occurrence
that ranks first stays and the others are removed, with their offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import any_names, cut, join_skewed, table, unused

#: Both tile any text: each character belongs to one unit.
UNITS = {"sentence": r"[^\n.!?]+[.!?]*\n?|[.!?]+\n?|\n", "line": r"[^\n]+\n?|\n"}


def _units(min_words: int, unit: str):
    tile = re.compile(UNITS[unit])

    def run(batches):
        for batch in batches:
            docs, units, starts, ends, digests = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                for k, piece in enumerate(tile.findall(text)):
                    words = piece.lower().encode().split()
                    if len(words) >= min_words:
                        docs.append(doc), units.append(k), starts.append(at), ends.append(at + len(piece))
                        digests.append(hashlib.md5(b" ".join(words), usedforsecurity=False).digest())
                    at += len(piece)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(units, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "unit", "start", "end", "digest"])

    return run


def repeated_units(docs: DataFrame, min_words: int = 6, unit: str = "sentence") -> DataFrame:
    """The removed units: doc_id, unit, start, end, keep_doc_id, keep_unit, digest.

    ``unit``: "sentence" or "line". Units of fewer than ``min_words`` words are left alone; 1 takes in all that have
    a word. The first in order of doc_id (nulls last) and unit stays; rows that repeat a doc_id (or have none) rank
    together, so what stays in one stays in all of them. Start and end are code points of the original text, the
    end exclusive. Null and empty texts have no units; long texts are read whole. Other columns take no part,
    whatever their names; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    units = rows.mapInArrow(_units(min_words, unit), "doc_id long, unit int, start long, end long, digest binary")
    first = units.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "unit")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    groups = cut(first)
    met = join_skewed(units, groups, ["digest"], "_n", "doc_id").filter("NOT doc_id <=> _first.doc_id OR unit <> _first.unit")
    return met.select("doc_id", "unit", "start", "end", F.col("_first.doc_id").alias("keep_doc_id"), F.col("_first.unit").alias("keep_unit"), F.lower(F.hex("digest")).alias("digest"))


@any_names
def without_repeats(docs: DataFrame, min_words: int = 6, unit: str = "sentence") -> DataFrame:
    """``docs`` with their repeated units cut out of the text; columns as before, whatever their names.

    Null ids keep their text; repeated ids lose the same spans; see ``repeated_units`` for the rest.
    """
    doc, gone = unused(docs, "gone_from"), unused(docs, "gone_spans")
    found = repeated_units(docs, min_words, unit).filter("doc_id IS NOT NULL")
    spans = found.groupBy(F.col("doc_id").alias(doc)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(gone))
    met = docs.join(spans, docs["doc_id"].cast("long") == F.col(doc), "left")
    ahead = F.expr(f"transform(`{gone}`, (g, i) -> substring(text, if(i = 0, 0, `{gone}`[i - 1].end) + 1, g.start - if(i = 0, 0, `{gone}`[i - 1].end)))")
    rest = F.expr(f"substring(text, element_at(`{gone}`, -1).end + 1)")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.concat(F.array_join(ahead, ""), rest))
    return met.select(*[(text if c == "text" else F.col(c)).alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repeated_units`` of ``documents``: sentences of six words or more; nulls, ties and odd rows as there."""
    return repeated_units(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH tiles AS (
  SELECT doc_id, regexp_extract_all(text, '[^\n.!?]+[.!?]*\n?|[.!?]+\n?|\n') AS u FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, unnest(u) AS piece, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS unit FROM tiles),
placed AS (
  SELECT doc_id, unit, piece,
         CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY unit) AS BIGINT) AS "end",
         regexp_extract_all(lower(piece), '[^\x20\x09-\x0D]+') AS words
  FROM units),
named AS (
  SELECT doc_id, unit, "end" - length(piece) AS start, "end", md5(array_to_string(words, ' ')) AS digest
  FROM placed WHERE len(words) >= 6),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_doc_id, first_value(unit) OVER w AS keep_unit
  FROM named WINDOW w AS (PARTITION BY digest ORDER BY doc_id, unit))
SELECT doc_id, unit, start, "end", keep_doc_id, keep_unit, digest
FROM ranked WHERE doc_id <> keep_doc_id OR unit <> keep_unit
"""
