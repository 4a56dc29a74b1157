"""How document filters interact: what every order of them keeps, removes and loses, per part of the corpus.

Each document fails a subset of the five filters, so a part is a 2x2x2x2x2 table of counts. One pass over the
documents fills it, three times (all documents, good ones, toxic ones). All orders and steps are then
contractions of these tables: along each axis einsum takes pass, fail or all.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a selector: pass, fail, all.
PASS, FAIL, ALL = 0, 1, 2
_SELECT = np.array([[1, 0], [0, 1], [1, 1]], np.int64)
_MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 200 words), B (under half of its words distinct), C (over 2 % capitals), D (a mark of #$%&*|)."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [F.size(words) < 200, F.size(F.array_distinct(words)) * 100 < F.size(words) * 50, capitals * 100 > F.length(text) * 2, text.rlike(r"[#$%&*|]")]


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, cell (bit k: fails filter k), docs, good, toxic: number of documents of each set of failures.

    Equal texts are told by SHA-256. Rows that agree in all that counts are one row with a number from the map side
    on, so neither a hot text nor a repeated id is a large task; the earliest id of a text joins rows by id, which
    spreads the rows of a group of copies.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    cell = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures(F.col("text")))), F.lit(0))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"], F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text"), cell.cast("int").alias("cell"))
    known = rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "part", "text", "cell").agg(F.count("*").alias("docs"))
    unknown = rows.filter("doc_id IS NULL").groupBy("part", "cell").agg(F.count("*").alias("docs"))
    first = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    said = labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.coalesce(F.bool_or(labels["quality"] == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(labels["toxic"] == 1), F.lit(False)).alias("toxic"))
    met = known.join(said, "doc_id", "left").join(first, ["doc_id", "text"], "left")
    cell = F.col("cell") + F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    of = [F.sum(F.when(F.col(c), F.col("docs")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    counts = met.groupBy("part", cell.alias("cell")).agg(F.sum("docs").alias("docs"), *of)
    none = F.lit(0).cast("long")
    both = counts.unionByName(unknown.select("part", "cell", "docs", none.alias("good"), none.alias("toxic")))
    return both.groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])


def contract(counts: np.ndarray) -> np.ndarray:
    """All selections of count tables: axes (part, 2, 2, 2, 2, 2) in, (part, 3, 3, 3, 3, 3) out, in order pass, fail, all."""
    return np.einsum("pabcde,va,wb,xc,yd,ze->pvwxyz", counts, *[_SELECT] * 5, optimize=True)


def _cell(before: str, own: str, fails: int, rest: int) -> tuple[int, ...]:
    """Index of a selection: filters ``before`` passed, ``own`` at ``fails``, all others at ``rest``."""
    return tuple(PASS if f in before else fails if f == own else rest for f in FILTERS)


def audit_part_counts(docs: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of every order and step (part, 120, 5) from count tables (part, 2, 2, 2, 2, 2)."""
    n, g, t = contract(docs), contract(good), contract(toxic)
    out = {m: np.zeros((len(docs), 120, 5), np.int64) for m in _MEASURES}
    total = {f: np.zeros(len(docs), np.int64) for f in FILTERS}
    for o, order in enumerate(permutations(FILTERS)):
        for k, f in enumerate(order):
            before = "".join(order[:k])
            here = (slice(None), *_cell(before, f, FAIL, ALL))
            out["kept"][:, o, k] = n[(slice(None), *_cell(before + f, f, PASS, ALL))]
            out["removed"][:, o, k] = n[here]
            out["redundant"][:, o, k] = n[(slice(None), *_cell("", f, FAIL, ALL))] - n[here]
            out["unique_fails"][:, o, k] = n[(slice(None), *_cell("", f, FAIL, PASS))]
            out["good_lost"][:, o, k], out["toxic_lost"][:, o, k] = g[here], t[here]
            total[f] += n[here]
    for o, order in enumerate(permutations(FILTERS)):
        for k, f in enumerate(order):
            out["shapley"][:, o, k] = total[f]
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the measures, for all 120 orders of the filters and their 5 steps.

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic. A part is a source (null: empty string). Null
    texts count as empty, very long ones whole. E fails where a smaller doc_id has the same text: rows that repeat
    an id and its text pass together or fail together, and rows without id neither fail nor make others fail, nor have
    labels. Several labels of an id count as good (toxic) if one says so. Other columns take no part, whatever their
    names; an empty table gives an empty result. Tables of counts are at most 32 rows a part, however large the part.
    """
    cells = failure_counts(docs, labels)
    tables = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "docs", "good", "toxic")).alias("cells"))
    orders = ["".join(o) for o in permutations(FILTERS)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                parts = batch.slice(at, 256)
                full = np.zeros((3, parts.num_rows, 32), np.int64)
                for p, own in enumerate(parts.column(1).to_pylist()):
                    for c in own:
                        full[:, p, c["cell"]] = c["docs"], c["good"], c["toxic"]
                # bit k of a cell is axis k: the first axis is the lowest bit
                axes = full.reshape(3, parts.num_rows, 2, 2, 2, 2, 2).transpose(0, 1, 6, 5, 4, 3, 2)
                found = audit_part_counts(*axes)
                names = pa.array(np.repeat(np.arange(parts.num_rows), 600))
                cols = [parts.column(0).take(names), pa.array(np.tile(np.repeat(orders, 5), parts.num_rows).tolist()), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), 120 * parts.num_rows))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(found[m].reshape(-1)) for m in _MEASURES)], names=["part", "filter_order", "step", *_MEASURES])

    return tables.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in _MEASURES))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filter_audit`` over ``documents`` and ``labels``; nulls, ties and odd rows as there."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
tested AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM docs d LEFT JOIN said s ON d.doc_id = s.doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM tested GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, s::INT AS step, filter_order[s] AS own, left(filter_order, s - 1) AS before FROM orders, range(1, 6) r(s)),
met AS (SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS fails_own, translate(fails, before, '') <> fails AS gone, length(fails) AS k FROM cells, steps),
sums AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails_own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_own), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails_own), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails_own AND k = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails_own), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails_own), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM sums
"""
