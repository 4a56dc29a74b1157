"""Queries of linkage disequilibrium and conserved segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linkage as ld
from ..operators import scan
from . import views as v
from .registry import query
from .views import sql

#: SNPs are parts on few chromosomes' worth of positions; pairs are order lines between near places.
_L = {
    "snp": "SELECT DISTINCT 'CEU' AS pop, chr, locus_id AS rs, pos FROM loci",
    "idx": "SELECT pop, chr, rs, pos, dense_rank() OVER (PARTITION BY pop, chr ORDER BY pos) - 1 AS i FROM snp",
    "pair": "SELECT i.pop, i.chr, i.i AS a, i.i + 1 + l_linenumber % 5 AS b, CASE WHEN l_quantity > 40 THEN -1 ELSE 1 - l_discount * 5 END AS dp, CASE WHEN l_quantity > 40 THEN -1 ELSE 1 - l_tax * 6 END AS rsq FROM lineitem JOIN idx i ON l_partkey = rs",
    "placed": "SELECT p.* FROM pair p JOIN idx j ON j.pop = p.pop AND j.chr = p.chr AND j.i = p.b",
    "step": "SELECT pop, chr, idx, CASE WHEN other > idx THEN 1 ELSE -1 END AS side, abs(other - idx) AS distance, max(dp) AS dprime, max(rsq) AS rsq FROM (SELECT pop, chr, a AS idx, b AS other, dp, rsq FROM placed UNION ALL SELECT pop, chr, b, a, dp, rsq FROM placed) GROUP BY ALL",
    "cutoff": "SELECT unnest(['dprime', 'dprime', 'rsq']) AS metric, unnest([0.9, 0.7, 0.8])::DOUBLE AS cutoff",
    "val": "SELECT * FROM (SELECT pop, metric, cutoff, chr, idx, side, distance, CASE metric WHEN 'dprime' THEN dprime ELSE rsq END AS value FROM step, cutoff) WHERE value <> -1",
    "walked": "SELECT * FROM (SELECT *, min(CASE WHEN value < cutoff THEN distance END) OVER (PARTITION BY pop, metric, cutoff, chr, idx, side) AS stop FROM val) WHERE (stop IS NULL OR distance < stop) AND value > 0",
    "span": "SELECT pop, metric, cutoff, chr, idx, side, count(*) AS steps FROM walked GROUP BY ALL",
    "ends": "SELECT pop, metric, cutoff, chr, idx, coalesce(max(steps) FILTER (side < 0), 0) AS down, coalesce(max(steps) FILTER (side > 0), 0) AS up FROM span GROUP BY ALL",
    "bound": "SELECT e.pop, metric, cutoff, e.chr, idx, l.pos AS low, h.pos AS high FROM ends e LEFT JOIN idx l ON l.pop = e.pop AND l.chr = e.chr AND l.i = idx - down LEFT JOIN idx h ON h.pop = e.pop AND h.chr = e.chr AND h.i = idx + up",
    "inside": "SELECT r.region_id, i.pop, i.chr, i.i AS idx, r.pos_min, r.pos_max FROM idx i JOIN regions r ON i.chr = r.chr AND i.pos BETWEEN r.pos_min AND r.pos_max",
}


def lsql(body: str, **more: str) -> str:
    return sql(body, **_L, **more)


def index(spark, d):
    return ld.neighbour_index(v.loci(spark, d).select(F.lit("CEU").alias("pop"), "chr", F.col("locus_id").alias("rs"), "pos"))


def steps(spark, d):
    i = index(spark, d)
    x = v.read(spark, d, "lineitem").join(i, F.col("l_partkey") == F.col("rs"))
    gone = F.col("l_quantity") > 40
    pairs = x.select("pop", "chr", F.col("pos").alias("pos1"), (F.col("idx") + 1 + F.col("l_linenumber") % 5).alias("_j"), F.when(gone, -1.0).otherwise(1 - F.col("l_discount") * 5).alias("dprime"), F.when(gone, -1.0).otherwise(1 - F.col("l_tax") * 6).alias("rsq"))
    ends = i.select("pop", "chr", F.col("idx").alias("_j"), F.col("pos").alias("pos2"))
    return ld.directed(pairs.join(ends, ["pop", "chr", "_j"]).drop("_j"), i)


def cutoffs(spark):
    return spark.createDataFrame([("dprime", 0.9), ("dprime", 0.7), ("rsq", 0.8)], "metric string, cutoff double")


@query("win_neighbour_index", lsql("SELECT chr, rs, pos, i AS idx FROM idx"))
def win_neighbour_index(spark, d):
    return index(spark, d).select("chr", "rs", "pos", v.long("idx").alias("idx"))


@query("win_ld_span", lsql("SELECT * FROM span"))
def win_ld_span(spark, d):
    return ld.spans(steps(spark, d), cutoffs(spark))


@query("ld_neighbours", lsql("SELECT metric, cutoff, chr, idx, side, distance, round(value, 6) AS value FROM walked"))
def ld_neighbours(spark, d):
    return ld.neighbours(steps(spark, d), cutoffs(spark)).select("metric", "cutoff", "chr", "idx", "side", "distance", F.round("value", 6).alias("value"))


@query("ld_snp_bounds", lsql("SELECT * FROM bound"))
def ld_snp_bounds(spark, d):
    return ld.bounds(ld.spans(steps(spark, d), cutoffs(spark)), index(spark, d))


@query("join_ld_region", lsql("SELECT region_id, chr, idx FROM inside"))
def join_ld_region(spark, d):
    from ..operators.intervals import points_in_regions

    return points_in_regions(index(spark, d), v.regions(spark, d).select("region_id", "chr", "pos_min", "pos_max")).select("region_id", "chr", "idx")


@query("ld_gene_bounds", lsql("SELECT region_id, 'CEU-' || CASE metric WHEN 'dprime' THEN 'DP' ELSE 'RS' END || printf('%.2f', cutoff) AS profile, chr, least(min(pos_min), min(low)) AS pos_min, greatest(max(pos_max), max(high)) AS pos_max FROM inside JOIN bound USING (pop, chr, idx) GROUP BY ALL"))
def ld_gene_bounds(spark, d):
    from ..functions.genotype import profile_name

    i = index(spark, d)
    x = ld.widened(v.regions(spark, d), i, ld.bounds(ld.spans(steps(spark, d), cutoffs(spark)), i))
    kind = F.when(F.col("metric") == "dprime", "DP").otherwise("RS")
    return x.select("region_id", profile_name(F.col("pop"), kind, F.col("cutoff")).alias("profile"), "chr", "pos_min", "pos_max")


@query("agg_merge_bounds", lsql("SELECT region_id, chr, metric, cutoff, least(min(pos_min), min(low)) AS pos_min, greatest(max(pos_max), max(high)) AS pos_max FROM inside JOIN bound USING (pop, chr, idx) GROUP BY ALL"))
def agg_merge_bounds(spark, d):
    i = index(spark, d)
    return ld.widened(v.regions(spark, d), i, ld.bounds(ld.spans(steps(spark, d), cutoffs(spark)), i)).select("region_id", "chr", "metric", "cutoff", "pos_min", "pos_max")


@query("ld_summary", lsql("SELECT chr, idx, count(*) FILTER (side > 0) AS up, count(*) FILTER (side < 0) AS down FROM step GROUP BY ALL"))
def ld_summary(spark, d):
    return steps(spark, d).groupBy("chr", "idx").agg(F.count_if(F.col("side") > 0).alias("up"), F.count_if(F.col("side") < 0).alias("down"))


#: A user's events in order are positions; every 17th number is left out, which breaks runs.
_SCORES = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, value / 40 AS value FROM events"
_STATE = "SELECT user_id, r + r // 17 AS pos, value, value >= 0.7 AS high FROM sc"
_FRESH = "SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(high) OVER w = high THEN 0 ELSE 1 END AS fresh FROM stt WINDOW w AS (PARTITION BY user_id ORDER BY pos)"
_RUNS = "SELECT user_id, high, min(pos) AS start, max(pos) AS \"end\", CAST(round(sum(value) * 4000) AS BIGINT) AS total, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM fr) GROUP BY user_id, island, high"


#: A region after each of its high runs (k counts runs of a batch from its first high one, so high runs are even).
_BATCHES = """SELECT *, row_number() OVER (PARTITION BY user_id, batch ORDER BY start) - 1 AS k FROM (SELECT *, min(start) FILTER (high) OVER b AS low_edge FROM (
  SELECT *, sum(CASE WHEN before IS NULL OR before <> start - 1 OR was_long OR is_long THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS batch
  FROM (SELECT *, lag("end") OVER w AS before, lag(is_long) OVER w AS was_long FROM (SELECT *, NOT high AND n > 5 AS is_long FROM exact_runs) WINDOW w AS (PARTITION BY user_id ORDER BY start)))
  WHERE NOT is_long WINDOW b AS (PARTITION BY user_id, batch)) WHERE start >= low_edge"""
_MERGES = """SELECT user_id, batch, k, start, "end" AS last, total, n FROM batches WHERE k = 0
  UNION ALL
  SELECT m.user_id, m.batch, h.k, CASE WHEN (m.total + l.total) / (m.n + l.n) >= 0.7 THEN m.start ELSE h.start END, h."end",
    CASE WHEN (m.total + l.total) / (m.n + l.n) >= 0.7 THEN m.total + l.total + h.total ELSE h.total END, CASE WHEN (m.total + l.total) / (m.n + l.n) >= 0.7 THEN m.n + l.n + h.n ELSE h.n END
  FROM merges m JOIN batches l ON l.user_id = m.user_id AND l.batch = m.batch AND l.k = m.k + 1 JOIN batches h ON h.user_id = m.user_id AND h.batch = m.batch AND h.k = m.k + 2"""
_EXACT = _RUNS.replace("CAST(round(sum(value) * 4000) AS BIGINT)", "sum(value)")


def _segments_sql(body: str) -> str:
    text = sql(body, sc=_SCORES, stt=_STATE, fr=_FRESH, exact_runs=_EXACT, batches=_BATCHES, merges=_MERGES, merged_regions="SELECT user_id, start, max(last) AS \"end\" FROM merges GROUP BY user_id, batch, start")
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def _runs(spark, d):
    x = scan.row_numbers(scan.banded(v.read(spark, d, "events").select("user_id", "event_id", "value"), ("user_id",), "event_id"), ("user_id",), ["event_id"], "r")
    x = x.select("user_id", (F.col("r") + F.floor(F.col("r") / 17)).alias("pos"), (F.col("value") / 40).alias("value"))
    return ld.runs(x, ("user_id",), 0.7)


@query("seg_runs", sql("SELECT * FROM rns", sc=_SCORES, stt=_STATE, fr=_FRESH, rns=_RUNS))
def seg_runs(spark, d):
    return _runs(spark, d).select("user_id", "high", "start", "end", F.round(F.col("total") * 4000).cast("long").alias("total"), "n")


@query("seg_merge", _segments_sql('SELECT user_id, start, "end" FROM merged_regions WHERE "end" - start + 1 >= 3'))
def seg_merge(spark, d):
    return ld.merged_segments(_runs(spark, d), ("user_id",), average=0.7, gap=5, least=3)


@query("etl_conserved_regions", _segments_sql('SELECT user_id, start, "end", "end" - start + 1 AS positions FROM merged_regions WHERE "end" - start + 1 >= 5'))
def etl_conserved_regions(spark, d):
    """Conserved regions per user: runs, merged greedily, with their lengths."""
    x = ld.merged_segments(_runs(spark, d), ("user_id",), average=0.7, gap=5, least=5)
    return x.select("user_id", "start", "end", (F.col("end") - F.col("start") + 1).alias("positions"))
