"""Interval work: zone-bucketed joins, interval merging, liftover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan

ZONE = 100_000


def with_zones(regions: DataFrame, zone: int = ZONE, low: str = "pos_min", high: str = "pos_max") -> DataFrame:
    """A row per zone that the closed interval [low, high] touches, in column zone."""
    return regions.withColumn("zone", F.explode(F.sequence(F.floor(F.col(low) / zone), F.floor(F.col(high) / zone))))


#: Pairs of points and intervals a task of a large join is dealt, and rows of intervals up to which they are broadcast.
PAIRS, LISTED = 1_000_000, 1_000_000


def _zone_pairs(p: DataFrame, r: DataFrame) -> tuple[int, int, int]:
    """Pairs that share a zone, the most of any zone, and the rows of intervals; from counts per zone."""
    near = p.groupBy("chr", "zone").agg(F.count("*").alias("_p")).join(r.groupBy("chr", "zone").agg(F.count("*").alias("_r")), ["chr", "zone"])
    both = F.col("_p") * F.col("_r")
    row = near.agg(F.coalesce(F.sum(both), F.lit(0)), F.coalesce(F.max(both), F.lit(0)), F.coalesce(F.sum("_r"), F.lit(0))).first()
    return row[0], row[1], row[2]


def _shared_out(p: DataFrame, r: DataFrame, tasks: int, most: int) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """Both sides dealt to ``tasks`` by chromosome, zone and a share of the points of a zone, which meets all its intervals."""
    on, shares = ("chr", "zone", "_share"), -(-most // PAIRS)
    p = p.withColumn("_share", F.pmod(F.xxhash64(*[c for c in p.columns if c != "zone"]), F.lit(shares))).repartition(tasks, *on)
    return p, r.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))).repartition(tasks, *on), on


def dealt(p: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """``p`` (a zone each) and ``r`` dealt by the columns that are returned, to as many tasks as their pairs need."""
    pairs, most, _ = _zone_pairs(p, r)
    least = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _shared_out(p, r, max(-(-pairs // PAIRS), least), max(most, 1))


def points_in_regions(points: DataFrame, regions: DataFrame, zone: int = ZONE, how: str = "inner", by: str | None = None) -> DataFrame:
    """Join points (chr, pos) with closed intervals (chr, pos_min, pos_max) on chromosome and zone.

    A point has one zone, so a pair comes out once. Small interval tables are broadcast by Spark; large
    ones shuffle on (chr, zone). ``how``: inner, left_semi or left_anti. Pairs may be far more than rows on either side:
    where zones hold many, a zone's points are dealt to as many tasks as its pairs need. With ``by`` the
    points are dealt by that column, which later grouping by it and others needs no shuffle for (up to LISTED interval rows).
    """
    p, r, on = points.withColumn("zone", F.floor(F.col("pos") / zone)), with_zones(regions, zone), ["chr", "zone"]
    if how == "inner":
        pairs, most, listed = _zone_pairs(p, r)
        tasks = -(-pairs // PAIRS)
        if by is not None and listed <= LISTED:
            p, r = p.repartition(max(tasks, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))), by), F.broadcast(r)
        elif tasks > 1:
            p, r, on = _shared_out(p, r, tasks, most)
            r = r.hint("shuffle_hash")  # to the planner it is as small as before it was spread over zones and shares
    p, r = p.alias("p"), r.alias("r")
    same = F.col("p.pos").between(F.col("r.pos_min"), F.col("r.pos_max"))
    for c in on:
        same = (F.col(f"p.{c}") == F.col(f"r.{c}")) & same
    joined = p.join(r, same, how)
    if how != "inner":
        return joined.drop("zone")
    return joined.select(*[f"p.{c}" for c in points.columns], *[f"r.{c}" for c in regions.columns if c not in points.columns])


def merged_intervals(intervals: DataFrame, keys: tuple[str, ...] = ("chr",), low: str = "pos_min", high: str = "pos_max", bands: int | None = None) -> DataFrame:
    """Overlapping or touching intervals of a key merged into one.

    Islands start where an interval begins beyond all earlier ends. Both the running maximum and the number of islands
    are scans over range partitions, so a long key is many tasks.
    """
    order = [low, high]
    x = scan.maximum_before(scan.banded(intervals.select(*keys, low, high), keys, low, bands), keys, order, high, "_end")
    x = scan.running_sum(x, keys, order, F.when(F.col("_end").isNull() | (F.col(low) > F.col("_end")), 1).otherwise(0), "_island")
    return x.groupBy(*keys, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")


def envelopes(regions: DataFrame) -> DataFrame:
    """region_id, chr, pos_min, pos_max over all of a region's intervals."""
    return regions.groupBy("region_id", "chr").agg(F.min("pos_min").alias("pos_min"), F.max("pos_max").alias("pos_max"))


def lifted(intervals: DataFrame, segments: DataFrame, least: float = 0.95, zone: int = ZONE) -> DataFrame:
    """Closed intervals (id, chr, start, end) moved to the new build: id, chain_id, new_chr, new_start, new_end, mapped.

    ``segments``: chain_id, score, old_chr, strand ('+' or '-'), new_chr, old_start, old_end, new_start. Of an
    interval's chains, best score first, the first one counts that maps ``least`` of it. On the reverse strand
    new_start is the high end. Intervals without such a chain, or landing on no known chromosome, are left out.
    """
    s = with_zones(segments.select("chain_id", "score", F.col("old_chr").alias("chr"), "strand", "new_chr", F.col("old_start").alias("pos_min"), F.col("old_end").alias("pos_max"), "new_start"), zone)
    r = intervals.select("id", "chr", F.col("start").alias("pos_min"), F.col("end").alias("pos_max"))
    # an interval in one zone meets all its segments in one task, which picks its chain: its pairs are not shuffled
    inside = F.floor(F.col("pos_min") / zone) == F.floor(F.col("pos_max") / zone)
    r, t, place = dealt(r.filter(inside).withColumn("zone", F.floor(F.col("pos_min") / zone)), s)
    near = _best_chain(_mapped(r, t, zone, place), least, place)
    return near.unionByName(_best_chain(_mapped(with_zones(intervals.select("id", "chr", F.col("start").alias("pos_min"), F.col("end").alias("pos_max")).filter(~inside), zone), s, zone), least))


def _mapped(r: DataFrame, s: DataFrame, zone: int, place: tuple[str, ...] = ()) -> DataFrame:
    """A row per interval and chain: how much of the interval it maps, and to where. ``place``: columns that both are dealt by."""
    r, s = r.alias("r"), s.alias("s")
    meet = (F.col("r.chr") == F.col("s.chr")) & (F.col("r.zone") == F.col("s.zone")) & (F.col("s.pos_max") >= F.col("r.pos_min")) & (F.col("s.pos_min") <= F.col("r.pos_max"))
    if "_share" in place:
        meet = meet & (F.col("r._share") == F.col("s._share"))
    # a pair may meet in several zones: it counts in the first one that both touch
    first = F.col("r.zone") == F.floor(F.greatest("s.pos_min", "r.pos_min") / zone)
    meet = meet if place else meet & first
    pairs = r.join(s, meet).select(*[F.col(f"r.{c}").alias(c) for c in place], "id", F.col("r.pos_min").alias("a"), F.col("r.pos_max").alias("b"), "chain_id", "score", "strand", "new_chr", F.col("s.pos_min").alias("os"), F.col("s.pos_max").alias("oe"), F.col("new_start").alias("ns"))
    seg = F.struct("os", "oe", "ns")
    by = pairs.groupBy(*place, "id", "a", "b", "chain_id", "score", "strand", "new_chr").agg(F.min(seg).alias("f"), F.max(seg).alias("l"), F.sum(F.col("oe") - F.col("os") + 1).alias("total"))
    length_f, length_l = F.col("f.oe") - F.col("f.os") + 1, F.col("l.oe") - F.col("l.os") + 1
    front = F.least(F.greatest(F.col("a") - F.col("f.os"), F.lit(0)), length_f - 1)
    end = F.least(F.greatest(F.col("b") - F.col("l.os"), F.lit(0)), length_l - 1)
    forward = F.col("strand") == "+"
    by = by.withColumn("mapped", F.col("total") - front - length_l + end + 1)
    return by.withColumn("new_start", F.when(forward, F.col("f.ns") + front).otherwise(F.col("l.ns") - end)).withColumn("new_end", F.when(forward, F.col("l.ns") + end).otherwise(F.col("f.ns") - front))


def _best_chain(by: DataFrame, least: float, place: tuple[str, ...] = ()) -> DataFrame:
    """The chain of each interval: best score, then smallest number, as the least of a struct (a missing score comes last)."""
    good = by.filter(F.col("mapped") / (F.col("b") - F.col("a") + 1) >= least)
    out = ["chain_id", "new_chr", "new_start", "new_end", "mapped"]
    best = F.struct(F.col("score").isNull().alias("_none"), (-F.col("score")).alias("_score"), *out)
    x = good.groupBy(*place, "id").agg(F.min(best).alias("_x")).select("id", *[f"_x.{c}" for c in out])
    return x.filter("new_chr IS NOT NULL AND new_chr > 0")
