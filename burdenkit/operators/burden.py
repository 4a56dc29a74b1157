"""Burden of samples over bins, bin summaries and the tests that need no more than sums and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["pheno", "kind", "bin"]


def sample_burdens(bins: DataFrame, carriers: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """pheno, kind, bin, sample_id, burden over samples that carry something; all others have burden 0.

    ``carriers``: locus_id, sample_id, coded genotype above 0. ``weights``: pheno, locus_id, weight. Bins and
    carriers of rare loci are few, so the join touches only nonzero genotypes.
    """
    x = bins if weights is None else bins.join(weights, ["pheno", "locus_id"])
    value = F.col("dosage").cast("double") if weights is None else F.col("dosage") * F.col("weight")
    return x.join(carriers, "locus_id").groupBy(*KEY, "sample_id").agg(F.sum(value).alias("burden"))


def with_samples(burdens: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Burdens with the other columns of ``rows`` (a row per pheno and sample_id).

    They meet on the sample alone, a sample's rows being a map by phenotype, so burdens that are dealt by samples stay where
    they are: there may be as many as carriers times bins. A task's share of samples is small and is hashed.
    """
    more = [c for c in rows.columns if c not in ("pheno", "sample_id")]
    of = rows.filter("pheno IS NOT NULL").groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("pheno", F.struct(*more)))).alias("_of"))
    met = burdens.join(of.hint("shuffle_hash"), "sample_id", how).withColumn("_own", F.try_element_at("_of", F.col("pheno")))
    met = met if how == "left" else met.filter("_own IS NOT NULL")
    return met.select(*burdens.columns, *[F.col(f"_own.{c}").alias(c) for c in more])


def with_status(burdens: DataFrame, status: DataFrame, how: str = "inner") -> DataFrame:
    """Burdens of the samples that have a status for the phenotype (left: of all), with is_case."""
    return with_samples(burdens, status, how)


def rank_sum(burdens: DataFrame, totals: DataFrame, reference_ties: bool = False) -> DataFrame:
    """pheno, kind, bin, w (rank sum of controls), z of the rank-sum test over all samples with status.

    ``burdens`` with is_case hold carriers only; the samples at zero come from ``totals`` (pheno, n0, n1) and
    share one midrank, so only carriers are sorted. Where is_case is null the sample takes no part, but a bin of
    such carriers only has a row (z null). ``reference_ties`` counts tie sizes less one, as older
    versions did. Negative burdens aren't expected.
    """
    value = burdens.filter("burden > 0").groupBy(*KEY, "burden").agg(F.count("is_case").alias("t"), F.count_if(~F.col("is_case")).alias("t0"))
    return rank_sum_of_values(value, totals, reference_ties)


def rank_sum_of_values(value: DataFrame, totals: DataFrame, reference_ties: bool = False) -> DataFrame:
    """The same of bins whose burdens are counted: pheno, kind, bin, burden, t (samples with a status), t0 (controls)."""
    order = Window.partitionBy(*KEY).orderBy("burden").rowsBetween(Window.unboundedPreceding, -1)
    ranked = value.withColumn("_mid", F.coalesce(F.sum("t").over(order), F.lit(0)) + (F.col("t") + 1) / 2)
    size = F.greatest(F.col("t") - 1, F.lit(0)) if reference_ties else F.col("t")
    sums = ranked.groupBy(*KEY).agg(F.sum("t").alias("above"), F.sum("t0").alias("above0"), F.sum(F.col("t0") * F.col("_mid")).alias("_w"), F.sum(F.pow(size.cast("double"), F.lit(3)) - size).alias("ties"))
    x = sums.join(F.broadcast(totals), "pheno").withColumn("zeros", F.col("n0") + F.col("n1") - F.col("above")).withColumn("zeros0", F.col("n0") - F.col("above0"))
    x = x.withColumn("w", F.col("_w") + F.col("zeros") * F.col("above0"))
    zero = F.greatest(F.col("zeros") - (1 if reference_ties else 0), F.lit(0)).cast("double")
    m, k, n = F.col("n0").cast("double"), F.col("n1").cast("double"), (F.col("n0") + F.col("n1")).cast("double")
    w = F.col("w") + F.col("zeros0") * (F.col("zeros") + 1) / 2
    ties = F.col("ties") + F.pow(zero, F.lit(3)) - zero
    var = m * k / 12 * ((n + 1) - ties / (n * (n - 1)))
    return x.select(*KEY, w.alias("w"), F.when((F.col("above") > 0) & (var > 0), (w - m * (n + 1) / 2) / F.sqrt(var)).alias("z"))


def sufficient(burdens: DataFrame, traits: DataFrame) -> DataFrame:
    """pheno, kind, bin and n, sx, sy, sxx, sxy, syy of burden x and trait y over all samples of ``traits``.

    ``traits``: sample_id, y. Samples at burden 0 count through the trait's totals.
    """
    total = traits.agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    x, y = F.col("burden"), F.col("y")
    own = burdens.join(traits.hint("shuffle_hash"), "sample_id").groupBy(*KEY).agg(F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    return own.join(F.broadcast(total))


def linear(sums: DataFrame) -> DataFrame:
    """slope, its standard error and t of the regression of trait on burden; null where burden does not vary."""
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy"))
    vx = sxx - sx * sx / n
    beta = (sxy - sx * sy / n) / vx
    rss = (syy - sy * sy / n) - beta * (sxy - sx * sy / n)
    se = F.sqrt(rss / (n - 2) / vx)
    known = (vx > 1e-9) & (n > 2)
    return sums.select(*KEY, "n", F.when(known, beta).alias("beta"), F.when(known, se).alias("se"), F.when(known & (se > 0), beta / se).alias("t"))


def residual(f0: Column, f1: Column) -> Column:
    """|control - case| / sqrt 2, or -1 where either frequency is negative (unknown)."""
    return F.when((f0 < 0) | (f1 < 0), -1.0).otherwise(F.abs(f0 - f1) / F.sqrt(F.lit(2.0)))
