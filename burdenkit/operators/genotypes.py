"""Allele counts, frequencies, weights and the choice of rare loci, over long calls (locus, sample)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype as g


def allele_counts(calls: DataFrame) -> DataFrame:
    """locus_id, allele, n over both alleles of each call."""
    return calls.select("locus_id", F.explode(F.array("a1", "a2")).alias("allele")).filter("allele IS NOT NULL").groupBy("locus_id", "allele").agg(F.count("*").alias("n"))


def major_alleles(counts: DataFrame) -> DataFrame:
    """locus_id, major (most frequent, ties to the lowest), n_major, n_all."""
    return counts.groupBy("locus_id").agg(F.max(F.struct(F.col("n"), (-F.col("allele")).alias("k"))).alias("x"), F.sum("n").alias("n_all")).select("locus_id", (-F.col("x.k")).alias("major"), F.col("x.n").alias("n_major"), "n_all")


def dosages(calls: DataFrame, majors: DataFrame | None = None) -> DataFrame:
    """locus_id, sample_id, dosage. Loci without any call keep their rows with null dosage."""
    majors = major_alleles(allele_counts(calls)) if majors is None else majors
    # rows without locus stay apart, so that both sides of the join read calls with one filter
    joined = calls.filter("locus_id IS NOT NULL").join(majors.select("locus_id", "major"), "locus_id", "left")
    joined = joined.unionByName(calls.filter("locus_id IS NULL").withColumn("major", F.lit(None).cast("long")).select(joined.columns))
    return joined.select("locus_id", "sample_id", g.dosage(F.col("a1"), F.col("a2"), F.col("major")).alias("dosage"))


#: Samples up to which their statuses are broadcast, and phenotypes whose statuses share a number.
LISTED, PACKED = 1_000_000, 30


def _packed_status(status: DataFrame) -> tuple[DataFrame, list[list[str]]]:
    """sample_id and columns _m0, _m1, ...: two bits a phenotype, 1 for a control, 2 for a case, 3 without a value; and the
    phenotypes of each column. A sample that has several rows for a phenotype has as many rows."""
    known = status.filter("pheno IS NOT NULL AND sample_id IS NOT NULL")
    names = sorted(r["pheno"] for r in known.select("pheno").distinct().collect())
    parts = [names[i : i + PACKED] for i in range(0, len(names), PACKED)] or [[""]]
    once = known.withColumn("_copy", F.row_number().over(Window.partitionBy("sample_id", "pheno").orderBy("is_case")))
    value = F.when(F.col("is_case").isNull(), 3).when(F.col("is_case"), 2).otherwise(1).cast("long")

    def mask(part: list[str]) -> Column:
        bits = F.create_map(*[F.lit(x) for i, n in enumerate(part) for x in (n, 4**i)]).cast("map<string,bigint>")
        return F.coalesce(F.sum(F.try_element_at(bits, F.col("pheno")) * value), F.lit(0).cast("long"))

    return once.groupBy("sample_id", "_copy").agg(*[mask(p).alias(f"_m{i}") for i, p in enumerate(parts)]).drop("_copy"), parts


def status_counts(doses: DataFrame, status: DataFrame, model: str = "additive") -> DataFrame:
    """pheno, locus_id, and of controls (0) and cases (1): genotypes n0, n1, non-major alleles m0, m1, contributions c0, c1.

    One pass for all phenotypes: calls meet a number per sample that holds its statuses, and are summed by locus and that number;
    only these sums are spread over phenotypes. Numbers of up to LISTED samples are broadcast.
    """
    of, parts = _packed_status(status)
    masks = [c for c in of.columns if c != "sample_id"]
    if of.count() <= LISTED:
        of = F.broadcast(of)
    dose = F.col("dosage")
    x = doses.join(of, "sample_id").groupBy("locus_id", *masks).agg(F.count(dose).alias("n"), F.sum(dose).alias("m"), F.sum(g.coded(dose, model)).alias("c"))
    codes = F.flatten(F.array(*[F.array(*[F.struct(F.lit(name).alias("pheno"), F.shiftright(m, 2 * i).bitwiseAND(F.lit(3)).alias("code")) for i, name in enumerate(part)]) for m, part in zip(masks, parts, strict=True)]))
    rows = x.select("locus_id", "n", "m", "c", F.explode(F.filter(codes, lambda s: s["code"] > 0)).alias("_s")).select("_s.pheno", "locus_id", "_s.code", "n", "m", "c")
    made = [F.coalesce(F.sum(F.when(F.col("code") == k + 1, F.col(v))), F.lit(0)).alias(f"{v}{k}") for k in (0, 1) for v in ("n", "m", "c")]
    return rows.groupBy("pheno", "locus_id").agg(*made)


def frequencies(counts: DataFrame) -> DataFrame:
    """Adds maf0 and maf1."""
    return counts.withColumn("maf0", g.folded(F.col("m0"), F.col("n0"))).withColumn("maf1", g.folded(F.col("m1"), F.col("n1")))


def is_rare(cutoff: float = 0.05, threshold: float = 0.0, use_cases: bool = False) -> Column:
    """Control frequency within [threshold, cutoff] (with ``use_cases`` the cases' may be instead)."""
    own = g.within(F.col("m0"), F.col("n0"), threshold, cutoff)
    return own | g.within(F.col("m1"), F.col("n1"), threshold, cutoff) if use_cases else own


def rare_loci(counts: DataFrame, cutoff: float = 0.05, threshold: float = 0.0, use_cases: bool = False) -> DataFrame:
    """Rows of ``counts`` that are polymorphic, present and rare for their phenotype."""
    return counts.filter(F.col("c0") + F.col("c1") > 0).filter(F.col("n0") + F.col("n1") > 0).filter(is_rare(cutoff, threshold, use_cases))


def weighted(counts: DataFrame, model: str = "minimum") -> DataFrame:
    """Adds weight: Madsen-Browning of controls and cases combined as minimum, maximum, control or overall."""
    w0, w1 = (g.madsen_browning(F.col(f"m{k}"), F.col(f"n{k}")) for k in (0, 1))
    both = {"minimum": F.least(w0, w1), "maximum": F.greatest(w0, w1), "control": w0}
    if model == "overall":
        return counts.withColumn("weight", g.madsen_browning(F.col("m0") + F.col("m1"), F.col("n0") + F.col("n1")))
    if model not in both:
        raise ValueError(f"no weight model {model}")
    return counts.withColumn("weight", F.when(F.col("n1") == 0, w0).when(F.col("n0") == 0, w1).otherwise(both[model]))


def case_control(traits: DataFrame, control: float = 0.0, least_share: float = 0.125, all_control: bool = False) -> DataFrame:
    """(pheno, sample_id, value) -> (pheno, sample_id, is_case), null values left out.

    Where controls are under ``least_share`` of a phenotype's samples, or with ``all_control``, all are controls.
    """
    known = traits.filter("value IS NOT NULL").withColumn("is_case", F.col("value") != control)
    share = known.groupBy("pheno").agg(F.avg((~F.col("is_case")).cast("double")).alias("_share"))
    few = F.lit(True) if all_control else F.col("_share") < least_share
    return known.join(F.broadcast(share), "pheno").select("pheno", "sample_id", F.when(few, False).otherwise(F.col("is_case")).alias("is_case"))


def included_samples(samples: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Samples named in ``include`` (if given) and not in ``exclude``, by column name."""
    if include is not None:
        samples = samples.join(include, "name", "left_semi")
    return samples if exclude is None else samples.join(exclude, "name", "left_anti")
