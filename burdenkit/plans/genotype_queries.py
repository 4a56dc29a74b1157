"""Queries of genotype coding, filters, frequencies and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genotype as g
from ..operators import genotypes as ops
from . import views as v
from .registry import query
from .views import sql


def _counts(spark, d, model="additive"):
    return ops.status_counts(ops.dosages(v.calls(spark, d)), v.status(spark, d), model)


@query("agg_allele_counts", sql("SELECT locus_id, allele, n FROM allele_counts"))
def agg_allele_counts(spark, d):
    return ops.allele_counts(v.calls(spark, d))


@query("agg_major_allele", sql("SELECT locus_id, major, n_major, n_all FROM major"))
def agg_major_allele(spark, d):
    return ops.major_alleles(ops.allele_counts(v.calls(spark, d)))


@query("prj_dosage", sql("SELECT locus_id, sample_id, dosage FROM dosages"))
def prj_dosage(spark, d):
    return ops.dosages(v.calls(spark, d))


@query("prj_disease_model", sql("SELECT locus_id, sample_id, dosage AS additive, CAST(dosage > 0 AS BIGINT) AS dominant, CAST(dosage > 1 AS BIGINT) AS recessive FROM dosages"))
def prj_disease_model(spark, d):
    dose = F.col("dosage")
    return ops.dosages(v.calls(spark, d)).select("locus_id", "sample_id", *[g.coded(dose, m).alias(m) for m in ("additive", "dominant", "recessive")])


_GT = """SELECT l_partkey AS locus_id, l_orderkey AS order_id, l_linenumber AS line,
  CASE l_linenumber % 7 WHEN 0 THEN './1' WHEN 1 THEN '1' WHEN 2 THEN '0/0/0' ELSE CAST(l_discount >= 0.10 AS INT)::VARCHAR || CASE WHEN l_linenumber % 2 = 0 THEN '|' ELSE '/' END || CAST(l_tax >= 0.08 AS INT)::VARCHAR END AS gt,
  CASE l_returnflag WHEN 'R' THEN 'q10' WHEN 'A' THEN 'PASS' ELSE '.' END AS ft FROM lineitem"""


def _raw_calls(spark, d):
    """Order lines as GT and FT fields of all forms: missing, haploid, triploid, phased and unphased."""
    n = F.col("l_linenumber") % 7
    two = F.concat((F.col("l_discount") >= 0.10).cast("int").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "|").otherwise("/"), (F.col("l_tax") >= 0.08).cast("int").cast("string"))
    gt = F.when(n == 0, "./1").when(n == 1, "1").when(n == 2, "0/0/0").otherwise(two)
    ft = F.when(F.col("l_returnflag") == "R", "q10").when(F.col("l_returnflag") == "A", "PASS").otherwise(".")
    return v.read(spark, d, "lineitem").select(F.col("l_partkey").alias("locus_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), gt.alias("gt"), ft.alias("ft"))


@query("prj_split_gt", sql("SELECT locus_id, order_id, line, CASE WHEN line % 7 > 2 THEN CAST(gt[1] AS BIGINT) END AS a1, CASE WHEN line % 7 > 2 THEN CAST(gt[3] AS BIGINT) END AS a2 FROM raw", raw=_GT))
def prj_split_gt(spark, d):
    x = _raw_calls(spark, d).withColumn("call", g.call_alleles(F.col("gt")))
    return x.select("locus_id", "order_id", "line", F.col("call")[0].alias("a1"), F.col("call")[1].alias("a2"))


@query("flt_genotype_ft", sql("SELECT locus_id, order_id, line, CASE WHEN ft <> 'q10' THEN gt END AS gt FROM raw", raw=_GT))
def flt_genotype_ft(spark, d):
    call = F.concat_ws(":", "gt", F.lit("9"), "ft")
    return _raw_calls(spark, d).select("locus_id", "order_id", "line", g.kept_call(call, F.lit("GT:DP:FT")).alias("gt"))


_STAR = "SELECT *, CASE WHEN locus_id % 3 = 0 THEN '*' ELSE 'C' END AS alt1 FROM calls WHERE a1 IS NOT NULL AND a2 < 2"


@query("prj_star_allele", sql("""SELECT locus_id, sample_id, CASE WHEN alt1 = '*' THEN 0 ELSE a1 END AS ref1, CASE WHEN alt1 = '*' THEN 0 ELSE a2 END AS ref2,
  CASE WHEN alt1 = '*' AND (a1 = 1 OR a2 = 1) THEN NULL ELSE a1 END AS miss1, CASE WHEN alt1 = '*' AND (a1 = 1 OR a2 = 1) THEN NULL ELSE a2 END AS miss2 FROM starred""", starred=_STAR))
def prj_star_allele(spark, d):
    c = v.calls(spark, d).filter("a1 IS NOT NULL AND a2 < 2")
    alleles = F.array(F.lit("A"), F.when(F.col("locus_id") % 3 == 0, "*").otherwise("C"))
    call = F.array("a1", "a2")
    x = c.select("locus_id", "sample_id", g.star_as(alleles, call).alias("r"), g.star_as(alleles, call, reference=False).alias("m"))
    return x.select("locus_id", "sample_id", F.col("r")[0].alias("ref1"), F.col("r")[1].alias("ref2"), F.col("m")[0].alias("miss1"), F.col("m")[1].alias("miss2"))


@query("flt_marker_pass", sql("SELECT p_partkey AS locus_id, CASE p_size % 5 WHEN 0 THEN 'q10' WHEN 1 THEN '.' ELSE 'PASS' END AS mark FROM part WHERE p_size % 5 <> 0"))
def flt_marker_pass(spark, d):
    k = F.col("p_size") % 5
    mark = F.when(k == 0, "q10").when(k == 1, ".").otherwise("PASS")
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("locus_id"), mark.alias("mark")).filter(g.filter_passes(F.col("mark")))


@query("prj_locus_id", sql("SELECT locus_id, CASE WHEN locus_id % 4 = 0 THEN 'chr' || chr || '-' || pos || '-A' ELSE id END AS label, CASE WHEN locus_id % 4 = 0 THEN 'chr' || chr || '-' || pos || '-A-A' ELSE id END AS label_twice FROM loci"))
def prj_locus_id(spark, d):
    label = F.when(F.col("locus_id") % 4 == 0, ".").otherwise(F.col("id"))
    args = (label, F.col("chr"), F.col("pos"), F.col("ref"))
    return v.loci(spark, d).select("locus_id", g.locus_label(*args).alias("label"), g.locus_label(*args, repeat_ref=True).alias("label_twice"))


@query("fn_chromosome", sql("SELECT p_partkey AS locus_id, CASE WHEN k < 22 THEN k + 1 WHEN k < 26 THEN k + 1 END AS chr FROM (SELECT p_partkey, p_partkey % 28 AS k FROM part)"))
def fn_chromosome(spark, d):
    k = F.col("p_partkey") % 28
    names = F.array(*[F.lit(f"chr{c}" if i % 2 else c) for i, c in enumerate([*map(str, range(1, 23)), "x", "Y", "X|Y", "M", "UN", "6_hap"])])
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("locus_id"), g.chromosome_code(F.element_at(names, (k + 1).cast("int"))).cast("long").alias("chr"))


@query("fn_scalars", sql("""SELECT p_partkey AS k, CASE WHEN p_size % 6 < 2 THEN 'intron' WHEN p_size % 6 = 2 THEN 'exon' WHEN p_size % 6 = 3 THEN 'reg' ELSE 'other' END AS role,
  'NC_' || p_partkey AS accession, 'CEU-RS' || printf('%.2f', (p_size % 10) / 10.0) AS profile, replace(p_name, ' ', '_') AS name FROM part"""))
def fn_scalars(spark, d):
    code = F.element_at(F.array(*[F.lit(x) for x in ("intron", "splice-5", "missense", "utr-3", "unknown", "near-gene")]), (F.col("p_size") % 6 + 1).cast("int"))
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("k"), g.role_class(code).alias("role"), g.without_version(F.concat(F.lit("NC_"), F.col("p_partkey").cast("string"), F.lit(".3"))).alias("accession"), g.profile_name(F.lit("CEU"), F.lit("RS"), (F.col("p_size") % 10) / 10).alias("profile"), g.escaped(F.col("p_name"), " ").alias("name"))


@query("flt_samples", sql("SELECT sample_id, name FROM samples WHERE nation < 15 AND segment <> 'FURNITURE'"))
def flt_samples(spark, d):
    s = v.samples(spark, d)
    return ops.included_samples(s, s.filter("nation < 15").select("name"), s.filter("segment = 'FURNITURE'").select("name")).select("sample_id", "name")


@query("flt_all_missing_pheno", sql("SELECT sample_id FROM samples WHERE trait IS NOT NULL"))
def flt_all_missing_pheno(spark, d):
    s = v.samples(spark, d)
    return s.join(v.status(spark, d).select("sample_id"), "sample_id", "left_semi").select("sample_id")


_COV = "SELECT sample_id, 'nation' AS covariate, CASE WHEN nation <> 3 THEN CAST(nation AS DOUBLE) END AS value FROM samples UNION ALL SELECT sample_id, 'balance', trait FROM samples"


def covariates(spark, d):
    """sample_id, covariate, value (null: missing)."""
    s = v.samples(spark, d)
    nation = s.select("sample_id", F.lit("nation").alias("covariate"), F.when(F.col("nation") != 3, F.col("nation").cast("double")).alias("value"))
    return nation.union(s.select("sample_id", F.lit("balance"), "trait"))


@query("flt_complete_covariates", sql("SELECT sample_id FROM covs GROUP BY sample_id HAVING count(value) = count(*)", covs=_COV))
def flt_complete_covariates(spark, d):
    c = covariates(spark, d)
    return v.samples(spark, d).join(c.filter("value IS NULL").select("sample_id"), "sample_id", "left_anti").select("sample_id")


@query("prj_case_control", sql("SELECT pheno, sample_id, is_case FROM status"))
def prj_case_control(spark, d):
    x = v.status(spark, d).select("pheno", "sample_id", F.col("is_case").cast("double").alias("value"))
    return ops.case_control(x, least_share=0.0)


@query("flt_min_control_frac", sql("SELECT pheno, sample_id, is_case AND NOT few AS is_case FROM (SELECT *, avg(CAST(NOT is_case AS DOUBLE)) OVER (PARTITION BY pheno) < 0.7 AS few FROM status)"))
def flt_min_control_frac(spark, d):
    x = v.status(spark, d).select("pheno", "sample_id", F.col("is_case").cast("double").alias("value"))
    return ops.case_control(x, least_share=0.7)


@query("flt_monomorphic", sql("SELECT m.locus_id, n_all, n_major, contribution FROM major m JOIN (SELECT locus_id, sum(dosage)::BIGINT AS contribution FROM dosages GROUP BY 1) USING (locus_id) WHERE n_all > n_major AND contribution > 0"))
def flt_monomorphic(spark, d):
    c = v.calls(spark, d)
    majors = ops.major_alleles(ops.allele_counts(c))
    total = ops.dosages(c, majors).groupBy("locus_id").agg(F.sum("dosage").alias("contribution"))
    return majors.filter("n_all > n_major").join(total, "locus_id").filter("contribution > 0").select("locus_id", "n_all", "n_major", "contribution")


@query("agg_maf", sql("""SELECT pheno, locus_id, n0, m0, n1, m1, round(CASE WHEN n0 > 0 THEN least(m0 / (2.0 * n0), 1 - m0 / (2.0 * n0)) END, 6) AS maf0,
  round(CASE WHEN n1 > 0 THEN least(m1 / (2.0 * n1), 1 - m1 / (2.0 * n1)) END, 6) AS maf1 FROM wide"""))
def agg_maf(spark, d):
    x = ops.frequencies(_counts(spark, d))
    return x.select("pheno", "locus_id", "n0", "m0", "n1", "m1", F.round("maf0", 6).alias("maf0"), F.round("maf1", 6).alias("maf1"))


@query("agg_avg_genotype", sql("SELECT locus_id, round(avg(dosage), 6) AS additive, round(avg(CAST(dosage > 0 AS INT)), 6) AS dominant FROM dosages GROUP BY locus_id"))
def agg_avg_genotype(spark, d):
    return ops.dosages(v.calls(spark, d)).groupBy("locus_id").agg(F.round(F.avg("dosage"), 6).alias("additive"), F.round(F.avg(g.coded(F.col("dosage"), "dominant")), 6).alias("dominant"))


@query("agg_total_contribution", sql("SELECT locus_id, coalesce(sum(dosage), 0)::BIGINT AS additive, coalesce(sum(CAST(dosage > 0 AS INT)), 0)::BIGINT AS dominant, coalesce(sum(CAST(dosage > 1 AS INT)), 0)::BIGINT AS recessive FROM dosages GROUP BY 1"))
def agg_total_contribution(spark, d):
    made = [F.coalesce(F.sum(g.coded(F.col("dosage"), m)), F.lit(0)).alias(m) for m in ("additive", "dominant", "recessive")]
    return ops.dosages(v.calls(spark, d)).groupBy("locus_id").agg(*made)


@query("flt_rare", sql("SELECT pheno, locus_id, m0, n0, m1, n1 FROM rare_loci"))
def flt_rare(spark, d):
    return ops.rare_loci(_counts(spark, d)).select("pheno", "locus_id", "m0", "n0", "m1", "n1")


@query("flt_present", sql("SELECT pheno, locus_id FROM wide WHERE n0 + n1 > 0"))
def flt_present(spark, d):
    return _counts(spark, d).filter("n0 + n1 > 0").select("pheno", "locus_id")


_MB = "CASE WHEN {n} > 0 THEN (2 * {n} + 2) / sqrt({n}::DOUBLE * ({m} + 1) * (2 * {n} - {m} + 1)) ELSE 1.0 END"
_W0, _W1, _WA = _MB.format(n="n0", m="m0"), _MB.format(n="n1", m="m1"), _MB.format(n="(n0 + n1)", m="(m0 + m1)")


def _model_sql(f: str) -> str:
    return f"CASE WHEN n1 = 0 THEN {_W0} WHEN n0 = 0 THEN {_W1} ELSE {f} END"


@query("agg_madsen_browning", sql(f"SELECT pheno, locus_id, round({_model_sql(f'least({_W0}, {_W1})')}, 6) AS minimum, round({_model_sql(f'greatest({_W0}, {_W1})')}, 6) AS maximum, round({_model_sql(_W0)}, 6) AS control, round({_WA}, 6) AS overall FROM wide"))
def agg_madsen_browning(spark, d):
    x = _counts(spark, d)
    for m in ("minimum", "maximum", "control", "overall"):
        x = ops.weighted(x, m).withColumnRenamed("weight", m)
    return x.select("pheno", "locus_id", *[F.round(m, 6).alias(m) for m in ("minimum", "maximum", "control", "overall")])


@query("agg_pheno_counts", sql("SELECT p.pheno, count(*) FILTER (is_case) AS cases, count(*) FILTER (NOT is_case) AS controls, count(*) FILTER (is_case IS NULL) AS missing FROM (samples CROSS JOIN phenos p) LEFT JOIN status s ON s.pheno = p.pheno AND s.sample_id = samples.sample_id GROUP BY 1"))
def agg_pheno_counts(spark, d):
    known = v.status(spark, d).groupBy("pheno").agg(F.count_if("is_case").alias("cases"), F.count_if(~F.col("is_case")).alias("controls"))
    total = v.samples(spark, d).agg(F.count("*").alias("total"))
    return known.join(F.broadcast(total)).select("pheno", "cases", "controls", (F.col("total") - F.col("cases") - F.col("controls")).alias("missing"))


@query("join_calls_status", sql("SELECT pheno, locus_id, is_case, n, m FROM freqs"))
def join_calls_status(spark, d):
    x = ops.dosages(v.calls(spark, d)).join(v.status(spark, d), "sample_id")
    return x.groupBy("pheno", "locus_id", "is_case").agg(F.count("dosage").alias("n"), F.coalesce(F.sum("dosage"), F.lit(0)).alias("m"))


@query("sort_loci", sql("SELECT locus_id, chr, pos, id, row_number() OVER (PARTITION BY chr ORDER BY pos, id) AS place FROM loci"))
def sort_loci(spark, d):
    from pyspark.sql import Window

    x = v.loci(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("chr").orderBy("pos", "id")).cast("long"))
    return x.select("locus_id", "chr", "pos", "id", "place").orderBy("chr", "pos", "id")
