"""Queries of readers and source normalisation. Input lines and rows are rendered from the tables, then parsed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import genotype as g
from ..functions.storage import remove, shared_folder
from ..sources import etl, knowledge_file, text, vcf
from ..operators import intervals as iv
from . import views as v
from .registry import query
from .views import sql


def _s(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def vcf_lines(spark, d):
    """Variant lines: a line per locus and a call (GT:DP:FT) per nation, that of its first customer; plus header lines; n is the line's place."""
    c = v.calls(spark, d).join(v.samples(spark, d).select("sample_id", "nation"), "sample_id")
    first = c.groupBy("locus_id", "nation").agg(F.min(F.struct("sample_id", "a1", "a2")).alias("x"))
    gt = F.when(F.col("x.a1").isNull(), "./.").otherwise(F.concat(_s("x.a1"), F.lit("|"), _s("x.a2")))
    call = F.concat_ws(":", gt, F.lit("9"), F.when(F.col("x.sample_id") % 11 == 0, "q10").otherwise("PASS"))
    per = first.groupBy("locus_id").agg(F.map_from_entries(F.collect_list(F.struct("nation", call.alias("call")))).alias("m"))
    part = v.read(spark, d, "part").select(F.col("p_partkey").alias("locus_id"), F.when(F.col("p_size") % 5 == 0, "q10").when(F.col("p_size") % 5 == 1, ".").otherwise("PASS").alias("mark"))
    x = v.loci(spark, d).join(part, "locus_id").join(per, "locus_id", "left")
    calls = F.expr("array_join(transform(sequence(0, 24), i -> coalesce(try_element_at(m, cast(i as bigint)), '.')), '\t')")
    body = x.select(F.concat_ws("\t", F.concat(F.lit("chr"), _s("chr")), _s("pos"), F.when(F.col("locus_id") % 4 == 0, ".").otherwise(F.col("id")), "ref", "alt", F.lit("."), "mark", F.lit("."), F.lit("GT:DP:FT"), calls).alias("value"), (F.col("locus_id") + 1000).alias("n"))
    n = v.read(spark, d, "nation")
    contig = n.select(F.concat(F.lit("##contig=<ID=chr"), _s(F.col("n_nationkey") + 1), F.lit(",length=1,assembly=GRCh"), _s(37 + F.col("n_regionkey") % 2), F.lit(">")).alias("value"), v.long("n_nationkey").alias("n"))
    names = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda z: z["n_name"]), "\t").alias("_n"))
    head = names.select(F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), "_n").alias("value"), F.lit(100).cast("long").alias("n"))
    return contig.union(head).union(body)


_VCF = """SELECT locus_id, nation, arg_min({'a1': a1, 'a2': a2, 's': sample_id}, sample_id) AS x FROM calls JOIN samples USING (sample_id) GROUP BY ALL"""


@query("src_vcf_header", "SELECT 'sample' AS what, CAST(n_nationkey AS BIGINT) AS place, n_name AS value FROM nation UNION ALL SELECT DISTINCT 'build', -1, 'GRCh' || (37 + n_regionkey % 2) FROM nation WHERE n_nationkey < 24")
def src_vcf_header(spark, d):
    x = vcf_lines(spark, d)
    names = vcf.sample_names(x).select(F.lit("sample").alias("what"), v.long("pos").alias("place"), F.col("name").alias("value"))
    return names.union(vcf.builds(x).select(F.lit("build"), F.lit(-1).cast("long"), "build"))


@query("chk_genome_build", "SELECT count(DISTINCT 37 + n_regionkey % 2) AS builds, count(DISTINCT 37 + n_regionkey % 2) = 1 AS usable_without, bool_or(n_regionkey % 2 = 0) AS has_37 FROM nation WHERE n_nationkey < 24")
def chk_genome_build(spark, d):
    x = vcf.builds(vcf_lines(spark, d))
    return x.agg(F.count("*").alias("builds"), (F.count("*") == 1).alias("usable_without"), F.bool_or(F.col("build") == "GRCh37").alias("has_37"))


_CALLED = "SELECT l.chr, l.pos, CASE WHEN l.locus_id % 4 = 0 THEN 'chr' || l.chr || '-' || l.pos || '-A' ELSE l.id END AS id, n_nationkey AS sample, CASE WHEN x.s % 11 <> 0 AND x.a1 IS NOT NULL THEN x.a1 END AS a1, CASE WHEN x.s % 11 <> 0 AND x.a1 IS NOT NULL THEN x.a2 END AS a2 FROM loci l JOIN part ON l.locus_id = p_partkey CROSS JOIN nation LEFT JOIN fv ON fv.locus_id = l.locus_id AND fv.nation = n_nationkey WHERE p_size % 5 <> 0"


@query("src_vcf_calls", sql("SELECT * FROM called", fv=_VCF, called=_CALLED))
def src_vcf_calls(spark, d):
    return vcf.long_calls(vcf.variants(vcf_lines(spark, d)))


@query("src_vcf_codec", sql("SELECT chr, pos, CASE WHEN locus_id % 4 = 0 THEN '.' ELSE id END AS id, CAST(25 AS INT) AS calls FROM loci UNION ALL SELECT -1, -1, '#', count(*)::INT + 1 FROM nation"))
def src_vcf_codec(spark, d):
    """The variant lines written as block gzip (.z), a file of which many tasks read in ranges, and parsed; a row counts the header lines."""
    folder = f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}"
    vcf.write_block_gzip(vcf_lines(spark, d).repartition(2), folder)
    x = vcf.lines(spark, f"{folder}/*.z", chunk=1 << 16)
    f = F.split("value", "\t")
    rows = x.filter(~F.col("value").startswith("#")).select(g.chromosome_code(f[0]).cast("long").alias("chr"), f[1].try_cast("bigint").alias("pos"), f[2].alias("id"), (F.size(f) - 9).alias("calls"))
    heads = x.filter(F.col("value").startswith("#")).agg(F.count("*").cast("int").alias("calls"))
    return rows.unionByName(heads.select(F.lit(-1).cast("long").alias("chr"), F.lit(-1).cast("long").alias("pos"), F.lit("#").alias("id"), "calls"))


@query("src_trait_file", "SELECT c_name AS name, 'balance' AS trait, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS value FROM customer WHERE c_custkey % 9 <> 0 UNION ALL SELECT c_name, 'nation', c_nationkey::DOUBLE FROM customer WHERE c_custkey % 9 <> 0")
def src_trait_file(spark, d):
    c = v.read(spark, d, "customer")
    rows = c.select(F.concat_ws("  ", "c_name", F.when(F.col("c_acctbal") >= 0, _s("c_acctbal")).otherwise("NA"), _s("c_nationkey"), F.lit("x")).alias("value"))
    head = spark.range(1).select(F.lit("#ID balance nation junk").alias("value"))
    return text.traits(head.union(rows), c.filter("c_custkey % 9 <> 0").select(F.col("c_name").alias("name")))


@query("src_sample_list", "SELECT DISTINCT c_name AS name FROM customer")
def src_sample_list(spark, d):
    return text.sample_list(v.read(spark, d, "customer").select(F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("value")))


def _region_lines(spark, d):
    r = v.regions(spark, d)
    swap = F.col("region_id") % 2 == 1
    return r.select(F.concat_ws("\t", F.concat(F.lit("chr"), _s("chr")), F.concat(F.lit("N"), _s("nation")), _s(F.when(swap, F.col("pos_max")).otherwise(F.col("pos_min"))), _s(F.when(swap, F.col("pos_min")).otherwise(F.col("pos_max")))).alias("value"))


@query("src_region_file", sql("SELECT 1000 + dense_rank() OVER (ORDER BY 'N' || nation) AS region_id, 'N' || nation AS name, chr, pos_min, pos_max FROM regions"))
def src_region_file(spark, d):
    return text.regions(_region_lines(spark, d), after=1000)


def _span_lines(spark, d, value):
    r = v.regions(spark, d)
    high = F.when(F.col("region_id") % 4 == 0, F.col("pos_min")).otherwise(F.col("pos_max"))
    gene = F.when(F.col("region_id") % 3 == 0, F.regexp_replace("name", "#", "_")).when(F.col("region_id") % 3 == 1, "nosuchgene")
    return r.select(F.concat_ws(" ", _s("chr"), value, _s("pos_min"), _s(high), gene).alias("value")), r.select(F.regexp_replace("name", "#", "_").alias("name"), "region_id")


_SPAN = "chr, pos_min, CASE WHEN region_id % 4 = 0 THEN pos_min ELSE pos_max END AS pos_max, region_id % 4 = 0 AS point, CASE WHEN region_id % 3 = 0 THEN region_id END AS region_id FROM regions WHERE region_id % 3 <> 1"


@query("src_role_file", sql(f"SELECT DISTINCT CASE WHEN region_id % 2 = 0 THEN 'exon' ELSE 'mine' END AS role, {_SPAN}"))
def src_role_file(spark, d):
    lines, names = _span_lines(spark, d, F.when(F.col("region_id") % 2 == 0, "exon").otherwise("mine"))
    return text.spans(lines, "role", names).select("role", "chr", "pos_min", "pos_max", "point", "region_id")


@query("src_weight_file", sql(f"SELECT DISTINCT 0.5::DOUBLE * (region_id % 5) AS weight, {_SPAN}"))
def src_weight_file(spark, d):
    lines, names = _span_lines(spark, d, _s(F.col("region_id") % 5 * 0.5))
    return text.spans(lines, "weight", names).select(F.col("weight").try_cast("double").alias("weight"), "chr", "pos_min", "pos_max", "point", "region_id")


@query("src_group_archive", "SELECT lower(r_name) AS source, n_name AS name, 'suppliers of ' || n_name AS description, s_name AS alias FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def src_group_archive(spark, d):
    n, s, r = v.read(spark, d, "nation"), v.read(spark, d, "supplier"), v.read(spark, d, "region")
    top = r.select(_s("r_regionkey").alias("file"), F.lit(-1).cast("long").alias("n"), F.lower("r_name").alias("value"))
    heads = n.select(_s("n_regionkey").alias("file"), (F.col("n_nationkey") * F.lit(10**12)).alias("n"), F.concat(F.lit("GROUP "), "n_name", F.lit(" suppliers of "), "n_name").alias("value"))
    body = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(_s("n_regionkey").alias("file"), (F.col("n_nationkey") * F.lit(10**12) + 1 + F.col("s_suppkey")).alias("n"), F.col("s_name").alias("value"))
    return text.archive(top.union(heads).union(body))


#: Every knowledge table made of the given ones, in SQL that Spark and DuckDB share.
_KNOWLEDGE = {
    "setting": "SELECT r_name AS setting, CAST(r_regionkey AS STRING) AS value FROM {region}",
    "grch_ucschg": "SELECT r_regionkey + 36 AS grch, r_regionkey + 17 AS ucschg FROM {region}",
    "ldprofile": "SELECT r_regionkey AS ldprofile_id, r_name AS ldprofile, 'made' AS description, 'rsq' AS metric, 0.5 AS value FROM {region}",
    "namespace": "SELECT n_nationkey AS namespace_id, n_name AS namespace, n_nationkey % 2 AS polygenic FROM {nation}",
    "relationship": "SELECT r_regionkey AS relationship_id, lower(r_name) AS relationship FROM {region}",
    "role": "SELECT n_nationkey AS role_id, n_name AS role, n_name AS description, n_nationkey % 2 AS coding, n_nationkey % 3 AS exon FROM {nation}",
    "source": "SELECT n_nationkey AS source_id, n_name AS source, CAST(NULL AS STRING) AS updated, 'v1' AS version, 37 AS grch, 19 AS ucschg, 19 AS current_ucschg FROM {nation}",
    "source_option": "SELECT n_nationkey AS source_id, n_name AS option, CAST(n_regionkey AS STRING) AS value FROM {nation}",
    "source_file": "SELECT n_nationkey AS source_id, n_name AS filename, n_regionkey * 1000 AS size, CAST(NULL AS STRING) AS modified FROM {nation}",
    "type": "SELECT r_regionkey AS type_id, r_name AS type FROM {region}",
    "warning": "SELECT s_suppkey AS warning_id, s_nationkey AS source_id, s_name AS warning FROM {supplier} WHERE s_suppkey % 9 = 0",
    "snp_merge": "SELECT p_partkey * 2 AS rsMerged, p_partkey AS rsCurrent, 1 AS source_id FROM {part}",
    "snp_locus": "SELECT l_partkey AS rs, l_partkey % 22 + 1 AS chr, l_orderkey AS pos, l_linenumber % 2 AS validated, 1 AS source_id FROM {lineitem}",
    "snp_entrez_role": "SELECT l_partkey AS rs, l_suppkey AS entrez_id, l_linenumber AS role_id, 2 AS source_id FROM {lineitem}",
    "snp_biopolymer_role": "SELECT l_partkey AS rs, l_suppkey + 1 AS biopolymer_id, l_linenumber AS role_id, 2 AS source_id FROM {lineitem}",
    "biopolymer": "SELECT s_suppkey AS biopolymer_id, 1 AS type_id, s_name AS label, CAST(NULL AS STRING) AS description, s_nationkey AS source_id FROM {supplier}",
    "biopolymer_name": "SELECT s_suppkey AS biopolymer_id, s_nationkey AS namespace_id, s_name AS name, 3 AS source_id FROM {supplier}",
    "biopolymer_name_name": "SELECT s_nationkey AS namespace_id, s_name AS name, 1 AS type_id, 2 AS new_namespace_id, lower(s_name) AS new_name, 3 AS source_id FROM {supplier}",
    "biopolymer_region": "SELECT s_suppkey AS biopolymer_id, 0 AS ldprofile_id, s_suppkey % 22 + 1 AS chr, s_suppkey * 100 AS posMin, s_suppkey * 100 + 99 AS posMax, 3 AS source_id FROM {supplier}",
    "biopolymer_zone": "SELECT s_suppkey AS biopolymer_id, s_suppkey % 22 + 1 AS chr, s_suppkey % 7 AS zone FROM {supplier}",
    "group": "SELECT n_nationkey AS group_id, 2 AS type_id, n_name AS label, n_name AS description, n_regionkey AS source_id FROM {nation}",
    "group_name": "SELECT n_nationkey AS group_id, n_regionkey AS namespace_id, n_name AS name, 4 AS source_id FROM {nation}",
    "group_group": "SELECT n_nationkey AS group_id, n_regionkey + 100 AS related_group_id, 1 AS relationship_id, 1 AS direction, CAST(NULL AS INT) AS contains, 4 AS source_id FROM {nation}",
    "group_biopolymer": "SELECT s_nationkey AS group_id, s_suppkey AS biopolymer_id, 100 AS specificity, s_suppkey % 101 AS implication, s_suppkey % 50 AS quality, 4 AS source_id FROM {supplier}",
    "group_member_name": "SELECT c_nationkey AS group_id, c_custkey AS member, 1 AS type_id, 2 AS namespace_id, c_name AS name, 4 AS source_id FROM {customer}",
    "gwas": "SELECT o_orderkey AS gwas_id, o_custkey AS rs, o_custkey % 22 + 1 AS chr, o_orderkey * 3 AS pos, o_orderstatus AS trait, CAST(NULL AS STRING) AS snps, '1.5' AS orbeta, CAST(NULL AS STRING) AS riskAfreq, o_custkey + 7 AS pubmed_id, 5 AS source_id FROM {orders}",
    "chain": "SELECT s_suppkey AS chain_id, 18 AS old_ucschg, s_suppkey % 22 + 1 AS old_chr, s_suppkey * 10 AS old_start, s_suppkey * 10 + 9 AS old_end, 19 AS new_ucschg, s_suppkey % 22 + 1 AS new_chr, s_suppkey * 11 AS new_start, s_suppkey * 11 + 9 AS new_end, s_suppkey * 3 AS score, s_suppkey % 2 AS is_fwd, 6 AS source_id FROM {supplier}",
    "chain_data": "SELECT s_suppkey AS chain_id, s_suppkey * 10 AS old_start, s_suppkey * 10 + 4 AS old_end, s_suppkey * 11 AS new_start FROM {supplier}",
}
_BASE = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")


def _fields(name: str) -> list[str]:
    return [f'{c.split(" ")[0]}' for c in knowledge_file.TABLES[name].split(", ")]


def _knowledge_sql() -> str:
    each = []
    for name, made in _KNOWLEDGE.items():
        text = " || '|' || ".join(f"coalesce(\"{c}\"::VARCHAR, '')" for c in _fields(name))
        each.append(f"SELECT '{name}' AS name, count(*) AS rows, sum(('0x' || left(md5({text}), 8))::BIGINT)::BIGINT AS digest FROM ({made.format(**{t: t for t in _BASE})})")
    return " UNION ALL ".join(each)


@query("src_knowledge_tables", _knowledge_sql())
def src_knowledge_tables(spark, d):
    """All knowledge tables, written as SQLite files and read again by ranges of rows with their types: rows and a digest of each."""
    base = {t: v.read(spark, d, t) for t in _BASE}
    folder = f"{shared_folder(spark)}/knowledge-{uuid.uuid4().hex}"
    found = []
    for name, made in _KNOWLEDGE.items():
        used = {t: x for t, x in base.items() if "{" + t + "}" in made}
        knowledge_file.write(spark.sql(made, **used), folder, name)
        x = knowledge_file.table(spark, f"{folder}/{name}-*.db", name, rows=50_000)
        text = F.concat_ws("|", *[F.coalesce(_s(f"`{c}`"), F.lit("")) for c in _fields(name)])
        digest = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
        found.append((name, *x.select(digest.alias("d")).agg(F.count("*"), F.sum("d")).first()))
        remove(spark, folder)  # a table's files go before the next one's are written
    return spark.createDataFrame(found, "name string, rows long, digest long").coalesce(1)


def chain_stanzas(spark, d):
    """A chain per supplier: three blocks from its region's start on, every other one on the reverse strand."""
    r = v.regions(spark, d)
    back = F.col("region_id") % 2 == 1
    size = (F.col("pos_max") - F.col("pos_min")) / 4
    b = F.floor(size).cast("long")
    head = F.concat_ws(" ", F.lit("chain"), _s(1000 + F.col("region_id") * 37 % 1000), F.concat(F.lit("chr"), _s("chr")), F.lit("2000000"), F.lit("+"), _s(F.col("pos_min") - 1), _s(F.col("pos_min") - 1 + 3 * b + 150), F.concat(F.lit("chr"), _s(F.col("chr") % 22 + 1)), F.lit("3000000"), F.when(back, "-").otherwise("+"), _s("pos_min"), _s(F.col("pos_min") + 3 * b + 90), _s("region_id"))
    return r.select(F.concat_ws("\n", head, F.concat_ws(" ", _s(b), F.lit("100"), F.lit("40")), F.concat_ws(" ", _s(b), F.lit("50"), F.lit("50")), _s(b)).alias("value"))


_CHAIN = """SELECT region_id AS chain_id, 1000 + region_id * 37 % 1000 AS score, chr AS old_chr, chr % 22 + 1 AS new_chr, CASE WHEN region_id % 2 = 1 THEN '-' ELSE '+' END AS strand, o AS old_start, o + b - 1 AS old_end,
  CASE WHEN region_id % 2 = 1 THEN 3000000 - pos_min - nn ELSE pos_min + 1 + nn END AS new_start FROM (
  SELECT *, pos_min + k * b + CASE k WHEN 0 THEN 0 WHEN 1 THEN 100 ELSE 150 END AS o, k * b + CASE k WHEN 0 THEN 0 WHEN 1 THEN 40 ELSE 90 END AS nn FROM (SELECT *, (pos_max - pos_min) // 4 AS b FROM regions), (SELECT unnest([0, 1, 2]) AS k))"""


@query("src_chain_file", sql(f"SELECT * FROM ({_CHAIN})"))
def src_chain_file(spark, d):
    return text.chains(chain_stanzas(spark, d))


_LIFT_PAIRS = "SELECT l.locus_id, c.*, l.pos - old_start AS off FROM loci l JOIN segs c ON l.chr = c.old_chr AND l.pos BETWEEN c.old_start AND c.old_end"
_LIFT_BEST = "SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY score DESC, chain_id) AS rn FROM lp"


@query("join_lift_segment", sql("SELECT locus_id AS id, chain_id, new_chr, CASE WHEN strand = '+' THEN new_start + off ELSE new_start - off END AS new_pos FROM lb WHERE rn = 1", segs=_CHAIN, lp=_LIFT_PAIRS, lb=_LIFT_BEST))
def join_lift_segment(spark, d):
    x = v.loci(spark, d).select(F.col("locus_id").alias("id"), "chr", F.col("pos").alias("start"), F.col("pos").alias("end"))
    return iv.lifted(x, text.chains(chain_stanzas(spark, d))).select("id", "chain_id", "new_chr", F.col("new_start").alias("new_pos"))


@query("sink_unlifted", sql("SELECT chr, pos, id FROM loci WHERE locus_id NOT IN (SELECT locus_id FROM lp)", segs=_CHAIN, lp=_LIFT_PAIRS))
def sink_unlifted(spark, d):
    lifted = join_lift_segment(spark, d)
    return v.loci(spark, d).join(lifted.select(F.col("id").alias("locus_id")), "locus_id", "left_anti").select("chr", "pos", "id")


_AGG = """SELECT region_id AS id, chain_id, score, strand, new_chr, a, b, arg_min({'s': old_start, 'e': old_end, 'n': new_start}, old_start) AS f, arg_max({'s': old_start, 'e': old_end, 'n': new_start}, old_start) AS l, sum(old_end - old_start + 1)::BIGINT AS total
  FROM (SELECT region_id, chr, pos_min + 500 AS a, pos_min + 12000 AS b FROM regions) r JOIN segs s ON r.chr = s.old_chr AND s.old_end >= a AND s.old_start <= b GROUP BY ALL"""
_EDGE = "SELECT *, least(greatest(a - f.s, 0), f.e - f.s) AS front, least(greatest(b - l.s, 0), l.e - l.s) AS tail FROM ag"
_MAPPED = "SELECT *, total - front - (l.e - l.s + 1) + tail + 1 AS mapped FROM ed"
_RANKED = "SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chain_id) AS rn FROM mp WHERE mapped / (b - a + 1) >= 0.95"


@query("agg_lift_region", sql("SELECT id, chain_id, new_chr, CASE WHEN strand = '+' THEN f.n + front ELSE l.n - tail END AS new_start, CASE WHEN strand = '+' THEN l.n + tail ELSE f.n - front END AS new_end, mapped FROM rk WHERE rn = 1", segs=_CHAIN, ag=_AGG, ed=_EDGE, mp=_MAPPED, rk=_RANKED))
def agg_lift_region(spark, d):
    x = v.regions(spark, d).select(F.col("region_id").alias("id"), "chr", (F.col("pos_min") + 500).alias("start"), (F.col("pos_min") + 12_000).alias("end"))
    return iv.lifted(x, text.chains(chain_stanzas(spark, d)))


@query("win_best_chain", sql("SELECT id, chain_id, score FROM rk WHERE rn = 1", segs=_CHAIN, ag=_AGG, ed=_EDGE, mp=_MAPPED, rk=_RANKED))
def win_best_chain(spark, d):
    scores = text.chains(chain_stanzas(spark, d)).select("chain_id", "score").distinct()
    return agg_lift_region(spark, d).join(scores, "chain_id").select("id", "chain_id", "score")


@query("chk_lift_chains", sql("SELECT old_chr, count(DISTINCT chain_id) AS chains FROM segs GROUP BY 1", segs=_CHAIN))
def chk_lift_chains(spark, d):
    return text.chains(chain_stanzas(spark, d)).groupBy("old_chr").agg(F.count_distinct("chain_id").alias("chains"))


@query("etl_ld_lift", sql("SELECT locus_id, coalesce(CASE WHEN strand = '+' THEN new_start + off ELSE new_start - off END, -1) AS pos FROM loci LEFT JOIN (SELECT * FROM lb WHERE rn = 1) USING (locus_id)", segs=_CHAIN, lp=_LIFT_PAIRS, lb=_LIFT_BEST))
def etl_ld_lift(spark, d):
    moved = join_lift_segment(spark, d).select(F.col("id").alias("locus_id"), "new_pos")
    return v.loci(spark, d).join(moved, "locus_id", "left").select("locus_id", F.coalesce("new_pos", F.lit(-1).cast("long")).alias("pos"))


@query("etl_snp_merge", "SELECT DISTINCT p_partkey AS old, CAST(p_size AS BIGINT) AS new FROM part WHERE p_size % 7 <> 0")
def etl_snp_merge(spark, d):
    p = v.read(spark, d, "part")
    lines = p.select(F.concat_ws("\t", _s("p_partkey"), F.when(F.col("p_size") % 7 == 0, "").otherwise(_s("p_size"))).alias("value"))
    return etl.merges(text.tabbed(lines.union(lines), ["old", "new"]))


_ROLE_ROWS = "SELECT l_partkey AS rs, CASE WHEN l_quantity <> 13 THEN l_suppkey END AS entrez, l_linenumber AS code FROM lineitem"


def _role_parts(spark, d):
    rows = v.read(spark, d, "lineitem").select(F.col("l_partkey").alias("rs"), F.when(F.col("l_quantity") != 13, F.col("l_suppkey")).alias("entrez"), v.long("l_linenumber").alias("code"))
    codes = v.read(spark, d, "region").select((v.long("r_regionkey") + 1).alias("code"), F.lower("r_name").alias("role"))
    return etl.snp_roles(rows, codes)


@query("etl_snp_role", sql("SELECT DISTINCT rs, entrez, lower(r_name) AS role FROM rr JOIN region ON code = r_regionkey + 1 WHERE entrez IS NOT NULL", rr=_ROLE_ROWS))
def etl_snp_role(spark, d):
    return _role_parts(spark, d)[0]


@query("etl_snp_role_counts", sql("SELECT count(*) FILTER (entrez IS NULL) AS incomplete, count(*) FILTER (entrez IS NOT NULL AND code > 5) AS orphan FROM rr", rr=_ROLE_ROWS))
def etl_snp_role_counts(spark, d):
    return _role_parts(spark, d)[1]


_CHR = "SELECT l_partkey AS rs, CASE WHEN l_linenumber % 6 = 0 THEN 'X' ELSE (l_partkey % 22 + 1)::VARCHAR END AS chr, CASE WHEN l_linenumber % 6 = 0 AND l_suppkey % 2 = 0 THEN 'PAR' ELSE (l_partkey % 22 + 1)::VARCHAR END AS file_chr, l_partkey * 7919 % 1000000 AS pos, l_tax > 0.02 AND l_partkey % 13 <> 0 AS valid, CASE WHEN l_quantity > 45 OR l_partkey % 7 = 0 THEN NULL WHEN l_quantity > 35 OR l_partkey % 11 = 0 THEN '36' ELSE '37' END AS build FROM lineitem"
_REASON = "SELECT *, CASE WHEN build IS NULL THEN 4 WHEN build <> '37' THEN 3 WHEN NOT valid THEN 2 WHEN chr <> file_chr AND NOT (file_chr = 'PAR' AND chr IN ('X', 'Y')) THEN 1 ELSE 0 END AS reason FROM cr"


def _snp_loci(spark, d):
    x = v.read(spark, d, "lineitem")
    six, own = F.col("l_linenumber") % 6 == 0, _s(F.col("l_partkey") % 22 + 1)
    rows = x.select(F.col("l_partkey").alias("rs"), F.when(six, "X").otherwise(own).alias("chr"), F.when(six & (F.col("l_suppkey") % 2 == 0), "PAR").otherwise(own).alias("file_chr"), (F.col("l_partkey") * 7919 % 1_000_000).alias("pos"), ((F.col("l_tax") > 0.02) & (F.col("l_partkey") % 13 != 0)).alias("valid"), F.when((F.col("l_quantity") > 45) | (F.col("l_partkey") % 7 == 0), None).when((F.col("l_quantity") > 35) | (F.col("l_partkey") % 11 == 0), "36").otherwise("37").alias("build"))
    return etl.snp_loci(rows, "37", need_valid=True)


@query("etl_snp_locus", sql("SELECT DISTINCT rs, chr, pos, valid FROM rn WHERE reason = 0", cr=_CHR, rn=_REASON))
def etl_snp_locus(spark, d):
    return _snp_loci(spark, d)[0]


@query("set_reject_reasons", sql("SELECT ['chromosome', 'validation', 'version', 'build'][m] AS reason, count(*) AS snps FROM (SELECT rs, min(reason) AS m FROM rn GROUP BY 1) WHERE m > 0 GROUP BY 1", cr=_CHR, rn=_REASON))
def set_reject_reasons(spark, d):
    return _snp_loci(spark, d)[1]


_GENES = "SELECT s_suppkey AS id, 'G' || s_suppkey AS symbol, CASE WHEN s_suppkey % 4 = 0 THEN 'G' || (s_suppkey + 1) || '|A' || s_suppkey // 2 ELSE '-' END AS synonyms, 'HGNC:HGNC:' || s_suppkey || '|Ensembl:E' || s_suppkey AS xrefs FROM supplier"


@query("etl_entrez_gene", sql("""SELECT id, 'symbol' AS namespace, symbol AS name FROM gs UNION SELECT id, 'symbol', n FROM (SELECT id, unnest(string_split(synonyms, '|')) AS n FROM gs WHERE synonyms <> '-') WHERE n NOT IN (SELECT symbol FROM gs g2 WHERE g2.id <> id)
  AND n NOT IN (SELECT symbol FROM gs) UNION SELECT id, 'hgnc', 'HGNC:' || id FROM gs UNION SELECT id, 'ensembl', 'E' || id FROM gs""", gs=_GENES))
def etl_entrez_gene(spark, d):
    k = F.col("s_suppkey")
    s = v.read(spark, d, "supplier")
    syn = F.when(k % 4 == 0, F.concat(F.lit("G"), _s(k + 1), F.lit("|A"), _s(F.floor(k / 2)))).otherwise("-")
    return etl.gene_aliases(s.select(k.alias("id"), F.concat(F.lit("G"), _s(k)).alias("symbol"), syn.alias("synonyms"), F.concat(F.lit("HGNC:HGNC:"), _s(k), F.lit("|Ensembl:E"), _s(k)).alias("xrefs")))


@query("etl_entrez_region", sql("SELECT DISTINCT region_id AS id, chr, pos_min, pos_max FROM regions WHERE region_id % 5 <> 0 AND region_id % 3 <> 0"))
def etl_entrez_region(spark, d):
    r = v.regions(spark, d)
    wrong = F.col("region_id") % 5 == 0
    acc = F.concat(F.when(wrong, "NT_").otherwise("NC_0000"), F.lpad(_s("chr"), 2, "0"), F.lit(".9"))
    build = F.when(F.col("region_id") % 3 == 0, "36").otherwise("37")
    return etl.gene_regions(r.select(F.col("region_id").alias("id"), acc.alias("accession"), (F.col("pos_min") - 1).alias("start"), (F.col("pos_max") - 1).alias("end"), "chr", build.alias("build")))


@query("etl_entrez_history", "WITH RECURSIVE m AS (SELECT s_suppkey AS old, s_suppkey // 3 AS new FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey > 0), c AS (SELECT old, new FROM m UNION ALL SELECT c.old, m.new FROM c JOIN m ON c.new = m.old) SELECT min(new) AS id, 'S' || old AS name FROM c GROUP BY old")
def etl_entrez_history(spark, d):
    from ..operators import graph

    old = v.read(spark, d, "supplier").filter("s_suppkey % 3 = 0 AND s_suppkey > 0").select(F.col("s_suppkey").alias("old"), F.floor(F.col("s_suppkey") / 3).alias("new"))
    return graph.followed(old).select(F.col("new").alias("id"), F.concat(F.lit("S"), _s("old")).alias("name"))


@query("etl_entrez_xref", "SELECT DISTINCT s_suppkey AS id, 'uniprot' AS namespace, 'U' || l_partkey AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 2 = 0")
def etl_entrez_xref(spark, d):
    """Protein accessions of genes joined with accession -> UniProt; versions are stripped, only current genes count."""
    own = v.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.concat(F.lit("NP_"), _s("l_partkey"), F.lit(".2")).alias("accession")).distinct()
    table = v.read(spark, d, "part").select(F.concat(F.lit("NP_"), _s("p_partkey"), F.lit(".1")).alias("accession"), F.concat(F.lit("U"), _s("p_partkey")).alias("name"))
    current = v.read(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"))
    key = g.without_version(F.col("accession"))
    return own.join(current, "id", "left_semi").withColumn("accession", key).join(table.withColumn("accession", key), "accession").select("id", F.lit("uniprot").alias("namespace"), "name").distinct()


def _stanzas(spark, d):
    s = v.read(spark, d, "supplier")
    k = F.col("s_suppkey")
    lines = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: GO:"), _s(k)), F.concat(F.lit("name: "), "s_name"), F.lit("namespace: process"), F.when(k > 0, F.concat(F.lit("is_a: GO:"), _s(F.floor(k / 2)), F.lit(" ! parent"))), F.when(k % 3 == 0, F.concat(F.lit("relationship: regulates GO:"), _s(k + 1))), F.when(k % 3 == 1, F.concat(F.lit("relationship: has_part GO:"), _s(k + 2))), F.when(k % 11 == 0, "is_obsolete: true"))
    return s.select(lines.alias("value"))


_LIVE = "SELECT s_suppkey AS k, s_name FROM supplier WHERE s_suppkey % 11 <> 0"


@query("etl_go_terms", sql("SELECT 'GO:' || k AS id, 'GO:' || k // 2 AS other, 'is_a' AS relation, -1 AS contains FROM live UNION ALL SELECT 'GO:' || k, 'GO:' || (k + 1), 'regulates', 0 FROM live WHERE k % 3 = 0 UNION ALL SELECT 'GO:' || k, 'GO:' || (k + 2), 'has_part', NULL FROM live WHERE k % 3 = 1", live=_LIVE))
def etl_go_terms(spark, d):
    return etl.terms(_stanzas(spark, d))[1]


@query("etl_go_term_names", sql("SELECT 'GO:' || k AS id, s_name AS name, 'process' AS space FROM live", live=_LIVE))
def etl_go_term_names(spark, d):
    return etl.terms(_stanzas(spark, d))[0]


@query("etl_go_assoc", "SELECT DISTINCT 'GO:' || l_suppkey AS term, 'P' || l_partkey AS member, unnest(['symbol', 'uniprot_pid', 'symbol', 'uniprot_pid']) AS namespace, unnest(['P' || l_partkey, 'P' || l_partkey, 'N' || l_partkey % 100, 'N' || l_partkey % 100]) AS name FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber <> 2")
def etl_go_assoc(spark, d):
    rows = v.read(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 2, "OTHER").otherwise("UniProtKB").alias("db"), F.concat(F.lit("P"), _s("l_partkey")).alias("accession"), F.concat(F.lit("N"), _s(F.col("l_partkey") % 100)).alias("symbols"), F.concat(F.lit("GO:"), _s("l_suppkey")).alias("term"), F.when(F.col("l_returnflag") == "R", "IEA").otherwise("IDA").alias("evidence"), F.lit("taxon:9606").alias("taxon"))
    return etl.associations(rows)


@query("etl_interaction_pairs", "SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, min(l_orderkey) AS label, count(DISTINCT l_orderkey) AS ids FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2")
def etl_interaction_pairs(spark, d):
    return etl.interaction_pairs(v.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


@query("etl_gene_sets", "SELECT 'order ' || o_orderkey AS name, o_orderpriority AS description, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_suppkey) - 1 AS position, 'G' || l_suppkey AS gene FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey")
def etl_gene_sets(spark, d):
    genes = v.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    o = v.read(spark, d, "orders").join(genes, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = o.select(F.concat_ws("\t", F.concat(F.lit("order "), _s("o_orderkey")), "o_orderpriority", F.array_join(F.transform("s", lambda x: F.concat(F.lit("G"), x.cast("string"))), "\t")).alias("value"))
    x = etl.gene_sets(lines)
    return x.select("name", "description", v.long("position").alias("position"), "gene")


def _regulatory(spark, d):
    r = v.regions(spark, d)
    poly = F.col("region_id") % 3 == 0
    a = r.select(F.col("region_id").alias("id"), F.explode(F.array(F.struct(F.lit("type").alias("key"), F.when(poly, "POLYMORPHISM").otherwise("BINDING").alias("value")), F.struct(F.lit("gene").alias("key"), F.col("name").alias("value")), F.struct(F.lit("rs").alias("key"), F.when(F.col("region_id") % 2 == 0, _s("region_id")).alias("value")))).alias("x")).select("id", "x.key", "x.value")
    return etl.regulatory(a, r.select(F.col("region_id").alias("id"), "chr", "pos_min", "pos_max"))


@query("etl_regulatory", sql("SELECT region_id AS id, 'BINDING' AS type, name AS gene, chr, pos_min, pos_max FROM regions WHERE region_id % 3 <> 0"))
def etl_regulatory(spark, d):
    return _regulatory(spark, d)[1]


@query("etl_regulatory_roles", sql("SELECT region_id AS rs, name AS gene, 'regulatory' AS role FROM regions WHERE region_id % 6 = 0"))
def etl_regulatory_roles(spark, d):
    return _regulatory(spark, d)[0]


@query("etl_gwas", """SELECT DISTINCT trait, rs, chr, pos FROM (
  SELECT p_name AS trait, unnest([p_partkey, p_partkey + 1]) AS rs, unnest([p_partkey % 22 + 1, 3]) AS chr, unnest([p_partkey * 10, p_partkey * 10 + 5]) AS pos FROM part WHERE p_size % 3 = 0
  UNION ALL SELECT p_name, p_partkey, NULL, NULL FROM part WHERE p_size % 3 = 1
  UNION ALL SELECT p_name, NULL, unnest([p_partkey % 22 + 1, 3]), unnest([p_partkey * 10, p_partkey * 10 + 5]) FROM part WHERE p_size % 3 = 1)""")
def etl_gwas(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size") % 3
    snps = F.when(n == 0, F.concat(F.lit("rs"), _s(k), F.lit(", rs"), _s(k + 1))).when(n == 1, F.concat(F.lit("rs"), _s(k))).otherwise(F.concat(F.lit("rs"), _s(k), F.lit(" x rs1")))
    rows = v.read(spark, d, "part").select(F.col("p_name").alias("trait"), F.concat(_s(k % 22 + 1), F.lit(";chr3")).alias("chrs"), F.concat(_s(k * 10), F.lit("; "), _s(k * 10 + 5)).alias("poss"), snps.alias("snps"))
    return etl.associations_catalogue(rows)


_EXON = "SELECT s_suppkey % 22 + 1 AS chr, unnest([s_suppkey * 104729 % 900000, s_suppkey * 104729 % 900000 + 2500]) AS pos_min, unnest([s_suppkey * 104729 % 900000 + 3000, s_suppkey * 104729 % 900000 + 9000]) AS pos_max FROM supplier"


def exons(spark, d):
    k = F.col("s_suppkey")
    low = k * 104_729 % 900_000
    rows = v.read(spark, d, "supplier").select((k % 22 + 1).alias("chr"), F.concat_ws(",", _s(low), _s(low + 2500), F.lit("")).alias("starts"), F.concat_ws(",", _s(low + 3000), _s(low + 9000), F.lit("")).alias("ends"))
    return etl.exons(rows)


@query("etl_exons", sql("SELECT DISTINCT * FROM ex", ex=_EXON))
def etl_exons(spark, d):
    return exons(spark, d)


_ISLANDS = "SELECT chr, pos_min, pos_max, CASE WHEN pos_min <= max(pos_max) OVER (PARTITION BY chr ORDER BY pos_min, pos_max ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT * FROM ex)"
_MERGED = "SELECT chr, min(pos_min) AS pos_min, max(pos_max) AS pos_max FROM (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY pos_min, pos_max ROWS UNBOUNDED PRECEDING) AS island FROM isl) GROUP BY chr, island"


@query("win_interval_merge", sql("SELECT * FROM mg", ex=_EXON, isl=_ISLANDS, mg=_MERGED))
def win_interval_merge(spark, d):
    return iv.merged_intervals(exons(spark, d))


@query("join_exon_overlap", sql("SELECT locus_id, chr, pos FROM loci l SEMI JOIN mg ON l.chr = mg.chr AND l.pos BETWEEN mg.pos_min AND mg.pos_max", ex=_EXON, isl=_ISLANDS, mg=_MERGED))
def join_exon_overlap(spark, d):
    return iv.points_in_regions(v.loci(spark, d).select("locus_id", "chr", "pos"), iv.merged_intervals(exons(spark, d)), how="left_semi")


_LINES = """SELECT n_nationkey::BIGINT AS n, '##contig=<ID=chr' || (n_nationkey + 1) || ',length=1,assembly=GRCh' || (37 + n_regionkey % 2) || '>' AS value FROM nation
  UNION ALL SELECT 100, concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT') || chr(9) || string_agg(n_name, chr(9) ORDER BY n_nationkey) FROM nation
  UNION ALL SELECT 1000 + l.locus_id, concat_ws(chr(9), 'chr' || any_value(l.chr), any_value(l.pos), CASE WHEN l.locus_id % 4 = 0 THEN '.' ELSE any_value(l.id) END, any_value(ref), any_value(alt), '.', CASE any_value(p_size) % 5 WHEN 0 THEN 'q10' WHEN 1 THEN '.' ELSE 'PASS' END, '.', 'GT:DP:FT') || chr(9)
    || string_agg(CASE WHEN fv.x IS NULL THEN '.' ELSE CASE WHEN fv.x.a1 IS NULL THEN './.' ELSE fv.x.a1 || '|' || fv.x.a2 END || ':9:' || CASE WHEN fv.x.s % 11 = 0 THEN 'q10' ELSE 'PASS' END END, chr(9) ORDER BY n_nationkey)
    FROM loci l SEMI JOIN mg ON l.chr = mg.chr AND l.pos BETWEEN mg.pos_min AND mg.pos_max JOIN part ON p_partkey = l.locus_id CROSS JOIN nation LEFT JOIN fv ON fv.locus_id = l.locus_id AND fv.nation = n_nationkey GROUP BY l.locus_id"""


@query("filter_vcf_lines", sql("SELECT n, value FROM kept_lines", ex=_EXON, isl=_ISLANDS, mg=_MERGED, fv=_VCF, kept_lines=_LINES))
def filter_vcf_lines(spark, d):
    """Header lines and the variant lines inside merged exons, whole and with their places in the file; ``reports.write_lines`` writes them."""
    return vcf.inside(vcf_lines(spark, d), iv.merged_intervals(exons(spark, d)), "n")


@query("etl_build_map", "SELECT s_suppkey AS source, CASE s_suppkey % 4 WHEN 0 THEN 36 WHEN 1 THEN 37 WHEN 2 THEN 38 ELSE 99 END AS grch, CASE s_suppkey % 4 WHEN 0 THEN 18 WHEN 1 THEN 19 WHEN 2 THEN 38 END AS hg, 38 AS target, s_suppkey % 4 <> 3 AS known FROM supplier")
def etl_build_map(spark, d):
    k = F.col("s_suppkey") % 4
    x = v.read(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.when(k == 1, 37).when(k == 3, 99).alias("grch"), F.when(k == 0, 18).when(k == 2, 38).alias("hg"))
    return etl.completed_builds(x)


@query("etl_ld_pairs", "SELECT 'CEU' AS pop, l_suppkey % 22 + 1 AS chr, l_partkey AS pos1, l_partkey + l_linenumber AS pos2, l_partkey AS rs1, l_partkey + l_linenumber AS rs2, round(l_discount * 10, 2) AS dprime, round(l_tax * 10, 2) AS rsq FROM lineitem")
def etl_ld_pairs(spark, d):
    x = v.read(spark, d, "lineitem")
    end = F.col("l_partkey") + F.col("l_linenumber")
    lines = x.select(F.concat_ws(" ", _s("l_partkey"), _s(end), F.lit("CEU"), F.concat(F.lit("rs"), _s("l_partkey")), F.concat(F.lit("rs"), _s(end)), _s(F.round(F.col("l_discount") * 10, 2)), _s(F.round(F.col("l_tax") * 10, 2)), _s(F.col("l_suppkey") % 22 + 1)).alias("value"))
    f = lines.select(F.split("value", " ").alias("f"))
    rows = f.select(F.col("f")[2].alias("pop"), F.col("f")[7].try_cast("bigint").alias("chr"), F.col("f")[0].try_cast("bigint").alias("pos1"), F.col("f")[1].try_cast("bigint").alias("pos2"), F.col("f")[3].alias("rs1"), F.col("f")[4].alias("rs2"), F.col("f")[5].alias("dprime"), F.col("f")[6].alias("rsq"))
    return etl.ld_pairs(rows)


_FILES = "SELECT p_partkey % 2 AS file, chr, pos, CASE WHEN locus_id % 3 = 0 THEN 'G' ELSE 'C' END AS alt, locus_id FROM loci JOIN part ON p_partkey = locus_id UNION ALL SELECT 1 - p_partkey % 2, chr, pos, 'C', locus_id FROM loci JOIN part ON p_partkey = locus_id WHERE p_size % 2 = 0"
_SITES = "SELECT chr, pos, list_sort(list_distinct(list(alt))) AS alts, count(DISTINCT file) AS files FROM fl GROUP BY ALL"


@query("join_vcf_merge", sql("SELECT file, chr, pos, 'A' AS ref, 'A,' || array_to_string(alts, ',') AS alleles, 0 AS sample, '0/' || list_position(alts, alt) AS call FROM fl JOIN st USING (chr, pos) UNION ALL SELECT 1 - file, chr, pos, 'A', 'A,' || array_to_string(alts, ','), 0, '0/0' FROM (SELECT DISTINCT file, chr, pos FROM fl) JOIN st USING (chr, pos) WHERE files = 1", fl=_FILES, st=_SITES))
def join_vcf_merge(spark, d):
    x = v.loci(spark, d).join(v.read(spark, d, "part").select(F.col("p_partkey").alias("locus_id"), "p_size"), "locus_id")
    file = F.col("locus_id") % 2
    own = x.select(file.alias("file"), "chr", "pos", "ref", F.when(F.col("locus_id") % 3 == 0, "G").otherwise("C").alias("alt"))
    both = x.filter("p_size % 2 = 0").select((1 - file).alias("file"), "chr", "pos", "ref", F.lit("C").alias("alt"))
    return vcf.merged(own.union(both).withColumn("sample", F.lit(0)).withColumn("call", F.lit("0/1")), fill_reference=True)


@query("src_incremental_sources", "SELECT s_suppkey AS source, 'v' || s_nationkey AS version, md5(s_name || s_acctbal::INT) AS digest FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0")
def src_incremental_sources(spark, d):
    """Sources to load again: every fifth is new and every seventh has other content than at the last load."""
    from ..streaming.incremental import changed

    k = F.col("s_suppkey")
    now = v.read(spark, d, "supplier").select(k.alias("source"), F.concat(F.lit("v"), _s("s_nationkey")).alias("version"), F.md5(F.concat("s_name", _s(F.rint("s_acctbal").cast("int"))).cast("binary")).alias("digest"))
    before = now.filter("source % 5 <> 0").withColumn("digest", F.when(F.col("source") % 7 == 0, "old").otherwise(F.col("digest")))
    return changed(now, before)
