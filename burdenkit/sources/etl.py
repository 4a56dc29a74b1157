"""Normalising public annotation sources: each function takes typed or tabbed rows and returns table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g

#: GRCh builds and the UCSC hg builds that they go by.
BUILDS = {34: 16, 35: 17, 36: 18, 37: 19, 38: 38}
#: By how much a kind of link says that its first term contains its second.
CONTAINS = {"is_a": -1, "part_of": -1, "regulates": 0, "positively_regulates": 0, "negatively_regulates": 0}


def merges(rows: DataFrame) -> DataFrame:
    """(old, new) as text -> distinct pairs of numbers, rows with both only."""
    return rows.select(F.col("old").try_cast("bigint").alias("old"), F.col("new").try_cast("bigint").alias("new")).filter("old IS NOT NULL AND new IS NOT NULL").distinct()


def snp_roles(rows: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rs, entrez, code) -> rows with their role, and counts of incomplete rows and unknown codes."""
    whole = F.col("rs").isNotNull() & F.col("entrez").isNotNull() & F.col("code").isNotNull()
    known = rows.filter(whole).join(F.broadcast(codes), "code", "left")
    counts = rows.agg(F.count_if(~whole).alias("incomplete")).crossJoin(known.agg(F.count_if(F.col("role").isNull()).alias("orphan")))  # one row each
    return known.filter("role IS NOT NULL").select("rs", "entrez", "role").distinct(), counts


def snp_loci(rows: DataFrame, build: str, need_valid: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rs, chr, file_chr, pos, valid, build) -> accepted (rs, chr, pos, valid) and rejected rs by reason.

    The first reason that holds rejects a row: no build, other build, not validated, wrong chromosome. An rs
    counts under its mildest reason, and not at all if a row of it was accepted.
    """
    par = (F.col("file_chr") == "PAR") & F.col("chr").isin("X", "Y")
    reason = F.when(F.col("build").isNull(), 4).when(F.col("build") != build, 3).when(F.lit(need_valid) & ~F.col("valid"), 2).when((F.col("chr") != F.col("file_chr")) & ~par, 1).otherwise(0)
    marked = rows.filter("rs IS NOT NULL AND chr IS NOT NULL AND pos IS NOT NULL").withColumn("reason", reason)
    names = F.element_at(F.array(*[F.lit(x) for x in ("chromosome", "validation", "version", "build")]), F.col("reason"))
    rejected = marked.groupBy("rs").agg(F.min("reason").alias("reason")).filter("reason > 0").groupBy(names.alias("reason")).agg(F.count("*").alias("snps"))
    return marked.filter("reason = 0").select("rs", "chr", "pos", "valid").distinct(), rejected


def gene_aliases(genes: DataFrame) -> DataFrame:
    """(id, symbol, synonyms '|', xrefs 'db:id|...') -> id, namespace, name; '-' is none.

    A synonym that is exactly one other gene's symbol is no alias.
    """
    primary = genes.select("id", F.lit("symbol").alias("namespace"), F.col("symbol").alias("name"))
    owner = primary.groupBy("name").agg(F.min("id").alias("_owner"), F.count_distinct("id").alias("_n")).filter("_n = 1").select("name", "_owner")
    other = genes.filter("synonyms <> '-'").select("id", F.explode(F.split("synonyms", r"\|")).alias("name"))
    other = other.join(owner, "name", "left").filter("_owner IS NULL OR _owner = id").select("id", F.lit("symbol").alias("namespace"), "name")
    x = genes.filter("xrefs <> '-'").select("id", F.explode(F.split("xrefs", r"\|")).alias("x"))
    cross = x.select("id", F.lower(F.substring_index("x", ":", 1)).alias("namespace"), F.expr("substring(x, instr(x, ':') + 1)").alias("name"))
    return primary.union(other).union(cross).distinct()


def majority_build(rows: DataFrame) -> DataFrame:
    """Rows of the build that most rows have (ties: the greatest)."""
    top = rows.groupBy("build").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "build")).alias("x")).select(F.col("x.build").alias("_b"))
    return rows.join(F.broadcast(top), F.col("build") == F.col("_b"), "left_semi")


def gene_regions(rows: DataFrame) -> DataFrame:
    """(id, accession, start, end, build; 0-based) -> id, chr, pos_min, pos_max of the majority build.

    Chromosomes come from NC_0000nn accessions; others, and rows whose chr differs, are rejected.
    """
    n = F.regexp_extract("accession", r"^NC_0*([0-9]+)\.", 1).try_cast("int")
    x = rows.withColumn("_chr", n).filter(F.col("_chr").between(1, 24) & (F.col("_chr") == F.col("chr")))
    return majority_build(x).select("id", F.col("_chr").cast("long").alias("chr"), (F.least("start", "end") + 1).alias("pos_min"), (F.greatest("start", "end") + 1).alias("pos_max")).distinct()


def terms(stanzas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Term stanzas (value with its lines) -> terms (id, name, space) and links (id, other, relation, contains).

    Obsolete and anonymous terms are left out. contains: is_a and part_of -1, regulates 0, others null.
    """
    v = F.col("value")
    live = stanzas.filter(v.startswith("[Term]") & ~v.contains("is_obsolete: true") & ~v.contains("is_anonymous: true"))
    one = live.select(*[F.regexp_extract(v, rf"(?m)^{k}: (.*)$", 1).alias(n) for k, n in (("id", "id"), ("name", "name"), ("namespace", "space"))], v.alias("_v"))
    isa = one.select("id", F.explode(F.regexp_extract_all("_v", F.lit(r"(?m)^is_a: ([^ \n]+)"), 1)).alias("other")).withColumn("relation", F.lit("is_a"))
    rel = one.select("id", F.explode(F.regexp_extract_all("_v", F.lit(r"(?m)^relationship: ([a-z_]+ [^ \n]+)"), 1)).alias("r")).select("id", F.substring_index("r", " ", -1).alias("other"), F.substring_index("r", " ", 1).alias("relation"))
    contains = F.create_map(*[F.lit(x) for kv in CONTAINS.items() for x in kv])[F.col("relation")]
    return one.filter("id <> ''").select("id", "name", "space"), isa.union(rel).distinct().withColumn("contains", contains)


def associations(rows: DataFrame) -> DataFrame:
    """Annotation rows (db, accession, symbols '|', term, evidence, taxon) -> term, member, namespace, name.

    UniProt rows of taxon 9606 that weren't inferred electronically; each name is tried as symbol and as accession.
    """
    kept = rows.filter("db = 'UniProtKB' AND evidence <> 'IEA' AND taxon LIKE '%9606%'")
    x = kept.select("term", F.col("accession").alias("member"), F.explode(F.concat(F.array("accession"), F.split("symbols", r"\|"))).alias("name"))
    return x.select("term", "member", F.explode(F.array(F.lit("symbol"), F.lit("uniprot_pid"))).alias("namespace"), "name").distinct()


def interaction_pairs(rows: DataFrame) -> DataFrame:
    """(id, a, b) interactions -> pair group: label (least id), a, b, ids; members in either order are one pair."""
    x = rows.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return x.groupBy("a", "b").agg(F.min("id").alias("label"), F.count_distinct("id").alias("ids"))


def gene_sets(lines: DataFrame) -> DataFrame:
    """Gene-set lines 'name, description, gene ...' (tabs) -> name, description, position, gene."""
    x = lines.withColumn("f", F.split("value", "\t"))
    return x.select(F.col("f")[0].alias("name"), F.try_element_at("f", F.lit(2)).alias("description"), F.posexplode(F.expr("slice(f, 3, size(f))")).alias("position", "gene")).filter("gene <> ''")


def regulatory(attributes: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, key, value) pivoted and joined with (id, chr, pos_min, pos_max): SNP roles, and regulatory regions with gene."""
    wide = attributes.groupBy("id").pivot("key", ["type", "gene", "rs"]).agg(F.min("value"))
    x = wide.join(regions, "id")
    poly = F.col("type") == "POLYMORPHISM"
    return x.filter(poly).select(F.col("rs").try_cast("bigint").alias("rs"), "gene", F.lit("regulatory").alias("role")).filter("rs IS NOT NULL").distinct(), x.filter(~poly).select("id", "type", "gene", "chr", "pos_min", "pos_max")


def _list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def associations_catalogue(rows: DataFrame) -> DataFrame:
    """(trait, chrs ';', poss ';', snps text) -> trait, rs, chr, pos; interactions (' x ') are skipped.

    With as many rs numbers as positions they go row by row; otherwise each list gives rows of its own.
    """
    x = rows.filter(~F.coalesce(F.col("snps"), F.lit("")).contains(" x "))
    x = x.select("trait", F.arrays_zip(_list(F.col("chrs")).alias("c"), _list(F.col("poss")).alias("p")).alias("at"), F.regexp_extract_all(F.coalesce("snps", F.lit("")), F.lit(r"[rR][sS]([0-9]+)"), 1).alias("rs"))
    same = F.size("at") == F.size("rs")
    zipped = x.filter(same).select("trait", F.explode(F.arrays_zip("at", "rs")).alias("z")).select("trait", F.col("z.rs").alias("rs"), F.col("z.at.c").alias("c"), F.col("z.at.p").alias("p"))
    alone = x.filter(~same).select("trait", F.explode("rs").alias("rs"), F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("p"))
    placed = x.filter(~same).select("trait", F.lit(None).cast("string").alias("rs"), F.explode("at").alias("z")).select("trait", "rs", F.col("z.c").alias("c"), F.col("z.p").alias("p"))
    out = zipped.union(alone).union(placed)
    return out.select("trait", F.col("rs").try_cast("bigint").alias("rs"), g.chromosome_code(F.col("c")).cast("long").alias("chr"), F.col("p").try_cast("bigint").alias("pos")).distinct()


def exons(rows: DataFrame) -> DataFrame:
    """(chr, starts ',', ends ',') -> distinct chr, pos_min, pos_max."""
    x = rows.select("chr", F.explode(F.arrays_zip(F.split("starts", ",").alias("s"), F.split("ends", ",").alias("e"))).alias("z"))
    return x.select("chr", F.col("z.s").try_cast("bigint").alias("pos_min"), F.col("z.e").try_cast("bigint").alias("pos_max")).filter("pos_min IS NOT NULL AND pos_max IS NOT NULL").distinct()


def completed_builds(sources: DataFrame) -> DataFrame:
    """(source, grch, hg) with the missing one filled in, known (is either a known build) and target (newest hg)."""
    pairs = [x for kv in BUILDS.items() for x in kv]
    to_hg = F.create_map(*[F.lit(x) for x in pairs])
    to_grch = F.create_map(*[F.lit(x) for k in range(0, len(pairs), 2) for x in (pairs[k + 1], pairs[k])])
    x = sources.select("source", F.coalesce("grch", to_grch[F.col("hg")]).alias("grch"), F.coalesce("hg", to_hg[F.col("grch")]).alias("hg"))
    top = x.agg(F.max("hg").alias("target"))
    return x.join(F.broadcast(top)).withColumn("known", F.col("grch").isNotNull() & F.col("hg").isNotNull())


def ld_pairs(rows: DataFrame) -> DataFrame:
    """(pop, pos1, pos2, rs1, rs2 as text, dprime, rsq) with numbers of the rs names."""
    def number(c: str) -> Column:
        return F.regexp_extract(c, r"([0-9]+)", 1).try_cast("bigint").alias(c)

    return rows.select("pop", "chr", "pos1", "pos2", number("rs1"), number("rs2"), F.col("dprime").try_cast("double").alias("dprime"), F.col("rsq").try_cast("double").alias("rsq"))


