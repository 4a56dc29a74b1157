"""Cohort views over the star-schema tables, in Spark and as SQL with the same rows.

Customers are samples, parts are loci, order lines are genotype calls, suppliers are gene regions, nations
are gene groups and regions of the world their parent groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, name, nation, segment, trait; trait is null where the balance is negative."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("sample_id"), F.col("c_name").alias("name"), long("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("trait"))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pheno, sample_id, is_case of samples with a trait: one phenotype per market segment and one of two segments."""
    s = samples(spark, sf_dir).filter("trait IS NOT NULL")
    named = F.array(F.lit("main"), *[F.lit(x) for x in SEGMENTS])
    rows = s.select("sample_id", "segment", F.explode(named).alias("pheno"))
    is_case = F.when(F.col("pheno") == "main", F.col("segment").isin("BUILDING", "MACHINERY")).otherwise(F.col("segment") == F.col("pheno"))
    return rows.select("pheno", "sample_id", is_case.alias("is_case"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pheno, sample_id, y: the main phenotype as measured (the trait), the others as 0 and 1."""
    x = status(spark, sf_dir).join(samples(spark, sf_dir).select("sample_id", "trait"), "sample_id")
    return x.select("pheno", "sample_id", F.when(F.col("pheno") == "main", F.col("trait").cast("double")).otherwise(F.col("is_case").cast("double")).alias("y"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PHENOS = ("main", *SEGMENTS)


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locus_id, chr, pos, id, ref, alt."""
    k = F.col("p_partkey")
    alt = F.when(k % 10 == 0, "C,G").otherwise("C")
    return read(spark, sf_dir, "part").select(k.alias("locus_id"), (k % 22 + 1).alias("chr"), (k * 7919 % 1_000_000 + 1).alias("pos"), F.concat(F.lit("rs"), k.cast("string")).alias("id"), F.lit("A").alias("ref"), alt.alias("alt"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locus_id, sample_id, a1, a2: the first order line of a customer for a part; null alleles are missing calls."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # dealt by locus once: what follows by locus, or by locus and sample, needs no further shuffle of calls
    first = lines.join(orders, lines.l_orderkey == orders.o_orderkey).repartition("l_partkey").groupBy("l_partkey", "o_custkey").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")).alias("x"))
    known = F.col("x.l_quantity") <= 48
    a1 = F.when(known, F.when(F.col("x.l_discount") >= 0.10, 1).otherwise(0))
    a2 = F.when(known, F.when(F.col("x.l_tax") >= 0.08, F.when(F.col("l_partkey") % 10 == 0, 2).otherwise(1)).otherwise(0))
    return first.select(F.col("l_partkey").alias("locus_id"), F.col("o_custkey").alias("sample_id"), a1.cast("long").alias("a1"), a2.cast("long").alias("a2"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, name, nation, chr, pos_min, pos_max (closed)."""
    k = F.col("s_suppkey")
    low = k * 104_729 % 900_000 + 1
    return read(spark, sf_dir, "supplier").select(k.alias("region_id"), F.col("s_name").alias("name"), long("s_nationkey").alias("nation"), (k % 22 + 1).alias("chr"), low.alias("pos_min"), (low + 20_000 + k % 7 * 30_000).alias("pos_max"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, name, parent."""
    return read(spark, sf_dir, "nation").select(long("n_nationkey").alias("group_id"), F.col("n_name").alias("name"), long("n_regionkey").alias("parent"))


def group_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, region_id: genes whose number is no multiple of 3 belong to their nation's group, some to the next one too."""
    r = regions(spark, sf_dir).filter("region_id % 3 <> 0")
    own = r.select(F.col("nation").alias("group_id"), "region_id")
    return own.union(r.filter("region_id % 4 = 1").select(((F.col("nation") + 1) % 25).alias("group_id"), "region_id"))


#: The same views for DuckDB, in an order in which each uses earlier ones only.
VIEWS = {
    "samples": "SELECT c_custkey AS sample_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS trait FROM customer",
    "phenos": "SELECT unnest(['main', 'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS pheno",
    "status": "SELECT pheno, sample_id, CASE WHEN pheno = 'main' THEN segment IN ('BUILDING', 'MACHINERY') ELSE segment = pheno END AS is_case FROM samples, phenos WHERE trait IS NOT NULL",
    "loci": "SELECT p_partkey AS locus_id, p_partkey % 22 + 1 AS chr, p_partkey * 7919 % 1000000 + 1 AS pos, 'rs' || p_partkey AS id, 'A' AS ref, CASE WHEN p_partkey % 10 = 0 THEN 'C,G' ELSE 'C' END AS alt FROM part",
    "firsts": "SELECT l_partkey, o_custkey, l_discount, l_tax, l_quantity, row_number() OVER (PARTITION BY l_partkey, o_custkey ORDER BY l_orderkey, l_linenumber, l_discount, l_tax, l_quantity) AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "calls": "SELECT l_partkey AS locus_id, o_custkey AS sample_id, CASE WHEN l_quantity <= 48 THEN CAST(l_discount >= 0.10 AS BIGINT) END AS a1, CASE WHEN l_quantity <= 48 THEN CASE WHEN l_tax >= 0.08 THEN CASE WHEN l_partkey % 10 = 0 THEN CAST(2 AS BIGINT) ELSE 1 END ELSE 0 END END AS a2 FROM firsts WHERE rn = 1",
    "regions": "SELECT s_suppkey AS region_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation, s_suppkey % 22 + 1 AS chr, s_suppkey * 104729 % 900000 + 1 AS pos_min, s_suppkey * 104729 % 900000 + 1 + 20000 + s_suppkey % 7 * 30000 AS pos_max FROM supplier",
    "grps": "SELECT CAST(n_nationkey AS BIGINT) AS group_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS parent FROM nation",
    "group_regions": "SELECT nation AS group_id, region_id FROM regions WHERE region_id % 3 <> 0 UNION ALL SELECT (nation + 1) % 25, region_id FROM regions WHERE region_id % 3 <> 0 AND region_id % 4 = 1",
    "alleles": "SELECT locus_id, a1 AS allele FROM calls WHERE a1 IS NOT NULL UNION ALL SELECT locus_id, a2 FROM calls WHERE a2 IS NOT NULL",
    "allele_counts": "SELECT locus_id, allele, count(*) AS n FROM alleles GROUP BY ALL",
    "major": "SELECT locus_id, arg_min(allele, (-n) * 1000 + allele) AS major, max(n) AS n_major, sum(n)::BIGINT AS n_all FROM allele_counts GROUP BY locus_id",
    "dosages": "SELECT c.locus_id, c.sample_id, CASE WHEN a1 IS NOT NULL THEN CAST(a1 <> major AS BIGINT) + CAST(a2 <> major AS BIGINT) END AS dosage FROM calls c LEFT JOIN major m ON c.locus_id = m.locus_id",
    "freqs": "SELECT pheno, locus_id, is_case, count(dosage) AS n, coalesce(sum(dosage), 0)::BIGINT AS m FROM dosages JOIN status USING (sample_id) GROUP BY ALL",
    "wide": "SELECT pheno, locus_id, coalesce(sum(n) FILTER (NOT is_case), 0)::BIGINT AS n0, coalesce(sum(m) FILTER (NOT is_case), 0)::BIGINT AS m0, coalesce(sum(n) FILTER (is_case), 0)::BIGINT AS n1, coalesce(sum(m) FILTER (is_case), 0)::BIGINT AS m1 FROM freqs GROUP BY ALL",
    "rare": "SELECT *, coalesce(least(m0, 2 * n0 - m0) <= 0.05 * 2 * n0 + 1e-9 AND n0 > 0, false) AS rare0 FROM wide WHERE m0 + m1 > 0",
    "rare_loci": "SELECT pheno, locus_id, n0, m0, n1, m1 FROM rare WHERE rare0 AND n0 + n1 > 0",
    "locus_region": "SELECT locus_id, region_id, l.chr, pos FROM loci l JOIN regions r ON l.chr = r.chr AND pos BETWEEN pos_min AND pos_max",
}


def sql(body: str, **more: str) -> str:
    """``body`` with the views (and ``more`` of them) that it uses as common table expressions."""
    import re

    every = VIEWS | more
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for v in every:
            if v not in need and re.search(rf"\b{v}\b", text):
                need.add(v)
                todo.append(every[v])
    used = [f"{v} AS ({every[v]})" for v in every if v in need]
    return ("WITH " + ",\n".join(used) + "\n" if used else "") + body


def normal_tail_sql(z: str) -> str:
    """DuckDB: two-sided tail of the normal distribution; series up to 3, continued fraction beyond."""
    x = f"abs({z})"
    density = f"(exp(-{x} * {x} / 2) / sqrt(2 * pi()))"
    inner = f"list_reduce([1.0::DOUBLE] || [k::DOUBLE FOR k IN range(60, 0, -1)], lambda a, k: 1 + a * {x} * {x} / (2 * k + 1))"
    outer = f"list_reduce([{x}::DOUBLE] || [k::DOUBLE FOR k IN range(90, 0, -1)], lambda a, k: {x} + k / a)"
    return f"(CASE WHEN {x} <= 3 THEN 1 - 2 * {density} * {x} * {inner} WHEN {x} > 38 THEN 0 ELSE 2 * {density} / {outer} END)"


def t_tail_sql(t: str, df: str) -> str:
    """DuckDB: two-sided tail of Student's t with over 30 degrees of freedom, by the expansion about the normal distribution."""
    y, b = f"(({df} - 0.5) * ln(1 + {t} * {t} / {df}))", f"(48.0 * ({df} - 0.5) * ({df} - 0.5))"
    z = f"((((((-0.4 * {y} - 3.3) * {y} - 24) * {y} - 85.5) / (0.8 * {y} * {y} + 100 + {b}) + {y} + 3) / {b} + 1) * sqrt({y}))"
    return f"(SELECT {normal_tail_sql('q')} FROM (SELECT {z} AS q))"
