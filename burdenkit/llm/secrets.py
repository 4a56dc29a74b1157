"""Secret scan: fixed patterns plus a battery of randomness tests, in DataFrame functions only.

Tokens of letters and digits get an inferred encoding. Three tests (chi-squared evenness, runs about the middle,
lag-1 serial correlation) are combined twice: by Fisher's rule into the probability that the token is uniform over
its alphabet, and, each weighted by what text of that length shows in it, into the probability that text looks
as random. False discoveries of the second are controlled over the whole corpus by encoding and length band
(Benjamini-Hochberg on a histogram of bounded size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

_C = "A-Za-z0-9+/_-"
#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the runs of AKIA[A-Z0-9]+ that have 16 characters
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ that have 32 characters
#: A run of the token alphabet. Of fewer than 12 characters not even one whose characters all differ and that is
#: alone in its band gets below 0.01 as text, so shorter ones could never be discovered.
TOKEN = rf"(?<![{_C}])[{_C}]{{12,}}+"
KINDS = ("assign", "access", "hex", "random")
#: Encodings: pattern, alphabet, and what text shows: how much it exceeds evenness a character (alphabet size x index
#: of coincidence - 1), and its runs and serial statistics less those of random tokens, by the root of the length.
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.7, 0.05, -0.05),
    "base32": (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1, 0.05, -0.09),
    "base36": (r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 1.4, 0.06, -0.09),
    "base64": (r"^", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.2, 0.08, -0.05),
}
_SPAN = "array<struct<start:int,end:int,kind:int,hit:string>>"


def _located(hits: str, parts: str, kind: int, chunk: int = 256) -> Column:
    """Spans of ``hits`` (all matches) from the pieces between them: a running sum of lengths in code points.

    Sums run within chunks, then over chunks: appending to one array of all spans would take quadratic time in
    texts with very many matches.
    """
    within = f"""aggregate(sequence(c * {chunk}, least(size({hits}), c * {chunk} + {chunk}) - 1), named_struct('at', 0, 'spans', cast(array() as {_SPAN})),
        (a, i) -> named_struct(
            'at', a.at + length({parts}[i]) + length({hits}[i]),
            'spans', array_append(a.spans, named_struct('start', a.at + length({parts}[i]), 'end', a.at + length({parts}[i]) + length({hits}[i]), 'kind', {kind}, 'hit', {hits}[i]))))"""
    chunks = f"transform(sequence(0, cast((size({hits}) - 1) div {chunk} as int)), c -> {within})"
    ahead = f"""aggregate({chunks}, named_struct('at', 0, 'out', cast(array() as array<struct<off:int,spans:{_SPAN}>>)),
        (a, c) -> named_struct('at', a.at + c.at, 'out', array_append(a.out, named_struct('off', a.at, 'spans', c.spans))), a -> a.out)"""
    moved = f"flatten(transform({ahead}, c -> transform(c.spans, s -> named_struct('start', s.start + c.off, 'end', s.end + c.off, 'kind', s.kind, 'hit', s.hit))))"
    return F.expr(f"CASE WHEN size({hits}) > 0 THEN {moved} ELSE cast(array() as {_SPAN}) END")


def _log10_lower(z: Column) -> Column:
    """log10 of the normal distribution function: a polynomial near 0, the leading term of the tail below -4."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-z * z / 2) / 2.5066282746310002
    near = F.log10(F.when(z < 0, tail).otherwise(1 - tail))
    far = (-z * z / 2 - F.log(-z * 2.5066282746310002)) / 2.302585092994046
    return F.when(z < -4, far).otherwise(near)


def battery(tokens: DataFrame, hit: str = "hit", level: float = 3.0) -> DataFrame:
    """Adds encoding, n, z_even, z_runs, z_serial, log_uniform, random and log_p of each token.

    log_uniform: log10 of Fisher's combined probability of the three tests for a uniform token; random: it is above
    10^-level. log_p: log10 of the probability as text, from the three statistics less what text shows, weighted
    by that difference (the best weights for normal statistics).
    """
    kind = F.lit("base64")
    for name in ("base36", "base32", "hex"):
        kind = F.when(F.col(hit).rlike(ENCODINGS[name][0]), name).otherwise(kind)

    def of(k: int) -> Column:
        out = F.lit(ENCODINGS["base64"][k])
        for name in ("base36", "base32", "hex"):
            out = F.when(F.col("encoding") == name, F.lit(ENCODINGS[name][k])).otherwise(out)
        return out

    plain = F.when(F.col("encoding") == "hex", F.lower(hit)).when(F.col("encoding") == "base64", F.translate(hit, "-_", "+/")).otherwise(F.col(hit))
    d = tokens.withColumn("encoding", kind).withColumn("_plain", plain).withColumn("_alphabet", of(1)).withColumn("n", F.length(hit).cast("double"))
    d = d.withColumn("_a", F.length("_alphabet").cast("double"))
    squares = F.expr("aggregate(sequence(1, length(_alphabet)), 0D, (s, i) -> s + pow(length(_plain) - length(replace(_plain, substr(_alphabet, i, 1), '')), 2))")
    values = F.expr("transform(filter(split(_plain, ''), c -> c <> ''), c -> cast(instr(_alphabet, c) as double))")
    d = d.withColumn("_chi2", F.col("_a") / F.col("n") * squares - F.col("n")).withColumn("_v", values)
    d = d.withColumn("_high", F.expr("transform(_v, v -> if(v > _a / 2, 1D, 0D))"))
    d = d.withColumn("_n1", F.expr("aggregate(_high, 0D, (s, x) -> s + x)")).withColumn("_mean", F.expr("aggregate(_v, 0D, (s, x) -> s + x) / n"))
    d = d.withColumn("_runs", F.expr("1 + aggregate(zip_with(slice(_high, 2, size(_high)), slice(_high, 1, size(_high) - 1), (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)"))
    d = d.withColumn("_var", F.expr("aggregate(_v, 0D, (s, x) -> s + (x - _mean) * (x - _mean))"))
    d = d.withColumn("_cov", F.expr("aggregate(zip_with(slice(_v, 2, size(_v)), slice(_v, 1, size(_v) - 1), (x, y) -> (x - _mean) * (y - _mean)), 0D, (s, x) -> s + x)"))
    df = F.col("_a") - 1
    even = (F.pow(F.col("_chi2") / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # Wilson-Hilferty
    n0 = F.col("n") - F.col("_n1")
    cross = 2 * F.col("_n1") * n0
    spread = cross * (cross - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    d = d.withColumn("z_even", even).withColumn("z_runs", F.when(spread > 0, (F.col("_runs") - 1 - cross / F.col("n")) / F.sqrt(spread)).otherwise(99.0))
    d = d.withColumn("z_serial", F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var") * F.sqrt("n")).otherwise(99.0))
    half = -2.302585092994046 * (_log10_lower(-F.col("z_even")) + _log10_lower(-F.abs("z_runs")) + _log10_lower(-F.abs("z_serial")) + 2 * 0.30102999566398120)
    half = F.greatest(half, F.lit(0.0))
    uniform = (F.log(1 + half + half * half / 2) - half) / 2.302585092994046  # the chi-squared tail with six degrees of freedom
    excess, root = F.col("n") * of(2), F.sqrt("n")
    spread_text = F.sqrt(2 * (df + 2 * excess))
    pulls = [(excess / spread_text, (F.col("_chi2") - df - excess) / spread_text), (root * of(3), F.col("z_runs") - root * of(3)), (-root * of(4), root * of(4) - F.col("z_serial"))]
    as_text = sum(w * z for w, z in pulls) / F.sqrt(sum(w * w for w, _ in pulls))
    out = d.withColumn("log_uniform", uniform).withColumn("random", uniform > -level).withColumn("log_p", F.least(F.lit(0.0), _log10_lower(as_text)))
    return out.drop("_plain", "_alphabet", "_a", "_chi2", "_v", "_high", "_n1", "_mean", "_runs", "_var", "_cov")


def discoveries(tokens: DataFrame, rate: float = 0.01, bins: int = 20, most: int = 400) -> DataFrame:
    """Per encoding and length band, the histogram bin from which on tokens are kept at this false-discovery rate.

    Bins are twentieths of -log10 p up to ``most``, so there are at most 4 x 20 x 401 of them.
    """
    counts = tokens.groupBy("encoding", "band", "bin").agg(F.count("*").alias("k"))
    down = Window.partitionBy("encoding", "band").orderBy(F.desc("bin"))
    whole = Window.partitionBy("encoding", "band")
    ranked = counts.withColumn("found", F.sum("k").over(down)).withColumn("m", F.sum("k").over(whole))
    kept = ranked.filter(F.col("m") * F.pow(F.lit(10.0), -F.col("bin") / bins) <= rate * F.col("found"))
    return kept.groupBy("encoding", "band").agg(F.min("bin").alias("least_bin"))


def _uncovered(d: DataFrame) -> DataFrame:
    """The tokens (_row, start, end, kind, hit) that no base span overlaps, by one sort of a text's spans."""
    some = d.filter(F.size("_tokens") > 0)
    free = some.filter(F.size("_base") == 0).select("_row", F.explode("_tokens").alias("t")).select("_row", "t.*")
    both = some.filter(F.size("_base") > 0).select("_row", F.explode(F.expr("concat(_tokens, transform(_base, b -> named_struct('start', b.start, 'end', b.end, 'kind', b.kind, 'hit', cast(NULL AS string))))")).alias("t")).select("_row", "t.*")
    base, ahead, back = F.col("kind") < 3, Window.unboundedPreceding, -1
    before = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(ahead, back))
    behind = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(ahead, back))
    alone = both.withColumn("_before", before).withColumn("_behind", behind).filter("kind = 3 AND coalesce(_before <= start, true) AND coalesce(_behind >= end, true)")
    return free.union(alone.select(*free.columns))


def secret_spans(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """doc_id and spans (structs start, end, kind number; by start, then kind) of each row's text.

    Starts and ends are code points, the end exclusive. Null texts count as empty; long texts are read whole, and
    very many spans take linear time. Base spans (assign, access, hex) always stay; random spans are added where
    no base span touches the token. The texts are read once; null ids and rows that repeat come out as they are;
    other columns take no part, whatever their names; an empty table gives an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": TOKEN}
    for name, p in patterns.items():
        d = d.withColumn(f"_m_{name}", F.regexp_extract_all("_text", F.lit(p), 0))
    for name, p in patterns.items():
        d = d.withColumn(f"_p_{name}", F.when(F.size(f"_m_{name}") > 0, F.split("_text", p, -1)))
    for k, name in enumerate(patterns):
        d = d.withColumn(f"_s_{name}", _located(f"_m_{name}", f"_p_{name}", k))
    long_enough = F.filter("_s_assign", lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 8)
    d = d.select("doc_id", F.concat(long_enough, F.col("_s_access"), F.col("_s_hex")).alias("_base"), F.col("_s_random").alias("_tokens"))
    d = cut(d.select("doc_id", F.expr("transform(_base, b -> named_struct('start', b.start, 'end', b.end, 'kind', b.kind))").alias("_base"), "_tokens").withColumn("_row", F.monotonically_increasing_id()))
    tests = battery(_uncovered(d))
    tests = tests.withColumn("band", F.floor(F.log2("n")).cast("int")).withColumn("bin", F.least(F.lit(400), F.floor(-F.col("log_p") * 20)).cast("int"))
    tests = cut(tests.select("_row", "start", "end", "kind", "encoding", "band", "bin", "random"))
    found = tests.join(F.broadcast(discoveries(tests, rate)), ["encoding", "band"]).filter(F.col("random") & (F.col("bin") >= F.col("least_bin")))
    more = found.groupBy("_row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("_more"))
    out = d.select("_row", "doc_id", "_base").join(more, "_row", "left")
    by_start = "array_sort({0}, (x, y) -> CASE WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1 ELSE x.kind - y.kind END)"
    return out.select("doc_id", F.expr(by_start.format("_base")).alias("base"), F.expr(by_start.format("concat(_base, coalesce(_more, array()))")).alias("spans"))


def _joined(column: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({column}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``secret_spans`` of ``documents`` as counts, digest and text; nulls, ties and odd rows as there."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    # in SQL: a second argument of a Python lambda, even one with a default, would be the span's index
    number = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *number, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
