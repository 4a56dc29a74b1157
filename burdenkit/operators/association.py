"""Association tests of bins: linear, logistic, rank-sum and the two kernel tests, for all phenotypes and bins at once.

One registry, one result: pheno, kind, bin, test, n, p_value, margin (how far p may be off), p_coded, status. Burden tests
need sums over carriers only; all other samples enter through the null models and their totals. The logistic
test goes in Newton rounds, each one sum per bin. The kernel tests are in ``kernel``.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Scratch, cut
from ..functions.tails import NORMAL_MARGIN, T_MARGIN, normal_tail, t_tail
from . import burden as u
from .kernel import kernel_test
from .null_models import LEAST_WEIGHT, ROUNDS, STEP, Null, dot, form, linear_null, logistic, logistic_null, solved

KEY = u.KEY
#: Bins up to which the logistic test's estimates are broadcast each round.
LISTED = 500_000
OUT = [*KEY, "test", "n", "p_value", "margin", "p_coded", "status"]


@dataclass
class Study:
    """What the tests read. Null models are fitted once, when the first test asks for them.

    ``bins``: pheno, kind, bin, locus_id. ``burdens``: pheno, kind, bin, sample_id, burden above 0. ``doses``: locus_id,
    sample_id, dosage (null: missing; absent: 0). ``weights``: pheno, locus_id, weight. ``status``: pheno, sample_id, is_case.
    ``outcomes``: pheno, sample_id, y. ``covariates``: sample_id, covariate, value (null: missing), or None.
    """

    bins: DataFrame
    burdens: DataFrame
    doses: DataFrame
    weights: DataFrame
    status: DataFrame
    outcomes: DataFrame
    covariates: DataFrame | None = None
    reference_df: bool = False

    @cached_property
    def linear(self) -> Null:
        return linear_null(self.outcomes, self.covariates)

    @cached_property
    def logistic(self) -> Null:
        return logistic_null(self.status.select("pheno", "sample_id", F.col("is_case").cast("double").alias("y")), self.covariates)

    @cached_property
    def names(self) -> DataFrame:
        """pheno, kind, bin of all bins."""
        return cut(self.bins.select(*KEY).distinct())


def burden_sums(burdens: DataFrame, null: Null) -> DataFrame:
    """pheno, kind, bin and sums over the null model's samples: bb of burden squared, br with the residual, b0, b1, ... with the covariates, all weighted by v."""
    b, v = F.col("burden"), F.col("v")
    met = u.with_samples(burdens, null.design.select("pheno", "sample_id", "r", "v", *null.x))
    return met.groupBy(*KEY).agg(F.sum(b * b * v).alias("bb"), F.sum(b * F.col("r")).alias("br"), *[F.sum(b * v * F.col(c)).alias(f"b{k}") for k, c in enumerate(null.x)])


def linear_effects(burdens: DataFrame, names: DataFrame, null: Null, reference_df: bool = False) -> DataFrame:
    """pheno, kind, bin, n, beta, se, t, df of y on covariates and burden; beta is null where the burden depends on the covariates."""
    x = names.join(null.models, "pheno").join(burden_sums(burdens, null), KEY, "left")
    left = F.col("bb") - form(F.col("inverse"), [F.col(f"b{k}") for k in range(len(null.x))])
    x = x.withColumn("_xx", F.when(F.col("usable") & (left > 1e-9 * F.col("bb")), left)).withColumn("df", F.col("n") - F.col("rank") - 1 + int(reference_df))
    x = x.withColumn("beta", F.col("br") / F.col("_xx"))
    se = F.sqrt((F.col("rss") - F.col("beta") * F.col("br")) / (F.col("n") - F.col("rank") - 1) / F.col("_xx"))
    x = x.withColumn("se", F.when(F.col("n") > F.col("rank") + 1, se))
    return x.select(*KEY, "n", "beta", "se", F.when(F.col("se") > 0, F.col("beta") / F.col("se")).alias("t"), "df", "usable")


def logistic_effects(burdens: DataFrame, names: DataFrame, null: Null, reference_df: bool = False, few: int = 200_000, salts: int = 32) -> DataFrame:
    """pheno, kind, bin, n, beta, se, t, df, way of case status on covariates and burden.

    ``way``: constant (the burden depends on the covariates, or nobody carries), separated (all carriers are cases, or
    all are controls: the effect is infinite), none (no null model), converged, or stopped after ROUNDS rounds.

    Every Newton round is one sum per bin. Samples at burden zero differ in their covariates only, so they are counted
    by distinct covariates once (cells); a bin sums over all cells as if nobody carried, and over its carriers the
    difference that the burden makes. Cells are broadcast when there are at most ``few``; else they are dealt to
    ``salts`` copies, each of which meets a share of the bins.
    """
    k = len(null.x)
    x = [F.col(c) for c in null.x]
    usable = null.models.filter("usable").select("pheno", "n", "rank", F.col("beta").alias("null_beta"))
    scratch = Scratch(names.sparkSession)
    cells = scratch.put("cells", null.design.groupBy("pheno", *null.x).agg(F.count("*").alias("cell_n"), F.sum("y").alias("cell_y")))
    small = cells.count() <= few
    # dealt by bins once: a round then sums them where they lie, and only bins are shuffled
    carriers = scratch.put("carriers", u.with_samples(burdens.filter("burden <> 0"), null.design.select("pheno", "sample_id", "y", *null.x)).repartition(*KEY))
    met = carriers.groupBy(*KEY).agg(F.min("y").alias("_low"), F.max("y").alias("_high"), F.count("*").alias("_carriers"))
    start = names.join(usable, "pheno", "left").join(met, KEY, "left")
    way = F.when(F.col("n").isNull(), "none").when(F.col("_carriers").isNull(), "constant").when(F.col("_low") == F.col("_high"), "separated").otherwise("open")
    zero = F.lit(None).cast("double")
    listed = names.count() <= LISTED
    state = scratch.put("state", start.select(*KEY, "n", "rank", F.concat("null_beta", F.array(F.lit(0.0))).alias("beta"), zero.alias("variance"), way.alias("way")))
    eta = dot(F.col("beta"), x)
    mu0, mu = logistic(eta), logistic(eta + F.col("beta")[k] * F.col("burden"))
    v0, v = (F.greatest(m * (1 - m), F.lit(LEAST_WEIGHT)) for m in (mu0, mu))
    upper = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    total = [f"s{m}" for m in range(len(upper) + k + 1)]
    for _ in range(ROUNDS):
        active = state.filter("way = 'open'").select(*KEY, "beta")
        if active.isEmpty():
            break
        if small:
            pairs = active.join(F.broadcast(cells), "pheno")
        else:
            dealt = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            pairs = active.withColumn("_salt", F.pmod(F.xxhash64(*KEY), F.lit(salts)).cast("int")).join(dealt, ["pheno", "_salt"])
        n, y = F.col("cell_n"), F.col("cell_y")
        of = [n * v0 * x[i] * x[j] if j < k else F.lit(0.0) for i, j in upper] + [x[i] * (y - n * mu0) for i in range(k)] + [F.lit(0.0)]
        all_zero = pairs.groupBy(*KEY).agg(*[F.sum(e).alias(t) for e, t in zip(of, total, strict=True)])
        b = F.col("burden")
        of = [x[i] * x[j] * (v - v0) if j < k else x[i] * b * v if i < k else b * b * v for i, j in upper] + [x[i] * (mu0 - mu) for i in range(k)] + [b * (F.col("y") - mu)]
        own = carriers.join(F.broadcast(active) if listed else active, KEY).groupBy(*KEY).agg(*[F.sum(e).alias(t) for e, t in zip(of, total, strict=True)])
        sums = all_zero.unionByName(own).groupBy(*KEY).agg(*[F.sum(t).alias(t) for t in total])
        sums = sums.select(*KEY, F.array(*total[: len(upper)]).alias("xx"), F.array(*total[len(upper) :]).alias("xr"))
        moved = solved(sums, k + 1).select(*KEY, F.zip_with("xr", "step", lambda _, s: s).alias("_step"), F.col("inverse")[(k + 1) ** 2 - 1].alias("_variance"))
        now = state.join(moved, KEY, "left")
        size = F.array_max(F.transform("_step", F.abs))
        after = F.when(F.col("_step").isNull(), F.col("way")).when(F.col("_variance") <= 0, "constant").when(size < STEP, "converged").otherwise("open")
        state = scratch.put("state", now.select(*KEY, "n", "rank", F.when(F.col("_step").isNotNull(), F.zip_with("beta", "_step", lambda a, s: a + s)).otherwise(F.col("beta")).alias("beta"), F.coalesce("_variance", "variance").alias("variance"), after.alias("way")))
    found = state.withColumn("_b", F.when(F.col("way").isin("converged", "open") & (F.col("variance") > 0), F.col("beta")[k])).withColumn("se", F.when(F.col("_b").isNotNull(), F.sqrt("variance")))
    last = F.when(F.col("way") == "open", "stopped").otherwise(F.col("way"))
    return cut(found.select(*KEY, "n", F.col("_b").alias("beta"), "se", (F.col("_b") / F.col("se")).alias("t"), (F.col("n") - F.col("rank") - 1 + int(reference_df)).alias("df"), last.alias("way")))


def rank_sums(burdens: DataFrame, names: DataFrame, status: DataFrame, reference_ties: bool = False) -> DataFrame:
    """pheno, kind, bin, n, w, z of all bins; where all samples tie at zero w is its mean and z null."""
    totals = status.groupBy("pheno").agg(F.count_if(~F.col("is_case")).alias("n0"), F.count_if("is_case").alias("n1"))
    found = u.rank_sum(u.with_status(burdens, status), totals, reference_ties)
    n0, n = F.col("n0"), F.col("n0") + F.col("n1")
    return names.join(F.broadcast(totals), "pheno").join(found, KEY, "left").select(*KEY, n.alias("n"), F.coalesce("w", n0 * (n + 1) / 2).alias("w"), "z")


def _result(x: DataFrame, test: str, p, margin, status, coded=None) -> DataFrame:
    return x.select(*KEY, F.lit(test).alias("test"), F.col("n").cast("long").alias("n"), p.alias("p_value"), margin.alias("margin"), (p if coded is None else coded).alias("p_coded"), status.alias("status"))


def _linear(s: Study) -> DataFrame:
    x = linear_effects(s.burdens, s.names, s.linear, s.reference_df)
    known = F.col("t").isNotNull()
    return _result(x, "linear", F.when(known, t_tail(F.col("t"), F.col("df"))).otherwise(1.0), F.when(known, T_MARGIN).otherwise(0.0), F.when(~F.col("usable"), "no null model").when(known, "ok").otherwise("constant burden"))


def _logistic(s: Study) -> DataFrame:
    x = logistic_effects(s.burdens, s.names, s.logistic, s.reference_df)
    known, way = F.col("t").isNotNull(), F.col("way")
    status = F.when(way == "none", "no null model").when(way == "constant", "constant burden").when(way == "converged", "ok").otherwise(way)
    return _result(x, "logistic", F.when(known, t_tail(F.col("t"), F.col("df"))).otherwise(1.0), F.when(known, T_MARGIN).otherwise(0.0), status)


def _wilcoxon(s: Study) -> DataFrame:
    x = rank_sums(s.burdens, s.names, s.status)
    known = F.col("z").isNotNull()
    return _result(x, "wilcoxon", F.when(known, normal_tail(F.col("z"))).otherwise(1.0), F.when(known, NORMAL_MARGIN).otherwise(0.0), F.when(known, "ok").otherwise("all tied"))


def _kernel(test: str, binary: bool) -> Callable[[Study], DataFrame]:
    def run(s: Study) -> DataFrame:
        x = kernel_test(s.bins, s.doses, s.weights, s.names, s.logistic if binary else s.linear, binary)
        return _result(x, test, F.col("p_value"), F.col("accuracy"), F.col("status"), F.col("p_coded"))

    return run


#: All tests by name.
TESTS: dict[str, Callable[[Study], DataFrame]] = {"linear": _linear, "logistic": _logistic, "wilcoxon": _wilcoxon, "skat-linear": _kernel("skat-linear", False), "skat-logistic": _kernel("skat-logistic", True)}


def run_tests(study: Study, names: list[str]) -> DataFrame:
    """The tests of these names over all bins of the study; repeats are ignored, unknown names are warned of and skipped."""
    known = []
    for name in dict.fromkeys(names):
        if name in TESTS:
            known.append(TESTS[name](study))
        else:
            warnings.warn(f"no test {name}", stacklevel=2)
    if not known:
        schema = "pheno string, kind string, bin string, test string, n long, p_value double, margin double, p_coded double, status string"
        return study.burdens.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, known)
