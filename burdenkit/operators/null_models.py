"""Null models of the association tests: trait on covariates, per phenotype, as sums over samples.

Samples never leave the cluster. The design (a row per phenotype and sample) is summed to X'WX and X'r per
phenotype, which a task solves; for the logistic model every Newton round is one such sum.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Scratch, cut

#: Newton rounds at most, and the step that ends them: small enough for the variance, which is one round behind.
ROUNDS, STEP = 30, 1e-10
#: Weights of the logistic model are kept from zero.
LEAST_WEIGHT = 1e-12


@dataclass
class Null:
    """Fitted null models.

    ``design``: pheno, sample_id, y, x0 (1), x1, ..., mu, r (residual), v (weight: 1, or mu (1 - mu)).
    ``models``: pheno, n, rank, usable, beta, inverse (of X'VX, row by row; zero for columns that depend on earlier ones), rss.
    """

    x: list[str]
    design: DataFrame
    models: DataFrame


def products(x: list[Column], weight: Column) -> Column:
    """Sums of weight x_i x_j for i <= j, as an array."""
    return F.array(*[F.sum(weight * x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))])


def dot(beta: Column, x: list[Column]) -> Column:
    return reduce(add, (beta[k] * c for k, c in enumerate(x)))


def form(inverse: Column, x: list[Column]) -> Column:
    """x' A x of a matrix given row by row."""
    return reduce(add, (inverse[i * len(x) + j] * a * b for i, a in enumerate(x) for j, b in enumerate(x)))


def logistic(eta: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(35.0)), F.lit(-35.0))))


def square(upper: list[float], k: int) -> np.ndarray:
    """The symmetric matrix of its upper triangle, row by row."""
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = upper
    return np.triu(out) + np.triu(out, 1).T


def generalized_inverse(gram: np.ndarray, tolerance: float = 1e-10) -> tuple[np.ndarray, int]:
    """Inverse over the columns that don't depend on earlier ones (zero elsewhere), and their number."""
    kept: list[int] = []
    for k in range(len(gram)):
        if gram[k, k] <= 0:
            continue
        left = gram[k, k] - (gram[k, kept] @ np.linalg.solve(gram[np.ix_(kept, kept)], gram[kept, k]) if kept else 0.0)
        if left > tolerance * gram[k, k]:
            kept.append(k)
    out = np.zeros_like(gram)
    if kept:
        out[np.ix_(kept, kept)] = np.linalg.inv(gram[np.ix_(kept, kept)])
    return out, len(kept)


def solved(sums: DataFrame, k: int) -> DataFrame:
    """``sums`` with columns ``step`` (inverse of ``xx`` times ``xr``), ``inverse`` and ``rank``; a row a model, in batches."""

    def run(batches):
        for batch in batches:
            steps, inverses, ranks = [], [], []
            for xx, xr in zip(batch.column("xx").to_pylist(), batch.column("xr").to_pylist(), strict=True):
                gram = square(xx, k)
                if np.isfinite(gram).all():
                    inverse, rank = generalized_inverse(gram)
                else:
                    inverse, rank = np.zeros((k, k)), 0
                steps.append((inverse @ np.array(xr)).tolist())
                inverses.append(inverse.reshape(-1).tolist())
                ranks.append(rank)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(steps, kind), pa.array(inverses, kind), pa.array(ranks, pa.int32())], names=[*batch.schema.names, "step", "inverse", "rank"])

    return sums.mapInArrow(run, _ddl(sums) + ", step array<double>, inverse array<double>, rank int")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def design(outcomes: DataFrame, covariates: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """pheno, sample_id, y, x0 (1), x1, ... of the samples with outcome and all covariates, and the names of the x.

    ``outcomes``: pheno, sample_id, y (null: missing). ``covariates``: sample_id, covariate, value (null: missing);
    a column each, shifted to mean 0 and scaled to deviation 1 over all samples, which changes no fit.
    """
    rows = outcomes.filter("y IS NOT NULL").select("pheno", "sample_id", F.col("y").cast("double").alias("y"), F.lit(1.0).alias("x0"))
    if covariates is None:
        return rows, ["x0"]
    names = sorted(r[0] for r in covariates.select("covariate").distinct().collect())  # columns, not rows
    wide = covariates.groupBy("sample_id").pivot("covariate", names).agg(F.first("value")).dropna()
    of = wide.agg(*[f(F.col(f"`{n}`")).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    scaled = [((F.col(f"`{n}`") - (of[f"mean{i}"] or 0.0)) / (of[f"sd{i}"] or 1.0)).alias(f"x{i + 1}") for i, n in enumerate(names)]
    return rows.join(wide.select("sample_id", *scaled), "sample_id"), [f"x{i}" for i in range(len(names) + 1)]


def linear_null(outcomes: DataFrame, covariates: DataFrame | None = None) -> Null:
    """Least squares of y on the covariates. Usable where there are more samples than columns."""
    rows, x = design(outcomes, covariates)
    rows, cols = cut(rows), [F.col(c) for c in x]
    sums = rows.groupBy("pheno").agg(F.count("*").alias("n"), products(cols, F.lit(1.0)).alias("xx"), F.array(*[F.sum(c * F.col("y")) for c in cols]).alias("xr"))
    fits = cut(solved(sums, len(x)).select("pheno", "n", "rank", F.col("step").alias("beta"), "inverse"))
    mu = dot(F.col("beta"), cols)
    fitted = cut(rows.join(fits.select("pheno", "beta"), "pheno").select("pheno", "sample_id", "y", *x, mu.alias("mu"), (F.col("y") - mu).alias("r"), F.lit(1.0).alias("v")))
    rss = fitted.groupBy("pheno").agg(F.sum(F.col("r") * F.col("r")).alias("rss"))
    return Null(x, fitted, cut(fits.join(rss, "pheno").withColumn("usable", F.col("n") > F.col("rank"))))


def logistic_null(outcomes: DataFrame, covariates: DataFrame | None = None) -> Null:
    """Newton's method on all phenotypes at once. Usable where there are cases and controls, more samples than columns, and it converged."""
    rows, x = design(outcomes, covariates)
    rows, cols, k = cut(rows), [F.col(c) for c in x], len(x)
    scratch = Scratch(rows.sparkSession)
    state = scratch.put("state", rows.groupBy("pheno").agg(F.count("*").alias("n"), F.sum("y").alias("cases")).withColumn("beta", F.array_repeat(F.lit(0.0), k)).withColumn("inverse", F.array_repeat(F.lit(0.0), k * k)).withColumn("rank", F.lit(0)).withColumn("size", F.lit(float("inf"))))
    mu = logistic(dot(F.col("beta"), cols))
    v = F.greatest(mu * (1 - mu), F.lit(LEAST_WEIGHT))
    for _ in range(ROUNDS):
        if state.filter(F.col("size") >= STEP).isEmpty():
            break
        now = rows.join(state.select("pheno", "beta"), "pheno")
        sums = now.groupBy("pheno").agg(products(cols, v).alias("xx"), F.array(*[F.sum(c * (F.col("y") - mu)) for c in cols]).alias("xr"))
        moved = solved(sums, k).join(state.select("pheno", "n", "cases", "beta"), "pheno")
        state = scratch.put("state", moved.select("pheno", "n", "cases", F.zip_with("beta", "step", lambda a, b: a + b).alias("beta"), "inverse", "rank", F.array_max(F.transform("step", F.abs)).alias("size")))
    far = F.array_max(F.transform("beta", F.abs))
    models = cut(state.select("pheno", "n", "rank", "beta", "inverse", F.lit(None).cast("double").alias("rss"), ((F.col("n") > F.col("rank")) & (F.col("cases") > 0) & (F.col("cases") < F.col("n")) & (F.col("size") < STEP) & (far < 30)).alias("usable")))
    scratch.drop("state")
    fitted = rows.join(models.select("pheno", "beta"), "pheno").select("pheno", "sample_id", "y", *x, mu.alias("mu"), (F.col("y") - mu).alias("r"), v.alias("v"))
    return Null(x, cut(fitted), models)
