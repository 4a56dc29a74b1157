"""Kernel tests (sequence kernel association) of bins from carriers only.

Of the samples a bin needs the scores of its loci, their sums with the covariates and the products of pairs of
loci that some sample carries both of. All are sums over the nonzero genotypes, so no samples x loci matrix exists.
Loci that no chain of such pairs links are apart in a bin's matrix but for the covariates, which are a few columns: a
large bin is solved block by block, in as many tasks as it has large blocks, and its matrix never exists as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..functions.tails import LEAST_WEIGHT, Chained, Reduced, quadratic_form_p
from .burden import KEY
from .null_models import Null

#: Share of missing genotypes beyond which a locus takes no part.
MOST_MISSING = 0.15
#: Loci of a bin up to which its matrix is solved whole, and of a block up to which the bin's own task solves it.
WHOLE, OWN = 300, 300


def fit_loci(calls: DataFrame, models: DataFrame, most_missing: float = MOST_MISSING) -> DataFrame:
    """pheno, locus_id, mean of the loci fit for the test: few missing genotypes and two or more different ones.

    ``calls``: pheno, locus_id, sample_id, dosage of the null model's samples, null where missing and absent where 0.
    """
    dose = F.col("dosage")
    by = calls.groupBy("pheno", "locus_id").agg(F.count_if(dose.isNull()).alias("missing"), F.count(dose).alias("seen"), F.coalesce(F.sum(dose), F.lit(0.0)).alias("total"), F.count_distinct(dose).alias("kinds"), F.count_if(dose == 0).alias("zeros"))
    x = by.join(models.select("pheno", "n"), "pheno")
    absent = F.col("n") - F.col("missing") - F.col("seen")
    kinds = F.col("kinds") + F.when((absent > 0) & (F.col("zeros") == 0), 1).otherwise(0)
    return x.filter((F.col("missing") <= most_missing * F.col("n")) & (kinds >= 2)).select("pheno", "locus_id", (F.col("total") / (F.col("n") - F.col("missing"))).alias("mean"))


def weighted_genotypes(bins: DataFrame, doses: DataFrame, weights: DataFrame, null: Null) -> DataFrame:
    """pheno, locus_id, sample_id, g (weighted, missing ones at their mean; nonzero only), r, v and the covariates."""
    used = bins.select("pheno", "locus_id").distinct()
    calls = doses.filter("dosage IS NULL OR dosage > 0").select("locus_id", "sample_id", F.col("dosage").cast("double").alias("dosage"))
    met = calls.join(used, "locus_id").join(null.design.drop("y", "mu"), ["pheno", "sample_id"])
    fit = fit_loci(met, null.models).join(weights, ["pheno", "locus_id"])
    g = F.coalesce("dosage", "mean") * F.col("weight")
    return met.join(fit, ["pheno", "locus_id"]).select("pheno", "locus_id", "sample_id", g.alias("g"), "r", "v", *null.x).filter("g <> 0")


def locus_sums(genotypes: DataFrame, null: Null) -> DataFrame:
    """pheno, locus_id, score (sum of g r), h (sums of g v x)."""
    g = F.col("g")
    return genotypes.groupBy("pheno", "locus_id").agg(F.sum(g * F.col("r")).alias("score"), F.array(*[F.sum(g * F.col("v") * F.col(c)) for c in null.x]).alias("h"))


def pair_sums(bins: DataFrame, genotypes: DataFrame) -> DataFrame:
    """pheno, kind, bin, a, b (loci, a <= b), product (sum of g_a v g_b) of pairs that a sample carries both of."""
    own = bins.join(genotypes.select("pheno", "locus_id", "sample_id", "g", "v"), ["pheno", "locus_id"])
    carried = own.groupBy(*KEY, "sample_id").agg(F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct("locus_id", "g"))).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a, i: F.transform(F.slice(F.col("c"), i + 1, F.size("c")), lambda b: F.struct(a["locus_id"].alias("a"), b["locus_id"].alias("b"), (a["g"] * b["g"]).alias("g")))))
    return carried.select(*KEY, "v", F.explode(pairs).alias("p")).groupBy(*KEY, "p.a", "p.b").agg(F.sum(F.col("p.g") * F.col("v")).alias("product"))


def locus_statistics(genotypes: DataFrame, null: Null, binary: bool) -> DataFrame:
    """pheno, locus_id, q, trace: what a locus adds to its bins' statistic and to the sum of the weights of their null distribution."""
    sums = locus_sums(genotypes, null)
    own = genotypes.groupBy("pheno", "locus_id").agg(F.sum(F.col("g") * F.col("g") * F.col("v")).alias("gg"))
    k = len(null.x)
    h = F.col("h")
    inner = sum((F.col("inverse")[i * k + j] * h[i] * h[j] for i in range(k) for j in range(k)), F.lit(0.0))
    scale = F.lit(1.0) if binary else F.col("rss") / (F.col("n") - F.col("rank"))
    return sums.join(own, ["pheno", "locus_id"]).join(null.models.filter("usable"), "pheno").select("pheno", "locus_id", (F.col("score") * F.col("score") / scale / 2).alias("q"), ((F.col("gg") - inner) / 2).alias("trace"))


def bin_statistics(bins: DataFrame, genotypes: DataFrame, null: Null, binary: bool) -> DataFrame:
    """pheno, kind, bin, loci, q, trace: the test's statistic and the sum of the weights of its null distribution."""
    return summed_statistics(bins.join(locus_statistics(genotypes, null, binary), ["pheno", "locus_id"]))


def summed_statistics(rows: DataFrame) -> DataFrame:
    """The same of bins whose rows have the ``locus_statistics`` of their loci."""
    return rows.groupBy(*KEY).agg(F.count("*").alias("loci"), F.sum("q").alias("q"), F.sum("trace").alias("trace"))


def small_matrix_p(score: np.ndarray, h: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], inverse: np.ndarray, scale: float) -> tuple:
    """loci, q, trace, weights, accuracy, fault, p, coded p, status of a bin from its sums; ``pairs``: places a, b and product."""
    q = 0.5 * float(score @ score) / scale
    middle = np.zeros((len(score), len(score)))
    a, b, product = pairs
    middle[a, b] = product
    middle[b, a] = product
    middle -= h @ inverse @ h.T
    trace = float(middle.trace() / 2)
    live = np.abs(middle).sum(0) >= LEAST_WEIGHT  # loci that the covariates explain have an empty column
    try:
        values = np.linalg.eigvalsh(middle[np.ix_(live, live)] / 2) if live.any() else np.empty(0)
    except np.linalg.LinAlgError:
        return len(score), q, trace, 0, 0.0, 9, 1.0, 10.0, "eigenvalues failed"
    values = values[values > LEAST_WEIGHT]
    if not len(values):
        return len(score), q, trace, 0, 0.0, 0, 1.0, -1.0, "no eigenvalues"
    p, coded, accuracy, fault = quadratic_form_p(q, values)
    return len(score), q, trace, len(values), accuracy, fault, p, coded, "fault" if fault else "ok"


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that pairs ``a``, ``b`` lead to from each of ``n`` places."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, label[a], least)
        np.minimum.at(now, label[b], least)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def spectrum(h: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of half the products of linked loci, and half the covariates' part (``h`` ``root``) seen from its eigenvectors."""
    middle = np.zeros((len(h), len(h)))
    a, b, product = pairs
    middle[a, b] = product / 2
    middle[b, a] = product / 2
    values, vectors = np.linalg.eigh(middle)
    return values, vectors.T @ (h @ root) / np.sqrt(2)


def tridiagonal(matrix: np.ndarray, columns: np.ndarray, panel: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and neighbours of a tridiagonal matrix similar to the symmetric ``matrix``, and ``columns`` turned likewise.

    Householder's reflections a panel at a time, in the place of ``matrix`` (which is lost), so it needs little memory beside it.
    """
    n, columns = len(matrix), columns.copy()
    diagonal, beside = np.zeros(n), np.zeros(max(n - 1, 0))
    for start in range(0, n, panel):
        stop = min(start + panel, n)
        v, w = np.zeros((n, stop - start)), np.zeros((n, stop - start))
        for p, j in enumerate(range(start, stop)):
            diagonal[j] = matrix[j, j] - 2 * v[j, :p] @ w[j, :p]
            if j == n - 1:
                break
            x = matrix[j + 1 :, j] - v[j + 1 :, :p] @ w[j, :p] - w[j + 1 :, :p] @ v[j, :p]
            size = np.linalg.norm(x)
            beside[j] = x[0]
            if n - j - 1 < 2 or np.linalg.norm(x[1:]) == 0:
                continue  # nothing to reflect
            beside[j] = -size if x[0] > 0 else size
            x[0] -= beside[j]
            tau = 2 / (x @ x)
            y = matrix[j + 1 :, j + 1 :] @ x - v[j + 1 :, :p] @ (w[j + 1 :, :p].T @ x) - w[j + 1 :, :p] @ (v[j + 1 :, :p].T @ x)
            y *= tau
            y -= 0.5 * tau * (y @ x) * x
            v[j + 1 :, p], w[j + 1 :, p] = x, y
            columns[j + 1 :] -= tau * np.outer(x, x @ columns[j + 1 :])
        for at in range(stop, n, 512):
            rows = slice(at, min(at + 512, n))
            matrix[rows, stop:] -= v[rows] @ w[stop:].T + w[rows] @ v[stop:].T
    return diagonal, beside, columns


def root_of(inverse: np.ndarray) -> np.ndarray:
    """A matrix whose square (times its transpose) is ``inverse``, which has no negative eigenvalues."""
    values, vectors = np.linalg.eigh(inverse)
    return vectors * np.sqrt(np.maximum(values, 0))


def blocks(h: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], root: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``spectrum`` of all blocks of up to ``own`` loci, and the block of each locus in a larger one (else -1)."""
    a, b, product = pairs
    label = linked(len(h), a, b)
    size = np.bincount(label, minlength=len(h))[label]
    alone = size == 1
    diagonal = np.zeros(len(h))
    diagonal[a[a == b]] = product[a == b]
    values, rows = [diagonal[alone] / 2], [h[alone] @ root / np.sqrt(2)]
    # the loci and pairs of a block are a stretch each
    order, of_pair = np.argsort(label, kind="stable"), np.argsort(label[a], kind="stable")
    place = np.empty(len(h), int)
    place[order] = np.arange(len(h))
    a, b, product = a[of_pair], b[of_pair], product[of_pair]
    of_locus, of_pair = label[order], label[a]
    for k in np.unique(label[(size > 1) & (size <= own)]):
        low, high = np.searchsorted(of_locus, (k, k + 1))
        first, last = np.searchsorted(of_pair, (k, k + 1))
        found = spectrum(h[order[low:high]], (place[a[first:last]] - low, place[b[first:last]] - low, product[first:last]), root)
        values.append(found[0])
        rows.append(found[1])
    return np.concatenate(values), np.concatenate(rows), np.where((size > own) & ~alone, label, -1)


def reduced_p(q: float, values: np.ndarray, rows: np.ndarray, chains: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None) -> tuple:
    """weights, accuracy, fault, p, coded p, status of a bin by the spectra of its small blocks and its large ones as ``chains``."""
    if not all(np.isfinite(x).all() for x in (values, rows, *(x for c in chains or () for x in c))):
        return 0, 0.0, 9, 1.0, 10.0, "eigenvalues failed"
    form = Chained(values, rows, chains) if chains else Reduced(values, rows)
    if not (weights := form.above(LEAST_WEIGHT)):
        return 0, 0.0, 0, 1.0, -1.0, "no eigenvalues"
    p, coded, accuracy, fault = quadratic_form_p(q, np.array([form.high]) if weights == 1 else form)
    return weights, accuracy, fault, p, coded, "fault" if fault else "ok"


def kernel_test(bins: DataFrame, doses: DataFrame, weights: DataFrame, names: DataFrame, null: Null, binary: bool) -> DataFrame:
    """pheno, kind, bin, n, loci, q, trace, weights (of the null distribution), accuracy, fault, p_value, p_coded, status of all bins ``names``.

    Coded p: see ``quadratic_form_p``; -1 without eigenvalues, 10 where their computation failed, 1 without loci or null model.
    """
    genotypes = cut(weighted_genotypes(bins, doses, weights, null))
    nothing = F.lit(None)
    loci = bins.join(locus_sums(genotypes, null), ["pheno", "locus_id"]).select(*KEY, F.col("locus_id").alias("a"), nothing.cast("long").alias("b"), F.col("score").alias("value"), "h")
    pairs = pair_sums(bins, genotypes).select(*KEY, "a", "b", F.col("product").alias("value"), nothing.cast("array<double>").alias("h"))
    scale = F.lit(1.0) if binary else F.col("rss") / (F.col("n") - F.col("rank"))
    models = null.models.filter("usable").select("pheno", "inverse", scale.alias("scale"))
    rows = loci.join(models, "pheno").unionByName(pairs.join(models.select("pheno"), "pheno", "left_semi"), allowMissingColumns=True)
    ends = [("weights", pa.int64()), ("accuracy", pa.float64()), ("fault", pa.int64()), ("p_value", pa.float64()), ("p_coded", pa.float64()), ("status", pa.string())]
    sums = [("loci", pa.int64()), ("q", pa.float64()), ("trace", pa.float64())]
    parts = [("values", pa.list_(pa.float64())), ("rows", pa.list_(pa.float64()))]
    links = [("links", pa.list_(pa.float64()))]
    left = [("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.float64()), ("h", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64()))]
    key_kinds = [(c, pa.string()) for c in KEY]
    ddl = {pa.string(): "string", pa.int64(): "long", pa.float64(): "double", pa.list_(pa.float64()): "array<double>"}

    def named(kinds):
        return ", ".join(f"{n} {ddl[t]}" for n, t in kinds)

    def matrix(rows: pa.Table):
        is_pair = rows["b"].is_valid()
        own, pair = rows.filter(pa.compute.invert(is_pair)).sort_by("a"), rows.filter(is_pair)
        at = own["a"].to_numpy()
        h = own["h"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
        inverse = np.array(own["inverse"][0].as_py(), float).reshape(h.shape[1], h.shape[1])
        return own, pair, h, tuple(np.searchsorted(at, pair[c].to_numpy()) for c in ("a", "b")), inverse

    def of(key: tuple, rows: pa.Table) -> pa.Table:
        """A bin's result if it is small; else its sums, the spectrum of its small blocks, and the rows of the others as they are."""
        own, pair, h, places, inverse = matrix(rows)
        score, scale, product = own["value"].to_numpy(), own["scale"][0].as_py(), pair["value"].to_numpy()
        schema = pa.schema([*key_kinds, *sums, *ends, *parts, *left])
        one = dict(zip(KEY, (x.as_py() for x in key), strict=True))
        if len(score) <= WHOLE or not np.isfinite(h).all():
            found = small_matrix_p(score, h, (*places, product), inverse, scale)
            return pa.Table.from_pylist([one | dict(zip([n for n, _ in (*sums, *ends)], found, strict=True))], schema)
        values, seen, block = blocks(h, (*places, product), root_of(inverse), OWN)
        trace = (product[places[0] == places[1]].sum() - np.einsum("ij,jk,ik", h, inverse, h, optimize=True)) / 2
        one |= {"loci": len(score), "q": 0.5 * float(score @ score) / scale, "trace": float(trace), "values": values.tolist(), "rows": seen.reshape(-1).tolist()}
        more = []
        for part, label in ((own, block), (pair, block[places[0]])):
            x = part.append_column("block", pa.array(label)).filter(pa.array(label >= 0))
            more.append(pa.table([x[n] if n in x.column_names else pa.nulls(len(x), t) for n, t in zip(schema.names, schema.types, strict=True)], schema))
        return pa.concat_tables([pa.Table.from_pylist([one], schema), *more])

    def of_block(key: tuple, rows: pa.Table) -> pa.Table:
        """A large block as a tridiagonal matrix, made in the place of its own: eigenvectors would take five times the memory."""
        _, pair, h, (a, b), inverse = matrix(rows)
        whole, product = np.zeros((len(h), len(h))), pair["value"].to_numpy() / 2
        whole[a, b] = product
        whole[b, a] = product
        along, link, seen = tridiagonal(whole, h @ root_of(inverse) / np.sqrt(2))
        one = dict(zip(KEY, (x.as_py() for x in key[:-1]), strict=True))
        return pa.Table.from_pylist([one | {"values": along.tolist(), "links": link.tolist(), "rows": seen.reshape(-1).tolist()}], pa.schema([*key_kinds, *parts, *links]))

    def of_large(key: tuple, rows: pa.Table) -> pa.Table:
        main, chains, k = None, [], 1
        for i in range(len(rows)):
            x, values, seen = rows.slice(i, 1), *(rows[c][i].values.to_numpy(zero_copy_only=False) for c in ("values", "rows"))
            if x["loci"][0].is_valid:
                main, own = x.to_pylist()[0], (values, seen)
            else:
                k = len(seen) // len(values)
                chains.append((values, rows["links"][i].values.to_numpy(zero_copy_only=False), seen.reshape(len(values), k)))
        k = len(own[1]) // len(own[0]) if len(own[0]) else k
        found = reduced_p(main["q"], own[0], own[1].reshape(len(own[0]), k), chains)
        one = dict(zip(KEY, (x.as_py() for x in key), strict=True)) | {n: main[n] for n, _ in sums}
        return pa.Table.from_pylist([one | dict(zip([n for n, _ in ends], found, strict=True))], pa.schema([*key_kinds, *sums, *ends]))

    first = cut(rows.groupBy(*KEY).applyInArrow(of, named([*key_kinds, *sums, *ends, *parts, *left])))
    later = first.filter("block IS NOT NULL").groupBy(*KEY, "block").applyInArrow(of_block, named([*key_kinds, *parts, *links]))
    spectra = first.filter("`values` IS NOT NULL").select(*KEY, *[n for n, _ in sums + parts], nothing.cast("array<double>").alias("links")).unionByName(later, allowMissingColumns=True)
    large = spectra.groupBy(*KEY).applyInArrow(of_large, named([*key_kinds, *sums, *ends]))
    found = first.filter("status IS NOT NULL").select(*KEY, *[n for n, _ in sums + ends]).unionByName(large)
    every = names.join(null.models.select("pheno", "n", "usable"), "pheno", "left").join(found, KEY, "left")
    status = F.coalesce("status", F.when(F.col("usable"), "no loci").otherwise("no null model"))
    zero = [F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("loci", "long"), ("q", "double"), ("trace", "double"), ("weights", "long"), ("accuracy", "double"), ("fault", "long"))]
    return every.select(*KEY, F.coalesce("n", F.lit(0)).alias("n"), *zero, F.coalesce("p_value", F.lit(1.0)).alias("p_value"), F.coalesce("p_coded", F.lit(1.0)).alias("p_coded"), status.alias("status"))
