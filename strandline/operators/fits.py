"""Least-squares fits of all features at once: sums of products in one aggregation, small systems solved afterwards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.distributions import p_from_z
from strandline.sources.storage import Shelf

#: Upper probabilities of a Poisson variable of mean 1: a uniform number beyond so many of them is that value. Further ones are below 1e-9.
POISSON = tuple(float(x) for x in np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(12)]))


def cross_products(x: list[Column], y: Column, weight: Column) -> list[Column]:
    """The normal equations' sums of a group: ``_gram`` (upper triangle, by rows) and ``_side``."""
    gram = [F.sum(weight * x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    return [F.array(*gram).alias("_gram"), F.array(*(F.sum(weight * c * y) for c in x)).alias("_side")]


def solved(ridge: float = 0.0):
    """A function of ``_gram`` and ``_side``: the coefficients, and after them the last one's variance factor.

    Without a ridge, coefficients that the rows don't determine are those of least norm. A batch of systems is solved at once.
    """

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, side: pd.Series) -> pd.Series:
        b = np.array(side.tolist(), float)
        k = b.shape[1] if b.ndim == 2 else 0
        m, at = np.zeros((len(b), k, k)), np.triu_indices(k)
        m[:, at[0], at[1]] = np.array(gram.tolist(), float).reshape(len(b), -1)
        m[:, at[1], at[0]] = m[:, at[0], at[1]]
        inverse = np.linalg.inv(m + ridge * np.eye(k)) if ridge else np.linalg.pinv(m, rcond=1e-12, hermitian=True)
        return pd.Series([*np.concatenate([(inverse @ b[:, :, None])[:, :, 0], inverse[:, -1, -1:]], axis=1)])

    return solve


def poisson_hash(*parts: Column) -> Column:
    """What a draw depends on: the first 32 bits, in hexadecimal digits, of a digest of what identifies row and draw."""
    return F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8)


def poisson_weight(drawn: Column) -> Column:
    """How often a row is drawn in a Poisson bootstrap, from :func:`poisson_hash`: any partitioning gives the same. Digits of one length compare as numbers do."""
    least = [int(np.ceil(t * 2.0**32)) for t in POISSON]
    return sum(((drawn >= f"{n:08x}").cast("double") for n in least if n < 2**32), F.lit(0.0))


def negative_binomial(rows: DataFrame, features: DataFrame, x: list[str], steps: int) -> DataFrame:
    """Fits log-linear means with a feature's dispersion: ``feature``, ``beta`` (array), ``factor`` (variance of the last coefficient) and ``converged``.

    rows has ``feature``, ``y``, ``size`` and the columns x; features has ``feature``, ``dispersion`` and a positive ``mean``. Each step is one
    aggregation of reweighted normal equations over the features that still move; those that don't by 1e-8 leave. A feature that moves
    after all steps has its last figures, and ``converged`` false.
    """
    shelf, done = Shelf(), []
    rows = shelf.put(rows.join(features.select("feature", F.col("dispersion").alias("a")), "feature").select("feature", "y", "size", "a", *x), "counts")
    start = F.array(F.ln("mean"), *(F.lit(0.0) for _ in x[1:]))
    now = features.select("feature", start.alias("beta"))
    solve, none = solved(1e-8), F.lit(None).cast("double")
    now = shelf.put(now.withColumns({"factor": none, "moved": none}), "fits")
    for step in range(steps):
        cur = rows.join(now.select("feature", "beta"), "feature")
        eta = sum((F.col(c) * F.get("beta", F.lit(i)) for i, c in enumerate(x)), F.lit(0.0))
        cur = cur.withColumn("eta", eta).withColumn("mu", F.greatest(F.col("size") * F.exp(F.greatest(F.least("eta", F.lit(30.0)), F.lit(-30.0))), F.lit(1e-6)))
        weight, target = F.col("mu") / (1 + F.col("a") * F.col("mu")), F.col("eta") + (F.col("y") - F.col("mu")) / F.col("mu")
        sums = cur.groupBy("feature").agg(*cross_products([F.col(c) for c in x], target, weight))
        new = sums.select("feature", solve("_gram", "_side").alias("_found")).join(now.select("feature", F.col("beta").alias("_old")), "feature")
        beta = F.slice("_found", 1, len(x))
        moved = F.array_max(F.zip_with(beta, "_old", lambda a, b: F.abs(a - b)))
        now = shelf.put(new.select("feature", beta.alias("beta"), F.get("_found", F.lit(len(x))).alias("factor"), moved.alias("moved")), "fits")
        done.append(now.filter("moved < 1e-8").withColumn("converged", F.lit(True)))
        now = now.filter("moved >= 1e-8")
        if now.isEmpty():
            break
    else:
        done.append(now.withColumn("converged", F.lit(False)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    kept = Shelf().put(out.drop("moved"), "fitted")
    shelf.clear()
    return kept


def wald(beta: Column, factor: Column) -> dict[str, Column]:
    """``log2fc``, ``se``, ``stat`` and ``p`` of a coefficient on the natural scale."""
    ln2, error = F.ln(F.lit(2.0)), F.sqrt(factor)
    return {"log2fc": beta / ln2, "se": error / ln2, "stat": beta / error, "p": p_from_z(beta / error)}
