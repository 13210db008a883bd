"""Linear yield models from fold-wise moment matrices (M4, M7-M10, M14, C1-C6 on linear models).

One aggregate over the rows gives, per group and fold, the number of rows, the means
and the centred products of all features and the target. Everything after that works on
those rows, one per group and fold, whatever the number of input rows: a fold's training
matrix is the sum of the other folds' (parts are merged, never subtracted, so nothing
cancels), every penalty is fitted on it, and a held-out fold is scored from its own
matrix. A whole search of 20 penalties x 5 folds is one read of the data.

A model is a row: group, features, their means and scales (population deviation,
as a standard scaler's), one weight per scaled feature and the intercept. Scoring joins
rows with their group's model and adds up the products.

Rows with a null feature or target take no part. A constant feature, and one that the
features before it already give (remaining variance below ``ALIASED`` of its own) gets
weight 0 in a least-squares fit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIASED = 1e-9
#: Coordinate descent ends when no weight moves by more than this, relative to the target's deviation.
TOLERANCE, SWEEPS = 1e-13, 20_000


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _complete(df: DataFrame, names: Sequence[str]) -> DataFrame:
    fine = F.lit(True)
    for c in names:
        fine = fine & _q(c).isNotNull()
    return df.where(fine)


def moments(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """``by``, n, means, products: the features, then the target. One aggregate with map-side partial sums."""
    names = [*features, target]
    x = _complete(df, names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    n = F.count(F.lit(1))
    out = x.groupBy(*by).agg(
        n.alias("n"), *[F.avg(_q(c)).alias(f"_m{i}") for i, c in enumerate(names)],
        *[(F.covar_pop(_q(names[i]), _q(names[j])) * n).alias(f"_c{i}_{j}") for i, j in pairs])
    row = [F.array(*[F.col(f"_c{min(i, j)}_{max(i, j)}") for j in range(len(names))]) for i in range(len(names))]
    return out.select(*by, "n", F.array(*[F.col(f"_m{i}") for i in range(len(names))]).alias("means"),
                      F.array(*row).alias("products"))


def merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The moments of several parts together, per ``by`` (the parts of one group are its folds, so few)."""
    x = parts.groupBy(*by).agg(F.collect_list(F.struct("n", "means", "products")).alias("p"))
    size = F.sequence(F.lit(0), F.size(F.col("p")[0]["means"]) - 1)
    x = x.withColumn("n", F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["n"]))
    x = x.withColumn("means", F.transform(size, lambda i: F.aggregate(
        "p", F.lit(0.0), lambda a, p: a + p["n"] * F.get(p["means"], i)) / F.col("n")))

    def product(i: Column, j: Column) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda a, p: a + F.get(F.get(p["products"], i), j) + p["n"]
                           * (F.get(p["means"], i) - F.get(F.col("means"), i)) * (F.get(p["means"], j) - F.get(F.col("means"), j)))

    return x.select(*by, "n", "means", F.transform(size, lambda i: F.transform(size, lambda j: product(i, j))).alias("products"))


def training_moments(parts: DataFrame, by: Sequence[str], fold: str = "fold", folds: int = 5) -> DataFrame:
    """Per group and held-out fold, the moments of all other folds."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda h: h != F.col(fold))
    return merged(parts.withColumn("held_out", F.explode(others)).drop(fold), [*by, "held_out"])


def least_squares(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of a least-squares fit on a correlation-scaled matrix, by pivots in order; aliased columns get 0."""
    p = len(target)
    m = np.column_stack([gram, target])
    used = []
    for k in range(p):
        if m[k, k] <= ALIASED:
            continue
        m[k] /= m[k, k]
        for i in range(p):
            if i != k:
                m[i] -= m[i, k] * m[k]
        used.append(k)
    out = np.zeros(p)
    out[used] = m[used, p]
    return out


def elastic_net(gram: np.ndarray, target: np.ndarray, l1: np.ndarray, l2: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights (problems, features) that minimise w'Gw/2 - c'w + l1 |w|_1 + l2 |w|^2 / 2 each, by coordinate descent."""
    w = np.zeros_like(target)
    width = np.diagonal(gram, axis1=1, axis2=2)
    for _ in range(SWEEPS):
        moved = np.zeros(len(w))
        for j in range(w.shape[1]):
            rho = target[:, j] - np.einsum("pk,pk->p", gram[:, j], w) + width[:, j] * w[:, j]
            below = width[:, j] + l2
            new = np.where(width[:, j] > 0, np.sign(rho) * np.maximum(np.abs(rho) - l1, 0) / np.where(below > 0, below, 1), 0)
            moved = np.maximum(moved, np.abs(new - w[:, j]))
            w[:, j] = new
        if (moved <= TOLERANCE * scale).all():
            break
    return w


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds scales, weights and intercept to rows of moments and penalties."""
    if rows.empty:
        return rows.assign(scales=None, weights=None, intercept=None)
    n = rows["n"].to_numpy(float)
    means = np.stack(rows["means"])
    products = np.stack([np.stack(p) for p in rows["products"]]) / n[:, None, None]
    spread = np.sqrt(np.maximum(np.diagonal(products, axis1=1, axis2=2), 0))
    p = means.shape[1] - 1
    constant = spread[:, :p] <= 1e-12 * np.maximum(np.abs(means[:, :p]), 1)
    scales = np.where(constant, 1.0, spread[:, :p])
    gram = products[:, :p, :p] / (scales[:, :, None] * scales[:, None, :])
    gram[np.broadcast_to(constant[:, :, None], gram.shape) | np.broadcast_to(constant[:, None, :], gram.shape)] = 0
    target = np.where(constant, 0, products[:, :p, p] / scales)
    alpha, ratio = (rows[c].to_numpy(float) for c in ("alpha", "l1_ratio"))
    weights = np.zeros((len(rows), p))
    plain = alpha == 0
    for i in np.flatnonzero(plain):
        weights[i] = least_squares(gram[i], target[i])
    if (~plain).any():
        a, r = alpha[~plain], ratio[~plain]
        weights[~plain] = elastic_net(gram[~plain], target[~plain], a * r, a * (1 - r), np.maximum(spread[~plain, p], 1e-300))
    return rows.assign(scales=list(scales), weights=list(weights), intercept=means[:, p])


def fit(stats: DataFrame, penalties: Sequence[tuple[str, float, float]] = (("linear", 0.0, 0.0),)) -> DataFrame:
    """One model a row of ``stats`` and penalty (model_type, alpha, l1_ratio); alpha 0 is least squares.

    Objective: mean squared error / 2 + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2) over standardised features.
    """
    kinds = F.array(*[F.struct(F.lit(i).alias("map"), F.lit(m).alias("model_type"), F.lit(float(a)).alias("alpha"),
                               F.lit(float(r)).alias("l1_ratio")) for i, (m, a, r) in enumerate(penalties)])
    x = stats.withColumn("_kind", F.explode(kinds)).select(*stats.columns, "_kind.*")
    schema = T.StructType([*x.schema.fields, T.StructField("scales", T.ArrayType(T.DoubleType())),
                           T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType())])
    return x.mapInPandas(lambda batches: (_fitted(b) for b in batches), schema)


def slopes() -> Column:
    """Weights per unit of the unscaled features."""
    return F.zip_with("weights", "scales", lambda w, s: w / s)


def cross_validated(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str],
                    penalties: Sequence[tuple[str, float, float]] = (("linear", 0.0, 0.0),), folds: int = 5) -> DataFrame:
    """``by``, map, model_type, alpha, l1_ratio, mean_r2, std_r2 over the folds (column ``fold``).

    A fold's r2 is 1 - SSE / SST from its moments alone; a fold with a constant
    target (or of one row) has none and is left out of the mean.
    """
    parts = moments(df, features, target, [*by, "fold"])
    models = fit(training_moments(parts, by, folds=folds), penalties).withColumnRenamed("held_out", "fold")
    models = models.select(*by, "fold", "map", "model_type", "alpha", "l1_ratio", "intercept", slopes().alias("b"),
                           F.col("means").alias("at"))
    p, last = len(features), F.lit(len(features))
    x = models.join(parts, [*by, "fold"])
    index = F.sequence(F.lit(0), F.lit(p - 1))

    def dot(values) -> Column:
        return F.aggregate(index, F.lit(0.0), lambda a, i: a + F.get(F.col("b"), i) * values(i))

    off = F.get("means", last) - F.col("intercept") - dot(lambda i: F.get("means", i) - F.get("at", i))
    own = F.get(F.get("products", last), last)
    with_target = dot(lambda i: F.get(F.get("products", i), last))
    within = F.aggregate(index, F.lit(0.0), lambda a, i: a + F.get("b", i) * F.aggregate(
        index, F.lit(0.0), lambda c, j: c + F.get("b", j) * F.get(F.get("products", i), j)))
    sse = F.col("n") * off * off + own - 2 * with_target + within
    r2 = F.when(own > 0, 1 - sse / own)
    return (x.withColumn("_r2", r2).groupBy(*by, "map", "model_type", "alpha", "l1_ratio")
            .agg(F.avg("_r2").alias("mean_r2"), F.stddev_pop("_r2").alias("std_r2")))


def best_of(scores: DataFrame, by: Sequence[str], digits: int = 9) -> DataFrame:
    """The map of the largest mean r2 (compared at ``digits`` places; ties go to the first map) per group."""
    key = F.struct(-F.round("mean_r2", digits), F.col("map"))
    return scores.where(F.col("mean_r2").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("n_maps"), F.min_by(F.struct("mean_r2", "model_type", "alpha", "l1_ratio"), key).alias("b")
    ).select(*by, "n_maps", F.col("b.mean_r2").alias("best_cv_r2"), "b.model_type", "b.alpha", "b.l1_ratio")


def predict(rows: DataFrame, models: DataFrame, features: Sequence[str], by: Sequence[str],
            output: str = "prediction") -> DataFrame:
    """Rows x models of their group: columns of ``rows``, model_type, ``output``. A null feature gives null."""
    m = models.select(*by, "model_type", "intercept", "means", slopes().alias("_b"))
    x = rows.join(m, list(by))
    total = F.col("intercept")
    for i, c in enumerate(features):
        total = total + F.get("_b", F.lit(i)) * (_q(c) - F.get("means", F.lit(i)))
    return x.select(*[_q(c) for c in rows.columns], "model_type", total.alias(output))


def contributions(rows: DataFrame, models: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Exact additive contributions contrib_<feature> = weight x (value - mean) / scale."""
    m = models.select(*by, "means", slopes().alias("_b"))
    x = rows.join(m, list(by))
    return x.select(*[_q(c) for c in rows.columns], *[
        (F.get("_b", F.lit(i)) * (_q(c) - F.get("means", F.lit(i)))).alias(f"contrib_{c}") for i, c in enumerate(features)])
