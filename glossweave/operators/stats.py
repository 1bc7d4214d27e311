"""Statistics of evidence tables: sums go over the cluster, only what is as large as the model comes to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distribution(table: DataFrame, column: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """One row: n, zeros, largest, mean, exact median, and the values at index int(q n)."""
    counts = table.groupBy(column).agg(F.count("*").alias("k")).withColumn("below", F.sum("k").over(W.orderBy(column)) - F.col("k"))
    total = table.agg(F.count("*").alias("n"), F.sum((F.col(column) == 0).cast("long")).alias("zeros"), F.max(column).alias("largest"), F.avg(column).alias("mean"), F.percentile(column, F.lit(0.5)).alias("median"))
    at = lambda q: F.least(F.floor(F.col("n") * q), F.col("n") - 1)
    picks = [F.max(F.when((F.col("below") <= at(q)) & (F.col("below") + F.col("k") > at(q)), F.col(column))).alias(f"q{round(q * 100)}") for q in quantiles]
    return counts.crossJoin(F.broadcast(total)).groupBy("n", "zeros", "largest", "mean", "median").agg(*picks)


def low_counts(table: DataFrame, column: str, most: int = 15) -> DataFrame:
    return table.where(F.col(column).between(0, most)).groupBy(column).agg(F.count("*").alias("n"))


def gaussian_mixture_bic(table: DataFrame, column: str, k: tuple[int, ...] = (1, 2, 3), seed: int = 0) -> list[tuple[int, float]]:
    """(components, BIC) by one-dimensional mixtures."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=[column], outputCol="features").transform(table.select(F.col(column).cast("double")).dropna())
    n, var = x.agg(F.count("*"), F.var_pop(column)).first()
    one = -n / 2 * (np.log(2 * np.pi * var) + 1) if var else 0.0
    fit = lambda i: GaussianMixture(k=i, seed=seed).fit(x).summary.logLikelihood if i > 1 else float(one)
    return [(i, (3 * i - 1) * float(np.log(n)) - 2 * fit(i)) for i in k]


def dip(histogram: DataFrame, column: str, count: str = "n") -> float:
    """Hartigan's dip of a histogram of distinct values, which must fit on the driver: the largest gap between the distribution and the nearest unimodal one."""
    rows = histogram.orderBy(column).select(F.col(column).cast("double"), count).collect()
    x, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    if len(x) < 2:
        return 0.0
    upper = np.cumsum(w) / w.sum()
    lower = upper - w / w.sum()
    best = np.inf
    for mode in range(len(x)):  # convex up to the mode, concave from there on
        gap = max(_half_gap(x[: mode + 1], lower[: mode + 1], upper[: mode + 1], 1), _half_gap(x[mode:], lower[mode:], upper[mode:], -1))
        best = min(best, gap)
    return float(best / 2)


def _half_gap(x: np.ndarray, lower: np.ndarray, upper: np.ndarray, sign: int) -> float:
    """How far the distribution rises above its greatest convex minorant (below its least concave majorant)."""
    y = lower if sign > 0 else -upper
    hull: list[int] = []
    for i in range(len(x)):
        while len(hull) > 1 and (y[hull[-1]] - y[hull[-2]]) * (x[i] - x[hull[-1]]) >= (y[i] - y[hull[-1]]) * (x[hull[-1]] - x[hull[-2]]):
            hull.pop()
        hull.append(i)
    fit = np.interp(x, x[hull], y[hull])
    return float(np.max((upper - fit) if sign > 0 else (-lower - fit))) if len(x) else 0.0


def zscore(table: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<column>_z`` by the population's mean and deviation; 0 without deviation."""
    m = table.agg(*[F.avg(c).alias(f"{c}__m") for c in columns], *[F.stddev_pop(c).alias(f"{c}__s") for c in columns])
    t = table.crossJoin(F.broadcast(m))
    return t.select(*table.columns, *[F.when(F.col(f"{c}__s") > 0, (F.col(c) - F.col(f"{c}__m")) / F.col(f"{c}__s")).otherwise(0.0).alias(f"{c}_z") for c in columns])


def one_hot(table: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Adds a 0/1 column a level but the first."""
    return table.select("*", *[(F.col(column) == v).cast("int").alias(f"{column}_{v}") for v in sorted(levels)[1:]])


def ols(table: DataFrame, y: str, xs: list[str]) -> dict:
    """Least squares with an intercept: coefficients and R^2, from sums of products."""
    cols = {"1": F.lit(1.0), **{x: F.col(x).cast("double") for x in xs}}
    names, t = list(cols), F.col(y).cast("double")
    sums = [F.sum(cols[a] * cols[b]).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums += [F.sum(cols[a] * t).alias(f"b{i}") for i, a in enumerate(names)] + [F.sum(t * t).alias("yy"), F.sum(t).alias("y"), F.count("*").alias("n")]
    r = table.dropna(subset=[y, *xs]).agg(*sums).first()
    if not r["n"]:
        return {"n": 0, "coefficients": {}, "r2": None}
    g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
    b = np.array([r[f"b{i}"] for i in range(len(names))])
    w = np.linalg.lstsq(g, b, rcond=None)[0]
    total = r["yy"] - r["y"] ** 2 / r["n"]
    return {"n": r["n"], "coefficients": dict(zip(names, w.tolist())), "r2": float(1 - (r["yy"] - w @ b) / total) if total > 0 else None}


def logit(table: DataFrame, y: str, xs: list[str]) -> dict:
    """Logistic regression: AUC, McFadden's R^2, coefficients and p-values."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    t = VectorAssembler(inputCols=xs, outputCol="features").transform(table.select(F.col(y).cast("double").alias("label"), *[F.col(x).cast("double") for x in xs]).dropna())
    m = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=50).fit(t)
    s = m.summary
    auc = BinaryClassificationEvaluator(rawPredictionCol="prediction", labelCol="label").evaluate(m.transform(t))
    return {"auc": auc, "mcfadden_r2": 1 - s.deviance / s.nullDeviance if s.nullDeviance else None, "coefficients": dict(zip(xs, m.coefficients.tolist())), "p_values": dict(zip([*xs, "1"], s.pValues))}


def poisson_r2(table: DataFrame, y: str, xs: list[str]) -> float | None:
    """Share of the deviance that a Poisson model explains."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    t = VectorAssembler(inputCols=xs, outputCol="features").transform(table.select(F.col(y).cast("double").alias("label"), *[F.col(x).cast("double") for x in xs]).dropna())
    s = GeneralizedLinearRegression(family="poisson", link="log", maxIter=50).fit(t).summary
    return 1 - s.deviance / s.nullDeviance if s.nullDeviance else None


def nested_models(table: DataFrame, targets: list[str], blocks: dict[str, list[str]]) -> list[dict]:
    """For each target, models over ever more blocks of columns: AUC for 0/1 targets, R^2 for others."""
    out = []
    for y in targets:
        two = table.where(F.col(y).isNotNull() & ~F.col(y).cast("double").isin(0.0, 1.0)).head(1) == []
        xs: list[str] = []
        for name, columns in blocks.items():
            xs = xs + columns
            fit = logit(table, y, xs) if two else ols(table, y, xs)
            out.append({"target": y, "upto": name, "columns": len(xs), "auc": fit.get("auc"), "r2": fit.get("mcfadden_r2", fit.get("r2"))})
    return out
