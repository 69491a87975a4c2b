"""How well a classifier tells two sets of rows apart, each row judged by a model that never saw it.

All models of the test, every fold with all features and with each alone, are fitted
together: one step of all of them is one pass over the rows, which sends back only each
model's loss, gradient and curvature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators.intervals import rate_interval
from plumbline.operators.rates import class_means
from plumbline.operators.sampling import stratified_folds
from plumbline.session import settle

#: Passes over the rows at most, and the gradient's length per row at which a model is fitted.
PASSES, FLAT = 100, 1e-12


def measurable(df: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with every feature, one row: judged and skipped counts)."""
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    return df.where(whole), df.agg(F.count_if(whole).alias("judged"), F.count_if(~whole).alias("skipped"))


def _fold_scaling(rows: DataFrame, features: list[str], folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Per fold: mean and population deviation of the rows outside it (0 becomes 1)."""
    sums = rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.var_pop(f).alias(f"v_{f}") for f in features]
    ).collect()
    n = np.zeros(folds)
    m, v = np.zeros((folds, len(features))), np.zeros((folds, len(features)))
    for r in sums:
        n[r["fold"]] = r["n"]
        m[r["fold"]] = [r[f"m_{f}"] for f in features]
        v[r["fold"]] = [r[f"v_{f}"] for f in features]
    means, scales = np.empty_like(m), np.empty_like(m)
    for k in range(folds):
        others = np.arange(folds) != k
        w = n[others] / n[others].sum()
        means[k] = w @ m[others]
        scales[k] = np.sqrt(w @ (v[others] + (m[others] - means[k]) ** 2))
    scales[scales == 0] = 1.0
    return means, scales


class _Fit:
    """One model on its way to the least penalised loss. The intercept, the first weight, costs nothing.

    ``at`` is where the next pass measures. A step that doesn't lessen the loss is halved, from the last point that did.
    """

    def __init__(self, size: int, penalty: float):
        self.cost = np.append(0.0, np.full(size, penalty))
        self.at = self.base = np.zeros(size + 1)
        self.step = np.zeros(size + 1)
        self.least = np.inf
        self.done = False

    def take(self, loss: float, gradient: np.ndarray, curvature: np.ndarray, rows: float) -> None:
        """Move on, given what a pass measured at ``at``."""
        loss = loss + 0.5 * float(self.cost @ self.at**2)
        if loss > self.least + 1e-12 * abs(self.least):
            self.step = self.step / 2
            self.done = bool(np.linalg.norm(self.step) <= 1e-14 * (1 + np.linalg.norm(self.base)))
        else:
            self.base, self.least = self.at, loss
            uphill = gradient + self.cost * self.at
            self.done = bool(np.linalg.norm(uphill) <= FLAT * rows)
            self.step = -_solved(curvature + np.diag(self.cost), uphill)
        self.at = self.base + self.step


def _solved(curvature: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Through the Cholesky factor; by least squares where saturated rows leave no curvature."""
    try:
        lower = np.linalg.cholesky(curvature)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(curvature, slope, rcond=None)[0]
    return np.linalg.solve(lower.T, np.linalg.solve(lower, slope))


def _scores(x: np.ndarray, means: np.ndarray, scales: np.ndarray, columns: list[int]) -> np.ndarray:
    """Standardised features behind a column of ones."""
    return np.column_stack([np.ones(len(x)), (x[:, columns] - means[columns]) / scales[columns]])


def _folded(df: DataFrame, key: str, label: str, features: list[str], folds: int, seed) -> DataFrame:
    """(key, y, features, fold) of the measurable rows, written once. Fewer than ``folds`` rows on a side are refused."""
    rows, _ = measurable(df.select(key, F.col(label).cast("int").alias("y"), *[F.col(f).cast("double").alias(f) for f in features]), features)
    placed = settle(stratified_folds(rows, "y", key, folds, seed))
    sizes = {r["y"]: r["count"] for r in placed.groupBy("y").count().collect()}
    if set(sizes) != {0, 1} or min(sizes.values()) < folds:
        raise ValueError(f"need at least {folds} measurable rows on either side")
    return placed


def two_sample_rows(
    df: DataFrame, key: str, label: str, features: list[str], folds: int = fixed.FOLDS, seed=0, penalty: float = fixed.PENALTY
) -> DataFrame:
    """(key, label, model, correct): every row judged out of fold by ``all`` features and by each alone.

    ``label`` is 1 for generated. Rows with an unmeasurable feature take no part.
    Fewer than ``folds`` rows on a side are refused.
    """
    return _judged(_folded(df, key, label, features, folds, seed), key, features, folds, penalty)


def _judged(placed: DataFrame, key: str, features: list[str], folds: int, penalty: float) -> DataFrame:
    means, scales = _fold_scaling(placed, features, folds)
    models = [list(range(len(features))), *[[i] for i in range(len(features))]]
    fits = {(k, m): _Fit(len(columns), penalty) for k in range(folds) for m, columns in enumerate(models)}

    for _ in range(PASSES):
        points = {name: fit.at for name, fit in fits.items() if not fit.done}
        if not points:
            break

        def measure(frames: Iterator[pd.DataFrame], points=points) -> Iterator[pd.DataFrame]:
            held = {name: np.zeros(2 + len(w) + len(w) ** 2) for name, w in points.items()}
            for pdf in frames:
                x, y, fold = pdf[features].to_numpy(float), pdf["y"].to_numpy(float), pdf["fold"].to_numpy()
                for (k, m), w in points.items():
                    learn = fold != k
                    z = _scores(x[learn], means[k], scales[k], models[m])
                    reach = z @ w
                    likely = 0.5 + 0.5 * np.tanh(reach / 2)
                    loss = np.logaddexp(0.0, reach).sum() - y[learn] @ reach
                    curvature = np.einsum("ri,r,rj->ij", z, likely * (1 - likely), z)
                    held[k, m] += np.concatenate([[len(z), loss], z.T @ (likely - y[learn]), curvature.ravel()])
            for (k, m), values in held.items():
                yield pd.DataFrame({"k": k, "m": m, "i": np.arange(len(values)), "v": values})

        totals = placed.mapInPandas(measure, "k int, m int, i int, v double").groupBy("k", "m", "i").agg(F.sum("v").alias("v")).toPandas()
        for name, part in totals.groupby(["k", "m"]):
            values = part.sort_values("i")["v"].to_numpy()
            size = len(fits[name].at)
            fits[name].take(values[1], values[2 : 2 + size], values[2 + size :].reshape(size, size), values[0])

    found = {name: fit.base for name, fit in fits.items()}
    names = ["all", *features]
    kind = placed.schema[key].dataType.simpleString()

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x, y, fold = pdf[features].to_numpy(float), pdf["y"].to_numpy(), pdf["fold"].to_numpy()
            for m, name in enumerate(names):
                generated = np.zeros(len(pdf), dtype=bool)
                for k in np.unique(fold):
                    at = fold == k
                    generated[at] = _scores(x[at], means[k], scales[k], models[m]) @ found[k, m] > 0
                yield pd.DataFrame({key: pdf[key].to_numpy(), "y": y, "model": name, "correct": generated == (y == 1)})

    return placed.mapInPandas(judge, f"{key} {kind}, y int, model string, correct boolean")


def two_sample_test(
    df: DataFrame, key: str, label: str, features: list[str], folds: int = fixed.FOLDS, seed=0, **interval
) -> tuple[DataFrame, DataFrame]:
    """(interval of the accuracy with all features, per feature: accuracy alone and both sides' means).

    The features come most telling first.
    """
    placed = _folded(df, key, label, features, folds, seed)
    judged = settle(_judged(placed, key, features, folds, fixed.PENALTY))
    accuracy = rate_interval(judged.where("model = 'all'"), [key], "correct", **interval)
    alone = judged.where("model <> 'all'").groupBy(F.col("model").alias("feature")).agg(F.avg(F.col("correct").cast("double")).alias("alone"))
    table = alone.join(class_means(placed.withColumnRenamed("y", label), label, features), "feature")
    return accuracy, by_accuracy_desc(table)


def by_accuracy_desc(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("alone"), "feature")
