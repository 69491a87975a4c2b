"""Means and covariances of vector sets, and the distance between two Gaussians.

Tasks reduce their rows to packed triangles of cross products, which are added up in a tree. Only d x d matrices are ever solved in one
place, and d is the rank of the rows where they are fewer than their dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.hashing import seeded_hash
from plumbline.functions.resampling import weights
from plumbline.functions.vectors import vector_mean, width_of
from plumbline.operators.resample import kinds_of, sets_in, tree_merge
from plumbline.session import settle

#: Bytes of replicates' sums a task holds at a time.
REPLICATE_BYTES = 64 << 20


def _center(df: DataFrame, vector: str, d: int) -> np.ndarray:
    """Mean of all rows, taken off before products are formed so that large means cost no digits."""
    return np.array(vector_mean(df, [], vector, d=d).first()["mean"])


def _with_ones(column: pa.Array, center: np.ndarray) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(center)) - center
    return np.hstack([x, np.ones((len(x), 1))])


def _added(parts: DataFrame, by: list[str]) -> DataFrame:
    return tree_merge(parts, by, np.add, lambda b: np.frombuffer(b, float), lambda a: a.tobytes())


def gram_sums(df: DataFrame, by: list[str], vector: str, center: np.ndarray) -> DataFrame:
    """(by..., state): the packed upper triangle of sums of products of centred entries; its last column holds plain sums and the count.

    A task sends one row per set, however many rows it held.
    """
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in by], F.col(vector).cast("array<double>").alias("__v"))
    upper = np.triu_indices(len(center) + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        sums: dict[tuple, list] = {}
        for batch in batches:
            if batch.num_rows:
                x = _with_ones(batch.column("__v"), center)
                for one, name, places in sets_in(batch, by):
                    held = sums.setdefault(name, [one, 0.0])
                    held[1] = held[1] + (x[places].T @ x[places])[upper]
        for one, total in sums.values():
            yield pa.RecordBatch.from_arrays([*(one.columns if one is not None else []), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                             names=[*by, "part", "state"])

    return _added(rows.mapInArrow(partial, ", ".join([*kinds_of(rows, by), "part int, state binary"])), by)


def _solve_moments(packed: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    d = len(center)
    gram = np.zeros((d + 1, d + 1))
    gram[np.triu_indices(d + 1)] = packed
    gram = gram + np.triu(gram, 1).T
    n = gram[d, d]
    if n < 2:
        raise ValueError("need at least two rows for a covariance")
    shift = gram[:d, d] / n
    return center + shift, (gram[:d, :d] - n * np.outer(shift, shift)) / (n - 1), n


def gaussian_stats(df: DataFrame, by: list[str], vector: str, d: int | None = None) -> DataFrame:
    """(by..., n, mean, cov): mean vector and sample covariance (row-major) per set."""
    d = d or width_of(df, vector)
    center = _center(df, vector, d)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mean, cov, n = _solve_moments(np.frombuffer(batch.column("state")[i].as_py(), float), center)
                lists = [pa.array([x], pa.list_(pa.float64())) for x in (mean, cov.ravel())]
                yield pa.RecordBatch.from_arrays([*batch.select(by).slice(i, 1).columns, pa.array([int(n)]), *lists], names=[*by, "n", "mean", "cov"])

    sums = gram_sums(df, by, vector, center)
    return sums.mapInArrow(solve, ", ".join([*kinds_of(sums, by), "n bigint, mean array<double>, cov array<double>"]))


def _root(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.sqrt(np.maximum(values, 0.0))) @ vectors.T


def frechet(mean_a: np.ndarray, cov_a: np.ndarray, mean_b: np.ndarray, cov_b: np.ndarray) -> float:
    """Squared mean distance plus both traces minus twice the trace of the covariances' geometric mean.

    The root is taken of a symmetric product, so it has no imaginary part.
    """
    if mean_a.shape != mean_b.shape:
        raise ValueError(f"dimensions differ: {len(mean_a)} and {len(mean_b)}")
    half = _root(cov_a)
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(half @ cov_b @ half), 0.0)).sum()
    gap = mean_a - mean_b
    return max(0.0, float(gap @ gap + np.trace(cov_a) + np.trace(cov_b) - 2.0 * cross))


def _two_sides(df: DataFrame, side: str, vector: str, real: str, generated: str, minimum: int, d: int | None = None) -> dict[str, tuple]:
    """Both sides' moments; 2 x (d x d) numbers."""
    found = {
        r[side]: (np.array(r["mean"]), np.array(r["cov"]).reshape(len(r["mean"]), -1), r["n"])
        for r in gaussian_stats(df, [side], vector, d).collect()
    }
    for name in (real, generated):
        n = found[name][2] if name in found else 0
        if n < minimum:
            raise ValueError(f"{n} {name} rows; below {minimum} the figure misleads")
    return found


def frechet_distance(
    df: DataFrame, side: str, vector: str, real: str = "real", generated: str = "generated", minimum: int = fixed.FRECHET_MIN_ROWS,
    d: int | None = None,
) -> DataFrame:
    """One row: distance between the two sides' Gaussians, and their rows. Fewer rows than dimensions are compared in the space they span."""
    d = d or width_of(df, vector)
    if df.limit(d + 1).count() <= d:
        df, d = span_project(df, vector, d=d), None
    found = _two_sides(df, side, vector, real, generated, minimum, d)
    value = frechet(found[real][0], found[real][1], found[generated][0], found[generated][1])
    return df.sparkSession.createDataFrame(
        [(value, int(found[real][2]), int(found[generated][2]))], "value double, real bigint, generated bigint"
    )


def span_project(df: DataFrame, vector: str, out: str | None = None, d: int | None = None) -> DataFrame:
    """``vector`` in an orthonormal basis of the span of all rows about their common mean.

    Distances between the sides' Gaussians are unchanged; the width becomes the rank.
    Rows come back unchanged where they already fill their space.
    """
    d = d or width_of(df, vector)
    few = df.select(F.col(vector).cast("array<double>")).limit(d + 1).collect()
    if not few:
        return df if out is None or out == vector else df.withColumn(out, F.col(vector))
    if len(few) <= d:
        # no more numbers than one covariance has
        x = np.array([r[0] for r in few])
        center = x.mean(axis=0)
        _, sigma, rows = np.linalg.svd(x - center, full_matrices=False)
        keep = sigma > max(x.shape) * np.finfo(float).eps * sigma[0]
        matrix = rows[keep].T
    else:
        stats = gaussian_stats(df, [], vector, d).first()
        n, cov = stats["n"], np.array(stats["cov"]).reshape(d, d)
        values, basis = np.linalg.eigh(cov * (n - 1))
        sigma = np.sqrt(np.maximum(values, 0.0))
        # Singular values through the cross products carry rounding of about sqrt(eps).
        keep = sigma > max(n, d) * np.sqrt(np.finfo(float).eps) * sigma.max() / max(n, d) ** 0.5
        if keep.all():
            return df if out is None or out == vector else df.withColumn(out, F.col(vector))
        center, matrix = np.array(stats["mean"]), basis[:, keep]
    packed = df.sparkSession.sparkContext.broadcast((center, matrix))

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        c, m = packed.value
        return pd.Series(list((np.stack(v.to_numpy()) - c) @ m))

    return df.withColumn(out or vector, project(F.col(vector).cast("array<double>")))


def frechet_interval(
    df: DataFrame, side: str, vector: str, key: str, real: str = "real", generated: str = "generated",
    resamples: int = fixed.FRECHET_RESAMPLES, confidence: float = fixed.CONFIDENCE, seed: int = fixed.SEED,
    minimum: int = fixed.FRECHET_MIN_ROWS,
) -> DataFrame:
    """Interval for the distance with the real side held fixed and the generated rows resampled.

    Fewer rows than dimensions are first put in the space they span. Resampled sets hold fewer
    different rows, which moves every replicate up alike; so the interval keeps its width and is
    centred on the figure itself. A row's weight in a replicate follows from its key, so a task sends
    one triangle per replicate, and the replicates are solved side by side.
    """
    narrow = settle(df.select(F.col(side).cast("string").alias(side), seeded_hash(seed, key).alias("__k"), F.col(vector).cast("array<double>").alias("__v")))
    if narrow.count() <= width_of(narrow, "__v"):
        narrow = settle(span_project(narrow, "__v"))
    found = _two_sides(narrow, side, "__v", real, generated, minimum)
    (mean_real, cov_real, _), (center, cov, n) = found[real], found[generated]
    value = frechet(mean_real, cov_real, center, cov)
    made = narrow.where(F.col(side) == generated).select("__k", "__v")
    packed = df.sparkSession.sparkContext.broadcast((center, mean_real, cov_real))
    upper = np.triu_indices(len(center) + 1)
    together = max(1, min(resamples, REPLICATE_BYTES // (8 * len(upper[0]))))

    def weigh(first: int):
        replicates = np.arange(first, min(resamples, first + together))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId() if TaskContext.get() else 0
            sums = np.zeros((len(replicates), len(upper[0])))
            for batch in batches:
                x, counts = _with_ones(batch.column(1), packed.value[0]), weights(batch.column(0).to_numpy(), replicates)
                for k in range(len(replicates)):
                    drawn = counts[:, k] > 0
                    some = x[drawn]
                    sums[k] += ((some * counts[drawn, k, None]).T @ some)[upper]
            states = pa.array([s.tobytes() for s in sums], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(replicates, pa.int32()), pa.array(np.full(len(replicates), part), pa.int32()), states], names=["__r", "part", "state"])

        return run

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, mean_real, cov_real = packed.value
        for batch in batches:
            for state in batch.column("state"):
                mean, cov, _ = _solve_moments(np.frombuffer(state.as_py(), float), center)
                yield pa.RecordBatch.from_arrays([pa.array([frechet(mean_real, cov_real, mean, cov)])], names=["v"])

    parts = [made.mapInArrow(weigh(first), "__r int, part int, state binary") for first in range(0, resamples, together)]
    sums = parts[0]
    for more in parts[1:]:
        sums = sums.unionByName(more)
    tail = (1.0 - confidence) / 2.0
    spread = _added(sums, ["__r"]).mapInArrow(solve, "v double").agg(F.percentile("v", F.array(F.lit(tail), F.lit(1.0 - tail))).alias("q"))
    half = (F.col("q")[1] - F.col("q")[0]) / 2
    return spread.select(
        F.lit(value).alias("value"), (F.lit(value) - half).alias("low"), (F.lit(value) + half).alias("high"),
        F.lit(resamples).alias("resamples"), F.lit(confidence).alias("confidence"), F.lit(n).cast("bigint").alias("n"),
    )
