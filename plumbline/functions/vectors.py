"""Array arithmetic on dense vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12
WIDE_VECTOR = 256


def as_doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """``v`` scaled to length one; the norm is floored so a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(NORM_FLOOR))
    return F.transform(v, lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(NORM_FLOOR)) * F.greatest(norm(b), F.lit(NORM_FLOOR)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x - y), F.lit(0.0), lambda s, x: s + x * x))


def width_of(df: DataFrame, v: str) -> int:
    """Vector length, read from one row."""
    row = df.where(F.col(v).isNotNull()).select(F.size(v).alias("d")).first()
    if row is None:
        raise ValueError("no vectors")
    return int(row["d"])


def vector_mean(df: DataFrame, by: list[str], v: str, out: str = "mean", d: int | None = None) -> DataFrame:
    """Mean vector and row count per group.

    Up to 256 dimensions it is one map-side-combined aggregate with a sum per
    dimension; wider vectors are summed as (position, value) rows. Rows without a
    vector are left out, and so are groups that have no other.
    """
    d = d or width_of(df, v)
    df = df.where(F.col(v).isNotNull())
    if d <= WIDE_VECTOR:
        means = F.array(*[F.avg(F.element_at(v, i + 1).cast("double")) for i in range(d)])
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), means.alias(out))
    long = df.select(*by, F.posexplode(v).alias("__p", "__x"))
    sums = long.groupBy(*by, "__p").agg(F.avg(F.col("__x").cast("double")).alias("__m"), F.count("__x").alias("__n"))
    return sums.groupBy(*by).agg(
        F.max("__n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("__p", "__m"))), lambda s: s["__m"]).alias(out),
    )
