"""Values of one group brought onto another scale through quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators.skew import ROWS_PER_TASK, checked_broadcast, exact_quantiles


def contrast_stretch(df: DataFrame, group: str, value: str, out: str = "stretched", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``value`` stretched so the group's dark and light percentiles land on 0 and 255, truncated.

    A group whose percentiles lie within 1 of each other keeps its values.
    """
    ends = exact_quantiles(
        df, [group], F.col(value), [fixed.INK_PERCENTILE, fixed.PAPER_PERCENTILE], "__ends", rows_per_task
    )
    joined = df.join(checked_broadcast(ends), group, "left")
    dark, light = F.element_at("__ends", 1), F.element_at("__ends", 2)
    stretched = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col(value) - dark) / (light - dark) * 255.0)))
    return joined.withColumn(
        out, F.when(light - dark < 1.0, F.col(value)).otherwise(stretched.cast("double"))
    ).drop("__ends")


def tone_curve(df: DataFrame, group: str, value: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(group, knots): 21 evenly spaced quantiles of the group's values."""
    steps = fixed.TONE_QUANTILES - 1
    return exact_quantiles(df, [group], F.col(value), [i / steps for i in range(steps + 1)], "knots", rows_per_task)


def quantile_match(df: DataFrame, group: str, value: str, target: DataFrame, out: str = "matched", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``value`` mapped so its group's quantiles become those of ``target`` (one row: knots).

    The map is piecewise linear from 0 and flat beyond the last knot; the source
    knots are made strictly increasing. A group without values is left as it is.
    """
    source = tone_curve(df, group, value, rows_per_task).withColumnRenamed("knots", "__src")
    goal = [float(x) for x in target.select("knots").first()["knots"]]
    rising = F.transform(
        "__src",
        lambda x, i: F.array_max(F.slice(F.col("__src"), F.lit(1), i + 1)) + i * F.lit(1e-6),
    )
    knots = source.select(group, F.concat(F.array(F.lit(0.0)), rising).alias("__x"))
    y = F.array(F.lit(0.0), *[F.lit(g) for g in goal])
    joined = df.join(checked_broadcast(knots), group, "left")
    v = F.col(value).cast("double")
    # How many knots lie at or below the value: the segment it falls in starts there.
    at = F.aggregate("__x", F.lit(0), lambda n, x: n + F.when(x <= v, 1).otherwise(0))
    placed = joined.withColumn("__at", at)
    i = F.col("__at")
    last = len(goal) + 1
    x0, x1 = F.try_element_at("__x", F.greatest(i, F.lit(1))), F.try_element_at("__x", i + 1)
    y0, y1 = F.try_element_at(y, F.greatest(i, F.lit(1))), F.try_element_at(y, i + 1)
    mapped = (
        F.when(F.col("__x").isNull(), v)
        .when(i >= last, F.lit(goal[-1]))
        .when(i == 0, F.lit(0.0))
        .otherwise(y0 + (y1 - y0) * (v - x0) / (x1 - x0))
    )
    return placed.withColumn(out, mapped).drop("__x", "__at")
