"""Bootstrap intervals.

Units are what is resampled: records for a rate or a ratio, groups for any average over groups. How often a unit counts in a replicate
follows from (seed, replicate, unit key) alone, so one rule serves any number of units, sets that share units share their draws, and a
query in SQL makes the same ones. A replicate's number of units is not held at the sample's: figures are functions of sums, quantiles
or aggregates that weigh units against each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.hashing import seeded_hash
from plumbline.functions.numbers import separates
from plumbline.operators.resample import Aggregate, replicate_figures, replicate_quantiles, replicate_sums
from plumbline.session import settle


def bootstrap(
    units: DataFrame, key: list[str], sums: list[str], statistic: Callable[[Callable[[str], Column]], Column],
    by: list[str] | None = None, resamples: int = fixed.RESAMPLES, confidence: float = fixed.CONFIDENCE, seed=fixed.SEED,
    single: str = "refuse", recentre: bool = False,
) -> DataFrame:
    """(by..., value, low, high, resamples, confidence, n) per set of units.

    ``sums`` are the columns summed over units; ``statistic(total)`` combines
    ``total(name)`` into the figure, with ``total("n")`` the number of units drawn.
    All sets of one call, and all figures of one statistic, share their draws: a
    difference is paired. Fewer than two units are refused, or give a point with 0
    resamples (``single="point"``). If a replicate is undefined, so are the ends; one that
    draws no unit counts all of them once. ``recentre`` reports value plus and minus half
    the interval's width. A set without units gives no row.
    """
    by = by or []
    rows = units.select(*by, seeded_hash(seed, *key).alias("__k"), *[F.col(c).cast("double").alias(c) for c in sums])
    totals = replicate_sums(rows, by, sums, resamples)
    return _ends(totals.select(*by, "__r", "n", F.when(F.col("n") > 0, statistic(F.col)).alias("__s")), by, resamples, confidence, single, recentre)


def bootstrap_quantile(
    units: DataFrame, key: list[str], value: str, prob: float = 0.5, by: list[str] | None = None, resamples: int = fixed.RESAMPLES,
    confidence: float = fixed.CONFIDENCE, seed=fixed.SEED, single: str = "refuse", recentre: bool = False, **options,
) -> DataFrame:
    """The same for a quantile of ``value``, exact in every replicate; units without a value are left out."""
    by = by or []
    rows = units.select(*by, seeded_hash(seed, *key).alias("__k"), F.col(value).cast("double").alias("__v"))
    return _ends(replicate_quantiles(rows, by, prob, resamples, **options), by, resamples, confidence, single, recentre)


def bootstrap_aggregate(
    units: DataFrame, key: list[str], aggregate: Aggregate, by: list[str] | None = None, resamples: int = fixed.RESAMPLES,
    confidence: float = fixed.CONFIDENCE, seed=fixed.SEED, single: str = "refuse", recentre: bool = False,
) -> DataFrame:
    """The same for any aggregate that takes weighted units and merges its states."""
    by = by or []
    rows = units.select(*by, seeded_hash(seed, *key).alias("__k"), *aggregate.columns)
    return _ends(replicate_figures(rows, by, aggregate, resamples), by, resamples, confidence, single, recentre)


def _ends(figures: DataFrame, by: list[str], resamples: int, confidence: float, single: str, recentre: bool) -> DataFrame:
    """Point and ends from (by..., __r, __s, n), replicate -1 being the point; a set has ``resamples`` + 1 rows."""
    tail = (1.0 - confidence) / 2.0
    is_point = F.col("__r") < 0
    point = F.max(F.when(is_point, F.col("__s"))).over(Window.partitionBy(*by))
    filled = figures.withColumn("__s", F.when(F.col("n") > 0, F.col("__s")).otherwise(point))
    drawn = F.when(~is_point, F.col("__s"))
    joined = filled.groupBy(*by).agg(
        F.max(F.when(is_point, F.col("__s"))).alias("value"), F.max(F.when(is_point, F.col("n"))).alias("n"),
        F.when(F.count(drawn) == resamples, F.percentile(drawn, F.array(F.lit(tail), F.lit(1.0 - tail)))).alias("__q"),
    ).where("n is not null")
    alone = F.col("n") < 2
    if single == "refuse":
        joined = joined.where(F.when(alone, F.raise_error(F.lit("need at least two units to resample")).cast("boolean")).otherwise(True))
    low, high = F.col("__q")[0], F.col("__q")[1]
    if recentre:
        half = (high - low) / 2
        low, high = F.col("value") - half, F.col("value") + half
    return joined.select(
        *by, "value", F.when(alone, F.col("value")).otherwise(low).alias("low"), F.when(alone, F.col("value")).otherwise(high).alias("high"),
        F.when(alone, 0).otherwise(resamples).alias("resamples"), F.lit(confidence).alias("confidence"), F.col("n").cast("bigint").alias("n"),
    )


# -- figures --


def rate_interval(hits: DataFrame, key: list[str], hit: str, **options) -> DataFrame:
    """Share of rows where ``hit`` holds."""
    rows = hits.withColumn("__hit", F.col(hit).cast("double"))
    return bootstrap(rows, key, ["__hit"], lambda t: t("__hit") / t("n"), **options)


def ratio_interval(terms: DataFrame, key: list[str], numerator: str, denominator: str, **options) -> DataFrame:
    """Sum over sum; 0 where the denominators sum to 0."""
    return bootstrap(
        terms, key, [numerator, denominator],
        lambda t: F.when(t(denominator) != 0, t(numerator) / t(denominator)).otherwise(0.0), **options,
    )


def mean_interval(units: DataFrame, key: list[str], value: str, **options) -> DataFrame:
    """Mean over units, such as a figure per group; one unit gives a point."""
    return bootstrap(units, key, [value], lambda t: t(value) / t("n"), **{"single": "point", **options})


def paired_ratio_interval(units: DataFrame, key: list[str], numerator: str, denominator: str, **options) -> DataFrame:
    """Mean over mean on the same draws; undefined where the denominator's mean is not positive."""
    return bootstrap(
        units, key, [numerator, denominator], lambda t: F.when(t(denominator) > 0, t(numerator) / t(denominator)),
        **{"single": "point", **options},
    )


def paired_diff_interval(units: DataFrame, key: list[str], first: str, second: str, base: str, **options) -> DataFrame:
    """Share of ``first`` minus share of ``second``, both of ``base``, on the same draws, with a verdict.

    Too few groups are not judged; otherwise the difference is real where 0 lies outside.
    """
    found = bootstrap(
        units, key, [first, second, base], lambda t: F.when(t(base) != 0, t(first) / t(base) - t(second) / t(base)), **options
    )
    verdict = (
        F.when(F.col("n") < fixed.MIN_GROUPS_FOR_VERDICT, "too few groups to judge")
        .when(F.col("low") > 0, "higher, and the difference is real")
        .when(F.col("high") < 0, "lower, and the difference is real")
        .otherwise("no difference that survives resampling")
    )
    return found.withColumn("verdict", verdict)


def relative_change_interval(steps: DataFrame, group: str, order: Column, value: str, **options) -> DataFrame:
    """Mean over groups of (last - first) / first, with the decision it supports.

    ``undefined`` counts the groups without a change, their first value being zero or an end NULL. Without a group that has one,
    the figures are NULL and nothing is decided.
    """
    ends = steps.groupBy(group).agg(F.min_by(value, order).alias("__first"), F.max_by(value, order).alias("__last"))
    step = F.when(F.col("__first") != 0, (F.col("__last") - F.col("__first")) / F.col("__first"))
    change = settle(ends.select(group, step.alias("change")))
    found = mean_interval(change.where("change is not null"), [group], "change", **options)
    decision = (
        F.when((F.col("value") <= fixed.GAIN_NEEDED) & (F.col("high") < 0), "run")
        .otherwise("close")
    )
    counted = change.agg(F.count(F.when(F.col("change").isNull(), 1)).alias("undefined"))
    decided = found.withColumn("decision", F.when(F.col("value").isNotNull(), decision))
    # the counts come first, so that they are returned without any interval too
    return counted.join(decided, F.lit(True), "left").select(*decided.columns, "undefined")


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Figures both runs have, and whether their intervals share no point."""
    a = first.select("name", *[F.col(c).alias(f"first_{c}") for c in ("value", "low", "high")])
    b = second.select("name", *[F.col(c).alias(f"second_{c}") for c in ("value", "low", "high")])
    apart = separates(F.col("first_low"), F.col("first_high"), F.col("second_low"), F.col("second_high"))
    return a.join(b, "name").withColumn("verdict", F.when(apart, "SEPARATE").otherwise("overlap"))
