"""Faults of outputs and readiness of data, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed

OK, PARTIAL, MISSING = "ok", "partial", "miss"


def output_checks(rows: DataFrame, key: str, v: str, expected_width: int | None = None) -> DataFrame:
    """(key, fault) for outputs that are absent, empty, of the wrong width or flat; first fault only."""
    value = F.col(v)
    wrong = F.lit(False) if expected_width is None else F.size(value) != expected_width
    fault = (
        F.when(value.isNull(), "no output for the request")
        .when(F.size(value) == 0, "empty")
        .when(wrong, "wrong width")
        .when(F.array_max(value) - F.array_min(value) < 1e-6, "flat")
    )
    return rows.select(key, fault.alias("fault")).where(F.col("fault").isNotNull())


def require_sound(rows: DataFrame, key: str, v: str, expected_width: int | None = None) -> DataFrame:
    """``rows`` unchanged; the first faulty one stops the job and is named."""
    marked = rows.join(output_checks(rows, key, v, expected_width), key, "left")
    told = F.concat(F.lit("request "), F.col(key).cast("string"), F.lit(": "), F.col("fault"))
    return marked.where(
        F.when(F.col("fault").isNull(), True).otherwise(F.raise_error(told).cast("boolean"))
    ).drop("fault")


def preflight_faults(rows: DataFrame, key: str, size: Column, height: Column, wanted_height: int, predicted: Column) -> DataFrame:
    """(key, fault): empty, wrong height, or much narrower than predicted."""
    fault = (
        F.when(size.isNull() | (size == 0), "empty")
        .when(height != wanted_height, "wrong height")
        .when((predicted > 0) & (size / predicted < fixed.PREFLIGHT_NARROW), "narrow")
    )
    return rows.select(key, fault.alias("fault")).where(F.col("fault").isNotNull())


def status(found: Column, expected: Column) -> Column:
    """``ok`` at the expected count, ``partial`` at another, ``miss`` at none."""
    return F.when(F.coalesce(found, F.lit(0)) == 0, MISSING).when(found == expected, OK).otherwise(PARTIAL)


def readiness(observed: DataFrame, expected: DataFrame, either: tuple[str, str], needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checks, capabilities).

    ``observed`` (label, found); ``expected`` (label, expected, required); one of
    ``either`` is enough, and then neither blocks and the derived label ``either``
    is ok. ``needs`` (capability, label).
    """
    pair = F.col("label").isin(*either)
    rows = expected.join(observed, "label", "left").withColumn("status", status(F.col("found"), F.col("expected")))
    any_ok = rows.where(pair).agg(F.coalesce(F.bool_or(F.col("status") == OK), F.lit(False)).alias("any_ok"))
    has_either = bool(any_ok.first()["any_ok"])
    required = F.when(pair, F.lit(not has_either)).otherwise(F.col("required"))
    checks = rows.select(
        "label", F.coalesce("found", F.lit(0)).cast("bigint").alias("found"), "expected", "status",
        (required & (F.col("status") != OK)).alias("blocking"),
    )
    derived = checks.select("label", "status").unionByName(
        checks.limit(1).select(F.lit("either").alias("label"), F.lit(OK if has_either else MISSING).alias("status"))
    )
    able = (
        needs.join(derived, "label", "left")
        .groupBy("capability")
        .agg(
            F.bool_and(F.coalesce(F.col("status") == OK, F.lit(False))).alias("ready"),
            F.concat_ws(", ", F.array_sort(F.collect_list(
                F.when(F.coalesce(F.col("status") == OK, F.lit(False)), F.lit(None)).otherwise(F.col("label"))
            ))).alias("blockers"),
        )
    )
    return checks, able


def condition_spread(rows: DataFrame, condition: str, stats: list[str], phase: str) -> DataFrame:
    """Per statistic: largest minus smallest value over the conditions, before and after.

    ``rows`` holds one row per (phase, condition); phase is ``before`` or ``after``.
    """
    long = rows.select(
        phase, F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v")) for s in stats])).alias("m")
    )
    wide = long.groupBy("m.stat").pivot(phase, ["before", "after"]).agg(F.max("m.v") - F.min("m.v"))
    return wide.select("stat", "before", "after", (F.col("after") > F.col("before")).alias("worse"))


def condition_agree(counts: DataFrame, n: str) -> DataFrame:
    """One row: how many conditions, how many different counts, and whether all agree."""
    return counts.agg(F.count(F.lit(1)).alias("conditions"), F.count_distinct(n).alias("counts")).withColumn(
        "agree", F.col("counts") == 1
    )
