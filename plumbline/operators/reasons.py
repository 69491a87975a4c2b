"""Exclusion with a counted reason: nothing leaves a record set unnamed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DROPPED = "dropped"
EXCLUDED = "excluded"
KEPT = "kept"


class Rule(NamedTuple):
    """``kind`` tells a defect in the data (dropped) from a decision of scope (excluded)."""

    reason: str
    when: Column
    kind: str = DROPPED


def first_reason(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``reason`` and ``kind`` of the first rule that holds; NULL and ``kept`` where none does."""
    marks = [
        F.when(r.when, F.struct(F.lit(r.reason).alias("reason"), F.lit(r.kind).alias("kind"))) for r in rules
    ]
    mark = F.coalesce(*marks, F.struct(F.lit(None).cast("string").alias("reason"), F.lit(KEPT).alias("kind")))
    return df.withColumn("__mark", mark).select("*", "__mark.reason", "__mark.kind").drop("__mark")


def kept(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNull()).drop("reason", "kind")


def drop_report(df: DataFrame) -> DataFrame:
    """(reason, kind, n, share of everything seen), most common first.

    The kept rows are a line of the report too, so the counts add up to the rows seen.
    """
    counts = df.groupBy("reason", "kind").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    return (
        counts.withColumn("share", F.col("n") / F.sum("n").over(everything))
        .withColumn("reason", F.coalesce("reason", F.lit(KEPT)))
        .orderBy(F.desc("n"), "reason")
    )


def exclude(column: str, values: list[str], reason: str) -> Rule:
    """Rule that sets a list of ids aside as out of scope."""
    return Rule(reason, F.col(column).isin(*values), EXCLUDED)


def reconciles(report: DataFrame, seen: DataFrame) -> DataFrame:
    """One row: rows seen, rows reported, and whether they agree."""
    reported = report.agg(F.sum("n").alias("reported"))
    looked = seen.agg(F.count(F.lit(1)).alias("seen"))
    both = reported.select("reported", F.lit(None).cast("bigint").alias("seen")).unionByName(
        looked.select(F.lit(None).cast("bigint").alias("reported"), "seen")
    )
    return both.agg(F.max("reported").alias("reported"), F.max("seen").alias("seen")).withColumn(
        "agree", F.col("reported") == F.col("seen")
    )
