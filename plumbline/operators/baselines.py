"""Measured figures kept per dataset, and what they say about a run.

A metric table holds (dataset, name, value DOUBLE); ``pack_records`` is the record
count the figures were measured on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed

SCHEMA = "dataset string, name string, value double"


def save_metrics(metrics: DataFrame, path: str) -> None:
    """Replace the figures of the datasets in ``metrics``; other datasets keep theirs."""
    (
        metrics.select("dataset", "name", "value")
        .repartition("dataset")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset")
        .parquet(path)
    )


def load_metrics(spark: SparkSession, path: str, dataset: str) -> DataFrame | None:
    """A dataset's figures, or None where none were measured."""
    found = spark.read.schema(SCHEMA).parquet(path).where(F.col("dataset") == dataset)
    return None if found.limit(1).count() == 0 else found.select("dataset", "name", "value")


def carry_over(previous: DataFrame, measured: DataFrame) -> DataFrame:
    """Figures after a run: what it measured, and what it did not from before, marked carried."""
    old = previous.select("dataset", "name", F.col("value").alias("__old"))
    new = measured.select("dataset", "name", F.col("value").alias("__new"), F.lit(True).alias("__measured"))
    return old.join(new, ["dataset", "name"], "full_outer").select(
        "dataset",
        "name",
        F.when(F.col("__measured"), F.col("__new")).otherwise(F.col("__old")).alias("value"),
        F.col("__measured").isNull().alias("carried"),
    )


def missing_required(metrics: DataFrame, datasets: DataFrame, required: tuple[str, ...] = fixed.REQUIRED_METRICS) -> DataFrame:
    """(dataset, name) of required figures a dataset lacks."""
    wanted = datasets.select("dataset", F.explode(F.array(*[F.lit(n) for n in required])).alias("name"))
    return wanted.join(metrics.select("dataset", "name"), ["dataset", "name"], "left_anti")


def is_stale(recorded: Column, current: Column) -> Column:
    """Measured on another record count; an unrecorded count cannot be judged."""
    return F.coalesce(recorded.cast("bigint") != current.cast("bigint"), F.lit(False))


def baseline_lookup(
    datasets: DataFrame, metrics: DataFrame, fallback: dict[str, float]
) -> DataFrame:
    """Each dataset's baseline per figure and where it came from.

    ``datasets`` holds (dataset, records); ``fallback`` names the figures and what stands in for one that was never measured. Provenance: ``measured``, ``stale``,
    ``measured, count not recorded``, or ``fallback``.
    """
    counts = metrics.where(F.col("name") == "pack_records").select("dataset", F.col("value").alias("__recorded"))
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("default")) for n, v in fallback.items()])
    wanted = datasets.join(counts, "dataset", "left").select("*", F.explode(names).alias("w")).select(
        "dataset", "records", "__recorded", "w.name", "w.default"
    )
    found = metrics.select("dataset", "name", F.col("value").alias("__value"))
    note = (
        F.when(F.col("__value").isNull(), "fallback")
        .when(is_stale(F.col("__recorded"), F.col("records")), "stale")
        .when(F.col("__recorded").isNull(), "measured, count not recorded")
        .otherwise("measured")
    )
    return wanted.join(found, ["dataset", "name"], "left").select(
        "dataset", "name", F.coalesce("__value", "default").alias("value"), note.alias("provenance")
    )


def metric_rows(df: DataFrame, dataset: Column, names: list[str]) -> DataFrame:
    """A wide row of figures as (dataset, name, value) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(dataset.alias("dataset"), F.explode(pairs).alias("m")).select("dataset", "m.name", "m.value")


def self_checks(metrics: DataFrame) -> DataFrame:
    """(check, passed) from one row of fid_self, fid_floor, retrieval_real, cer_real."""
    checks = {
        "distance to itself is about zero": F.col("fid_self") <= fixed.SELF_FRECHET_LIMIT,
        "other half is farther than itself": F.col("fid_floor") > F.col("fid_self"),
        "retrieval reaches its floor": F.col("retrieval_real") >= fixed.RETRIEVAL_FLOOR,
        "error rate on real records is usable": F.col("cer_real") <= fixed.ERROR_CEILING,
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()])
    return metrics.select(F.explode(rows).alias("c")).select("c.check", "c.passed")


def carry_verdict(top1: Column, chance: Column, reference: Column) -> Column:
    return (
        F.when(top1 < fixed.CHANCE_MULTIPLE * chance, "not carried")
        .when(top1 > fixed.CARRIED_SHARE * reference, "carried")
        .otherwise("partly")
    )
