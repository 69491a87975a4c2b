"""What a run leaves behind: its log, its samples and terms, and the figures from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "step bigint, wall_time double, metric string, value double"
PARTS = ("per_sample", "terms", "draws", "results", "vectors", "distances", "features", "counts")


def run_log_append(df: DataFrame, path: str) -> None:
    """Append (step, wall_time, metric, value) as JSON lines."""
    df.select("step", "wall_time", "metric", "value").write.mode("append").json(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def aligned(df: DataFrame, column: str, values: DataFrame, key: str) -> DataFrame:
    """``df`` with ``column`` from ``values`` if those cover it one to one, else NULL throughout."""
    from plumbline.operators.joins import pairing_faults

    kind = values.schema[column].dataType
    whole = pairing_faults(df, values, [key]).limit(1).count() == 0
    if not whole:
        return df.withColumn(column, F.lit(None).cast(kind))
    return df.join(values.select(key, column), key)


def run_bundle_write(path: str, run: str, **parts: DataFrame) -> None:
    """Write a run's tables; each replaces what the same run left before, other runs keep theirs.

    Call it with ``per_sample`` before anything is measured, and with ``terms``,
    ``draws`` and ``results`` as they come.
    """
    unknown = set(parts) - set(PARTS)
    if unknown:
        raise ValueError(f"a run has {PARTS}, not {sorted(unknown)}")
    for name, df in parts.items():
        (
            df.withColumn("run", F.lit(run))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/{name}")
        )


def run_bundle_read(spark: SparkSession, path: str, part: str, schema, run: str | None = None) -> DataFrame:
    rows = spark.read.schema(schema).parquet(f"{path}/{part}")
    return rows if run is None else rows.where(F.col("run") == run)


def log_rows(df: DataFrame, step: Column, at: Column, metric: Column, value: Column) -> DataFrame:
    """Any table as log rows; ``at`` a timestamp, kept as epoch seconds."""
    return df.select(
        step.cast("bigint").alias("step"), (F.unix_micros(at) / 1e6).alias("wall_time"), metric.alias("metric"), value.cast("double").alias("value")
    )
