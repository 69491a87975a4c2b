"""Where the plan modules put their queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(read)`` under ``name``; ``read("orders")`` gives a table."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # The tables' timestamps carry no zone; the SQL twins read them as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(partial(table, spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def h(*keys: str, seed=fixed.SEED) -> str:
    """SQL of the seeded hash."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 15))::BIGINT"


ENGLISH = fixed.PUNCTUATION + fixed.DIGITS + fixed.UPPERCASE + fixed.LOWERCASE
SQL_ENGLISH = "'" + ENGLISH.replace("'", "''") + "'"
