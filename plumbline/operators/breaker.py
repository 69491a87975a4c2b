"""A key that fails too often in a row is given up for good."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators.skew import ROWS_PER_TASK, profile


def breaker(
    df: DataFrame, key: str, seq: str, ok: str, width: int | None = None, limit: int = fixed.MAX_CONSECUTIVE_FAILURES,
    tie: str | None = None,
) -> DataFrame:
    """(key, dead, dead_at, failures) after all rows of each key in ``seq`` order, equal places by ``tie``, failures last.

    ``dead_at`` is the place of the failure that made ``limit`` in a row. ``failures``
    counts the running ones, and stays at ``limit`` once dead. A key's rows are cut
    into stretches of ``width`` places (one stretch, unless a key is too big for a
    task) and each is reduced to how it begins, how it ends, and where it breaks by
    itself; a key of any size is then folded from its stretches.
    """
    if width is None:
        _, biggest = profile(df, [key])
        if biggest > ROWS_PER_TASK:
            ends = df.agg(F.min(seq).alias("lo"), F.max(seq).alias("hi")).first()
            width = max(1, (ends["hi"] - ends["lo"]) // -(-biggest // ROWS_PER_TASK))
    stretch = F.floor(F.col(seq) / F.lit(width)) if width else F.lit(0)
    rows = df.select(key, F.col(seq).cast("bigint").alias("__q"), F.col(ok).alias("__ok"), stretch.cast("bigint").alias("__s"),
                     (F.col(tie) if tie else F.lit(None)).alias("__t"))
    line = Window.partitionBy(key, "__s").orderBy("__q", "__t", F.desc("__ok"))
    placed = rows.withColumn("__rn", F.row_number().over(line)).withColumn(
        "__since", F.max(F.when(F.col("__ok"), F.col("__rn"))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("__k", F.col("__rn") - F.coalesce("__since", F.lit(0)))
    opening = F.col("__since").isNull()
    summary = placed.groupBy(key, "__s").agg(
        F.count(F.lit(1)).alias("__n"),
        F.max(F.when(F.col("__ok"), F.col("__rn"))).alias("last_ok"),
        F.array(*[F.min(F.when(opening & (F.col("__k") == i), F.col("__q"))) for i in range(1, limit + 1)]).alias("opening"),
        F.min(F.when(~opening & ~F.col("__ok") & (F.col("__k") == limit), F.col("__q"))).alias("inner"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("__s", "__n", "last_ok", "opening", "inner")))
    start = F.struct(F.lit(0).cast("bigint").alias("run"), F.lit(None).cast("bigint").alias("dead_at"))

    def fold(state, part):
        through = F.get(part["opening"], (F.lit(limit - 1) - state["run"]).cast("int"))
        broken = F.coalesce(state["dead_at"], through, part["inner"])
        run = F.when(part["last_ok"].isNull(), state["run"] + part["__n"]).otherwise(part["__n"] - part["last_ok"])
        return F.struct(
            F.when(broken.isNotNull(), F.lit(limit)).otherwise(run).cast("bigint").alias("run"), broken.alias("dead_at")
        )

    ended = summary.groupBy(key).agg(F.aggregate(ordered, start, fold).alias("e"))
    return ended.select(
        key, F.col("e.dead_at").isNotNull().alias("dead"), F.col("e.dead_at").alias("dead_at"), F.col("e.run").alias("failures")
    )
