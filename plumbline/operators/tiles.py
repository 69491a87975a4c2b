"""Every left row against every right row of its group, without forming pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import checked_broadcast, profile


def _pieces(df: DataFrame, by: list[str], rows: int, name: str) -> tuple[DataFrame | None, Column]:
    """Pieces a group is cut into: one, but for groups of more than ``rows`` rows."""
    total, biggest = profile(df, by)
    if not by:
        return None, F.lit(max(1, -(-total // rows)))
    if biggest <= rows:
        return None, F.lit(1)
    big = (
        df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
        .select(*by, F.ceil(F.col("n") / rows).cast("int").alias(name))
    )
    return checked_broadcast(big), F.coalesce(F.col(name), F.lit(1))


def tiled_cogroup(
    left: DataFrame, right: DataFrame, by: list[str], left_key: str | list[str], right_key: str | list[str],
    kernel: Callable, schema: str, block: int, tile: int,
) -> DataFrame:
    """Run ``kernel(left rows, right rows)`` on each block of left rows and tile of right rows.

    A group's left rows are cut into blocks and its right rows into tiles by key
    hash; a block meets every tile of its group. One task holds one block and one tile,
    whatever the group's size. Results of a row's tiles are for the caller to merge.
    """
    many_left, blocks = _pieces(left, by, block, "__blocks")
    many_right, tiles = _pieces(right, by, tile, "__tiles")

    def place(df: DataFrame) -> DataFrame:
        for extra in (many_left, many_right):
            if extra is not None:
                df = df.join(extra, by, "left")
        return df

    def every(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    def one(count: Column, key: str | list[str]) -> Column:
        return F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), count).cast("int")

    l = place(left).withColumn("__block", one(blocks, left_key)).withColumn("__tile", every(tiles))
    r = place(right).withColumn("__tile", one(tiles, right_key)).withColumn("__block", every(blocks))
    group = [*by, "__block", "__tile"]
    # Both sides may come from one table; fresh names keep them apart.
    l = l.select(*left.columns, "__block", "__tile").toDF(*left.columns, "__block", "__tile")
    r = r.select(*right.columns, "__block", "__tile").toDF(*right.columns, "__block", "__tile")
    return l.groupBy(*group).cogroup(r.groupBy(*group)).applyInPandas(kernel, schema)
