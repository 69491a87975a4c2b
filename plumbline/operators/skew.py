"""Building blocks that stay even when one group holds a large share of the rows.

Each measures the groups first (one map-side-combined count) and takes the plain
plan unless a group is too big for one task; then the big groups, and only they,
are cut along the order in question and the pieces' counts put the cut together.
The list of big groups has at most rows / ``ROWS_PER_TASK`` entries and is counted
before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import HASH_BITS, seeded_hash
from plumbline.session import settle

ROWS_PER_TASK = 2_000_000
BROADCAST_ROWS = 200_000
#: Rows of a table without groups that one task puts in order.
ORDERED_TOGETHER = 250_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if ``df`` has at most ``max_rows`` rows, else ``df`` for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def profile(df: DataFrame, by: list[str]) -> tuple[int, int]:
    """(all rows, rows of the largest group)."""
    if not by:
        n = df.count()
        return n, n
    row = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("s"), F.max("n").alias("m")).first()
    return int(row["s"] or 0), int(row["m"] or 0)


def in_order(df: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """``df`` written in ``parts`` even ranges of ``order``, with __part, the range's number, and __at, a number that rises with the order.

    The ranges' ends are sampled on the whole of ``order``, whatever its types, so outliers and repeated beginnings gather no
    rows; only rows equal in all of it stay together.
    """
    cut = df.repartitionByRange(parts, *order) if parts > 1 else df.coalesce(1)
    numbered = cut.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return settle(numbered.withColumn("__part", F.shiftright("__at", 33)))


def _ranked_in_order(rows: DataFrame, by: list[str], order: list[Column], total: int, name: str, size: str | None, rows_per_task: int) -> DataFrame:
    """Places in each group of ``rows``, whose groups are few: ranges of the order are counted, a row's place is its range's start and its own in it."""
    held = in_order(rows, [*[F.col(c) for c in by], *order], -(-total // rows_per_task))
    counts = held.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first"))
    group = Window.partitionBy(*by)
    starts = counts.select(
        *[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__in"),
        (F.sum("__rows").over(group.orderBy("__part")) - F.col("__rows") - F.col("__first") + 1).alias("__shift"), F.sum("__rows").over(group).alias("__n"),
    )
    here = F.col("__part") == F.col("__in")
    for c in by:
        here &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    placed = held.join(checked_broadcast(starts), here).withColumn(name, (F.col("__at") + F.col("__shift")).cast("bigint"))
    return placed.withColumn(size, F.col("__n")) if size else placed


def spread_rank(
    df: DataFrame,
    by: list[str],
    key: list[str],
    seed=None,
    name: str = "rn",
    size: str | None = None,
    position: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """1-based place of each row in its group, by ``position`` and then ``key``.

    Without a ``position`` the order is the seeded one, by hash of (seed, key).
    ``size`` also gives the group's row count. Groups of up to ``rows_per_task`` rows are ranked
    by a window. A larger group, or the whole table where there are no groups, is put in order
    over ranges of (position, key), each of which is counted.
    """
    order = [seeded_hash(seed, *key) if position is None else position, *[F.col(k) for k in key]]
    columns = [*df.columns, name, *([size] if size else [])]
    if not by:
        per_task = min(rows_per_task, ORDERED_TOGETHER)
        return _ranked_in_order(df, [], order, df.count(), name, size, per_task).select(*columns)

    def windowed(rows: DataFrame) -> DataFrame:
        out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
        return (out.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*by))) if size else out).select(*columns)

    _, biggest = profile(df, by)
    if biggest <= rows_per_task:
        return windowed(df)
    hot = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_task)
    total = int(hot.agg(F.sum("__n")).first()[0])
    names = checked_broadcast(hot.select(*[F.col(c).alias(f"__hot_{c}") for c in by]))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__hot_{c}"))
    crowded = _ranked_in_order(df.join(names, same, "left_semi"), by, order, total, name, size, rows_per_task)
    return windowed(df.join(names, same, "left_anti")).unionByName(crowded.select(*columns))


def spread_sum(
    df: DataFrame, value: str, key: list[str], seed, name: str = "running", pieces: int = 4096
) -> DataFrame:
    """Running total of ``value`` over the whole table in seeded order, the row's own value left out.

    The hash range is cut into ``pieces``; the pieces' totals are the only rows summed in one task.
    """
    at = seeded_hash(seed, *key)
    cut = df.withColumn("__at", at).withColumn(
        "__piece", F.floor(F.col("__at") / F.lit(float(2**HASH_BITS)) * pieces).cast("int")
    )
    earlier = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("__piece").agg(F.sum(value).alias("__sum")).select(
        "__piece", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before")
    )
    within = Window.partitionBy("__piece").orderBy("__at", *key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(F.broadcast(offsets), "__piece")
        .withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)) + F.col("__before"))
        .select(*df.columns, name)
    )


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """First ``k`` rows per group. Spark cuts each map task's rows to ``k`` per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def first_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row per group as a map-side-combined aggregate."""
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*by, "__row.*").select(*df.columns)


def exact_quantiles(
    df: DataFrame,
    by: list[str],
    value: Column,
    probs: list[float],
    name: str = "q",
    rows_per_task: int = ROWS_PER_TASK,
    bins: int = 1000,
) -> DataFrame:
    """Linear-interpolated quantiles per group, NULL values left out.

    A hot group's values are first combined by equality, then cut at ``bins`` even ranks of what they are at most, as often as needed until
    the pieces that hold a wanted rank have at most ``rows_per_task`` different values each; only these are ordered.
    """
    anchor = by or ["__all"]
    rows = df.select(*by, value.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    if not by:
        rows = rows.withColumn("__all", F.when(F.col("__v").isNotNull(), F.lit(0)))
    _, biggest = profile(rows, anchor)
    plain = F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs])).alias(name)
    if biggest <= rows_per_task:
        return rows.groupBy(*anchor).agg(plain).select(*by, name)

    hot = rows.groupBy(*anchor).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_task)
    hot_keys = checked_broadcast(hot.select(*anchor))
    cool = rows.join(hot_keys, anchor, "left_anti").groupBy(*anchor).agg(plain)

    counted = settle(rows.join(hot_keys, anchor, "left_semi").groupBy(*anchor, "__v").agg(F.count(F.lit(1)).alias("__c")))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    wanted = settle(
        counted.groupBy(*anchor).agg(F.sum("__c").alias("__n"))
        .select(*anchor, F.explode(ranks).alias("w"), "__n").select(*anchor, F.col("w.i").alias("__i"), ((F.col("__n") - 1) * F.col("w.p")).alias("__pos"))
        .select("*", F.explode(F.array(F.floor("__pos"), F.ceil("__pos"))).alias("__rank")).distinct()
    )
    piece = [*anchor, "__piece"]
    held = pieces_holding(counted, anchor, wanted, rows_per_task, bins)
    running = Window.partitionBy(*piece).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = held.withColumn("__to", F.col("__start") + F.sum("__c").over(running)).withColumn("__from", F.col("__to") - F.col("__c"))
    found = wanted.join(placed.select(*anchor, "__v", "__from", "__to"), anchor).where((F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    points = found.groupBy(*anchor, "__i", "__pos").agg(
        F.min_by("__v", "__rank").alias("__low"), F.max_by("__v", "__rank").alias("__high")
    )
    pos = F.col("__pos")
    quantile = F.col("__low") + (F.col("__high") - F.col("__low")) * (pos - F.floor(pos))
    warm = points.groupBy(*anchor).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), quantile.alias("q")))),
                    lambda s: s["q"]).alias(name)
    )
    return cool.unionByName(warm).select(*by, name)


def pieces_holding(counted: DataFrame, anchor: list[str], wanted: DataFrame, rows_per_task: int, bins: int) -> DataFrame:
    """(anchor..., __v, __c, __piece, __start): the rows of ``counted`` (distinct values with counts) in pieces of their group that hold one of its
    ``wanted`` ranks, __start being the rank at which a piece begins. Pieces are cut anew while one has more than ``rows_per_task`` values.
    """
    held = counted.withColumns({"__piece": F.lit("").cast("string"), "__start": F.lit(0).cast("bigint")})
    piece = [*anchor, "__piece"]
    while True:
        sizes = held.groupBy(*piece).agg(F.count(F.lit(1)).alias("__values"))
        most = sizes.agg(F.max("__values")).first()[0] or 0
        if most <= rows_per_task:
            return held
        parts = min(bins, 2 * -(-most // rows_per_task))
        cuts = held.groupBy(*piece).agg(F.percentile_approx("__v", [i / parts for i in range(1, parts)], 10_000).alias("__cuts"))
        inside = held.join(checked_broadcast(cuts), piece)
        number = F.lpad(F.size(F.filter("__cuts", lambda c: c < F.col("__v"))).cast("string"), 6, "0")
        cut = inside.withColumn("__piece", F.concat("__piece", number)).drop("__cuts")
        before = Window.partitionBy(*anchor, "__start").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
        bars = cut.groupBy(*piece, "__start").agg(F.sum("__c").alias("__bar")).withColumn("__new", F.col("__start") + F.coalesce(F.sum("__bar").over(before), F.lit(0)))
        ranks = wanted.select(*anchor, "__rank").distinct()
        needed = bars.join(checked_broadcast(ranks), anchor).where((F.col("__rank") >= F.col("__new")) & (F.col("__rank") < F.col("__new") + F.col("__bar")))
        needed = needed.select(*piece, "__new").distinct()
        held = settle(cut.join(checked_broadcast(needed), piece).select(*anchor, "__v", "__c", "__piece", F.col("__new").alias("__start")))
