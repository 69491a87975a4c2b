"""Group-disjoint splits balanced by record count."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import seeded_hash
from plumbline.operators.joins import share_of_total
from plumbline.operators.skew import in_order, spread_sum

#: Groups dealt at a time.
GROUPS_PER_TASK = 1_000_000


def _checked(counts: DataFrame, ratios: dict[str, float]) -> int:
    if abs(sum(ratios.values()) - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1: {ratios}")
    if any(r <= 0 for r in ratios.values()):
        raise ValueError(f"ratios must be positive: {ratios}")
    groups = counts.count()
    if groups < len(ratios):
        raise ValueError(f"{groups} groups cannot fill {len(ratios)} sides")
    return groups


def group_split(
    counts: DataFrame, group: str, ratios: dict[str, float], seed, n: str = "n", groups_per_task: int = GROUPS_PER_TASK
) -> DataFrame:
    """(group, n, split): each group, in seeded order, to the side furthest below its share of records.

    Equal shortfalls go to the alphabetically first side. ``counts`` has one row per
    group. The rule is one after another, so ranges of the seeded order follow each other: a
    range starts from the room that the ones before it leave, and only that list of numbers
    goes from range to range. Once all starts are known, the ranges are dealt side by side.
    """
    groups = _checked(counts, ratios)
    sides = sorted(ratios)
    at = seeded_hash(seed, group)
    held = in_order(counts.select(group, F.col(n).cast("bigint").alias("n")), [at, F.col(group)], math.ceil(groups / groups_per_task))
    sums = {r["__part"]: r["n"] for r in held.groupBy("__part").agg(F.sum("n").alias("n")).collect()}
    total = float(sum(sums.values()))
    room = [ratios[s] * total for s in sides]
    starts: dict[int, list[float]] = {}
    for part in sorted(sums):
        starts[part] = room
        if part != max(sums):
            row = _dealt(held.where(F.col("__part") == part), group, sides, {part: room}, ends=True).collect()
            room = list(row[0]["room"])
    return _dealt(held, group, sides, starts)


def _dealt(held: DataFrame, group: str, sides: list[str], starts: dict[int, list[float]], ends: bool = False) -> DataFrame:
    """Ranges of ``held`` dealt from their starts: (group, n, split), or with ``ends`` only the room that each range leaves."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, room = None, []
        for batch in batches:
            dealt = []
            for part, size in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if part != now:
                    now, room = part, list(starts[part])
                side = room.index(max(room))
                room[side] -= size
                dealt.append(sides[side])
            if not ends:
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(dealt, pa.string())], names=[group, "n", "split"])
        if ends and now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([room], pa.list_(pa.float64()))], names=["room"])

    kind = held.schema[group].dataType.simpleString()
    placed = held.repartition("__part").sortWithinPartitions("__part", "__at").select("__part", "__at", group, "n")
    return placed.mapInArrow(deal, "room array<double>" if ends else f"`{group}` {kind}, n bigint, split string")


def share_split(counts: DataFrame, group: str, ratios: dict[str, float], seed, n: str = "n") -> DataFrame:
    """(group, n, split): the seeded order cut where the records before a group pass each side's share.

    No step depends on the one before, so it is the form for very many groups.
    """
    _checked(counts, ratios)
    total = int(counts.agg(F.sum(n).alias("s")).first()["s"])
    running = spread_sum(counts.select(group, F.col(n).cast("bigint").alias("n")), "n", [group], seed)
    sides = list(ratios)
    cut, side = 0.0, None
    for name in sides[:-1]:
        cut += ratios[name]
        test = F.col("running") < F.lit(cut * total)
        side = F.when(test, name) if side is None else side.when(test, name)
    label = F.lit(sides[-1]) if side is None else side.otherwise(sides[-1])
    return running.select(group, "n", label.alias("split"))


def require_sides(split: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """``split`` unchanged; a side without groups is refused."""
    present = {r["split"] for r in split.select("split").distinct().limit(len(ratios) + 1).collect()}
    empty = sorted(set(ratios) - present)
    if empty:
        raise ValueError(f"sides without groups: {empty}")
    return split


def split_validate(split: DataFrame, group: str) -> DataFrame:
    """(group, places, splits) of groups on two sides or twice on one; empty for a sound split."""
    return (
        split.groupBy(group)
        .agg(F.count(F.lit(1)).alias("places"), F.array_sort(F.collect_set("split")).alias("splits"))
        .where("places > 1")
    )


def set_overlap_guard(split: DataFrame, group: str) -> DataFrame:
    """``split`` unchanged if no group is placed twice; otherwise refused."""
    bad = split_validate(split, group).limit(3).collect()
    if bad:
        raise ValueError(f"groups placed more than once: {[r[0] for r in bad]}")
    return split


def split_summary(split: DataFrame) -> DataFrame:
    """Groups and records per side with their shares."""
    sums = split.groupBy("split").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("records"))
    return sums.select(
        "split", "groups", share_of_total("groups").alias("group_share"), "records", share_of_total("records").alias("record_share")
    )


def split_save(split: DataFrame, group: str, path: str, name: str, seed: int, ratios: dict[str, float]) -> None:
    """Groups as a table sorted by side and group, then a one-row JSON header that marks it finished."""
    guarded = set_overlap_guard(split, group)
    guarded.select("split", group).sortWithinPartitions("split", group).write.mode("overwrite").parquet(f"{path}/groups")
    spark = split.sparkSession
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "groups"))))
    header = (
        spark.read.schema(guarded.select("split", group).schema).parquet(f"{path}/groups")
        .groupBy("split").agg(F.count(F.lit(1)).alias("groups"))
        .agg(counts.alias("counts"))
        .select(F.lit(name).alias("name"), F.lit(seed).alias("seed"), "counts",
                F.create_map(*[x for k in sorted(ratios) for x in (F.lit(k), F.lit(float(ratios[k])))]).alias("ratios"))
    )
    header.coalesce(1).write.mode("overwrite").json(f"{path}/header")


def split_load(spark: SparkSession, path: str, group: str, kind: str = "string") -> tuple[DataFrame, DataFrame]:
    """(split, header) of a saved split; overlap is refused on reading too."""
    header = spark.read.schema(
        "name string, seed bigint, counts map<string,bigint>, ratios map<string,double>"
    ).json(f"{path}/header")
    split = spark.read.schema(f"split string, {group} {kind}").parquet(f"{path}/groups")
    return set_overlap_guard(split, group), header


def official_split(df: DataFrame, split: str, group: str) -> DataFrame:
    """Records and groups on each side of the source's own division."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("records"), F.count_distinct(group).alias("groups"))
