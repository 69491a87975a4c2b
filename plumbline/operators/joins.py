"""Pairing and restricting record sets by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.skew import checked_broadcast


def keep_known(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ``known``."""
    return df.join(checked_broadcast(known.select(*on).distinct()), on, "left_semi")


def without_known(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in ``known``."""
    return df.join(checked_broadcast(known.select(*on).distinct()), on, "left_anti")


def exclusion_counts(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """One row: rows kept and rows set aside by ``known``."""
    marked = df.join(
        checked_broadcast(known.select(*on).distinct().withColumn("__hit", F.lit(True))), on, "left"
    )
    return marked.agg(
        F.count_if(F.col("__hit").isNull()).alias("kept"), F.count_if(F.col("__hit").isNotNull()).alias("excluded")
    )


def _both(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), on, "full_outer")


def pairing_faults(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys present on one side only, with the side."""
    odd = _both(left.select(*on), right.select(*on), on).where(F.col("__l").isNull() | F.col("__r").isNull())
    return odd.select(*on, F.when(F.col("__l").isNull(), "right").otherwise("left").alias("only_on"))


def strict_pair(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Joined rows; a key without its partner stops the job."""
    both = _both(left, right, on)
    whole = F.col("__l") & F.col("__r")
    told = F.concat_ws(" ", F.lit("no partner for"), *[F.col(c).cast("string") for c in on])
    return both.where(F.coalesce(whole, F.raise_error(told).cast("boolean"))).drop("__l", "__r")


def paired_runs(first: DataFrame, second: DataFrame, on: list[str], produced: str) -> tuple[DataFrame, DataFrame]:
    """(pairs where both runs produced ``produced``, one row with the number lost).

    A key with output in one run only leaves both.
    """
    def side(df: DataFrame, label: str) -> DataFrame:
        names = {c: f"{label}_{c}" for c in df.columns if c not in on}
        return df.withColumnsRenamed(names)

    both = side(first, "first").join(side(second, "second"), on, "full_outer")
    whole = F.col(f"first_{produced}").isNotNull() & F.col(f"second_{produced}").isNotNull()
    counts = both.agg(
        F.count_if(whole).alias("kept"), F.count_if(~whole).alias("lost")
    )
    return both.where(whole), counts


def rebind_run(saved: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Saved rows with the request each came from, in any order the saved rows carry.

    A saved key without a request stops the job, and so does a request key held twice.
    """
    once = requests.groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), F.first(F.struct(*[c for c in requests.columns if c != key])).alias("__r")
    )
    joined = saved.join(once, key, "left")
    fault = (
        F.when(F.col("__n").isNull(), F.concat(F.lit("no request has key "), F.col(key).cast("string")))
        .when(F.col("__n") > 1, F.concat(F.lit("several requests have key "), F.col(key).cast("string")))
    )
    sound = F.when(fault.isNull(), True).otherwise(F.raise_error(fault).cast("boolean"))
    return joined.where(sound).select(*saved.columns, "__r.*")


def split_assign(records: DataFrame, split: DataFrame, group: str, strict: bool = True) -> DataFrame:
    """Records with the side their group is on.

    Strict: records of a group outside the split stop the job, up to ten groups
    named. Otherwise they are left out.
    """
    if strict:
        unknown = records.select(group).join(split.select(group), group, "left_anti").distinct().limit(10)
        names = [str(r[0]) for r in unknown.collect()]
        if names:
            raise ValueError(f"groups not in the split, e.g. {sorted(names)}")
    return records.join(checked_broadcast(split.select(group, "split")), group, "inner")


def set_reconcile(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: keys only left, only right, in both."""
    both = _both(left.select(*on).distinct(), right.select(*on).distinct(), on)
    return both.agg(
        F.count_if(F.col("__r").isNull()).alias("only_left"),
        F.count_if(F.col("__l").isNull()).alias("only_right"),
        F.count_if(F.col("__l") & F.col("__r")).alias("shared"),
    )


def overlap_filter(gallery: DataFrame, queries: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Both sides restricted to groups they share; queries see the restricted gallery."""
    shared_gallery = keep_known(gallery, queries, [group])
    return shared_gallery, keep_known(queries, shared_gallery, [group])


def union_sides(real: DataFrame, generated: DataFrame, label: str = "label") -> DataFrame:
    """Real rows labelled 0 over generated rows labelled 1."""
    return real.withColumn(label, F.lit(0)).unionByName(generated.withColumn(label, F.lit(1)))


def count_per_group(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def spread_hist(df: DataFrame, by: list[str]) -> DataFrame:
    """How many groups have how many records."""
    return count_per_group(df, by).groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


def dataset_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Records, groups, and the least, median (truncated) and most records of a group.

    The median is weighted over the histogram of group sizes.
    """
    return spread_hist(df, by).agg(
        F.sum(F.col("n") * F.col("groups")).alias("records"),
        F.sum("groups").alias("groups"),
        F.min("n").alias("least"),
        F.percentile("n", 0.5, F.col("groups")).cast("bigint").alias("median"),
        F.max("n").alias("most"),
    )


def min_records(df: DataFrame, by: list[str], floor: int) -> tuple[DataFrame, DataFrame]:
    """(rows of groups with at least ``floor`` records, dropped groups with their counts).

    Stops if no group is left.
    """
    counts = count_per_group(df, by)
    enough = counts.where(F.col("n") >= floor)
    if enough.limit(1).count() == 0:
        raise ValueError(f"no group has {floor} records")
    return keep_known(df, enough, by), counts.where(F.col("n") < floor)


def eligible_groups(df: DataFrame, by: list[str], style_refs: int) -> DataFrame:
    """Groups with enough records for a target, its references and one more."""
    return count_per_group(df, by).where(F.col("n") >= style_refs + 2)


def group_members(df: DataFrame, by: list[str], key: str, chunk: int = 10_000) -> DataFrame:
    """Keys of each group as sorted arrays of bounded length: (by, part, n, keys).

    A group of any size is spread over parts by the key's hash.
    """
    from plumbline.operators.skew import profile

    _, biggest = profile(df, by)
    parts = max(1, -(-biggest // chunk))
    return (
        df.select(*by, F.col(key).alias("__k"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"))
        .groupBy(*by, "part")
        .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("__k")).alias("keys"))
    )


def most_common(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def share_of_total(n: Column | str) -> Column:
    """Share of the sum over a reduced (one row per category) table."""
    n = F.col(n) if isinstance(n, str) else n
    return n / F.sum(n).over(Window.partitionBy())
