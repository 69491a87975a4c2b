"""Seeded samples and orders that depend on keys only.

Every draw ranks rows by hash of (seed, key), so a result is the same at any
partitioning and a rerun repeats it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.hashing import seeded_hash
from plumbline.operators.joins import count_per_group, keep_known, without_known
from plumbline.operators.skew import checked_broadcast, spread_rank, top_per_group


def _seeded(seed, key: str) -> list[Column]:
    return [seeded_hash(seed, key), F.col(key)]


def group_sample(
    df: DataFrame, group: str, key: str, seed,
    depth: int = fixed.REFERENCE_DEPTH, minimum: int = fixed.REFERENCE_MINIMUM, consumed: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(up to ``depth`` rows per group, groups withheld with their spare rows).

    Keys in ``consumed`` are no candidates; a group with fewer than ``minimum``
    candidates is withheld and named.
    """
    spare = df if consumed is None else without_known(df, consumed, [key])
    counts = count_per_group(df, [group], "__all").join(count_per_group(spare, [group], "spare"), group, "left").select(
        group, F.coalesce("spare", F.lit(0)).cast("bigint").alias("spare")
    )
    enough = counts.where(F.col("spare") >= minimum)
    chosen = top_per_group(spare, [group], _seeded(seed, key), depth)
    return keep_known(chosen, enough, [group]), counts.where(F.col("spare") < minimum)


def style_refs(df: DataFrame, group: str, key: str, k: int, seed) -> DataFrame:
    """(group, key, refs): ``k`` other keys of each row's group.

    The group stands in a ring in seeded order and the row takes ``k`` neighbours
    running from a start of its own, over the others only; so it never meets itself,
    and repeats come only where fewer than ``k`` others exist. Groups of one are left
    out. The join is on (group, place), which spreads a group of any size.
    """
    ring = spread_rank(df.select(group, key), [group], [key], seed, "rn", "n").where("n > 1")
    others = F.col("n") - 1
    start = F.pmod(seeded_hash(f"{seed}:start", key), others)
    steps = ring.select(
        group, key, "n", (F.col("rn") - 1).alias("__me"), start.alias("__start"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j")
    )
    seat = F.pmod(F.col("__me") + 1 + F.pmod(F.col("__start") + F.col("j"), F.col("n") - 1), F.col("n"))
    wanted = steps.select(group, key, "j", seat.cast("bigint").alias("__seat"))
    seats = ring.select(group, F.col(key).alias("__ref"), (F.col("rn") - 1).cast("bigint").alias("__seat"))
    found = wanted.join(seats, [group, "__seat"])
    return found.groupBy(group, key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "__ref"))), lambda s: s["__ref"]).alias("refs")
    )


def pick_other(df: DataFrame, group: str, key: str, seed) -> DataFrame:
    """(group, key, other): one other key of the same group; a group of one stops the job."""
    lone = count_per_group(df, [group]).where("n < 2").limit(1).collect()
    if lone:
        raise ValueError(f"group {lone[0][0]!r} has fewer than two rows")
    return style_refs(df, group, key, 1, seed).select(group, key, F.element_at("refs", 1).alias("other"))


def distinct_seats(seed, key: Column, n: Column, k: int) -> Column:
    """``k`` different numbers below ``n``, every ordered choice as likely as any other.

    The j-th is drawn among the n - j that are left: a number below that, moved up past each one taken before.
    """
    def next_seat(taken: Column, j: Column) -> Column:
        drawn = F.pmod(seeded_hash(seed, key, j), n - j).cast("bigint")
        free = F.aggregate(F.array_sort(taken), drawn, lambda seat, t: seat + F.when(seat >= t, 1).otherwise(0))
        return F.concat(taken, F.array(free))

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<bigint>"), next_seat)


def build_requests(df: DataFrame, group: str, key: str, style_refs: int, count: int, seed) -> DataFrame:
    """(request, group, target, refs) for ``count`` requests.

    Each draws one of the groups that can serve it and ``style_refs`` + 1 different
    keys of it in any order, the first being the target. Targets may repeat between requests,
    so the request number is the key.
    """
    sizes = count_per_group(df, [group]).where(F.col("n") >= style_refs + 2)
    served = spread_rank(sizes, [], [group], seed, "__g")
    groups = served.count()
    if not groups:
        raise ValueError(f"no group has {style_refs + 2} records")
    spine = df.sparkSession.range(count).withColumnRenamed("id", "request")
    drawn = spine.select("request", (F.pmod(seeded_hash(f"{seed}:group", "request"), F.lit(groups)) + 1).alias("__g"))
    chosen = F.posexplode(distinct_seats(f"{seed}:key", F.col("request"), F.col("n"), style_refs + 1)).alias("j", "__seat")
    wanted = drawn.join(checked_broadcast(served), "__g").select("request", group, chosen)
    seats = spread_rank(keep_known(df.select(group, key), sizes, [group]), [group], [key], seed, "rn").select(
        group, F.col(key).alias("__key"), (F.col("rn") - 1).cast("bigint").alias("__seat")
    )
    ordered = F.array_sort(F.collect_list(F.struct("j", "__key")))
    return (
        wanted.join(seats, [group, "__seat"])
        .groupBy("request", group)
        .agg(F.transform(ordered, lambda s: s["__key"]).alias("__keys"))
        .select("request", group, F.element_at("__keys", 1).alias("target"), F.slice("__keys", 2, style_refs).alias("refs"))
    )


def consumed_keys(requests: DataFrame) -> DataFrame:
    """Every key a run used as target or reference."""
    return requests.select(F.explode(F.concat(F.array("target"), "refs")).alias("key")).distinct()


def three_way_plan(
    df: DataFrame, group: str, key: str, train: int, targets: int, seed,
    reserve: int = fixed.REFERENCE_MINIMUM, groups: int | None = None,
) -> DataFrame:
    """Rows of eligible groups with their role: train, target or rest.

    A group needs train + targets + reserve rows; fewer than two such groups are
    refused. ``groups`` takes a seeded sample of them.
    """
    eligible = count_per_group(df, [group]).where(F.col("n") >= train + targets + reserve).select(group)
    if eligible.limit(2).count() < 2:
        raise ValueError(f"fewer than two groups have {train + targets + reserve} records")
    if groups is not None:
        eligible = eligible.orderBy(seeded_hash(f"{seed}:groups", group), group).limit(groups)
    ranked = spread_rank(keep_known(df, eligible, [group]), [group], [key], seed)
    role = F.when(F.col("rn") <= train, "train").when(F.col("rn") <= train + targets, "target").otherwise("rest")
    return ranked.withColumn("role", role).drop("rn")


def cap_per_group(df: DataFrame, group: str, key: str, cap: int = fixed.CAP_PER_GROUP) -> DataFrame:
    """First ``cap`` rows per group in key order."""
    return top_per_group(df, [group], [F.col(key)], cap).drop("rn")


def filtered_sample(
    df: DataFrame, groups: DataFrame, group: str, key: str, n: int, seed,
    size: str | None = None, low: float = fixed.STYLE_RANGE[0], high: float = fixed.STYLE_RANGE[1],
) -> DataFrame:
    """Seeded sample of ``n`` rows of the given groups, of sizes from ``low`` to ``high`` if ``size`` is named."""
    rows = keep_known(df, groups, [group])
    if size:
        rows = rows.where(F.col(size).between(low, high))
    return rows.orderBy(*_seeded(seed, key)).limit(n)


def gallery_query_split(df: DataFrame, group: str, key: str, k: int, seed, queries: int | None = None) -> DataFrame:
    """First ``k`` of each group's seeded order as gallery, the next ``queries`` (default ``k``) as queries.

    Groups too small for both are left out.
    """
    more = k if queries is None else queries
    enough = count_per_group(df, [group]).where(F.col("n") >= k + more)
    ranked = top_per_group(keep_known(df, enough, [group]), [group], _seeded(seed, key), k + more)
    return ranked.withColumn("side", F.when(F.col("rn") <= k, "gallery").otherwise("query")).drop("rn")


def halves(df: DataFrame, key: str, n: int, seed) -> DataFrame:
    """The first ``n`` rows of the seeded order as half 1, the next ``n`` as half 2; fewer rows are refused."""
    ranked = spread_rank(df, [], [key], seed, "rn").where(F.col("rn") <= 2 * n)
    if df.count() < 2 * n:
        raise ValueError(f"need {2 * n} records")
    return ranked.withColumn("half", F.when(F.col("rn") <= n, 1).otherwise(2)).drop("rn")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed, **options) -> DataFrame:
    """``fold`` 0..folds-1: each class's seeded order dealt out in turn."""
    ranked = spread_rank(df, [label], [key], seed, "rn", **options)
    return ranked.withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(folds)).cast("int")).drop("rn")


def even_spread(df: DataFrame, group: str, order: str, targets: int) -> DataFrame:
    """``role``: ``targets`` rows evenly spread over each group's order are targets, the rest is training.

    A group with no more rows than targets stops the job.
    """
    ranked = spread_rank(df, [group], [order], name="rn", size="n", position=F.col(order))
    p = F.col("rn") - 1
    step = F.col("n") / F.lit(float(targets))
    near = F.floor(p / step)

    def hit(k: Column) -> Column:
        place = F.least(F.col("n") - 1, F.floor(step * k + step / 2))
        return (k >= 0) & (k < targets) & (place == p)

    room = F.when(F.col("n") > targets, True).otherwise(
        F.raise_error(F.lit(f"{targets} targets leave nothing to learn from")).cast("boolean")
    )
    role = F.when(hit(near - 1) | hit(near) | hit(near + 1), "target").otherwise("train")
    return ranked.where(room).withColumn("role", role).drop("rn", "n")


def balanced_sides(df: DataFrame, key: str, seed) -> DataFrame:
    """``side`` A or B, half each in seeded order; an odd row more is A."""
    ranked = spread_rank(df, [], [key], seed, "rn")
    return ranked.withColumn("side", F.when(F.pmod(F.col("rn"), F.lit(2)) == 1, "A").otherwise("B")).drop("rn")


def head_tail_rank(df: DataFrame, group: str, order: Column, key: str) -> DataFrame:
    """``band``: head for the first tenth of each group's rows (one at least), tail for the last; both may apply."""
    ranked = spread_rank(df, [group], [key], name="rn", size="n", position=order)
    tenth = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    return ranked.withColumns({"head": F.col("rn") <= tenth, "tail": F.col("rn") > F.col("n") - tenth})


def head_tail_means(df: DataFrame, group: str, order: Column, key: str, value: str) -> DataFrame:
    """Mean value of the first and the last tenth of each group's rows."""
    marked = head_tail_rank(df, group, order, key)
    return marked.groupBy(group).agg(
        F.count(F.lit(1)).alias("steps"),
        F.avg(F.when(F.col("head"), F.col(value))).alias("head_mean"),
        F.avg(F.when(F.col("tail"), F.col(value))).alias("tail_mean"),
    )


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int, batch: int, skip_batches: int = 0, **options) -> DataFrame:
    """``place`` and ``batch`` of every row in the epoch's order, which depends on (seed, epoch) alone.

    The last short batch is dropped; batches a stopped run already took can be skipped.
    """
    ranked = spread_rank(df, [], [key], seed * 1_000_003 + epoch, "__p", "__n", **options)
    number = F.floor((F.col("__p") - 1) / batch)
    return (
        ranked.withColumns({"place": (F.col("__p") - 1).cast("bigint"), "batch": number.cast("bigint")})
        .where((F.col("batch") < F.floor(F.col("__n") / batch)) & (F.col("batch") >= skip_batches))
        .drop("__p", "__n")
    )


def batch_pad(df: DataFrame, batch: str, v: str, labels: str, refs: str | None = None) -> DataFrame:
    """Vectors and labels padded to their batch's widest, with masks of the real cells.

    Vectors are padded with 1.0 (paper), labels with 0. Rows of a batch that carry
    different numbers of references stop the job.
    """
    sizes = [F.max(F.size(v)).alias("__w"), F.greatest(F.max(F.size(labels)), F.lit(1)).alias("__l")]
    if refs:
        sizes += [F.min(F.size(refs)).alias("__r0"), F.max(F.size(refs)).alias("__r1")]
    widest = df.groupBy(batch).agg(*sizes)
    joined = df.join(checked_broadcast(widest), batch)
    if refs:
        joined = joined.where(F.when(F.col("__r0") == F.col("__r1"), True).otherwise(
            F.raise_error(F.lit("rows of a batch carry different numbers of references")).cast("boolean")
        ))

    def padded(c: str, width: str, value: Column) -> Column:
        return F.concat(F.col(c), F.array_repeat(value, F.col(width) - F.size(c)))

    def mask(c: str, width: str) -> Column:
        return F.concat(F.array_repeat(F.lit(True), F.size(c)), F.array_repeat(F.lit(False), F.col(width) - F.size(c)))

    return joined.select(
        *[c for c in df.columns if c not in (v, labels)],
        F.size(v).alias("width"), F.size(labels).alias("label_length"),
        padded(v, "__w", F.lit(1.0).cast("float")).alias(v), mask(v, "__w").alias("mask"),
        padded(labels, "__l", F.lit(fixed.PAD_INDEX)).alias(labels),
    )


def ordered(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rn`` within small groups, such as a request's few draws."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
