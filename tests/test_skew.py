"""Cut groups give the same result as whole ones, at any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import joins, sampling, skew, splitting
from plumbline.operators.skew import exact_quantiles, spread_rank, spread_sum


@pytest.fixture(scope="module")
def lopsided(spark):
    """One group holds half of the rows."""
    return spark.range(4000).select(
        F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 37)).alias("group"),
        F.round(F.sqrt("id") * 3, 1).alias("value"),
    ).repartition(7).cache()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("by", [["group"], []])
@pytest.mark.parametrize("limit", [100, 700])
def test_rank_of_cut_groups(lopsided, by, limit):
    whole = spread_rank(lopsided, by, ["key"], 5, "rn", "n")
    cut = spread_rank(lopsided.repartition(3), by, ["key"], 5, "rn", "n", rows_per_task=limit)
    assert rows(whole, "key", "rn", "n") == rows(cut, "key", "rn", "n")


def test_rank_by_position(lopsided):
    whole = spread_rank(lopsided, ["group"], ["key"], name="rn", position=F.col("value"))
    cut = spread_rank(lopsided, ["group"], ["key"], name="rn", position=F.col("value"), rows_per_task=90)
    assert rows(whole, "key", "rn") == rows(cut, "key", "rn")


def test_running_sum(lopsided):
    summed = spread_sum(lopsided.withColumn("x", F.col("key") % 11), "x", ["key"], 3)
    ranked = spread_rank(summed, [], ["key"], 3).select("rn", "x", "running").toPandas().sort_values("rn")
    assert (ranked["running"].to_numpy() == np.concatenate([[0], ranked["x"].cumsum()[:-1]])).all()


@pytest.mark.parametrize("by", [["group"], []])
def test_quantiles_of_cut_groups(lopsided, by):
    probs = [0.0, 0.02, 0.25, 0.5, 0.85, 1.0]
    got = exact_quantiles(lopsided, by, F.col("value"), probs, rows_per_task=50, bins=16)
    frame = lopsided.toPandas()
    for r in got.collect():
        values = frame[frame["group"] == r["group"]]["value"] if by else frame["value"]
        np.testing.assert_allclose(r["q"], np.quantile(values, probs), atol=1e-9)
    assert got.count() == (lopsided.select("group").distinct().count() if by else 1)


def test_quantiles_of_one_value(spark):
    flat = spark.range(500).select(F.lit("a").alias("group"), F.lit(2.5).alias("value"))
    assert exact_quantiles(flat, ["group"], F.col("value"), [0.1, 0.9], rows_per_task=10).first()["q"] == [2.5, 2.5]


def test_folds_of_cut_classes(lopsided):
    one = sampling.stratified_folds(lopsided, "group", "key", 10, 1)
    many = sampling.stratified_folds(lopsided.repartition(16), "group", "key", 10, 1, rows_per_task=100)
    assert rows(one, "key", "fold") == rows(many, "key", "fold")
    sizes = one.groupBy("group", "fold").count().groupBy("group").agg((F.max("count") - F.min("count")).alias("d"))
    assert sizes.agg(F.max("d")).first()[0] <= 1


def test_epoch_order_resumes(lopsided):
    full = sampling.epoch_order(lopsided, "key", 7, 2, 32)
    cut = sampling.epoch_order(lopsided.repartition(5), "key", 7, 2, 32, skip_batches=3, rows_per_task=300)
    assert rows(full.where("batch >= 3"), "key", "place", "batch") == rows(cut, "key", "place", "batch")
    assert full.count() == 4000 // 32 * 32
    assert rows(full, "key", "place") != rows(sampling.epoch_order(lopsided, "key", 7, 3, 32), "key", "place")


def test_members_in_parts(lopsided):
    parts = joins.group_members(lopsided, ["group"], "key", chunk=100)
    assert parts.agg(F.max("n")).first()[0] < 200
    assert parts.agg(F.sum("n")).first()[0] == 4000


def test_checked_broadcast(spark):
    small, large = spark.range(10), spark.range(5000)
    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(skew.checked_broadcast(small)) and not hinted(skew.checked_broadcast(large, 100))


def test_greedy_split_is_the_rule(spark):
    counts = spark.range(260).select(F.col("id").cast("string").alias("group"), (3 + (F.col("id") * 11) % 53).alias("n"))
    ratios = {"train": 0.7, "test": 0.3}
    split = splitting.group_split(counts, "group", ratios, 1337).collect()
    from hashlib import md5

    order = sorted(((int(md5(f"1337:{r['group']}".encode()).hexdigest()[:15], 16), r["group"], r["n"]) for r in split))
    total = sum(n for _, _, n in order)
    left = {k: v * total for k, v in ratios.items()}
    expected = {}
    for _, g, n in order:
        side = "test" if left["test"] >= left["train"] else "train"
        expected[g] = side
        left[side] -= n
    assert {r["group"]: r["split"] for r in split} == expected
    assert abs(sum(r["n"] for r in split if r["split"] == "test") / total - 0.3) < 0.02


def test_stretched_split_keeps_shares(spark):
    counts = spark.range(3000).select(F.col("id").alias("group"), (3 + (F.col("id") * 11) % 53).alias("n"))
    split = splitting.group_split(counts, "group", {"a": 0.5, "b": 0.3, "c": 0.2}, 1, groups_per_task=400)
    shares = {r["split"]: r["record_share"] for r in splitting.split_summary(split).collect()}
    assert split.count() == 3000
    for side, share in {"a": 0.5, "b": 0.3, "c": 0.2}.items():
        assert abs(shares[side] - share) < 0.02


def test_split_is_one_rule_at_any_size(spark):
    counts = spark.range(300).select(F.concat(F.lit("g"), "id").alias("group"), (2 + (F.col("id") * 13) % 29).alias("n"))
    ratios = {"x": 0.5, "y": 0.3, "z": 0.2}
    whole = rows(splitting.group_split(counts, "group", ratios, 3, groups_per_task=10**9), "group", "n", "split")
    assert rows(splitting.group_split(counts.repartition(7), "group", ratios, 3, groups_per_task=100), "group", "n", "split") == whole


@pytest.mark.parametrize("values", ["F.concat(F.lit('Customer#'), F.lpad(F.col('id').cast('string'), 9, '0'))", "F.lit('the same')", "F.struct(F.lit(1), -F.col('id'))"])
def test_order_is_cut_evenly(spark, values):
    """Keys with one beginning, one repeated value, tuples: the ranges are even and follow the order."""
    df = spark.range(1000).withColumn("at", eval(values)).repartition(5)  # noqa: S307
    held = skew.in_order(df, [F.col("at"), F.col("id")], 8)
    sizes = [r["count"] for r in held.groupBy("__part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 1000 / 8
    placed = [r["id"] for r in held.orderBy("__at").collect()]
    assert placed == [r["id"] for r in df.orderBy("at", "id").collect()]
    ranked = spread_rank(df, [], ["id"], position=F.col("at"), rows_per_task=130)
    assert [r["id"] for r in ranked.orderBy("rn").collect()] == placed
    assert "Window" not in ranked._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


@pytest.mark.parametrize("shape", ["outlier", "tie"])
def test_quantiles_of_skewed_values(spark, shape):
    value = {"outlier": F.when(F.col("id") == 7, 1e12).otherwise(F.sqrt("id")), "tie": F.when(F.col("id") % 4 < 3, 5.0).otherwise(F.sqrt("id"))}[shape]
    df = spark.range(4000).select(F.lit("a").alias("group"), value.alias("value")).repartition(3)
    probs = [0.0, 0.1, 0.5, 0.77, 0.999, 1.0]
    got = exact_quantiles(df, ["group"], F.col("value"), probs, rows_per_task=60, bins=5).first()["q"]
    np.testing.assert_allclose(got, np.quantile(df.toPandas()["value"], probs), rtol=1e-12)
    counted = df.groupBy("group", F.col("value").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    wanted = spark.createDataFrame([("a", r) for r in (400, 2000, 3995)], "group string, __rank long")
    held = skew.pieces_holding(counted, ["group"], wanted, 60, 5)
    sizes = [r["count"] for r in held.groupBy("__piece").count().collect()]
    assert max(sizes) <= 60 and sum(sizes) <= 3 * 60


def test_split_refusals(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 2)], "group string, n long")
    for ratios in ({"x": 0.5, "y": 0.4}, {"x": 1.5, "y": -0.5}, {"x": 0.4, "y": 0.3, "z": 0.3}):
        with pytest.raises(ValueError):
            splitting.group_split(counts, "group", ratios, 1)
    twice = spark.createDataFrame([("a", "x"), ("a", "y")], "group string, split string")
    with pytest.raises(ValueError):
        splitting.set_overlap_guard(twice, "group")
    with pytest.raises(ValueError):
        joins.split_assign(counts, twice.limit(1), "group")
    assert joins.split_assign(counts, twice.limit(1), "group", strict=False).count() == 1


def test_refs_never_meet_their_target(lopsided):
    refs = sampling.style_refs(lopsided, "group", "key", 4, 9)
    for r in refs.collect():
        assert len(r["refs"]) == 4 and r["key"] not in r["refs"] and len(set(r["refs"])) == 4
    assert rows(refs, "key", "refs") == rows(sampling.style_refs(lopsided.repartition(11), "group", "key", 4, 9), "key", "refs")


def test_refs_repeat_only_in_small_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "group string, key long")
    found = {r["key"]: r["refs"] for r in sampling.style_refs(df, "group", "key", 3, 1).collect()}
    assert found == {1: [2, 2, 2], 2: [1, 1, 1]}
    with pytest.raises(ValueError):
        sampling.pick_other(df, "group", "key", 1)


def test_requests(lopsided):
    made = sampling.build_requests(lopsided, "group", "key", 3, 500, 4).collect()
    member = {r["key"]: r["group"] for r in lopsided.collect()}
    assert [r["request"] for r in sorted(made, key=lambda r: r["request"])] == list(range(500))
    for r in made:
        keys = [r["target"], *r["refs"]]
        assert len(set(keys)) == 4 and {member[k] for k in keys} == {r["group"]}


def test_reference_leaves_out_what_was_used(spark):
    keys = [("a", f"a{i}") for i in range(20)] + [("b", f"b{i}") for i in range(20)] + [("thin", f"t{i}") for i in range(7)]
    df = spark.createDataFrame(keys, "group string, key string")
    used = df.where(F.col("key").isin("a0", "a1", "t0", "t1"))
    chosen, withheld = sampling.group_sample(df, "group", "key", 0, 12, 6, used.select("key"))
    assert chosen.join(used, "key", "left_semi").count() == 0
    assert {r["group"]: r["count"] for r in chosen.groupBy("group").count().collect()} == {"a": 12, "b": 12}
    assert [tuple(r) for r in withheld.collect()] == [("thin", 5)]


def test_even_spread_refuses_too_many_targets(spark):
    df = spark.range(3).select(F.lit("a").alias("group"), F.col("id").alias("key"))
    with pytest.raises(Exception, match="nothing to learn"):
        sampling.even_spread(df, "group", "key", 3).collect()


def test_sides_are_balanced(spark):
    sides = sampling.balanced_sides(spark.range(31).withColumnRenamed("id", "trial"), "trial", 5)
    assert {r["side"]: r["count"] for r in sides.groupBy("side").count().collect()} == {"A": 16, "B": 15}


def test_text_keys_and_outliers_are_cut(spark):
    rows = [("a", f"k{i:03d}", float(i)) for i in range(200)] + [("a", "zz", 1e12), ("b", "k1", 1.0)]
    df = spark.createDataFrame(rows, "group string, key string, value double")
    for position in (F.col("key"), F.col("value")):
        whole = spread_rank(df, ["group"], ["key"], name="rn", size="n", position=position)
        cut = spread_rank(df.repartition(3), ["group"], ["key"], name="rn", size="n", position=position, rows_per_task=40)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_requests_are_as_many_as_the_choices(spark):
    """A group of 40 rows serves 2,000 requests with different lists, each without repeats, and every row is as likely a target."""
    df = spark.range(40).select(F.lit("g").alias("group"), "id")
    found = sampling.build_requests(df, "group", "id", 4, 2000, 9).collect()
    lists = [(r["target"], *r["refs"]) for r in found]
    assert len(lists) == 2000 and all(len(set(x)) == 5 for x in lists)
    assert len(set(lists)) > 1900 and len({frozenset(x) for x in lists}) > 1900
    targets = np.bincount([x[0] for x in lists], minlength=40)
    assert targets.min() > 20 and targets.max() < 90
