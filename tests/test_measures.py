"""Similarity, moments, intervals and the two-sample test against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.vectors import vector_mean
from plumbline.operators import detect, intervals, moments, rates, similarity


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 6)) * 2
    groups = np.repeat(np.arange(30), 8)
    points = centres[groups] + rng.normal(size=(240, 6))
    rows = [(int(i), f"g{g:02d}", [float(x) for x in p]) for i, (g, p) in enumerate(zip(groups, points, strict=True))]
    return spark.createDataFrame(rows, "key long, group string, v array<double>").cache()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_scores_streamed_and_tiled(cloud, metric, monkeypatch):
    monkeypatch.setattr(similarity, "QUERY_BYTES", 50 * 8 * 6)
    monkeypatch.setattr(similarity, "PASSING", 7)
    gallery = vector_mean(cloud, ["group"], "v")
    near = similarity.score_against(cloud, gallery, ["key"], "group", "v", 4, metric)
    far = similarity.score_against(cloud, gallery, ["key"], "group", "v", 4, metric, gallery_rows=3)
    frame, means = cloud.toPandas(), gallery.toPandas().sort_values("group")
    q, g = np.stack(frame["v"]), np.stack(means["mean"])
    if metric == "cosine":
        expected = (q / np.linalg.norm(q, axis=1)[:, None]) @ (g / np.linalg.norm(g, axis=1)[:, None]).T
    else:
        expected = -np.linalg.norm(q[:, None] - g[None], axis=2)
    names = means["group"].to_numpy()
    for found in (near, far):
        for r in found.collect():
            row = expected[r["key"]]
            np.testing.assert_allclose([r["own"], r["total"]], [row[list(names).index(r["group"])], row.sum()], atol=1e-9)
            assert r["groups"] == 30
            assert [t["g"] for t in r["top"]] == list(names[np.argsort(-row)[:4]])


def test_unknown_query_group_stops(cloud):
    gallery = vector_mean(cloud.where("group <> 'g03'"), ["group"], "v")
    scored = similarity.score_against(cloud, gallery, ["key"], "group", "v", 2)
    with pytest.raises(Exception, match="not in the gallery"):
        similarity.retrieval_hits(scored, ["key"], "group", 2).collect()


def test_wide_vectors_have_the_same_mean(cloud, monkeypatch):
    narrow = {r["group"]: (r["n"], r["mean"]) for r in vector_mean(cloud, ["group"], "v").collect()}
    monkeypatch.setattr("plumbline.functions.vectors.WIDE_VECTOR", 2)
    for r in vector_mean(cloud, ["group"], "v").collect():
        assert r["n"] == narrow[r["group"]][0]
        np.testing.assert_allclose(r["mean"], narrow[r["group"]][1])


def test_random_vectors_are_near_chance(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"g{i % 10}", [float(x) for x in rng.normal(size=16)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "key long, group string, v array<double>")
    gallery = vector_mean(df.where("key < 500"), ["group"], "v")
    scored = similarity.score_against(df.where("key >= 500"), gallery, ["key"], "group", "v", 5)
    r = similarity.retrieval_score(similarity.retrieval_hits(scored, ["key"], "group", 5), 5).first()
    assert r["chance"] == 0.1 and abs(r["top1"] - 0.1) < 0.05 and abs(r["topk"] - 0.5) < 0.09


def test_identity_of_the_real_set_is_one(cloud):
    sets = cloud.where("key % 8 >= 4").withColumn("set", F.explode(F.array(F.lit("generated"), F.lit("real"), F.lit("floor"))))
    moved = sets.withColumn("v", F.when(F.col("set") == "floor", F.transform("v", lambda x: x * 0)).otherwise(F.col("v")))
    distances = similarity.group_distance(moved, cloud.where("key % 8 < 4"), ["set"], "group", "v")
    r = similarity.three_set_score(distances).first()
    assert r["identity"] == pytest.approx(1.0) and r["position"] == pytest.approx(0.0) and r["candidates"] == 30
    with pytest.raises(Exception, match="no reference"):
        similarity.group_distance(cloud, cloud.where("group <> 'g00'"), [], "group", "v").collect()


def test_one_group_has_no_others(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0])], "group string, v array<double>")
    r = similarity.group_distance(df, df, [], "group", "v").first()
    assert r["own"] == 0 and r["wrong"] is None and r["nearest_is_right"]


def gaussians(spark, n=400, d=5, shift=0.0, scale=1.0, offset=0.0):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(n, d)) + offset
    b = rng.normal(size=(n, d)) * scale + shift + offset
    rows = [(f"{s}{i}", s, [float(x) for x in p]) for s, m in (("real", a), ("generated", b)) for i, p in enumerate(m)]
    return spark.createDataFrame(rows, "key string, side string, v array<double>"), a, b


def test_moments(spark):
    df, a, _ = gaussians(spark, offset=1e6)
    r = moments.gaussian_stats(df.repartition(5), ["side"], "v").where("side = 'real'").first()
    np.testing.assert_allclose(r["mean"], a.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(np.reshape(r["cov"], (5, 5)), np.cov(a, rowvar=False), atol=1e-7)


def test_frechet_closed_form(spark):
    a, b = np.diag([1.0, 4.0]), np.diag([9.0, 1.0])
    assert moments.frechet(np.zeros(2), a, np.array([3.0, 0.0]), b) == pytest.approx(9 + 4 + 1)
    df, x, y = gaussians(spark, shift=2.0, scale=1.5)
    got = moments.frechet_distance(df, "side", "v").first()["value"]
    expected = moments.frechet(x.mean(axis=0), np.cov(x, rowvar=False), y.mean(axis=0), np.cov(y, rowvar=False))
    assert got == pytest.approx(expected, rel=1e-9)
    with pytest.raises(ValueError, match="misleads"):
        moments.frechet_distance(df, "side", "v", minimum=401)
    with pytest.raises(ValueError, match="dimensions"):
        moments.frechet(np.zeros(2), a, np.zeros(3), np.eye(3))


def test_projection_keeps_the_distance(spark):
    df, _, _ = gaussians(spark, shift=0.7)
    wide = df.withColumn("v", F.concat("v", F.transform("v", lambda x: 2 * x)))
    thin = moments.span_project(wide, "v")
    assert thin.select(F.size("v")).distinct().collect()[0][0] == 5
    full = moments.frechet_distance(wide, "side", "v").first()["value"]
    assert moments.frechet_distance(thin, "side", "v").first()["value"] == pytest.approx(full, rel=1e-6)
    assert moments.span_project(df, "v") is df


def test_frechet_interval(spark, monkeypatch):
    df, x, y = gaussians(spark, shift=0.5)
    mean, cov = x.mean(axis=0), np.cov(x, rowvar=False)
    w = slow_weights([f"generated{i}" for i in range(len(y))], 40)
    stats = [moments.frechet(mean, cov, np.average(y, axis=0, weights=c), np.cov(y, rowvar=False, fweights=c)) for c in w.T]
    point = moments.frechet(mean, cov, y.mean(axis=0), np.cov(y, rowvar=False))
    half = np.diff(np.percentile(stats, [2.5, 97.5]))[0] / 2
    for held in (moments.REPLICATE_BYTES, 8 * 21 * 7):  # all replicates in one pass, or seven
        monkeypatch.setattr(moments, "REPLICATE_BYTES", held)
        r = moments.frechet_interval(df.repartition(9), "side", "v", "key", resamples=40).first()
        np.testing.assert_allclose([r["value"], r["low"], r["high"]], [point, point - half, point + half], rtol=1e-9)


def test_few_rows_of_many_dimensions(spark):
    """Rows that can't fill their space are compared in the one they span, with the same result."""
    rng = np.random.default_rng(12)
    sides = {"real": rng.normal(size=(80, 600)), "generated": rng.normal(size=(70, 600)) * 1.2 + 0.1}
    rows = [(f"{s}{i}", s, [float(v) for v in p]) for s, m in sides.items() for i, p in enumerate(m)]
    df = spark.createDataFrame(rows, "key string, side string, v array<double>").repartition(4)
    stats = [f(sides[s]) for s in ("real", "generated") for f in (lambda m: m.mean(axis=0), lambda m: np.cov(m, rowvar=False))]
    full = moments.frechet(*stats)
    assert moments.frechet_distance(df, "side", "v", minimum=2).first()["value"] == pytest.approx(full, rel=1e-6)
    thin = moments.span_project(df, "v")
    assert thin.select(F.size("v")).distinct().collect() == [(149,)]
    r = moments.frechet_interval(df, "side", "v", "key", resamples=20, minimum=2).first()
    assert r["value"] == pytest.approx(full, rel=1e-6) and r["low"] < r["value"] < r["high"]


def slow_weights(keys, resamples, seed=1337):
    """Counts of mean one by plain arithmetic on the documented hash."""
    from hashlib import md5

    from plumbline.functions import resampling

    mask, rows = (1 << 60) - 1, []
    for key in keys:
        start, counts = int(md5(f"{seed}:{key}".encode()).hexdigest()[:15], 16), []
        for r in range(resamples):
            x = (start + r * 0x9E3779B97F4A7C1) & mask
            x = (x ^ x >> 31) * 0xBF58476D1CE4E5B & mask
            x = (x ^ x >> 29) * 0x94D049BB133111B & mask
            x ^= x >> 32
            counts.append(sum(x >= b for b in resampling.BOUNDS))
        rows.append(counts)
    return np.array(rows)


def test_interval_is_brute_force(spark):
    rng = np.random.default_rng(4)
    e, n = rng.integers(0, 9, 60), rng.integers(5, 20, 60)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(e, n, strict=True))], "key long, e int, n_chars int")
    w = slow_weights(range(60), 300)
    stats = (e @ w) / (n @ w)
    for parts in (1, 7):
        r = intervals.ratio_interval(df.repartition(parts), ["key"], "e", "n_chars", resamples=300).first()
        np.testing.assert_allclose([r["value"], r["low"], r["high"]], [e.sum() / n.sum(), *np.percentile(stats, [2.5, 97.5])], atol=1e-12)
        assert (r["resamples"], r["n"], r["confidence"]) == (300, 60, 0.95)


def test_weights_are_poisson_and_apart():
    from plumbline.functions import resampling

    w = resampling.weights(np.arange(20_000), np.arange(100)).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.002
    assert abs(np.corrcoef(w.T) - np.eye(100)).max() < 0.05
    assert (resampling.weights(np.arange(9), np.array([-1])) == 1).all()


def test_width_is_the_theory_s(spark):
    df = spark.range(4000).select("id", (F.pmod(F.xxhash64("id"), F.lit(100)) < 30).alias("hit"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10.0).alias("x"))
    r = intervals.rate_interval(df, ["id"], "hit", resamples=400).first()
    assert abs((r["high"] - r["low"]) / (np.sqrt(0.3 * 0.7 / 4000) * 1.96 * 2) - 1) < 0.2 and r["low"] < r["value"] < r["high"]
    r = intervals.mean_interval(df, ["id"], "x", resamples=300).first()
    spread = df.agg(F.stddev_pop("x")).first()[0] / np.sqrt(4000) * 1.96 * 2
    assert abs((r["high"] - r["low"]) / spread - 1) < 0.2


def test_sets_share_draws(spark):
    """The same units in two sets have the same replicates, at any size and however values are repeated."""
    df = spark.range(500).select("id", (F.col("id") % 3).cast("double").alias("x"))
    sets = df.select(F.lit("a").alias("set"), "id", "x").unionByName(df.select(F.lit(None).cast("string").alias("set"), "id", (F.col("x") + 10).alias("x")))
    found = {r["set"]: r for r in intervals.mean_interval(sets.repartition(5), ["id"], "x", by=["set"], resamples=60).collect()}
    alone = intervals.mean_interval(df, ["id"], "x", resamples=60).first()
    for c in ("value", "low", "high"):
        assert found["a"][c] == pytest.approx(alone[c], rel=1e-12)
        assert found[None][c] == pytest.approx(alone[c] + 10, rel=1e-12)


def expanded_quantiles(values, w, prob):
    return [np.quantile(np.repeat(values, c), prob) for c in w.T]


@pytest.mark.parametrize("kind, options, prob", [("plain", {}, 0.9), ("plain", {"ordered": 40, "pivots": 7}, 0.5), ("tied", {"ordered": 1, "pivots": 3}, 0.5), ("outlier", {"ordered": 30, "pivots": 3}, 0.9)])
def test_quantile_interval_is_brute_force(spark, kind, options, prob):
    rng = np.random.default_rng(8)
    values = {"plain": rng.normal(0, 1, 300), "tied": rng.integers(0, 4, 300).astype(float), "outlier": np.append(rng.normal(0, 1, 299), 1e12)}[kind]
    rows = [(s, i, float(v)) for s in ("x", "y") for i, v in enumerate(values)] + [("small", 1, 5.0), ("small", 2, 7.0), ("small", 3, None)]
    df = spark.createDataFrame(rows, "set string, id long, v double").repartition(4)
    w = slow_weights(range(300), 50)
    stats = expanded_quantiles(values, w, prob)
    found = {r["set"]: r for r in intervals.bootstrap_quantile(df, ["id"], "v", prob, ["set"], resamples=50, **options).collect()}
    for s in ("x", "y"):
        np.testing.assert_allclose([found[s]["value"], found[s]["low"], found[s]["high"]], [np.quantile(values, prob), *np.percentile(stats, [2.5, 97.5])], rtol=1e-12)
    assert found["small"]["n"] == 2
    whole = intervals.bootstrap_quantile(df.where("set = 'x'"), ["id"], "v", prob, resamples=50, **options).first()
    assert whole["low"] == pytest.approx(found["x"]["low"])


def test_aggregate_of_the_user_s_own(spark):
    from plumbline.plans.intervals import Evenness

    df = spark.range(200).select("id", F.concat(F.lit("c"), F.col("id") % 5 * (F.col("id") % 2)).alias("category"))
    names = np.array([f"c{i % 5 * (i % 2)}" for i in range(200)])
    w = np.column_stack([np.ones(200, int), slow_weights(range(200), 40)])
    shares = np.array([w[names == c].sum(axis=0) for c in sorted(set(names))]) / w.sum(axis=0)
    stats = -(shares * np.log(shares)).sum(axis=0)
    for parts in (1, 9):
        r = intervals.bootstrap_aggregate(df.repartition(parts), ["id"], Evenness(), resamples=40).first()
        np.testing.assert_allclose([r["value"], r["low"], r["high"]], [stats[0], *np.percentile(stats[1:], [2.5, 97.5])], rtol=1e-12)


def test_undefined_and_single(spark):
    one = spark.createDataFrame([("a", 2.0)], "g string, x double")
    r = intervals.mean_interval(one, ["g"], "x").first()
    assert (r["value"], r["low"], r["high"], r["resamples"]) == (2.0, 2.0, 2.0, 0)
    with pytest.raises(Exception, match="at least two"):
        intervals.rate_interval(one.withColumn("h", F.lit(True)), ["g"], "h").collect()
    mixed = spark.createDataFrame([("a", 1.0, -1.0), ("b", 1.0, 2.0)], "g string, x double, y double")
    r = intervals.paired_ratio_interval(mixed, ["g"], "x", "y", resamples=50).first()
    assert r["value"] == 2.0 and r["low"] is None


def test_verdicts(spark):
    def units(k):
        return spark.range(k).select("id", (F.lit(5.0) + F.col("id") % 2).alias("a"), F.lit(1.0).alias("b"), F.lit(10.0).alias("base"))

    assert intervals.paired_diff_interval(units(9), ["id"], "a", "b", "base", resamples=50).first()["verdict"].startswith("too few")
    assert intervals.paired_diff_interval(units(30), ["id"], "a", "b", "base", resamples=50).first()["verdict"].startswith("higher")
    assert intervals.paired_diff_interval(units(30), ["id"], "b", "a", "base", resamples=50).first()["verdict"].startswith("lower")
    steps = spark.range(60).select((F.col("id") % 20).alias("g"), F.col("id").alias("t"), (100.0 - F.col("id")).alias("loss"))
    assert intervals.relative_change_interval(steps, "g", F.col("t"), "loss", resamples=50).first()["decision"] == "run"


def test_undefined_changes_are_counted(spark):
    rows = [(g, t, v) for g, ends in enumerate([(2.0, 1.0), (4.0, 1.0), (-2.0, -1.0), (0.0, 1.0), (None, 1.0), (1.0, None)]) for t, v in enumerate(ends)]
    steps = spark.createDataFrame(rows, "g long, t long, loss double")
    found = intervals.relative_change_interval(steps, "g", F.col("t"), "loss", resamples=50).collect()
    assert len(found) == 1 and (found[0]["n"], found[0]["undefined"]) == (3, 3)
    assert abs(found[0]["value"] + 1.75 / 3) < 1e-12
    none = intervals.relative_change_interval(steps.where("g >= 3"), "g", F.col("t"), "loss", resamples=50).collect()
    assert [(r["value"], r["decision"], r["undefined"]) for r in none] == [(None, None, 3)]


def slope_at(w, x, y, penalty=1.0):
    """The penalised loss's gradient, by differences."""
    def loss(v):
        z = v[0] + x @ v[1:]
        return sum(math.log1p(math.exp(-abs(t))) + max(t, 0.0) - t * label for t, label in zip(z, y, strict=True)) + penalty / 2 * (v[1:] @ v[1:])

    h = 1e-5
    return np.array([(loss(w + h * e) - loss(w - h * e)) / (2 * h) for e in np.eye(len(w))])


@pytest.mark.parametrize("gap", [0.5, 3.0, 40.0])
def test_fits_end_where_the_loss_is_flat(gap):
    """Also for sides that a line tells apart, where plain steps overshoot."""
    rng = np.random.default_rng(2)
    y = np.arange(80) % 2
    x = rng.normal(size=(80, 2)) + gap * y[:, None]
    fit, passes = detect._Fit(2, 1.0), 0
    while not fit.done and passes < detect.PASSES:
        z = np.column_stack([np.ones(80), x])
        t = z @ fit.at
        p = 0.5 + 0.5 * np.tanh(t / 2)
        fit.take(np.logaddexp(0, t).sum() - y @ t, z.T @ (p - y), (z.T * (p * (1 - p))) @ z, 80)
        passes += 1
    assert passes < 40 and abs(slope_at(fit.base, x, y)).max() < 1e-5


def test_two_samples(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(int)
    rows = [(i, int(y[i]), float(x[i, 0]), float(x[i, 1]), 1.0) for i in range(300)] + [(900, 1, None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "key long, label int, a double, b double, flat double")
    judged = detect.two_sample_rows(df, "key", "label", ["a", "b", "flat"], folds=5, seed=2)
    from plumbline.operators.sampling import stratified_folds

    fold = {r["key"]: r["fold"] for r in stratified_folds(df.where("a is not null"), "label", "key", 5, 2).collect()}
    folds = np.array([fold[i] for i in range(300)])
    expected = {}
    for k in range(5):  # few features, so the least loss is found by walking downhill
        t = folds == k
        m, s = x[~t].mean(axis=0), x[~t].std(axis=0)
        z, w = (x[~t] - m) / s, np.zeros(3)
        for _ in range(4000):
            p = 0.5 + 0.5 * np.tanh((w[0] + z @ w[1:]) / 2)
            w = w - 0.01 * np.append((p - y[~t]).sum(), z.T @ (p - y[~t]) + w[1:])
        expected |= dict(zip(np.flatnonzero(t).tolist(), ((w[0] + ((x[t] - m) / s) @ w[1:] > 0) == (y[t] == 1)).tolist(), strict=True))
    assert {r["key"]: r["correct"] for r in judged.where("model = 'all'").collect()} == expected
    accuracy, alone = detect.two_sample_test(df, "key", "label", ["a", "b", "flat"], folds=5, seed=2, resamples=100)
    assert accuracy.first()["value"] == pytest.approx(np.mean(list(expected.values())))
    assert [r["feature"] for r in alone.collect()][0] == "a"
    with pytest.raises(ValueError):
        detect.two_sample_rows(df.where("label = 0"), "key", "label", ["a"])


def test_same_sets_cannot_be_told_apart(spark):
    df = spark.range(600).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0).alias("a"))
    value = detect.two_sample_test(df, "id", "label", ["a"], folds=5, resamples=100)[0].first()["value"]
    assert abs(value - 0.5) < 0.1


def test_blind_refusals(spark):
    answers = spark.createDataFrame([("j", 1, "A"), ("j", 2, "B")], "judge string, trial int, choice string")
    key = spark.createDataFrame([(1, "A"), (2, "A")], "trial int, side string")
    assert rates.blind_score(answers, key)[0].first()["accuracy"] == 0.5
    for bad_answers, bad_key in ((answers, key.limit(1)), (answers.limit(1), key)):
        with pytest.raises(Exception, match="trial|two answers"):
            rates.blind_score(bad_answers, bad_key)[0].collect()


def test_corpus_rate_is_not_the_mean(spark):
    df = spark.createDataFrame([("x", "a"), ("abcdefghij", "abcdefghij")], "p string, t string")
    r = rates.corpus_error_rate(rates.error_terms(df, "p", "t")).first()
    assert r["cer"] == pytest.approx(1 / 11) and r["mean_rate"] == 0.5


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_large_gallery_passes_the_queries(spark, monkeypatch, metric):
    """A gallery past every bound, queries in several blocks: the rows are those of the broadcast form, and no query is copied."""
    rng = np.random.default_rng(5)
    gallery = spark.createDataFrame([(f"g{i % 2000:04d}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(2000, 8)))], "group string, mean array<double>")
    queries = spark.createDataFrame([(i, f"g{i * 5:04d}" if i % 9 else "nobody", [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(300, 8)), 1))],
                                    "key long, group string, v array<double>")
    near = similarity.score_against(queries, gallery, ["key"], "group", "v", 4, metric)
    monkeypatch.setattr(similarity, "QUERY_BYTES", 8 * 8 * 70)
    monkeypatch.setattr(similarity, "PASSING", 130)
    monkeypatch.setattr(similarity, "GALLERY_BYTES", 8 * 8 * 500)
    far = similarity.score_against(queries.repartition(3), gallery, ["key"], "group", "v", 4, metric)
    a, b = ({r["key"]: r for r in df.collect()} for df in (near, far))
    assert set(a) == set(b) and len(b) == 300
    for x, r in a.items():
        assert [t["g"] for t in r["top"]] == [t["g"] for t in b[x]["top"]] and (r["own"] is None) == (b[x]["own"] is None)
        assert b[x]["total"] == pytest.approx(r["total"]) and b[x]["groups"] == 2000 and (r["own"] is None or b[x]["own"] == pytest.approx(r["own"]))
    assert far._jdf.queryExecution().executedPlan().toString().count("mapInArrow") <= 2
