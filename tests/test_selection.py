"""Selection rules, pairing, checks and marks, one scenario each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks, joins, marks, selection, tiles, tone
from plumbline.operators.breaker import breaker

SCHEMA = "request int, attempt int, score double, overrun int, support double, width_ratio double, doubled string, similarity double"


def draws(spark, *rows):
    """Per draw: request, attempt, score, and any of the other fields by name."""
    names = ["overrun", "support", "width_ratio", "doubled", "similarity"]
    base = {"overrun": 0, "support": None, "width_ratio": None, "doubled": None, "similarity": 0.0}
    return spark.createDataFrame([(r[0], r[1], r[2], *[{**base, **(r[3] if len(r) > 3 else {})}[n] for n in names]) for r in rows], SCHEMA)


def used_of(df, mode="readable"):
    return [r["attempt"] for r in selection.draws_used(df, "request", mode).orderBy("attempt").collect()]


def test_stops_at_the_first_acceptable(spark):
    df = draws(spark, (1, 1, 0.9), (1, 2, 0.1), (1, 3, 0.0), (1, 4, 0.0), (1, 5, 0.0))
    assert used_of(df) == [1, 2] and used_of(df, "hand") == [1, 2, 3, 4]


def test_extra_draws_only_without_an_acceptable_one(spark):
    df = draws(spark, *[(1, a, 0.9) for a in range(1, 6)], (1, 6, 0.2), (1, 7, 0.1), (1, 8, 0.1), (1, 9, 0.1))
    assert used_of(df) == [1, 2, 3, 4, 5, 6] and used_of(df, "hand") == [1, 2, 3, 4, 5, 6]
    assert used_of(draws(spark, *[(1, a, 0.9) for a in range(1, 12)])) == list(range(1, 9))


@pytest.mark.parametrize("fault,ok", [
    ({"overrun": 2}, True), ({"overrun": 3}, False), ({"support": 10.0}, True), ({"support": 10.1}, False), ({"width_ratio": 0.7}, True),
    ({"width_ratio": 1.4}, False), ({"width_ratio": 0.69}, False), ({"doubled": "the"}, False), ({}, True),
])
def test_gates(spark, fault, ok):
    assert draws(spark, (1, 1, 0.5, fault)).select(selection.acceptable().alias("ok")).first()["ok"] is ok


def chosen(df, mode="readable"):
    used = selection.draws_used(df, "request", mode)
    if mode == "readable":
        return selection.choose_readable(used, "request").first()["attempt"]
    r = selection.choose_closest(used, "request", "similarity").first()
    return r["attempt"], r["moved"]


def test_least_bad(spark):
    assert chosen(draws(spark, (1, 1, 0.3, {"support": 20.0}), (1, 2, 0.4, {"overrun": 9}), (1, 3, 0.6))) == 2
    assert chosen(draws(spark, (1, 1, 0.8), (1, 2, 0.6), (1, 3, 0.6))) == 2
    assert chosen(draws(spark, (1, 1, 0.1, {"doubled": "a"}), (1, 2, 0.4, {"overrun": 5}))) == 2
    assert chosen(draws(spark, (1, 1, None), (1, 2, 0.9))) == 2


def test_closest(spark):
    df = draws(spark, (1, 1, 0.1, {"similarity": 0.2}), (1, 2, 0.2, {"similarity": 0.9}), (1, 3, 0.9, {"similarity": 1.0}), (1, 4, 0.3, {"similarity": 0.9}))
    assert chosen(df, "hand") == (2, True)
    assert chosen(draws(spark, (1, 1, 0.1, {"similarity": 0.5}), (1, 2, 0.9, {"similarity": 0.9})), "hand") == (1, False)


def test_log(spark):
    df = draws(spark, (1, 1, 0.1), (2, 1, 0.3, {"overrun": 5, "support": 12.0}), (2, 2, 0.2), (3, 1, 0.9), (4, 1, None))
    log = selection.selection_log(selection.draws_used(df, "request"), "request").first()
    assert (log["requests"], log["draws"], log["first_draw_accepted"], log["none_accepted"], log["no_output"]) == (4, 5, 3, 1, 1)
    assert (log["rejected_for_overrun"], log["rejected_for_omission"], log["rejected_for_width"], log["rejected_for_doubling"]) == (1, 1, 0, 0)
    assert selection.no_output(df.select("request").distinct(), df, "request").collect()[0][0] == 4


def test_closest_needs_a_similarity(spark):
    df = draws(spark, (1, 1, 0.1, {"similarity": None}), (1, 2, 0.1, {"similarity": 0.9}), (2, 1, 0.2, {"similarity": None}), (2, 2, 0.1, {"similarity": None}))
    used = selection.draws_used(df, "request", "hand")
    picked = {r["request"]: r["attempt"] for r in selection.choose_closest(used, "request", "similarity").collect()}
    assert picked == {1: 2, 2: 1}


def test_style_order_ranks_all(spark):
    refs = spark.range(12).selectExpr("1 AS request", "id AS ord", "double(id) AS size")
    assert selection.style_order(refs, ["request"], "ord", "size").count() == 12
    assert selection.style_order(refs, ["request"], "ord", "size", keep=3).count() == 3


def test_style_order(spark):
    refs = spark.createDataFrame([(1, 0, 300.0, "zz"), (1, 1, 1090.0, "abc"), (1, 2, 810.0, "xy"), (1, 3, 1200.0, "abc"), (1, 4, 790.0, "a")],
                                 "request int, ord int, size double, text string").withColumn("target", F.lit("abc"))
    def ranks(**kw):
        return [r["ord"] for r in selection.style_order(refs, ["request"], "ord", "size", **kw).orderBy("rank").collect()]

    assert ranks() == [2, 4, 1, 3, 0]
    assert ranks(text="text", target="target", by="letters") == [1, 4, 2, 3, 0]
    assert ranks(by="letters") == [2, 4, 1, 3, 0]
    with pytest.raises(ValueError):
        ranks(by="colour")
    cycle = selection.style_cycle(spark.range(1, 8).select(F.lit(1).alias("request"), F.col("id").alias("attempt")),
                                  selection.style_order(refs, ["request"], "ord", "size").select("request", "rank", "ord"), "request")
    assert [r["ord"] for r in cycle.orderBy("attempt").collect()] == [2, 4, 1, 3, 0, 2, 4]


def test_predicted_size(spark):
    refs = spark.createDataFrame([("a", 100.0, "xxxxx"), ("a", 60.0, "xx"), ("a", 9.0, ""), ("b", 5.0, "")], "g string, size double, text string")
    targets = spark.createDataFrame([("a", "four"), ("a", "  "), ("b", "x")], "g string, target string")
    got = [r["predicted"] for r in selection.predicted_size(refs, ["g"], "size", "text", targets, "target").orderBy("g", F.desc("target")).collect()]
    assert got == [100.0, None, None]


def test_pairing(spark):
    a, b = spark.range(5).withColumn("x", F.lit(1)), spark.range(1, 5).withColumn("y", F.lit(2))
    assert [tuple(r) for r in joins.pairing_faults(a, b, ["id"]).collect()] == [(0, "left")]
    with pytest.raises(Exception, match="no partner for 0"):
        joins.strict_pair(a, b, ["id"]).collect()
    assert joins.strict_pair(a.where("id > 0"), b, ["id"]).count() == 4
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, text string")
    for key, told in ((9, "no request"), (2, "several")):
        with pytest.raises(Exception, match=told):
            joins.rebind_run(spark.createDataFrame([(key, 0)], "id long, ord int"), requests, "id").collect()
    assert joins.rebind_run(spark.createDataFrame([(1, 0)], "id long, ord int"), requests, "id").first()["text"] == "a"
    with pytest.raises(ValueError):
        joins.min_records(a, ["id"], 2)


def test_outputs(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 1.0]), (3, []), (4, None), (5, [1.0])], "key int, v array<double>")
    assert {r["key"]: r["fault"] for r in checks.output_checks(rows, "key", "v", 2).collect()} == {
        2: "flat", 3: "empty", 4: "no output for the request", 5: "wrong width",
    }
    with pytest.raises(Exception, match="request"):
        checks.require_sound(rows, "key", "v").collect()
    assert checks.require_sound(rows.where("key = 1"), "key", "v").count() == 1


def test_readiness(spark):
    expected = spark.createDataFrame([("words", 5, True), ("lines", 5, True), ("split", 2, True), ("extra", 1, False)], "label string, expected long, required boolean")
    needs = spark.createDataFrame([("train", "either"), ("divide", "split"), ("all", "lines"), ("all", "extra")], "capability string, label string")
    def state(**found):
        seen = spark.createDataFrame(list(found.items()), "label string, found long")
        ready, able = checks.readiness(seen, expected, ("words", "lines"), needs)
        return {r["label"]: (r["status"], r["blocking"]) for r in ready.collect()}, {r["capability"]: (r["ready"], r["blockers"]) for r in able.collect()}

    ready, able = state(lines=5, split=1)
    assert ready == {"words": ("miss", False), "lines": ("ok", False), "split": ("partial", True), "extra": ("miss", False)}
    assert able == {"train": (True, ""), "divide": (False, "split"), "all": (False, "extra")}
    ready, able = state(split=2)
    assert ready["words"] == ("miss", True) and not able["train"][0]


def test_nearest_in_stretches(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), int(rng.integers(0, 4000)), bool(rng.random() < 0.2)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g int, at long, anchor boolean")
    anchors = [(i, g, t) for i, g, t, a in rows if a]
    expected = {}
    for i, g, t, a in rows:
        if not a:
            near = min(((abs(u - t), j) for j, h, u in anchors if h == g), default=None)
            expected[i] = (near[1], near[0]) if near and near[0] <= 25 else (None, None)
    for width in (25, 7, 500):
        got = marks.attach_nearest(df.where("not anchor").select("g", "id", "at"), df.where("anchor").select("g", "id", "at"), ["g"], "id", "at", 25, width)
        assert {r["id"]: (r["anchor"], r["gap"]) for r in got.collect()} == expected


def test_nearest_boxes(spark):
    rng = np.random.default_rng(8)
    p = rng.uniform(0, 100, size=(300, 2))
    rows = [(i, 0, float(x), float(y), float(x + rng.uniform(0, 4)), float(y + rng.uniform(0, 4)), bool(rng.random() < 0.3)) for i, (x, y) in enumerate(p)]
    df = spark.createDataFrame(rows, "id long, g int, x0 double, y0 double, x1 double, y1 double, anchor boolean")
    anchors = [r for r in rows if r[-1]]
    for options in ({}, {"cell": 5.0}, {"block": 20, "tile": 9}):
        got = marks.attach_nearest_boxes(df.where("not anchor"), df.where("anchor"), ["g"], "id", 5.0, **options)
        found = {r["id"]: (r["anchor"], r["gap"]) for r in got.collect()}
        for i, _, x0, y0, x1, y1, a in rows:
            if a:
                continue
            gap, j = min((float(np.hypot(max(0, b[2] - x1, x0 - b[4]), max(0, b[3] - y1, y0 - b[5]))), b[0]) for b in anchors)
            if gap <= 5.0:
                assert found[i][0] == j and found[i][1] == pytest.approx(gap)
            else:
                assert found[i] == (None, None)


def test_crowded_boxes_leave_at_the_first_they_touch(spark, monkeypatch):
    monkeypatch.setattr(marks, "CHUNK", 7)
    rng = np.random.default_rng(5)
    spots = [*rng.uniform(0, 3, size=(150, 2)), *rng.uniform(0, 90, size=(60, 2))]
    rows = [(int(k), 0, float(x), float(y), float(x + 1), float(y + 1), bool(a)) for k, (x, y), a in zip(rng.permutation(210), spots, rng.random(210) < 0.5)]
    df = spark.createDataFrame(rows, "id long, g int, x0 double, y0 double, x1 double, y1 double, anchor boolean")

    def gap(p, b):
        return float(np.sqrt(max(0, b[2] - p[4], p[2] - b[4]) ** 2 + max(0, b[3] - p[5], p[3] - b[5]) ** 2))

    expected = {p[0]: min((gap(p, b), b[0]) for b in rows if b[-1]) for p in rows if not p[-1]}
    looked = []
    clear = marks._clear
    kernels = []
    monkeypatch.setattr(marks, "tiled_cogroup", lambda l, r, by, lk, rk, kernel, *rest: kernels.append(kernel) or tiles.tiled_cogroup(l, r, by, lk, rk, kernel, *rest))
    got = {r["id"]: (r["gap"], r["anchor"]) for r in marks.attach_nearest_boxes(df.where("not anchor"), df.where("anchor"), ["g"], "id", 4.0).collect()}
    assert got == {k: v if v[0] <= 4.0 else (None, None) for k, v in expected.items()}
    near = df.toPandas().query("x0 < 3 and y0 < 3").assign(__cx=0, __cy=0)
    monkeypatch.setattr(marks, "_clear", lambda *a: (looked.append(np.broadcast(a[0], a[2]).size), clear(*a))[1])
    kernels[0](near[~near.anchor], near[near.anchor])
    assert 0 < sum(looked) / 2 < 0.7 * (~near.anchor).sum() * near.anchor.sum()


def test_peaks(spark):
    centres = [30, 60, 95]
    bins = spark.createDataFrame([("a", c + o, 50.0 / (1 + abs(o))) for c in centres for o in range(-4, 5)] + [("a", 78, 0.5)], "s string, b int, x double")
    found = marks.bin_peaks(bins, ["s"], "b", "x", 120, 8.0)
    assert sorted(r["centre"] for r in found.collect()) == centres
    pitch = marks.median_pitch(found, ["s"], 8.0)
    assert pitch.first()["pitch"] == 32.5 and pitch.first()["lines"] == 3
    assert marks.median_pitch(found.where("centre = 30"), ["s"], 8.0).first()["pitch"] == 24.0
    strays = marks.stray_bins(spark.createDataFrame([("a", 31), ("a", 119), ("a", 2)], "s string, b int"), found, pitch.select("s", "pitch"), ["s"], "b")
    assert {r["b"]: (r["centre"], r["stray"]) for r in strays.collect()} == {31: (30, False), 119: (95, False), 2: (30, True)}


def test_tone(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.uniform(0, 90, 300).round(2), "b": np.full(50, 7.0), "goal": rng.normal(120, 20, 400).round(2)}
    df = spark.createDataFrame([(g, i, float(v)) for g, vs in values.items() for i, v in enumerate(vs)], "g string, i int, v double")
    stretched = {(r["g"], r["i"]): r["stretched"] for r in tone.contrast_stretch(df, "g", "v").collect()}
    dark, light = np.percentile(values["a"], [2, 85])
    assert [stretched[("a", i)] for i in range(300)] == list(np.floor(np.clip((values["a"] - dark) / (light - dark) * 255, 0, 255)))
    assert stretched[("b", 0)] == 7.0
    goal = np.quantile(values["goal"], np.linspace(0, 1, 21))
    matched = {(r["g"], r["i"]): r["matched"] for r in tone.quantile_match(df, "g", "v", tone.tone_curve(df.where("g = 'goal'"), "g", "v")).collect()}
    for g in ("a", "b"):
        x = np.maximum.accumulate(np.quantile(values[g], np.linspace(0, 1, 21))) + np.arange(21) * 1e-6
        expected = np.interp(values[g], np.concatenate([[0.0], x]), np.concatenate([[0.0], goal]), right=goal[-1])
        np.testing.assert_allclose([matched[(g, i)] for i in range(len(values[g]))], expected, atol=1e-6)


def followed(outcomes):
    run = 0
    for q, ok in outcomes:
        run = 0 if ok else run + 1
        if run == 3:
            return True, q, 3
    return False, None, run


@pytest.mark.parametrize("width", [None, 1, 3, 10])
def test_breaker(spark, width):
    rng = np.random.default_rng(7)
    rows = [(k, q, bool(rng.random() < 0.6)) for k in range(60) for q in range(int(rng.integers(1, 25)))]
    got = breaker(spark.createDataFrame(rows, "k int, q long, ok boolean"), "k", "q", "ok", width)
    expected = {k: followed([(q, ok) for j, q, ok in rows if j == k]) for k in range(60)}
    assert {r["k"]: (r["dead"], r["dead_at"], r["failures"]) for r in got.collect()} == expected
