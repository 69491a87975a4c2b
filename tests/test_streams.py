"""Streams fed by several files agree with the batch results, also after a restart."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators.breaker import breaker
from plumbline.operators.reasons import Rule
from plumbline.session import fresh_path
from plumbline.sources import runs
from plumbline.streaming import streams


def feed(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def moment(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_manifest_restarts(spark):
    folder, out, mark = (fresh_path(spark, n) for n in ("in", "out", "mark"))
    rules = [Rule("empty", F.col("text") == ""), Rule("long", F.length("text") > 3)]
    schema = "text string"
    def run():
        counts = streams.stream_manifest(streams.file_stream(spark, folder, schema, 1), rules)
        streams.drain(counts, out, "update", mark)
        rows = streams.latest(streams.stored(spark, out, counts.schema), ["reason", "kind"])
        return {r["reason"]: r["n"] for r in rows.collect()}

    feed(spark.createDataFrame([("",), ("abcd",), ("a",)], schema), folder)
    feed(spark.createDataFrame([("b",), ("abcde",)], schema), folder)
    assert run() == {"empty": 1, "long": 2, "kept": 2}
    feed(spark.createDataFrame([("c",)], schema), folder)
    assert run() == {"empty": 1, "long": 2, "kept": 3}
    assert run() == {"empty": 1, "long": 2, "kept": 3}


def test_metric_windows_and_late_rows(spark):
    folder, out = fresh_path(spark, "log"), fresh_path(spark, "out")
    def add(rows):
        logged = spark.createDataFrame([(s, moment(m), n, v) for s, m, n, v in rows], "step long, ts timestamp, name string, v double")
        runs.run_log_append(runs.log_rows(logged, F.col("step"), F.col("ts"), F.col("name"), F.col("v")).coalesce(1), folder)

    add([(1, 0, "loss", 4.0), (3, 5, "loss", 2.0), (2, 6, "loss", 3.0), (2, 6, "acc", 0.5)])
    add([(9, 200, "loss", 1.0)])
    add([(9, 202, "acc", 1.0)])
    add([(4, 7, "loss", 99.0), (10, 201, "loss", 0.5)])
    windows = streams.stream_metrics(streams.log_stream(spark, folder, 1), "10 minutes", "30 minutes")
    streams.drain(windows, out, "append")
    closed = {(r["metric"], r["start"]): (r["n"], r["mean"], r["latest"]) for r in streams.stored(spark, out, windows.schema).collect()}
    # The row of minute 7 came two batches after minute 200, so it was dropped; the last windows are still open.
    assert {k[0]: v for k, v in closed.items()} == {"loss": (3, 3.0, 2.0), "acc": (1, 0.5, 0.5)}


DRAW = "request int, attempt int, score double, overrun int, support double, width_ratio double, doubled string, ts timestamp"


def draw(request, attempt, score, minute):
    return (request, attempt, score, 0, None, None, None, moment(minute))


def test_first_acceptable(spark):
    folder, out = fresh_path(spark, "draws"), fresh_path(spark, "out")
    feed(spark.createDataFrame([draw(1, 1, 0.9, 0), draw(1, 2, 0.3, 1), draw(2, 1, 0.9, 0), draw(3, 1, None, 0)], DRAW), folder)
    feed(spark.createDataFrame([draw(1, 3, 0.1, 2), draw(2, 2, 0.7, 2), draw(2, 3, 0.8, 3)], DRAW), folder)
    feed(spark.createDataFrame([draw(4, 1, 0.2, 90)], DRAW), folder)
    feed(spark.createDataFrame([draw(5, 1, 0.2, 200)], DRAW), folder)
    settled = streams.stream_first_ok(streams.file_stream(spark, folder, DRAW, 1), "request", "ts", "1 minute", "10 minutes")
    streams.drain(settled, out, "append")
    rows = {r["request"]: (r["attempt"], r["ok"]) for r in streams.stored(spark, out, settled.schema).collect()}
    assert rows == {1: (2, True), 2: (2, False), 4: (1, True), 5: (1, True)}
    assert streams.stored(spark, out, settled.schema).count() == 4
    running = streams.collect_updates(streams.stream_choose(streams.file_stream(spark, folder, DRAW, 1), "request"), ["request"])
    assert {r["request"]: (r["attempt"], r["ok"]) for r in running.collect()} == rows


def test_requests_of_one_bucket_settle_apart(spark):
    folder = fresh_path(spark, "draws")
    rows = [draw(r, a, 0.9 if a < 3 or r % 3 else 0.3, r) for r in range(40) for a in (2, 1, 3)]
    feed(spark.createDataFrame([r for r in rows if r[1] == 2], DRAW), folder)
    feed(spark.createDataFrame([r for r in rows if r[1] != 2], DRAW), folder)
    feed(spark.createDataFrame([draw(0, 4, 0.1, 45), draw(1, 4, 0.1, 45)], DRAW), folder)
    feed(spark.createDataFrame([draw(100, 1, 0.1, 500)], DRAW), folder)
    found = {}
    for buckets in (1, 3, 1024):
        out = fresh_path(spark, "out")
        settled = streams.stream_first_ok(streams.file_stream(spark, folder, DRAW, 1), "request", "ts", "60 minutes", buckets=buckets)
        streams.drain(settled, out, "append")
        found[buckets] = sorted(map(tuple, streams.stored(spark, out, settled.schema).drop("epoch").collect()))
    assert found[1] == found[3] == found[1024]
    expected = {(r, 3, 0.3, True) if r % 3 == 0 else (r, 1, 0.9, False) for r in range(2, 40)} | {(0, 3, 0.3, True), (1, 4, 0.1, True), (100, 1, 0.1, True)}
    assert found[1] == sorted(expected)


def test_open_requests_come_out_when_the_input_ends(spark):
    folder, out = fresh_path(spark, "draws"), fresh_path(spark, "out")
    feed(spark.createDataFrame([draw(1, 1, 0.9, 0), draw(1, 2, 0.3, 1), draw(2, 1, 0.9, 0), draw(3, 1, None, 0), draw(None, 1, 0.2, 0)], DRAW), folder)
    feed(spark.createDataFrame([draw(4, 1, 0.9, 90), draw(4, 2, 0.7, 91), draw(4, 3, 0.8, 91), draw(5, 1, 0.2, 91)], DRAW), folder)
    settled = streams.stream_first_ok(streams.file_stream(spark, folder, DRAW, 1), "request", "ts", "1 minute", "10 minutes")
    streams.drain(settled, out, "append")
    given = streams.stored(spark, out, settled.schema).drop("epoch")
    rows = [tuple(r) for r in streams.complete_first_ok(given, spark.read.schema(DRAW).parquet(folder), "request").collect()]
    assert (4, 2, 0.7, False) not in {tuple(r) for r in given.collect()}
    assert sorted(rows, key=lambda r: r[0] or 0) == [(None, 1, 0.2, True), (1, 2, 0.3, True), (2, 1, 0.9, False), (4, 2, 0.7, False), (5, 1, 0.2, True)]


def test_registered_stream_gives_every_request(read):
    from plumbline.plans import selecting
    from plumbline.plans import streams as plans

    made = selecting.draws(read).where("score is not null").select("request").distinct().count()
    found = plans.stream_first_ok_settled(read)
    assert found.count() == found.select("request").distinct().count() == made


def test_breaker_agrees_with_batch(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(q), bool(rng.random() < 0.6)) for q in range(30) for k in range(12)]
    folder = fresh_path(spark, "events")
    for part in range(3):
        feed(spark.createDataFrame([r for r in rows if r[1] // 10 == part], "k int, q long, ok boolean"), folder)
    df = spark.createDataFrame(rows, "k int, q long, ok boolean")
    stream = streams.stream_breaker(streams.file_stream(spark, folder, df.schema, 1), "k", "q", "ok")
    got = streams.collect_updates(stream, ["k"])
    order = ["k", "dead", "dead_at", "failures"]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, breaker(df, "k", "q", "ok", 4).select(order).collect()))
