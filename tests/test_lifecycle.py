"""End to end with stand-in models: files to pack, requests to figures, saved terms to the same figures."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline import lifecycle
from plumbline.operators import scorers, selection
from plumbline.operators.intervals import compare_runs
from plumbline.operators.sampling import build_requests, consumed_keys
from plumbline.session import fresh_path
from plumbline.sources import packs

NAMES = ["alpha", "beta", "gamma", "delta", "rare", "tent"]


@pytest.fixture(scope="module")
def pack(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("crops")
    for w in range(6):
        for line in range(9):
            for folder, name in [("lines", f"{w:04d}-1-{line}")] + [("words", f"{w:04d}-1-{line}-{i}-{NAMES[(w + line + i) % 6]}") for i in range(4)]:
                if (w, line, name[-5:]) == (5, 8, "-beta"):
                    continue
                os.makedirs(root / "testset" / folder, exist_ok=True)
                (root / "testset" / folder / f"{name}.tif").write_text(f"{w}")
    path = fresh_path(spark, "pack")
    header, report = lifecycle.curate(spark, str(root), path)
    return path, header, report


def test_curate(spark, pack):
    path, header, report = pack
    counts = {r["reason"]: r["n"] for r in report.collect()}
    assert sum(counts.values()) == 54 and counts["kept"] == header.first()["count"] >= 53
    record = packs.pack_get(spark, path, "0002-1-3").first()
    assert record["text"] == "tent alpha beta gamma" and bytes(record["image"]) == b"2"
    with pytest.raises(ValueError):
        lifecycle.curate(spark, "x", "y", unit="pages")


# A lambda is sent to the workers by value; they cannot import this module.
embedder = lambda: lambda groups: [[1.0 if int(g) == i else 0.1 * i for i in range(6)] for g in groups]


def test_run_and_second_look(spark, pack):
    records = packs.pack_read(spark, pack[0]).select("key", "writer_id", "text")
    made = build_requests(records, "writer_id", "key", 1, 8, 7)
    used = consumed_keys(made)
    texts = records.select(F.col("key").alias("target"), "text")
    requests = made.join(texts, "target").select("request", "writer_id", "text", (F.length("text") * 10.0).alias("predicted"))
    # The first draw of every third request repeats itself; one request never yields anything.
    attempts = requests.select("request", "writer_id", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    bad = (F.col("attempt") == 1) & (F.col("request") % 3 == 0)
    reading = F.when(F.col("request") == 5, F.lit(None)).when(bad, F.lit("unlike what was asked for")).otherwise(F.concat(F.col("text"), F.lit("s")))
    draws = scorers.embed_with(attempts, "writer_id", embedder, batch=7).select(
        "request", "attempt", reading.alias("reading"), (F.length("text") * 9.0).alias("size"), F.lit(None).cast("double").alias("support"), "vector"
    )
    truths = requests.select("request", F.col("text").alias("real_reading"), F.col("predicted").alias("real_size"))
    gallery = scorers.embed_with(records.join(used, "key", "left_anti"), "writer_id", embedder).select("writer_id", "vector")
    path = fresh_path(spark, "runs")
    results = {r["name"]: r for r in lifecycle.measure_run(requests, draws, truths, gallery, path, "one", resamples=100).collect()}
    assert results["cer"]["n"] == 7 and results["cer_real"]["value"] == 0 and results["top1"]["value"] == 1.0
    lengths = {r["request"]: len(r["text"]) for r in requests.collect() if r["request"] != 5}
    assert results["cer"]["value"] == pytest.approx(7 / sum(lengths.values()))
    again = {r["name"]: r for r in lifecycle.reexamine(spark, path, "one", resamples=100).collect()}
    for name in results:
        assert (results[name]["value"], results[name]["low"], results[name]["high"]) == pytest.approx((again[name]["value"], again[name]["low"], again[name]["high"]))
    assert lifecycle.width_report(spark, path, "one").first()["median"] == pytest.approx(0.9)
    hand = lifecycle.measure_run(requests, draws, truths, gallery, path, "hand", mode="hand", resamples=100)
    verdicts = {r["name"]: r["verdict"] for r in compare_runs(lifecycle.reexamine(spark, path, "one", resamples=100), hand).collect()}
    assert verdicts["cer"] == "overlap" and len(verdicts) == 4


def test_wrong_number_of_answers_stops(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    with pytest.raises(Exception, match="1 answers for 2"):
        scorers.read_with(df.coalesce(1), "t", lambda: lambda texts: ["x"]).collect()
    with pytest.raises(Exception, match="vectors"):
        scorers.embed_with(df, "t", lambda: lambda texts: [1.0 for _ in texts]).collect()
    kept = scorers.verify_with(df, "t", "t", lambda: lambda a, b: [("w", 1, 11.0) if x == "a" else None for x in a])
    assert {r["t"]: r["omission"] and r["omission"]["support"] for r in kept.collect()} == {"a": 11.0, "b": None}
    made = scorers.generate_with(df, ["t"], lambda: lambda texts: [[1.0, 2.0] if t == "a" else None for t in texts])
    assert {r["t"]: r["output"] for r in made.collect()} == {"a": [1.0, 2.0], "b": None}


def test_records_and_answers_come_in_small_pieces(spark):
    import pandas as pd

    frame = pd.DataFrame({"n": range(2000)})
    given = list(scorers._answered(iter([frame]), lambda ns: [n + 1 for n in ns], ["n"], list, "m", 64))
    assert [len(g) for g in given] == [512, 512, 512, 464] and pd.concat(given)["m"].tolist() == list(range(1, 2001))
    scorers.read_with(spark.range(3), "id", lambda: lambda ids: [str(i) for i in ids])
    assert spark.conf.get(scorers.BATCH_CONF) == scorers.BATCH_BYTES


def test_scored_draws(spark):
    requests = spark.createDataFrame([(1, "about the", 90.0)], "request long, text string, predicted double")
    draws = spark.createDataFrame([(1, 1, "about the the", 45.0), (1, 2, None, None)], "request long, attempt int, reading string, size double")
    rows = {r["attempt"]: r for r in selection.score_draws(draws, requests, "request", "text", "predicted").collect()}
    assert (rows[1]["overrun"], rows[1]["doubled"], rows[1]["width_ratio"]) == (3, "the", 0.5) and rows[1]["score"] == pytest.approx(4 / 9)
    assert rows[2]["score"] is None and rows[2]["overrun"] is None
