"""A whole measurement: the gate, counts, figures that fail, a second look, rescoring and comparing."""

import pytest
from pyspark.sql import functions as F

from plumbline import evaluation
from plumbline.session import fresh_path

SAMPLE = ("request long, writer_id string, text string, predicted double, attempt int, reading string, size double, support double, vector array<double>, sharp double, "
          "real_reading string, real_size double, real_support double, real_vector array<double>, real_sharp double")
OPTIONS = {"resamples": 40, "fid_resamples": 5, "fid_minimum": 2}


@pytest.fixture(scope="module")
def tables(spark):
    asked = spark.range(60).select(F.col("id").alias("request"), F.concat(F.lit("w"), F.col("id") % 4).alias("writer_id"), F.concat(F.lit("some words "), "id").alias("text"))
    requests = asked.withColumn("predicted", F.length("text") * 10.0)
    mark = (F.col("request") % 4).cast("double")
    noise = lambda salt: F.pmod(F.xxhash64("request", F.lit(salt)), F.lit(1000)) / 1000.0
    vector = lambda salt: F.array(mark * 4 + noise(salt), F.lit(9.0) - mark + noise(salt + 1), F.lit(3.0) + noise(salt + 2))
    draws = asked.select("request", F.lit(1).alias("attempt"), F.when(F.col("request") != 7, F.concat("text", F.lit("x"))).alias("reading"),
                         (F.length("text") * 9.0).alias("size"), F.lit(None).cast("double").alias("support"), vector(1).alias("vector"), (noise(9) + 2).alias("sharp"))
    truths = asked.select("request", F.col("text").alias("real_reading"), (F.length("text") * 10.0).alias("real_size"), F.lit(12.0).alias("real_support"),
                          vector(5).alias("real_vector"), noise(8).alias("real_sharp"))
    gallery = asked.where("request % 4 < 3").select("writer_id", vector(20).alias("vector"))
    return requests, draws, truths, gallery


@pytest.fixture(scope="module")
def run(spark, tables):
    path = fresh_path(spark, "runs")
    results = evaluation.measure(*tables, path, "one", features=["sharp"], baseline=spark.createDataFrame([("fid_floor", 0.1, "measured"), ("retrieval_real", 0.9, "measured")],
                                 "name string, value double, provenance string"), **OPTIONS)
    return path, {r["name"]: r for r in results.collect()}


def test_gate_before_any_cost(spark):
    metrics = spark.createDataFrame([("d", "pack_records", 50.0), ("d", "cer_real", 0.2)], "dataset string, name string, value double")
    fallback = {"cer_real": 0.5, "fid_floor": 9.0}
    with pytest.raises(evaluation.StaleBaseline, match="cer_real"):
        evaluation.gate(metrics, "d", 51, fallback)
    allowed = {r["name"]: (r["value"], r["provenance"]) for r in evaluation.gate(metrics, "d", 51, fallback, allow_stale=True).collect()}
    assert allowed == {"cer_real": (0.2, "stale"), "fid_floor": (9.0, "fallback")}
    assert {r["provenance"] for r in evaluation.gate(metrics, "d", 50, fallback).collect()} == {"measured", "fallback"}


def test_every_figure_and_count(spark, run):
    path, rows = run
    assert set(rows) == set(evaluation.figures(spark, path, "one"))
    failed = {name for name, r in rows.items() if r["error"]}
    assert not failed
    assert rows["distance_floor"]["value"] is None  # no such set was given
    assert rows["top1"]["value"] == 1.0 and rows["top1"]["verdict"] == "carried" and rows["top1"]["n"] == 45
    assert rows["missing"]["value"] == 0.0 and rows["missing_real"]["value"] == 1.0 and rows["cer"]["n"] == 59
    assert rows["detectable"]["value"] == 1.0 and rows["fid"]["baseline"] == 0.1 and rows["fid"]["verdict"].endswith("x the floor")
    counted = {r["name"]: r["n"] for r in evaluation.counts(spark, path, "one").collect()}
    assert counted == {"requests": 60, "answered": 59, "retrieval_scored": 45, "retrieval_withheld": 14, "writers_not_in_gallery": 1}


def test_a_failing_figure_is_told_and_the_others_carry_on(spark, run):
    path, before = run
    rows = {r["name"]: r for r in evaluation.save_results(spark, path, "one", names=["fid", "cer"], resamples=40, fid_minimum=500).collect()}
    assert "misleads" in rows["fid"]["error"] and rows["fid"]["value"] is None
    assert rows["cer"]["error"] is None and rows["cer"]["low"] == pytest.approx(before["cer"]["low"])


def test_rescore_and_compare(spark, run, tables):
    path, rows = run
    requests, _, truths, gallery = tables
    same = {r["name"]: r for r in evaluation.rescore(spark, path, "one", "again", requests, truths, gallery, SAMPLE, features=["sharp"], names=["cer", "top1", "identity"], **OPTIONS).collect()}
    for name, r in same.items():
        assert (r["value"], r["low"], r["high"], r["n"]) == pytest.approx(tuple(rows[name][c] for c in ("value", "low", "high", "n")))
    worse = lambda df: df.withColumn("reading", F.lit("nothing alike"))
    evaluation.rescore(spark, path, "one", "worse", requests, truths, gallery, SAMPLE, worse, features=["sharp"], names=["cer", "top1"], **OPTIONS)
    verdicts = {r["name"]: r["verdict"] for r in evaluation.compare(spark, path, "one", "worse", ["cer", "top1"], **OPTIONS).collect()}
    assert verdicts == {"cer": "SEPARATE", "top1": "overlap"}
    with pytest.raises(Exception, match="no request has key"):
        evaluation.rescore(spark, path, "one", "strange", requests.where("request < 9"), truths, gallery, SAMPLE, names=["cer"], **OPTIONS)
