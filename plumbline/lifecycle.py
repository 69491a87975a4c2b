"""The three ways in: curate files into a pack, measure a run, look at a run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.hashing import record_id
from plumbline.functions.text import alphabet
from plumbline.functions.vectors import vector_mean
from plumbline.operators import intervals, rates, selection, similarity
from plumbline.operators.joins import strict_pair
from plumbline.operators.reasons import drop_report, kept
from plumbline.sources import files, packs, runs

UNITS = ("lines", "words")
TERMS = (
    "request bigint, writer_id string, errors bigint, real_errors bigint, length bigint, hit1 boolean, hitk boolean, "
    "real_size double, size double, run string"
)
RESULT = "name string, value double, low double, high double, n bigint"


def curate(
    spark: SparkSession, root: str, path: str, unit: str = "lines", charset: str = "english", height: int = 64, limit: int | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """(pack header, report of everything seen): crops below ``root`` with a sound text, packed at ``path``."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
    listed = files.list_files(spark, root)
    scan = files.scan_groups if unit == "lines" else files.scan_parts
    scanned = scan(listed, alphabet(charset), **options)
    places = ["line_index"] if unit == "lines" else ["line_index", "word_index"]
    key = record_id("writer_id", "text_id", *places)
    rows = kept(scanned).select(key.alias("key"), "writer_id", "text", "split", "path")
    if limit is not None:
        rows = files.limit_records(rows, ["key"], limit)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("content").alias("image"))
    whole = rows.join(content, "path").withColumn("ord", F.lit(None).cast("bigint"))
    header = packs.pack_write(whole, path, height, charset, root, {"unit": unit})
    return header, drop_report(scanned)


def measure_run(
    requests: DataFrame, draws: DataFrame, truths: DataFrame, gallery: DataFrame, path: str, run: str,
    mode: str = "readable", k: int = 5, seed=fixed.SEED, resamples: int = fixed.RESAMPLES,
) -> DataFrame:
    """(name, value, low, high, n) of a run; its samples, draws and terms are saved under ``path`` first.

    ``requests`` (request, writer_id, text, predicted); ``draws`` (request, attempt,
    reading, size, support, vector); ``truths`` (request, real_reading, real_size);
    ``gallery`` (writer_id, vector), without any target of the run. A request without
    output leaves together with its truth.
    """
    spark = requests.sparkSession
    scored = selection.score_draws(draws, requests, "request", "text", "predicted")
    used = selection.draws_used(scored, "request", mode)
    if mode == "readable":
        chosen = selection.choose_readable(used, "request")
    else:
        pages = similarity.page_vectors(gallery, ["writer_id"], "vector")
        near = used.join(requests.select("request", "writer_id"), "request").join(pages, "writer_id", "left")
        from plumbline.functions.vectors import cosine

        chosen = selection.choose_closest(near.withColumn("similarity", cosine(F.col("vector"), F.col("page"))).drop("page", "writer_id"), "request", "similarity")
    answered = requests.join(chosen.select("request"), "request", "left_semi")
    there = truths.join(answered.select("request"), "request", "left_semi")
    samples = strict_pair(strict_pair(answered, chosen.select("request", "reading", "size", "vector"), ["request"]), there, ["request"])
    runs.run_bundle_write(path, run, per_sample=samples, draws=used)

    stored = runs.run_bundle_read(spark, path, "per_sample", samples.schema.add("run", "string"), run)
    means = vector_mean(gallery, ["writer_id"], "vector")
    galleried = stored.join(means.select("writer_id"), "writer_id", "left_semi")
    hits = similarity.retrieval_hits(
        similarity.score_against(galleried, means, ["request"], "writer_id", "vector", k), ["request"], "writer_id", k
    ).select("request", "hit1", "hitk")
    terms = stored.select(
        "request", "writer_id", F.levenshtein("reading", "text").cast("bigint").alias("errors"),
        F.levenshtein("real_reading", "text").cast("bigint").alias("real_errors"), F.length("text").cast("bigint").alias("length"),
        F.col("real_size").cast("double").alias("real_size"), F.col("size").cast("double").alias("size"),
    ).join(hits, "request", "left")
    runs.run_bundle_write(path, run, terms=terms.select(*[c.split()[0] for c in TERMS.split(", ")[:-1]]))
    results = reexamine(spark, path, run, seed, resamples)
    runs.run_bundle_write(path, run, results=results)
    return runs.run_bundle_read(spark, path, "results", RESULT + ", run string", run).drop("run")


def reexamine(spark: SparkSession, path: str, run: str, seed=fixed.SEED, resamples: int = fixed.RESAMPLES) -> DataFrame:
    """A saved run's figures recomputed from its terms: (name, value, low, high, n)."""
    terms = runs.run_bundle_read(spark, path, "terms", TERMS, run)
    options = {"seed": seed, "resamples": resamples}
    scored = terms.where("hit1 is not null")
    figures = {
        "cer": intervals.ratio_interval(terms, ["request"], "errors", "length", **options),
        "cer_real": intervals.ratio_interval(terms, ["request"], "real_errors", "length", **options),
        "top1": intervals.rate_interval(scored, ["request"], "hit1", **options),
        "topk": intervals.rate_interval(scored, ["request"], "hitk", **options),
    }
    rows = [f.select(F.lit(name).alias("name"), "value", "low", "high", "n") for name, f in figures.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def width_report(spark: SparkSession, path: str, run: str) -> DataFrame:
    """A saved run's sizes against the real ones."""
    terms = runs.run_bundle_read(spark, path, "terms", TERMS, run)
    return rates.width_report(terms, F.col("real_size"), F.col("size"))
