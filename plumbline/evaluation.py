"""A whole measurement of a run, and looking at it again.

Every figure comes with an interval, its baseline and where that is from. What a run could not answer or be scored on is counted. The
terms of all figures are saved before any is worked out, so a second look, a comparison of two runs or a figure that
failed the first time needs nothing made anew. A figure that fails is reported in its row, and the others carry on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.vectors import cosine, vector_mean
from plumbline.operators import baselines, detect, intervals, moments, selection, similarity
from plumbline.operators.joins import exclusion_counts, rebind_run, strict_pair
from plumbline.session import settle
from plumbline.sources import runs

TERMS = (
    "request bigint, writer_id string, errors bigint, real_errors bigint, length bigint, hit1 boolean, hitk boolean, groups bigint, "
    "real_size double, size double, support double, real_support double"
)
VECTORS = "request bigint, writer_id string, side string, vector array<double>"
DISTANCES = "set string, writer_id string, own double, wrong double, gap double, nearest_is_right boolean, candidates bigint"
FEATURES = "key string, generated int, features map<string,double>"
COUNTS = "name string, n bigint"
RESULT = "name string, value double, low double, high double, n bigint, baseline double, provenance string, verdict string, error string"
#: The baseline that a figure is held against.
AGAINST = {"fid": "fid_floor", "top1": "retrieval_real", "cer": "cer_real", "cer_real": "cer_real"}


class StaleBaseline(ValueError):
    """The baseline was measured on other records than there are now."""


def gate(metrics: DataFrame, dataset: str, records: int, fallback: dict[str, float], allow_stale: bool = False) -> DataFrame:
    """(name, value, provenance) of a dataset's baseline, before anything is made; a stale one stops the run unless allowed."""
    one = metrics.sparkSession.createDataFrame([(dataset, records)], "dataset string, records bigint")
    found = settle(baselines.baseline_lookup(one, metrics, fallback).select("name", "value", "provenance"))
    stale = [r["name"] for r in found.where("provenance = 'stale'").orderBy("name").collect()]
    if stale and not allow_stale:
        raise StaleBaseline(f"{dataset} has {records} records, but {', '.join(stale)} were measured on another number; measure them again or allow it")
    return found


def choose(requests: DataFrame, draws: DataFrame, gallery: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(chosen draws, draws used): the first acceptable or most readable draw of each request, or with mode ``hand`` the one closest to its writer's page."""
    scored = selection.score_draws(draws, requests, "request", "text", "predicted")
    used = selection.draws_used(scored, "request", mode)
    if mode == "readable":
        return selection.choose_readable(used, "request"), used
    pages = similarity.page_vectors(gallery, ["writer_id"], "vector")
    near = used.join(requests.select("request", "writer_id"), "request").join(pages, "writer_id", "left")
    likeness = near.withColumn("similarity", cosine(F.col("vector"), F.col("page"))).drop("page", "writer_id")
    return selection.choose_closest(likeness, "request", "similarity"), used


def measure(
    requests: DataFrame, draws: DataFrame, truths: DataFrame, gallery: DataFrame, path: str, run: str, baseline: DataFrame | None = None,
    floor: DataFrame | None = None, features: list[str] | None = None, mode: str = "readable", k: int = 5, minimum: int = 1,
    names: list[str] | None = None, **options,
) -> DataFrame:
    """RESULT rows of a run; its samples, chosen draws, terms and counts are saved under ``path`` first.

    ``requests`` (request, writer_id, text, predicted); ``draws`` (request, attempt, reading, size, support, vector and the
    ``features``); ``truths`` (request, real_reading, real_size, real_support, real_vector and the features as real_<name>);
    ``gallery`` (writer_id, vector), without any target of the run; ``floor`` (writer_id, vector) lines that carry no hand. Writers with fewer
    than ``minimum`` gallery rows are not in the gallery, and requests of theirs are withheld from retrieval and counted.
    ``names`` works out some figures only; ``options``: seed, resamples, fid_resamples, fid_minimum.
    """
    spark, features = requests.sparkSession, features or []
    chosen, used = choose(requests, draws, gallery, mode)
    extra = [*features]
    made = chosen.select("request", "attempt", "reading", "size", "support", "vector", *extra)
    answered = requests.join(made.select("request"), "request", "left_semi")
    there = truths.join(answered.select("request"), "request", "left_semi")
    samples = strict_pair(strict_pair(answered, made, ["request"]), there, ["request"])
    runs.run_bundle_write(path, run, per_sample=samples, draws=used)
    stored = runs.run_bundle_read(spark, path, "per_sample", samples.schema.add("run", "string"), run).drop("run")

    counted = gallery.groupBy("writer_id").agg(F.count(F.lit(1)).alias("n"))
    enough = counted.where(F.col("n") >= minimum).select("writer_id")
    means = settle(vector_mean(gallery.join(enough, "writer_id", "left_semi"), ["writer_id"], "vector"))
    save_terms(stored, means, floor, features, path, run, k)
    asked = requests.agg(F.count(F.lit(1)).alias("n"))
    known = exclusion_counts(stored, means, ["writer_id"])
    thin = requests.select("writer_id").distinct().join(means, "writer_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    rows = [asked.select(F.lit("requests").alias("name"), "n"), stored.agg(F.count(F.lit(1)).alias("n")).select(F.lit("answered").alias("name"), "n"),
            known.select(F.lit("retrieval_scored").alias("name"), F.col("excluded").alias("n")), known.select(F.lit("retrieval_withheld").alias("name"), F.col("kept").alias("n")),
            thin.select(F.lit("writers_not_in_gallery").alias("name"), "n")]
    table = rows[0]
    for more in rows[1:]:
        table = table.unionByName(more)
    runs.run_bundle_write(path, run, counts=table)
    return save_results(spark, path, run, baseline, names, **options)


def save_terms(samples: DataFrame, means: DataFrame, floor: DataFrame | None, features: list[str], path: str, run: str, k: int) -> None:
    """What every figure is worked out from: per-request terms, vectors of both sides, distances per writer, features of both sides."""
    galleried = samples.join(means.select("writer_id"), "writer_id", "left_semi")
    hits = similarity.retrieval_hits(similarity.score_against(galleried, means, ["request"], "writer_id", "vector", k), ["request"], "writer_id", k)
    terms = samples.select(
        "request", "writer_id", F.levenshtein("reading", "text").cast("bigint").alias("errors"), F.levenshtein("real_reading", "text").cast("bigint").alias("real_errors"),
        F.length("text").cast("bigint").alias("length"), *[F.col(c).cast("double").alias(c) for c in ("real_size", "size", "support", "real_support")],
    ).join(hits.select("request", "hit1", "hitk", F.col("groups").cast("bigint").alias("groups")), "request", "left")
    both = samples.select("request", "writer_id", F.explode(F.array(
        F.struct(F.lit("generated").alias("side"), F.col("vector").cast("array<double>").alias("vector")),
        F.struct(F.lit("real").alias("side"), F.col("real_vector").cast("array<double>").alias("vector")))).alias("s")).select("request", "writer_id", "s.side", "s.vector")
    sets = both.select(F.col("side").alias("set"), "writer_id", "vector")
    if floor is not None:
        sets = sets.unionByName(floor.select(F.lit("floor").alias("set"), "writer_id", F.col("vector").cast("array<double>").alias("vector")))
    sets = sets.join(means.select("writer_id"), "writer_id", "left_semi")
    distances = similarity.group_distance(sets, means.select("writer_id", F.col("mean").alias("vector")), ["set"], "writer_id", "vector")
    pairs = [(g, F.create_map(*[x for f in features for x in (F.lit(f), F.col(f"{lead}{f}").cast("double"))]) if features else F.create_map().cast("map<string,double>"))
             for g, lead in ((1, ""), (0, "real_"))]
    sides = samples.select("request", F.explode(F.array(*[F.struct(F.lit(g).alias("generated"), m.alias("features")) for g, m in pairs])).alias("s"))
    told = sides.select(F.concat_ws(":", F.col("request"), F.col("s.generated")).alias("key"), "s.generated", "s.features")
    runs.run_bundle_write(path, run, terms=_as(terms, TERMS), vectors=_as(both, VECTORS), distances=_as(distances, DISTANCES), features=_as(told, FEATURES))


def _as(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in (f.strip().split(" ") for f in schema.split(", "))])


def figures(spark: SparkSession, path: str, run: str, seed=fixed.SEED, resamples: int = fixed.RESAMPLES, fid_resamples: int = fixed.FRECHET_RESAMPLES,
            fid_minimum: int = fixed.FRECHET_MIN_ROWS) -> dict[str, Callable[[], DataFrame]]:
    """Each figure of a saved run as (value, low, high, n), worked out when called."""
    def part(name: str, schema: str) -> DataFrame:
        return runs.run_bundle_read(spark, path, name, schema + ", run string", run).drop("run")

    terms, options = part("terms", TERMS), {"seed": seed, "resamples": resamples}
    scored = terms.where("hit1 IS NOT NULL")
    missed = terms.select("request", *[F.coalesce(F.col(c) > fixed.OMISSION_SUPPORT, F.lit(False)).alias(c) for c in ("support", "real_support")])
    distances = part("distances", DISTANCES)

    def identity() -> DataFrame:
        gaps = distances.groupBy("writer_id").agg(F.max(F.when(F.col("set") == "generated", F.col("gap"))).alias("made"), F.max(F.when(F.col("set") == "real", F.col("gap"))).alias("truth"))
        return intervals.paired_ratio_interval(gaps.where("made IS NOT NULL AND truth IS NOT NULL"), ["writer_id"], "made", "truth", **options)

    def detectable() -> DataFrame:
        rows = part("features", FEATURES)
        names = sorted(rows.select(F.explode(F.map_keys("features")).alias("f")).distinct().toPandas()["f"])
        if not names:
            raise ValueError("the run has no features")
        wide = rows.select("key", "generated", *[F.col("features")[f].alias(f) for f in names])
        return detect.two_sample_test(wide, "key", "generated", names, resamples=resamples)[0]

    def own(name: str) -> Callable[[], DataFrame]:
        return lambda: intervals.mean_interval(distances.where(F.col("set") == name), ["writer_id"], "own", **options)

    return {
        "fid": lambda: moments.frechet_interval(part("vectors", VECTORS), "side", "vector", "request", resamples=fid_resamples, seed=seed, minimum=fid_minimum),
        "top1": lambda: intervals.rate_interval(scored, ["request"], "hit1", **options),
        "topk": lambda: intervals.rate_interval(scored, ["request"], "hitk", **options),
        "distance": own("generated"), "distance_real": own("real"), "distance_floor": own("floor"), "identity": identity,
        "cer": lambda: intervals.ratio_interval(terms, ["request"], "errors", "length", **options),
        "cer_real": lambda: intervals.ratio_interval(terms, ["request"], "real_errors", "length", **options),
        "missing": lambda: intervals.rate_interval(missed, ["request"], "support", **options),
        "missing_real": lambda: intervals.rate_interval(missed, ["request"], "real_support", **options),
        "detectable": detectable,
    }


def save_results(spark: SparkSession, path: str, run: str, baseline: DataFrame | None = None, names: list[str] | None = None, **options) -> DataFrame:
    """RESULT rows from a saved run's terms, saved with it. ``names`` works out some of the figures only.

    One row of numbers for a figure comes to the driver; a figure that can't be worked out has its reason in ``error``.
    """
    known = {r["name"]: (r["value"], r["provenance"]) for r in baseline.collect()} if baseline is not None else {}
    groups = runs.run_bundle_read(spark, path, "terms", TERMS + ", run string", run).agg(F.max("groups")).first()[0]
    rows = []
    for name, work in figures(spark, path, run, **options).items():
        if names is not None and name not in names:
            continue
        against, source = known.get(AGAINST.get(name, ""), (None, None))
        try:
            found = work().select("value", "low", "high", "n").first()
            value = tuple(found) if found else (None, None, None, 0)
            rows.append((name, *value, against, source, _verdict(name, value[0], against, groups), None))
        except Exception as error:  # noqa: BLE001  the others carry on
            rows.append((name, None, None, None, None, against, source, None, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:500]))
    table = spark.createDataFrame(rows, RESULT)
    runs.run_bundle_write(path, run, results=table)
    return runs.run_bundle_read(spark, path, "results", RESULT + ", run string", run).drop("run")


def _verdict(name: str, value: float | None, against: float | None, groups: int | None) -> str | None:
    if value is None:
        return None
    if name == "top1" and groups and against is not None:
        if value < fixed.CHANCE_MULTIPLE / groups:
            return "not carried"
        return "carried" if value > fixed.CARRIED_SHARE * against else "partly"
    if name == "fid" and against:
        return f"{value / against:.1f}x the floor"
    if name == "cer" and against is not None:
        return f"{100 * (value - against):+.1f} points"
    return None


def counts(spark: SparkSession, path: str, run: str) -> DataFrame:
    return runs.run_bundle_read(spark, path, "counts", COUNTS + ", run string", run).drop("run")


def compare(spark: SparkSession, path: str, first: str, second: str, names: list[str] | None = None, **options) -> DataFrame:
    """(name, first_*, second_*, verdict) of two saved runs, both worked out anew with the same draws."""
    tables = [save_results(spark, path, run, None, names, **options) for run in (first, second)]
    return intervals.compare_runs(*[t.where("error IS NULL") for t in tables])


def rescore(
    spark: SparkSession, path: str, run: str, new_run: str, requests: DataFrame, truths: DataFrame, gallery: DataFrame, schema, change: Callable[[DataFrame], DataFrame] | None = None,
    baseline: DataFrame | None = None, floor: DataFrame | None = None, features: list[str] | None = None, k: int = 5, **options,
) -> DataFrame:
    """A finished run's samples, changed by ``change`` if given, measured as a run of its own; nothing is drawn again.

    ``schema`` is that of the saved samples. A sample that none of ``requests`` asked for stops the job.
    """
    saved = runs.run_bundle_read(spark, path, "per_sample", schema, run).drop("run")
    made = ["request", "attempt", "reading", "size", "support", "vector", *(features or [])]
    bound = rebind_run(saved.select(*made), requests, "request")
    samples = strict_pair(change(bound) if change else bound, truths.join(bound.select("request"), "request", "left_semi"), ["request"])
    runs.run_bundle_write(path, new_run, per_sample=samples)
    means = settle(vector_mean(gallery, ["writer_id"], "vector"))
    save_terms(samples, means, floor, features or [], path, new_run, k)
    return save_results(spark, path, new_run, baseline, **options)
