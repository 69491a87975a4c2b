"""Error rates and other shares over whole sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.text import error_rate, words
from plumbline.operators.skew import ROWS_PER_TASK, checked_broadcast, exact_quantiles


def error_terms(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """Each row's edits, target characters and own rate."""
    p, t = F.col(prediction), F.col(target)
    return df.withColumns(
        {"errors": F.levenshtein(p, t), "length": F.length(t), "rate": error_rate(p, t)}
    )


def corpus_error_rate(terms: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edits over target characters, summed before they are divided; 0 without characters."""
    total = F.sum("length")
    return terms.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("errors").alias("errors"), total.alias("length"),
        F.when(total > 0, F.sum("errors") / total).otherwise(0.0).alias("cer"),
        F.avg("rate").alias("mean_rate"),
    )


def error_gap(df: DataFrame, generated: str, target: str, real: str | None = None) -> DataFrame:
    """One row: rate of the generated reading, of the real one, and their difference (NULL without a real one)."""
    t = F.col(target)
    length = F.sum(F.length(t))

    def rate(reading: str) -> Column:
        return F.when(length > 0, F.sum(F.levenshtein(F.col(reading), t)) / length).otherwise(0.0)

    baseline = rate(real) if real else F.lit(None).cast("double")
    return df.agg(F.count(F.lit(1)).alias("samples"), rate(generated).alias("generated"), baseline.alias("real")).withColumn(
        "gap", F.col("generated") - F.col("real")
    )


def leave_one_out(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep..., index, text): the text without each of its words in turn, the last one excepted."""
    ws = df.select(*keep, words(F.col(text)).alias("__w")).where(F.size("__w") > 1)
    each = ws.select(*keep, "__w", F.explode(F.sequence(F.lit(0), F.size("__w") - 2)).alias("index"))
    i, n = F.col("index"), F.size("__w")
    rest = F.concat(F.slice("__w", F.lit(1), i), F.slice("__w", i + 2, n))
    return each.select(*keep, "index", F.array_join(rest, " ").alias("text"))


def width_report(df: DataFrame, real: Column, generated: Column, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row on generated size over real size: mean, median, p10, p90, shares too wide and too narrow."""
    ratio = generated / F.greatest(real, F.lit(1.0))
    shares = df.agg(
        F.avg(ratio).alias("mean"),
        F.avg(F.when(ratio > fixed.TOO_WIDE, 1.0).otherwise(0.0)).alias("wider"),
        F.avg(F.when(ratio < fixed.TOO_NARROW, 1.0).otherwise(0.0)).alias("narrower"),
    )
    q = exact_quantiles(df, [], ratio, [0.1, 0.5, 0.9], "q", rows_per_task)
    both = shares.unionByName(q, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("mean", "wider", "narrower")], F.first("q", True).alias("q")
    )
    return both.select(
        "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("p10"), F.col("q")[2].alias("p90"), "wider", "narrower",
        (F.abs(F.col("q")[1] - 1.0) > fixed.WIDTH_TOLERANCE).alias("systematic"),
    )


def missing_share(df: DataFrame, set_: str, support: str, threshold: float = fixed.OMISSION_SUPPORT) -> DataFrame:
    """Share of each set's rows missing a word; a row without a verdict misses none."""
    hit = F.coalesce(F.col(support) > threshold, F.lit(False))
    return df.groupBy(set_).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("share"))


def class_means(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Each feature's mean on either side: (feature, real, generated)."""
    long = df.select(
        F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("m")
    )
    return long.groupBy("m.feature").agg(
        F.avg(F.when(F.col("y") == 0, F.col("m.x"))).alias("real"), F.avg(F.when(F.col("y") == 1, F.col("m.x"))).alias("generated")
    )


def blind_score(answers: DataFrame, key: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row: answers, share right, passes; per judge: answers and share right).

    ``answers`` (judge, trial, choice); ``key`` (trial, side). A trial the key lacks
    stops the job, as do fewer than two answers.
    """
    hits = blind_hits(answers, key)
    n = F.count(F.lit(1))
    share = F.avg(F.col("hit").cast("double"))
    total = hits.agg(n.alias("answers"), share.alias("accuracy"))
    enough = F.when(F.col("answers") >= 2, True).otherwise(F.raise_error(F.lit("need at least two answers")).cast("boolean"))
    verdict = total.where(enough).withColumn("passes", F.col("accuracy") <= fixed.BLIND_PASS)
    return verdict, hits.groupBy("judge").agg(n.alias("answers"), share.alias("accuracy"))


def blind_hits(answers: DataFrame, key: DataFrame) -> DataFrame:
    joined = answers.join(checked_broadcast(key.select("trial", "side")), "trial", "left")
    told = F.concat(F.lit("no such trial: "), F.col("trial").cast("string"))
    hit = F.when(F.col("side").isNull(), F.raise_error(told).cast("boolean")).otherwise(F.col("choice") == F.col("side"))
    return joined.select("judge", "trial", hit.alias("hit"))
