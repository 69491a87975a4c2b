"""Streaming forms over the sample tables' files; their SQL twins are the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions import text as tx
from plumbline.operators import breaker as stop_rule
from plumbline.operators.reasons import Rule
from plumbline.plans.registry import SQL_ENGLISH, query, r6
from plumbline.plans.selecting import BADNESS, SQL_DRAWS, draws
from plumbline.session import fresh_path
from plumbline.streaming import streams


def as_stream(read, name):
    """All of a sample table's files as a stream: those of its folder, or the table's one file."""
    table = read(name)
    places = {file.rpartition("/")[::2] for file in table.inputFiles()}
    folder = min(place for place, _ in places)
    pattern = min(file for _, file in places) if len(places) == 1 else "*.parquet"
    return streams.file_stream(table.sparkSession, folder, table.schema, pattern=pattern)


@query("stream_manifest", f"""
SELECT coalesce(reason, 'kept') AS reason, CASE WHEN reason IS NULL THEN 'kept' ELSE 'dropped' END AS kind, count(*) AS n
FROM (SELECT CASE WHEN trim(text) = '' THEN '{fixed.EMPTY_TEXT}'
             WHEN length(translate(text, {SQL_ENGLISH}, '')) > 0 THEN '{fixed.OUT_OF_CHARSET}' END AS reason FROM documents) GROUP BY 1, 2""")
def stream_manifest(read):
    rules = [
        Rule(fixed.EMPTY_TEXT, tx.is_blank(F.col("text"))), Rule(fixed.OUT_OF_CHARSET, ~tx.alphabet("english").supports(F.col("text"))),
    ]
    return streams.collect_updates(streams.stream_manifest(as_stream(read, "documents"), rules), ["reason", "kind"])


@query("stream_metrics", """
SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type AS metric, count(*) AS n, round(avg(value), 6) AS mean,
       arg_max(value, event_id) AS latest FROM events GROUP BY 1, 2""")
def stream_metrics(read):
    log = as_stream(read, "events").select(
        F.col("event_id").alias("step"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric"), "value"
    )
    found = streams.collect_updates(streams.stream_metrics(log, "1 day", "1 hour"), ["start", "metric"])
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "metric", "n", r6("mean").alias("mean"), "latest")


SQL_FIRST_OK = SQL_DRAWS + f"""
SELECT request, attempt, score, ok FROM a WHERE score IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY request ORDER BY NOT ok, CASE WHEN ok THEN attempt END, {BADNESS}) = 1"""


@query("stream_first_ok", SQL_FIRST_OK)
def stream_first_ok(read):
    made = draws(read)
    path = fresh_path(made.sparkSession, "draws")
    made.write.parquet(path)
    chosen = streams.stream_choose(streams.file_stream(made.sparkSession, path, made.schema), "request")
    return streams.collect_updates(chosen, ["request"]).select("request", "attempt", "score", "ok")


@query("stream_first_ok_settled", SQL_FIRST_OK)
def stream_first_ok_settled(read):
    made = draws(read).withColumn("ts", F.timestamp_seconds(F.col("request") * 60 + F.col("attempt")))
    path, out = fresh_path(made.sparkSession, "draws"), fresh_path(made.sparkSession, "settled-draws")
    made.write.parquet(path)
    settled = streams.stream_first_ok(streams.file_stream(made.sparkSession, path, made.schema), "request", "ts", "1 minute")
    streams.drain(settled, out, "append")
    given = streams.stored(made.sparkSession, out, settled.schema).drop("epoch")
    return streams.complete_first_ok(given, made.sparkSession.read.schema(made.schema).parquet(path), "request").select("request", "attempt", "score", "ok")


SQL_BREAKER = """
WITH e AS (SELECT user_id, epoch_us(ts) AS q, event_id, event_type <> 'error' AS ok FROM events),
g AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY q, event_id) AS run FROM e),
k AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, run ORDER BY q, event_id) AS k FROM g),
z AS (SELECT user_id, min(q) FILTER (k = 3 AND NOT ok) AS dead_at, arg_max(CASE WHEN ok THEN 0 ELSE k END, struct_pack(q := q, e := event_id)) AS tail FROM k GROUP BY 1)
SELECT user_id, dead_at IS NOT NULL AS dead, dead_at, (CASE WHEN dead_at IS NOT NULL THEN 3 ELSE tail END)::BIGINT AS failures FROM z
"""


def outcomes(rows):
    return rows.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("q"), (F.col("event_type") != "error").alias("ok"))


@query("stream_breaker", SQL_BREAKER)
def stream_breaker(read):
    followed = streams.stream_breaker(outcomes(as_stream(read, "events")), "user_id", "q", "ok", tie="event_id")
    return streams.collect_updates(followed, ["user_id"])


@query("breaker", SQL_BREAKER)
def breaker(read):
    return stop_rule.breaker(outcomes(read("events")), "user_id", "q", "ok", width=86_400_000_000, tie="event_id")
