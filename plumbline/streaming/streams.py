"""Streaming forms: counted ingest, metric windows, first acceptable draw, stop rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline import fixed
from plumbline.operators.reasons import Rule, first_reason
from plumbline.operators.selection import acceptable, badness
from plumbline.session import fresh_path

#: Groups that ``stream_first_ok`` deals its requests out to; a call takes milliseconds, whatever it holds.
REQUEST_BUCKETS = 1024


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """Parquet files as they arrive in ``folder``; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A run log's JSON lines as they arrive, with ``ts`` from the wall time."""
    from plumbline.sources.runs import LOG_SCHEMA

    reader = spark.readStream.schema(LOG_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder).withColumn("ts", F.timestamp_micros((F.col("wall_time") * 1e6).cast("bigint")))


def drain(stream: DataFrame, path: str, mode: str, checkpoint: str | None = None) -> None:
    """Run ``stream`` over everything there is and store each batch under ``path`` by epoch.

    A repeated epoch replaces its own folder, so a restart from ``checkpoint`` leaves
    each result once.
    """
    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch:08d}")

    run = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or f"{path}-checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    run.awaitTermination()


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """All epochs' rows with their ``epoch``."""
    return spark.read.schema(schema).option("basePath", path).parquet(path).select("*", F.col("epoch").cast("bigint").alias("__e")).drop("epoch").withColumnRenamed("__e", "epoch")


def latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each key's row of its last epoch: what an update-mode result amounts to."""
    rest = [c for c in rows.columns if c not in (*key, "epoch")]
    if not rest:
        return rows.select(*key).distinct()
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*key, "r.*")


def collect_updates(stream: DataFrame, key: list[str], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run an update-mode stream to the end of its input and return every key's last row."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, "stream")
    drain(stream, path, "update", checkpoint)
    return latest(stored(spark, path, stream.schema), key)


def stream_manifest(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """Running counts by reason over arriving records, the kept ones included."""
    marked = first_reason(records, rules)
    return marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "kind").agg(F.count(F.lit(1)).alias("n"))


def stream_metrics(log: DataFrame, window: str, lateness: str, ts: str = "ts") -> DataFrame:
    """Per metric and tumbling window: rows, mean, and the value of the highest step.

    Rows later than ``lateness`` behind the newest are dropped and counted by the engine.
    """
    grouped = log.withWatermark(ts, lateness).groupBy(F.window(ts, window).alias("w"), "metric")
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max_by("value", "step").alias("latest")
    ).select(F.col("w.start").alias("start"), "metric", "n", "mean", "latest")


def stream_choose(draws: DataFrame, request: str) -> DataFrame:
    """Running choice per request: the first acceptable attempt so far, else the least bad.

    An aggregate with map-side combining; a later draw changes nothing once an
    earlier attempt is acceptable.
    """
    rest = [c for c in draws.columns if c != request]
    made = draws.where(F.col("score").isNotNull()).withColumn("ok", F.coalesce(acceptable(), F.lit(False)))
    row = F.struct(*rest, "ok")
    chosen = made.groupBy(request).agg(
        F.min_by(row, F.when(F.col("ok"), F.col("attempt"))).alias("first"), F.min_by(row, badness()).alias("least")
    )
    return chosen.select(request, F.coalesce("first", "least").alias("r")).select(request, "r.*")


def _least_bad(rows: pd.DataFrame) -> pd.DataFrame:
    """Each request's least bad draw, beside its newest time and whether it was settled."""
    by = rows.groupby("name", dropna=False, sort=False)
    rows = rows.assign(seen=by["seen"].transform("max"), done=by["done"].transform("max"))
    return rows.sort_values(["level", "score", "attempt"], kind="stable").drop_duplicates("name")


def stream_first_ok(
    draws: DataFrame, request: str, ts: str, lateness: str, patience: str = "10 minutes", buckets: int = REQUEST_BUCKETS
) -> DataFrame:
    """(request, attempt, score, ok) once per request, as soon as it is settled.

    The first acceptable draw to arrive settles a request; without one, the least
    bad is given when no draw came for ``patience`` of event time. Later draws are
    ignored for as long as they come within ``patience`` of each other; then the
    request is forgotten. State per request is one draw, however many arrive. Requests
    are dealt out to ``buckets`` by hash, and a bucket's are settled together: a call for
    each of them takes longer than all else. A call holds its bucket's open requests.
    """
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)
    bad = badness()
    level = sum((bad[c].cast("int") * w for c, w in (("smear", 4), ("omitted", 2), ("doubled", 1))), F.lit(0))
    scored = (
        draws.where(F.col("score").isNotNull())
        .withColumn("ok", F.coalesce(acceptable(), F.lit(False)))
        # the name travels as text: pandas has no exact whole numbers beside NULL
        .select(F.pmod(F.xxhash64(request), F.lit(buckets)).cast("int").alias("bucket"), F.col(request).cast("string").alias("name"),
                F.col("attempt").cast("int").alias("attempt"), F.col("score").cast("double").alias("score"), "ok", level.alias("level"),
                F.col(ts).alias("ts"))
        .withWatermark("ts", lateness)
    )
    kind = draws.schema[request].dataType.simpleString()
    kept = pa.schema([("name", pa.string()), ("level", pa.int32()), ("score", pa.float64()), ("attempt", pa.int32()),
                      ("seen", pa.int64()), ("done", pa.bool_())])

    def settle_requests(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
        good = None
        for frame in [] if state.hasTimedOut else frames:
            seen = frame["ts"].to_numpy().astype("datetime64[ms]").astype("int64")
            rows = frame.assign(seen=np.maximum(seen, 0), done=False)
            fine = rows.loc[rows["ok"], ["name", "attempt", "score"]]
            good = (fine if good is None else pd.concat([good, fine])).sort_values("attempt", kind="stable").drop_duplicates("name")
            rows = rows[kept.names]
            held = _least_bad(rows if held is None else pd.concat([held, rows]))
        if good is not None and len(good):
            new = good[~good["name"].isin(held.loc[held["done"], "name"])]
            yield new.assign(ok=True)[["name", "attempt", "score", "ok"]]
            held["done"] |= held["name"].isin(new["name"])
        watermark = state.getCurrentWatermarkMs()
        over = held["seen"] + wait < watermark
        given = held[over & ~held["done"]]
        if len(given):
            yield given.assign(ok=False)[["name", "attempt", "score", "ok"]]
        held = held[~over]
        if not len(held):
            state.remove()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept) as writer:
            writer.write_table(pa.Table.from_pandas(held, kept, preserve_index=False))
        state.update((sink.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(max(int(held["seen"].min()) + wait, watermark + 1))

    settled = scored.groupBy("bucket").applyInPandasWithState(
        settle_requests, "name string, attempt int, score double, ok boolean", "held binary", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return settled.select(F.col("name").cast(kind).alias(request), "attempt", "score", "ok")


def complete_first_ok(given: DataFrame, draws: DataFrame, request: str) -> DataFrame:
    """``given``, the rows of ``stream_first_ok``, and a row for each request it still holds open when the input has ended.

    ``draws`` is the stream's whole input as a table. No time-out fires after the last rows, so what is open is chosen from it by
    the same rule. Nothing is stored: a later run goes on from the stream's own state.
    """
    known = given.select(F.col(request).alias("__given")).distinct()
    left = draws.join(known, F.col(request).eqNullSafe(F.col("__given")), "left_anti")
    chosen = stream_choose(left, request)
    return given.unionByName(chosen.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in given.schema]))


def stream_breaker(
    events: DataFrame, key: str, seq: str, ok: str, limit: int = fixed.MAX_CONSECUTIVE_FAILURES, tie: str | None = None
) -> DataFrame:
    """(key, dead, dead_at, failures) after each batch: the stop rule on arriving events.

    A key's rows of one batch are put in order of ``seq`` first, equal places by ``tie``, failures last; how many those can
    be is set by the source's rows per trigger. State is two numbers per key.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(
        key, F.col(seq).cast("bigint").alias("q"), F.col(ok).alias("ok"), (F.col(tie) if tie else F.lit(0)).alias("tie")
    )

    def follow(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, dead_at = state.get if state.exists else (0, None)
        if dead_at is None:
            batch = pd.concat(list(frames)).sort_values(["q", "tie", "ok"], ascending=[True, True, False])
            failed = ~batch["ok"].to_numpy(bool)
            for place, fail in zip(batch["q"].to_numpy(), failed, strict=True):
                run = run + 1 if fail else 0
                if run == limit:
                    dead_at = int(place)
                    break
        state.update((int(run), dead_at))
        yield pd.DataFrame({
            key: [name[0]], "dead": [dead_at is not None], "dead_at": pd.array([dead_at], dtype="Int64"), "failures": [int(run)],
        })

    return rows.groupBy(key).applyInPandasWithState(
        follow, f"{key} {kind}, dead boolean, dead_at bigint, failures bigint", "run bigint, dead_at bigint", "update",
        GroupStateTimeout.NoTimeout,
    )


