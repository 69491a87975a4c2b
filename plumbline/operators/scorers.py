"""User models run over records in batches, their answers kept to the record's key.

A model comes as a factory, called once per task, so that it is built where it runs.
Batches are streamed; an answer of another length or shape than the batch stops the
job, since it would put answers beside the wrong records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

READ_BATCH = 32
EMBED_BATCH = 64
#: Records that are given back at once, about.
PIECE_ROWS = 512
#: Bytes of a batch of records, long texts or short.
BATCH_BYTES, BATCH_CONF, SPARKS_OWN = f"{2 << 20}b", "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"


def _bound_batches(spark: SparkSession) -> None:
    """Records come to tasks in batches of ``BATCH_BYTES``, unless the session was given another bound than Spark's own."""
    if spark.conf.get(BATCH_CONF) == SPARKS_OWN:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def _answered(
    frames: Iterator[pd.DataFrame], model: Callable, inputs: list[str], answer: Callable, out: str, batch: int
) -> Iterator[pd.DataFrame]:
    """Frames with their answers, a few model batches at a time, so that a frame's answers are never held together."""
    step = batch * max(1, PIECE_ROWS // batch)
    for frame in frames:
        for start in range(0, len(frame), step):
            piece = frame.iloc[start : start + step]
            found: list = []
            for at in range(0, len(piece), batch):
                part = piece.iloc[at : at + batch]
                given = model(*[part[c].tolist() for c in inputs])
                if len(given) != len(part):
                    raise ValueError(f"{len(given)} answers for {len(part)} records")
                found.extend(answer(given))
            yield piece.assign(**{out: pd.Series(found, index=piece.index, dtype=object)})


def _in_batches(df: DataFrame, inputs: list[str], factory: Callable[[], Callable], answer: Callable, out: str, kind: str, batch: int) -> DataFrame:
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    _bound_batches(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _answered(frames, factory(), inputs, answer, out, batch)

    return df.mapInPandas(run, f"{types}, {out} {kind}")


def read_with(df: DataFrame, payload: str, reader: Callable[[], Callable[[Sequence], Sequence[str]]], out: str = "reading", batch: int = READ_BATCH) -> DataFrame:
    """``df`` with what the reader reads of each payload."""
    return _in_batches(df, [payload], reader, list, out, "string", batch)


def embed_with(df: DataFrame, payload: str, embedder: Callable[[], Callable[[Sequence], np.ndarray]], out: str = "vector", batch: int = EMBED_BATCH) -> DataFrame:
    """``df`` with each payload's vector; the embedder returns one row of an (n, d) array per payload."""

    def rows(given) -> list[list[float]]:
        found = np.asarray(given, dtype=float)
        if found.ndim != 2:
            raise ValueError(f"expected (n, d) vectors, got {found.shape}")
        return found.tolist()

    return _in_batches(df, [payload], embedder, rows, out, "array<double>", batch)


def verify_with(df: DataFrame, payload: str, text: str, verifier: Callable[[], Callable], out: str = "omission", batch: int = READ_BATCH) -> DataFrame:
    """``df`` with the word each payload most clearly lacks: (word, index, support), or NULL."""

    def rows(given) -> list:
        return [None if g is None else {"word": g[0], "index": int(g[1]), "support": float(g[2])} for g in given]

    return _in_batches(df, [payload, text], verifier, rows, out, "struct<word:string,index:int,support:double>", batch)


def generate_with(df: DataFrame, inputs: list[str], generator: Callable[[], Callable], out: str = "output", kind: str = "array<double>", batch: int = READ_BATCH) -> DataFrame:
    """``df`` with the generator's output per request, in its place; a request it fails on gets NULL."""
    return _in_batches(df, inputs, generator, list, out, kind, batch)
