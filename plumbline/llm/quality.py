"""Quality of documents by Bradley-Terry ranking.

Every preference, a document labelled good over one labelled bad, says that the score of the first exceeds that of the second with
probability sigmoid(difference). Scores are linear in features of the text, so the logistic loss is one on differences of
features. Features are cut at quantiles of the sample and each cell has a coefficient. The threshold is the exact quantile of the
scores of all labelled documents below which as many lie as were labelled bad.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import logistic
from plumbline.llm.common import bounded_sample, held_out, slices
from plumbline.operators.skew import exact_quantiles
from plumbline.session import settle

#: Documents of each label that the ranking is fitted on, at most, and preferences drawn for each of them.
SAMPLE, RIVALS = 4000, 6
#: Cells that a feature is cut into, the strength of the penalty, the score that the threshold is put at.
CELLS, PENALTY, CUT = 12, 1.0, 0.7

CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t",
           "line": b"\n", "stop": b".", "comma": b",", "loud": b"!?", "pipe": b"|", "mark": b"#$%&*", "bracket": b"()[]{}<>",
           "quote": b"\"'`", "link": b"/\\@_=", "dash": b"-+:;~^", "far": bytes(range(128, 256))}
NAMES = (*CLASSES, "chars", "words", "letters_a_word", "distinct", "top_word", "long_words", "short_words", "words_a_line", "distinct_lines",
         "capital_words", "distinct_pairs")


def features(text: str | None) -> list[float]:
    """What the text looks like: shares of kinds of characters, of words and of lines. An empty text has zeros."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    shares = [float(counts[list(kind)].sum()) / size for kind in CLASSES.values()]
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(set(zip(words[:-1], words[1:], strict=True))) / max(1, len(words) - 1)
    return [*shares, np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()) if words else 0.0, len(seen) / n, max(seen.values(), default=0) / n,
            float((lengths > 12).sum()) / n, float((lengths <= 3).sum()) / n, np.log1p(len(words) / len(lines)), len(set(lines)) / len(lines),
            sum(map(str.isupper, words)) / n, pairs]


@dataclass
class Ranking:
    """Cuts of every feature, a coefficient for every cell, the threshold and the scale of scores."""

    cuts: np.ndarray
    coefficients: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return cells(x, self.cuts) @ self.coefficients

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, ``CUT`` at the threshold."""
        return logistic.sigmoid((self.raw(x) - self.threshold) * self.scale + np.log(CUT / (1 - CUT)))


def cells(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One column for every cut of every feature: whether the value exceeds it."""
    return np.concatenate([x[:, [k]] > cuts[k][None, :] for k in range(x.shape[1])], axis=1).astype(float)


def fit(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, sample: int = SAMPLE) -> Ranking | None:
    """The ranking learned from labelled documents outside the held-out rows; None where both labels aren't there."""
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out(modulus, remainder))
    chosen = bounded_sample(known, "quality", sample, "doc_id")
    # at most twice the sample's size, whatever the table's: small enough to meet the texts where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([features(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([values, batch.column(1), batch.column(2)], names=["x", "quality", "draw"])

    measured = rows.select("text", F.col("quality").cast("int"), F.xxhash64("doc_id", "text").alias("draw")).mapInArrow(
        measure, "x array<double>, quality int, draw bigint").toArrow()
    y = measured.column(1).to_numpy()
    if set(np.unique(y)) != {0, 1}:
        return None
    order = np.argsort(measured.column(2).to_numpy(), kind="stable")
    x, y = np.array(measured.column(0).to_pylist(), float)[order], y[order]
    cuts = np.quantile(x, np.linspace(0, 1, CELLS + 1)[1:-1], axis=0).T
    z = cells(x, cuts)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = max(len(good), len(bad)) * RIVALS
    winners, losers = good[np.arange(n) % len(good)], bad[(np.arange(n) * 7 + np.arange(n) // len(good)) % len(bad)]
    w = logistic.fit(z[winners] - z[losers], np.ones(n), np.full(n, 1.0), PENALTY)
    ranking = Ranking(cuts, w, 0.0, 1.0)
    ranking.threshold = threshold(raw_scores(docs.where(~held_out(modulus, remainder)), ranking).join(known, "doc_id"))
    return ranking


def raw_scores(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, raw) of every whole text; only these two, not texts, then meet the labels."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.array([features(t.as_py()) for t in part.column(1)], float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ranking.raw(x))], names=["doc_id", "raw"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(score, "doc_id bigint, raw double")


def threshold(scored: DataFrame) -> float:
    """The middle between the scores (raw, quality) at which as many rows lie below as are labelled bad, over all rows."""
    scored = settle(scored.select("raw", "quality"))
    n, bad = scored.agg(F.count("*"), F.count(F.when(F.col("quality") == 0, 1))).first()
    return exact_quantiles(scored, [], F.col("raw"), [min(1.0, max(0.0, (bad - 0.5) / max(1, n - 1)))]).first()["q"][0]


def predict(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """``docs`` with score and predicted; columns of these names are replaced, all else stays.

    A NULL text is an empty one and is scored like any other. Without a ranking every score is 0.5.
    """
    docs = docs.drop("score", "predicted")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    held = docs.sparkSession.sparkContext.broadcast(ranking and (ranking.cuts, ranking.coefficients, ranking.threshold, ranking.scale))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value and Ranking(*held.value)
        for batch in batches:
            for part in slices(batch):
                x = np.array([features(t.as_py()) for t in part.column(part.schema.names.index("text"))], float)
                found = known.score(x) if known else np.full(len(part), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= CUT).astype(np.int32))],
                                                 names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, ", ".join([*fields, "score double", "predicted int"]))
