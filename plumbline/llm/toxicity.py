"""Toxicity behind disguises: noisy-channel restoration, then a score.

A writer means a word and a channel disguises it: letters turn into look-alikes, are repeated, or are spaced out. For a token
that may have gone through it, a lattice holds for every character the letters it may stand for, or that it repeats the last
one. The cheapest way through, under a trigram model of letters counted over the whole corpus, is the restored word. Scores
look at restored words and their beginnings: how much likelier they are in documents labelled toxic, as a cautious estimate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import logistic
from plumbline.llm.common import bounded_sample, held_out, slices

# What look-alikes may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
         "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h", "%": "x", "&": "a"}
#: Characters that may stand between the letters of a spaced-out word.
BETWEEN = " ._*-"
#: Letters of the model; all others are one more, and the bound of a word is another.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
PLACE = {c: i for i, c in enumerate(LETTERS)}
OTHER, BOUND, SYMBOLS = len(LETTERS), len(LETTERS) + 1, len(LETTERS) + 2

#: What the channel pays, in nats, for a look-alike, for repeating a letter, for a stray mark inside a word.
LOOK_COST, REPEAT_COST, STRAY_COST = 1.0, 0.5, 3.0
#: Labelled documents of each kind that scores are fitted on, at most.
SAMPLE = 12_000
#: Beginnings of words that count beside whole words; a feature's least documents; what caution takes off its weight.
BEGINNINGS, LEAST, CAUTION = (4, 5, 6), 3, 2.0
KEPT = 0.5
REMEMBERED = 300_000

SPACED = re.compile(r"(?<!\S)\w(?:([ ._*-])\w)(?:\1\w)+(?!\w)")
#: What goes at a token's beginning; at its end, which is read backwards.
BEGIN, END, DOUBLED_END = re.compile(r"[^\w@$!|+(€£]+"), re.compile(r"[^\w@$+€£]+"), re.compile(r"([$+@€£!])\1+(?=\w)")
#: A run of three, letters, marks that stand for letters, and those that may stand between or after letters.
TRIPLE, LETTER, STANDIN, MARK = (re.compile(p) for p in (r"(.)\1\1", r"[^\W\d_]", r"[\d@$!|+(€£]", r"[\d@$!|+(€£*#%&._-]"))


def letter_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of a letter after two others, (symbols, symbols, symbols), counted over the words of every document.

    Each task counts its words' trigrams in one array of fixed size and hands on those that occur; what comes to the driver is
    bounded by the number of trigrams there are.
    """
    table = np.full(0x110000, BOUND, np.uint8)
    table[[ord(c) for c in map(chr, range(0x3000)) if c.isalpha()]] = OTHER
    for c, i in PLACE.items():
        table[[ord(c), ord(c.upper()) if len(c.upper()) == 1 else ord(c)]] = i
    small = table[:0x3000].copy()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            for part in slices(batch):
                text = " ".join(t or "" for t in part.column(0).to_pylist())
                points = np.frombuffer(f"  {text}  ".encode("utf-32-le", "surrogatepass"), np.uint32)
                codes = np.where(points < 0x3000, small[np.minimum(points, 0x2FFF)], OTHER).astype(np.int32)
                grams = (codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:]
                # between two words only what leads to or from a letter counts
                total += np.bincount(grams[(codes[1:-1] != BOUND) | (codes[2:] != BOUND)], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    found = docs.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS ** 3)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    # a bound before a word is one whatever came before it
    three[:, BOUND, :] = three[:, BOUND, :].sum(axis=0)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    unigram = (one + 1) / (one.sum() + SYMBOLS)
    bigram = (two + 5 * unigram) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * bigram[None]) / (three.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest word behind a token, by Viterbi over its lattice; states are the last two letters meant."""
    model_of = model.item
    states: dict[tuple[int, int], tuple[float, tuple]] = {(BOUND, BOUND): (0.0, ())}
    last = ""
    for character in token:
        if character in PLACE or character.isalpha():
            choices = [(PLACE.get(character, OTHER), character, 0.0)]
        else:
            choices = [(PLACE[c], c, LOOK_COST) for c in LOOKS.get(character, "")]
        stray = REPEAT_COST if character == last else STRAY_COST if not character.isalnum() else None
        last = character
        following: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in states.items():
            for code, letter, price in choices:
                paid = cost + price - model_of(a, b, code)
                if (held := following.get((b, code))) is None or paid < held[0]:
                    following[b, code] = (paid, (path, letter))
            if stray is not None and path and ((held := following.get((a, b))) is None or cost + stray < held[0]):
                following[a, b] = (cost + stray, path)
        states = following or states
    cost, path = min((cost - model_of(a, b, BOUND), path) for (a, b), (cost, path) in states.items())
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def without_edges(token: str) -> str:
    """A token without marks around it, but for such as may stand for its first or last letter."""
    start = BEGIN.match(token)
    word = token[start.end():] if start else token
    back = word[::-1]
    end = END.match(back) or DOUBLED_END.match(back)
    return word[:len(word) - end.end()] if end else word


def suspect(word: str) -> bool:
    """Whether a word has three of a kind in a row, a letter before a mark, or a mark that may be a letter before a letter."""
    if TRIPLE.search(word):
        return True
    letter = LETTER.search(word)
    if not letter:
        return False
    back = word[::-1]
    last_mark, first_mark, last_letter = MARK.search(back), STANDIN.search(word), LETTER.search(back)
    return bool(last_mark and letter.start() < len(word) - last_mark.end() or first_mark and first_mark.start() < len(word) - last_letter.end())


def restore_token(token: str, model: np.ndarray) -> str:
    """A token in lower case, without marks around it, restored if it may be disguised."""
    word = without_edges(token.lower())
    return decode(word, model) if suspect(word) else word


def tokens_of(text: str) -> list[str]:
    """Tokens between white space; letters spaced out one by one are more tokens, together."""
    tokens = text.split()
    for run in SPACED.finditer(text):
        closed = "".join(c for c in run[0] if c not in BETWEEN)
        # the first letter may be a word of its own
        tokens += [closed, closed[1:]]
    return tokens


def restore(text: str, model: np.ndarray) -> str:
    """The text with every token restored, spaced-out words closed up."""
    closed = SPACED.sub(lambda run: "".join(c for c in run[0] if c not in BETWEEN), text)
    return " ".join(restore_token(t, model) for t in closed.split())


def features_of(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Scorer:
    """Weights of features and the coefficients of a document's strongest ones."""

    weights: dict[str, float]
    coefficients: np.ndarray


def measure(found: dict[str, float]) -> list[float]:
    """From the weights of a document's words, those of its three strongest; one word counts once, however often it occurs."""
    top = sorted(found.values(), reverse=True)[:3]
    return [1.0, *top, *[0.0] * (3 - len(top))]


class Weigher:
    """Weights of tokens, each restored once and remembered up to a bound."""

    def __init__(self, model: np.ndarray, weights: dict[str, float]):
        self.model, self.weights, self.known = model, weights, {}

    def __call__(self, text: str | None) -> list[float]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        found, known = {}, self.known
        for token in set(tokens_of(text or "")):
            if (held := known.get(token)) is None:
                word = restore_token(token, self.model)
                weight = max((self.weights.get(f, 0.0) for f in features_of(word)), default=0.0) if word else 0.0
                held = known[token] = (word, weight)
            if held[1] > 0:
                found[held[0]] = held[1]
        return measure(found)


def fit(docs: DataFrame, labels: DataFrame, letters: np.ndarray, modulus: int, remainder: int, sample: int = SAMPLE) -> Scorer | None:
    """The scorer learned from a bounded sample of labelled documents outside the held-out rows; None where both labels aren't there."""
    spark = docs.sparkSession
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(modulus, remainder))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if set(totals) != {0, 1}:
        return None
    chosen = bounded_sample(known, "toxic", sample, "doc_id")
    # at most twice the sample's size, whatever the table's: small enough to meet the texts where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int"))
    model = spark.sparkContext.broadcast(letters)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored: dict[str, str] = {}
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                tokens = set(tokens_of(text.as_py() or ""))
                if len(restored) > REMEMBERED:
                    restored = {}
                for token in tokens:
                    if token not in restored:
                        restored[token] = restore_token(token, model.value)
                seen[toxic].update({f for t in tokens for f in features_of(restored[t])})
        names = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([seen[k][f] for f in names], pa.int64()) for k in (1, 0))], names=["feature", "toxic", "clean"])

    drawn = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    n, m = drawn.get(1, 0) + 1.0, drawn.get(0, 0) + 1.0
    counted = rows.mapInArrow(count, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(f"t >= {LEAST}")
    weight = (F.log((F.col("t") + 0.5) / n) - F.log((F.col("c") + 0.5) / m) - CAUTION * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
    kept = counted.select("feature", weight.alias("weight")).where(F.col("weight") > KEPT).toArrow()
    weights = dict(zip(kept.column(0).to_pylist(), kept.column(1).to_pylist(), strict=True))
    held = spark.sparkContext.broadcast(weights)

    def strongest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weigher(model.value, held.value)
        for batch in batches:
            found = [weigh(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    # equal measures are counted together: the fit sees numbers of documents, not rows
    table = rows.mapInArrow(strongest, "x array<double>, toxic int").select(F.transform("x", lambda v: F.round(v, 1)).alias("x"), "toxic").groupBy(
        "x", "toxic").count().toArrow()
    x = np.array(table.column(0).to_pylist(), float).reshape(-1, 4)
    y, rows_of = table.column(1).to_numpy(), table.column(2).to_numpy().astype(float)
    stands_for = np.where(y == 1, totals[1] / max(1, drawn.get(1, 0)), totals[0] / max(1, drawn.get(0, 0)))
    return Scorer(weights, logistic.fit(x, y, rows_of * stands_for, 0.01))


def predict(docs: DataFrame, letters: np.ndarray, scorer: Scorer | None) -> DataFrame:
    """``docs`` with score and predicted; columns of these names are replaced, all else stays.

    A NULL text is an empty one and is scored like any other text without a telling word. Without a scorer every score is 0.
    """
    docs = docs.drop("score", "predicted")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    model = docs.sparkSession.sparkContext.broadcast(letters)
    held = docs.sparkSession.sparkContext.broadcast(scorer and (scorer.weights, scorer.coefficients))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, coefficients = held.value or ({}, None)
        weigh = Weigher(model.value, weights)
        for batch in batches:
            for part in slices(batch):
                x = np.array([weigh(t.as_py()) for t in part.column(part.schema.names.index("text"))], float)
                found = np.zeros(len(x)) if coefficients is None else logistic.sigmoid(x @ coefficients)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                                                 names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, ", ".join([*fields, "score double", "predicted int"]))
