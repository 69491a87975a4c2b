"""Languages of texts, span by span.

The script of a word, from ranges of code points, leaves the languages seen in that script. Among these a word's letter
groups, and the word itself, give each language a score. The best sequence of languages over the words of a text, where
every switch costs a penalty, labels spans; the text's language is the one that most of its letters are in.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bound_batches, bounded_sample, held_out, slices

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")

# First code points of stretches and the scripts in them; what is in no stretch is "other".
SCRIPTS = ((0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
           (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
           (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
           (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
           (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"))
FIRST = [a for a, _ in SCRIPTS]

#: Documents of each language that the model is fitted on, at most. The held-out rows are never among them.
SAMPLE = 3000
#: Letters in a group; cells that groups are hashed into, as a power of two; how often a cell has to occur; what a switch costs, in
#: nats; a script's least share of a language's letters.
GROUPS, CELLS, LEAST, SWITCH, SCRIPT_SHARE = (1, 2, 3, 4), 16, 3, 8.0, 0.005
#: Distinct words whose scores a task remembers.
REMEMBERED = 300_000
#: Words whose letter groups are worked on at once, and bytes of text labelled at once: they bound what a task holds besides its words.
AT_ONCE = 8192
SLICE = 2 << 20


def script_of(letter: str) -> str:
    at = bisect_right(FIRST, ord(letter)) - 1
    return SCRIPTS[at][1] if at >= 0 else "other"


NAMES = sorted({name for _, name in SCRIPTS} | {"other"})


def cells_of(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For every size of letter group, and for whole words, the cell at every letter of "<word>", and where words begin.

    A cell is -1 where no group of that size begins, so all sizes have the same letters.
    """
    marked = "<" + "><".join(words) + ">"
    points = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(len(points))
    mixed = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    cells, hashes = [], np.zeros(len(points), np.uint64)
    for size in range(1, max(GROUPS) + 1):
        held = np.zeros(len(points), np.uint64)
        held[:len(points) - size + 1] = mixed[size - 1:]
        hashes = (hashes ^ held ^ hashes >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        if size in GROUPS:
            cells.append(np.where(left >= size, (hashes >> np.uint64(64 - CELLS)).astype(np.int64), -1))
    place = (np.arange(len(points)) - np.repeat(starts, lengths)).astype(np.uint64)
    whole = np.add.reduceat((mixed ^ mixed >> np.uint64(32)) * (2 * place + np.uint64(1)), starts) * np.uint64(0xC2B2AE3D27D4EB4F)
    words_at = np.full(len(points), -1, np.int64)
    words_at[starts] = (whole ^ whole >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CELLS)
    return [*cells, words_at], starts


@dataclass
class Model:
    """Log-probabilities of the cells of letter groups for each language, and each script's languages."""

    languages: list[str]
    scores: np.ndarray
    scripts: dict[str, np.ndarray]


def fit(docs: DataFrame, modulus: int, remainder: int, sample: int = SAMPLE) -> Model:
    """The model of the labelled documents outside the held-out rows, of which a bounded sample by hash is read."""
    bound_batches(docs.sparkSession)
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(modulus, remainder)).select("doc_id", "text", "lang")
    chosen = bounded_sample(labelled, "lang", sample, "doc_id")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                words[lang.as_py()].update(WORD.findall(text.as_py().lower()))
        rows = []
        for lang, seen in words.items():
            known, times = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
            if not known:
                continue
            total = np.zeros(1 << CELLS)
            for at in range(0, len(known), AT_ONCE):
                cells, starts = cells_of(known[at:at + AT_ONCE])
                weight = np.repeat(times[at:at + AT_ONCE], np.diff(np.append(starts, len(cells[0]))))
                for c in cells:
                    total += np.bincount(c[c >= 0], weights=weight[c >= 0], minlength=1 << CELLS)
            rows += [(lang, int(cell), int(total[cell])) for cell in np.flatnonzero(total)]
            letters: Counter[str] = Counter()
            for word, n in seen.items():
                letters[script_of(word[0])] += n * len(word)
            rows += [(lang, -1 - NAMES.index(name), n) for name, n in letters.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["lang", "feature", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, feature bigint, n bigint")
    # as many rows come to the driver as there are cells and languages, whatever the sample's size
    found = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found.column(0).to_pylist()))
    place = {lang: i for i, lang in enumerate(languages)}
    lang = np.array([place[x] for x in found.column(0).to_pylist()], np.int64)
    feature, times = found.column(1).to_numpy(), found.column(2).to_numpy()
    counts, letters = np.zeros((len(languages), 1 << CELLS)), np.zeros((len(languages), len(NAMES)))
    cell = feature >= 0
    counts[lang[cell], feature[cell]] = times[cell]
    letters[lang[~cell], -1 - feature[~cell]] = times[~cell]
    counts[:, counts.sum(axis=0) < LEAST] = 0
    totals = counts.sum(axis=1, keepdims=True) + (counts.sum(axis=0) > 0).sum() + 1
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    scripts = {name: share[:, i] >= SCRIPT_SHARE for i, name in enumerate(NAMES)}
    return Model(languages, np.log((counts + 1) / totals).astype(np.float32), scripts)


class _Places(dict):
    """A word's row; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


class Words:
    """Scores and lengths of distinct words, remembered up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.narrowed = {name: ~allowed for name, allowed in model.scripts.items() if allowed.any() and not allowed.all()}
        self.forget()

    def forget(self) -> None:
        self.place = _Places()
        self.table = np.zeros((len(self.model.languages), 1 << 12), np.float32)
        self.letters = np.zeros(1 << 12, np.int64)

    def learn(self, words: list[str], start: int) -> None:
        """Enter the rows of new words, a bounded number at once."""
        for at in range(0, len(words), AT_ONCE):
            self._enter(words[at:at + AT_ONCE], start + at)

    def _enter(self, words: list[str], start: int) -> None:
        """The sum over the words' letter groups of the languages' log-probabilities, the best one's taken off."""
        cells, starts = cells_of(words)
        sums = np.zeros((len(self.model.languages), len(words)), np.float32)
        for at in cells:
            sums += np.add.reduceat(np.where(at >= 0, self.model.scores[:, at], np.float32(0)), starts, axis=1)
        if self.narrowed:
            scripts = np.array([script_of(word[0]) for word in words])
            for name, barred in self.narrowed.items():
                here = np.flatnonzero(scripts == name)
                sums[np.ix_(barred, here)] = sums[:, here].min(axis=0) - 50
        sums -= sums.max(axis=0)
        stop = start + len(words)
        if stop > self.table.shape[1]:
            more = max(stop, 2 * self.table.shape[1]) - self.table.shape[1]
            self.table = np.pad(self.table, ((0, 0), (0, more)))
            self.letters = np.pad(self.letters, (0, more))
        self.table[:, start:stop] = sums / len(GROUPS)
        self.letters[start:stop] = list(map(len, words))

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.place) > REMEMBERED:
            self.forget()
        known = len(self.place)
        rows = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if len(self.place) > known:
            self.learn(list(islice(self.place, known, None)), known)
        return rows


def best_paths(scores: np.ndarray, rows: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word of many texts, texts side by side: word t of all texts that have one in one step.

    ``scores`` has a row for each language; ``rows`` holds the words of all texts, one text after another, as its columns. A switch
    comes from the best language, so a step needs its place only, not all pairs of languages.
    """
    if not len(rows):
        return np.zeros(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    blocks = np.append(0, np.cumsum(active))
    # word t of a text stands in block t, texts in order of length
    step = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = blocks[step] + np.repeat(rank, lengths)
    gathered = np.empty((len(scores), len(rows)), np.float32)
    gathered[:, place] = scores[:, rows]
    stayed = np.empty(gathered.shape, bool)
    came = np.empty(len(rows), np.int8 if len(scores) < 128 else np.int32)
    state = np.zeros((len(scores), len(order)), np.float32)
    bounds = blocks.tolist()
    for t in range(longest):
        a, b = bounds[t], bounds[t + 1]
        held = state[:, :b - a]
        if t:
            jump = held.max(axis=0) - switch
            came[a:b] = held.argmax(axis=0)
            np.greater_equal(held, jump, out=stayed[:, a:b])
            np.maximum(held, jump, out=held)
        held += gathered[:, a:b]
    label = state.argmax(axis=0)
    labels = np.empty(len(rows), np.int64)
    for t in range(longest - 1, -1, -1):
        a, b = bounds[t], bounds[t + 1]
        now = label[:b - a]
        labels[a:b] = now
        if t:
            left = ~stayed[:, a:b][now, np.arange(b - a)]
            now[left] = came[a:b][left]
    return labels[place]


def _has_letter(word: str) -> bool:
    return word.isascii() or any(map(str.isalpha, word))


def words_of(text: str | None) -> list[str]:
    """Words in lower case: runs of letters and of numerals that are no digits, with a letter in them."""
    text = text or ""
    low = text.lower()
    found = WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]
    return found if text.isascii() else [w for w in found if _has_letter(w)]


def spans_of(text: str, labels: np.ndarray, languages: list[str]) -> list[tuple[int, int, str]]:
    """Runs of words with one label, from the first word's start to the last one's end."""
    if text.isascii() and (labels == labels[0]).all():
        start = WORD.search(text).start()
        end = len(text) - WORD.search(text[::-1]).start()
        return [(start, end, languages[labels[0]])]
    bounds = [m.span() for m in WORD.finditer(text) if _has_letter(m[0])]
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(bounds)]
    return [(bounds[a][0], bounds[b - 1][1], languages[labels[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def predict(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``docs`` with lang_pred, score and spans: the language of most letters, their share of all letters, the labelled stretches.

    ``und`` with score zero and no spans for a NULL text, one without letters, or a model of no languages. Ties go to the language
    first in name. Columns of these names are replaced; all other columns and all rows stay.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "spans")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*fields, "lang_pred string", "score double", "spans array<struct<start:int,end:int,lang:string>>"])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.scores, model.scripts))

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*held.value)
        remembered = Words(known)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = part.column(part.schema.names.index("text")).to_pylist()
                each = [words_of(t) if known.languages else [] for t in texts]
                flat = [w for ws in each for w in ws]
                rows = remembered(flat)
                lengths = np.array([len(ws) for ws in each], np.int64)
                labels = best_paths(remembered.table, rows, lengths, switch)
                letters = remembered.letters[rows]
                names, scores, spans, at = [], [], [], 0
                for text, n in zip(texts, lengths.tolist(), strict=True):
                    if not n:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        spans.append([])
                        continue
                    own = labels[at:at + n]
                    share = np.bincount(own, weights=letters[at:at + n], minlength=len(known.languages))
                    top = int(share.argmax())
                    names.append(known.languages[top])
                    scores.append(float(share[top] / share.sum()))
                    spans.append(spans_of(text, own, known.languages))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                     pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in s] for s in spans], span)],
                    names=[*part.schema.names, "lang_pred", "score", "spans"])

    return docs.mapInArrow(label, schema)
