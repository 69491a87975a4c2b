"""Benchmark passages in documents, by counting shared q-grams along diagonals.

Texts are compared without case, punctuation and spacing. Items are cut into overlapping windows, so close together that an excerpt of a
window's length from anywhere in an item lies within a window's edits of one. A window of m bytes that occurs with
k edits shares m - q + 1 - kq of its q-grams with the place, all on diagonals within k of each other; so counts in bands of
diagonals, overlapping by half, that stay below this bound rule a place out. What is left is aligned inside its band.

Documents stay where they are: items come to them as an index of bounded size, in several passes where there are many.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices

#: Bytes in a q-gram; bytes of a window and from one to the next; bytes of a window for each edit allowed.
GRAM, WINDOW, STEP, BYTES_AN_EDIT = 12, 96, 8, 16
#: Bytes of items indexed at once; the index has about 85 times as many.
BLOCK_BYTES = 1 << 18
SLICE = 2 << 20

KEPT_BYTES = bytes(i if i == 0 or i >= 128 or chr(i).isalnum() else 32 for i in range(256))
HIT_SCHEMA = "doc_id bigint, item_id bigint, n_windows int, edits int, start int, end int"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normalized(text: str) -> np.ndarray:
    """Bytes of the text in lower case, every stretch of ASCII characters other than letters and digits as one space."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(KEPT_BYTES), np.uint8)
    blank = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return data[keep]


def code_points(text: str) -> list[int]:
    """For every byte of the normalized text, the place in the text of the character it comes from."""
    places, blank = [], False
    for i, character in enumerate(text):
        for byte in character.lower().encode("utf-8", "surrogatepass").translate(KEPT_BYTES):
            if byte != 32 or not blank:
                places.append(i)
            blank = byte == 32
    return places


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every run of GRAM bytes."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint16) | data[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    n = len(data) - GRAM + 1
    h = eight[:n] * _A ^ four[8:8 + n] * _B
    return (h ^ h >> np.uint64(29)) * _B


@dataclass
class Index:
    """Windows of a block of items and the q-grams in them."""

    items: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    edits: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    bounds: np.ndarray
    windows: np.ndarray
    places: np.ndarray
    present: np.ndarray


def index_of(rows: Iterable[tuple[int, str]]) -> Index | None:
    """The index of some items. Items of fewer than GRAM normalized bytes match nothing."""
    items, windows = [], []
    for item, text in rows:
        data = normalized(text or "")
        inner = np.flatnonzero(data != 32)
        data = data[inner[0]:inner[-1] + 1] if len(inner) else data[:0]
        if len(data) < GRAM:
            continue
        starts = [*range(0, max(1, len(data) - WINDOW), STEP), max(0, len(data) - WINDOW)]
        for start in sorted(set(starts)):
            items.append(item)
            windows.append(data[start:start + WINDOW])
    if not windows:
        return None
    lengths = np.array([len(w) for w in windows])
    edits = np.minimum(lengths // BYTES_AN_EDIT, (lengths - GRAM) // GRAM)
    patterns = np.zeros((len(windows), WINDOW), np.uint8)
    for row, window in zip(patterns, windows, strict=True):
        row[:len(window)] = window
    hashes = [gram_hashes(w) for w in windows]
    each = np.concatenate(hashes)
    order = np.argsort(each, kind="stable")
    grams, first = np.unique(each[order], return_index=True)
    owner = np.repeat(np.arange(len(windows), dtype=np.int32), [len(h) for h in hashes])[order]
    place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes])[order]
    bits = max(16, int(32 * len(grams)).bit_length())
    present = np.zeros(1 << bits, bool)
    present[grams >> np.uint64(64 - bits)] = True
    return Index(np.array(items), patterns, lengths, edits, lengths - GRAM + 1 - edits * GRAM, grams, np.append(first, len(each)), owner, place, present)


def _dense(places: np.ndarray, count: int, reach: int) -> np.ndarray:
    """Those of the sorted places that are among ``count`` within ``reach`` of each other."""
    if len(places) < count:
        return places[:0]
    full = places[count - 1:] - places[:len(places) - count + 1] <= reach
    covered = np.zeros(len(places) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(full), 1)
    np.add.at(covered, np.flatnonzero(full) + count, -1)
    return places[np.cumsum(covered[:-1]) > 0]


def candidates(data: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(window, lowest diagonal): bands with as many shared q-grams as an occurrence within the window's edits must have."""
    hashes = gram_hashes(data)
    bits = len(index.present).bit_length() - 1
    places = np.flatnonzero(index.present[hashes >> np.uint64(64 - bits)])
    places = _dense(places, int(index.least.min()), WINDOW + int(index.edits.max()))
    at = np.searchsorted(index.grams, hashes[places])
    at = np.minimum(at, len(index.grams) - 1)
    true = index.grams[at] == hashes[places]
    places, at = places[true], at[true]
    sizes = index.bounds[at + 1] - index.bounds[at]
    entries = np.repeat(index.bounds[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    window, diagonal = index.windows[entries], np.repeat(places, sizes) - index.places[entries]
    step = index.edits[window] + 1
    band = diagonal // step
    window, band = np.concatenate((window, window)), np.concatenate((band, band - 1))
    order = np.lexsort((band, window))
    window, band = window[order], band[order]
    first = np.flatnonzero(np.append(True, (np.diff(window) != 0) | (np.diff(band) != 0))[:len(window)])
    many = np.diff(np.append(first, len(window))) >= index.least[window[first]]
    window, band = window[first][many], band[first][many]
    return window, band * (index.edits[window] + 1)


def align(data: np.ndarray, index: Index, window: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end): for every band, the least edits of its window against the data inside the band, and where it ends."""
    if not len(window):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length, step = index.lengths[window], index.edits[window] + 1
    wide = int(2 * step.max())
    offset = np.arange(wide)
    outside = offset[None, :] >= (2 * step)[:, None]
    large = WINDOW * 4
    row = np.where(outside, large, 0)
    done, end = np.full(len(window), large), np.zeros(len(window), np.int64)
    for i in range(1, int(length.max()) + 1):
        at = low[:, None] + offset[None, :] + i - 1
        inside = (at >= 0) & (at < len(data))
        same = inside & (data[np.clip(at, 0, len(data) - 1)] == index.patterns[window, i - 1][:, None])
        skipped = np.concatenate((row[:, 1:], np.full((len(row), 1), large)), axis=1) + 1
        row = np.minimum(row + ~same, skipped)
        row = np.where(outside, large, np.minimum.accumulate(row - offset, axis=1) + offset)
        ended = length == i
        if ended.any():
            best = row[ended].argmin(axis=1)
            done[ended], end[ended] = row[ended, best], low[ended] + best + i
    return done, end


def matches(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(text number, item, windows, edits, first byte, last byte) of every item in every text, in normalized bytes."""
    data = [normalized(t) for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    # a match that went on from one text into the next would have to skip more bytes than any window may
    apart = int(index.edits.max()) + 1
    starts = np.cumsum(sizes + apart) - sizes - apart
    joined = np.zeros(int(sizes.sum()) + apart * len(data), np.uint8)
    for start, part in zip(starts.tolist(), data, strict=True):
        joined[start:start + len(part)] = part
    window, low = candidates(joined, index)
    edits, end = align(joined, index, window, low)
    good = edits <= index.edits[window]
    window, edits, end = window[good], edits[good], end[good]
    text = np.searchsorted(starts, end - 1, side="right") - 1
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for t, w, cost, stop in zip(text.tolist(), window.tolist(), edits.tolist(), end.tolist(), strict=True):
        if (t, w) not in best or (cost, stop) < best[t, w]:
            best[t, w] = (cost, stop)
    found: dict[tuple[int, int], list[int]] = {}
    for (t, w), (cost, stop) in best.items():
        first, last = max(0, stop - int(index.lengths[w]) - int(starts[t])), stop - int(starts[t])
        held = found.setdefault((t, int(index.items[w])), [0, 0, first, last])
        held[:] = [held[0] + 1, held[1] + cost, min(held[2], first), max(held[3], last)]
    return [(t, item, *held) for (t, item), held in sorted(found.items())]


def indexes(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes of blocks of items, by a hash of the item; each block has about ``block_bytes`` at most."""
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        index = index_of(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
        if index:
            yield index


def _plain(index: Index) -> tuple:
    return tuple(getattr(index, name) for name in Index.__dataclass_fields__)


def hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, windows found, their edits, and the span (code points) they cover: one row for each item in a row of ``docs``.

    NULL and empty texts and items match nothing. Repeated rows of ``docs`` give repeated hits; equal items each give theirs.
    An item spread over a text in pieces gives one row from its first piece to its last.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    found = docs.sparkSession.createDataFrame([], HIT_SCHEMA)
    for index in indexes(benchmark, block_bytes):
        found = found.unionByName(_hits(texts, index))
    return found


def _hits(texts: DataFrame, index: Index) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(_plain(index))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(*held.value)
        names = [f.split(" ")[0] for f in HIT_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                keys, words = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for t, item, n, edits, first, last in matches(words, known):
                    places = code_points(words[t])
                    rows.append((keys[t], item, n, edits, places[first], places[min(last, len(places)) - 1] + 1))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return texts.mapInArrow(scan, HIT_SCHEMA)


def without_hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose texts hold no part of an item, all columns as they are."""
    for index in indexes(benchmark, block_bytes):
        docs = _without(docs, index)
    return docs


def _without(docs: DataFrame, index: Index) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(_plain(index))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(*held.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = [t or "" for t in part.column(part.schema.names.index("text")).to_pylist()]
                keep = np.ones(len(texts), bool)
                keep[[row[0] for row in matches(texts, known)]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)
