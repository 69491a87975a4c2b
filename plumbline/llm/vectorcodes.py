"""Vector codes by parts: whole-number codebooks fitted over all vectors, nearest entries through memoised grid cells.

A vector is cut into equal parts, and a part is given the index of the nearest entry of its position's codebook. Space is cut into
boxes by a grid. The first part to fall into a box has the box's distances worked out: the least and the greatest squared distance
from any point of the box to each entry. An entry whose least distance is beyond another's greatest one is dominated: no point of
the box has it as its nearest. The entries left are kept with the box, found again by a hash of its coordinates, and only they
are evaluated for the parts in it. Coordinates are compared after the look-up, so a clash of hashes costs time and changes nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are worked on as 64-bit numbers below this; parts and entries beyond it take exact Python numbers.
PLAIN = 1 << 26
#: Boxes a task keeps. Parts in further boxes are evaluated the same way, their boxes are worked out again.
KEPT_CELLS = 1 << 17
#: Vectors worked on at a time hold about this many components.
SLICE = 1 << 18
#: A sum travels in limbs of so many bits, so it is exact at any size.
LIMB = 30
#: Labels whose sums may be handed to all tasks: 16 bytes each.
FEW_LABELS = 200_000
GREATEST = (1 << 63) - 1

CODED = "vec_id bigint, label {label}, code string, error bigint"
_MIX = np.uint64(0xD6E8FEB86659FD93)


def whole(x: float) -> int:
    """floor(SCALE * x), exactly."""
    return math.floor(x * SCALE) if abs(x) < 2.0 ** 52 else int(x) * SCALE


def whole_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, numbers): which rows hold usable vectors, and their components as whole numbers, one row each.

    Out go NULL vectors, those with a NULL or non-finite component, and those of another length than ``width``.
    """
    column = column.cast(pa.large_list(pa.float64()))
    sizes = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    # NULL components come as NaN
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = values.reshape(len(rows), width)
    sound = np.isfinite(values).all(axis=1)
    rows, values = rows[sound], values[sound]
    if not values.size or np.abs(values).max() * SCALE < PLAIN:
        return rows, np.floor(values * SCALE).astype(np.int64)
    return rows, np.array([[whole(x) for x in v] for v in values.tolist()], object).reshape(values.shape)


def part_cells(parts: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, hash) of the grid cell of every part; ``parts`` is (vectors, positions, components)."""
    cells = parts >> shift
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        h = (h ^ cells[:, :, k].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return cells, h


class Grid:
    """Nearest entries of one set of codebooks, an array of (positions, entries, components)."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.plain = books.dtype != object
        # Boxes about half as wide as the components spread: narrower ones are seldom met twice, wider ones leave every entry possible.
        spread = float(books.std(axis=1).mean()) / 2 if self.plain and books.size else 0.0
        self.shift = round(math.log2(spread)) if spread >= 1 else 0
        self.row_of: dict[int, int] = {}
        self.coordinates = np.zeros((0, books.shape[2] + 1), np.int64)
        self.possible = np.zeros((0, books.shape[1]), bool)

    def _work_out(self, position: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Which entries some point of each box may be nearest to."""
        low = (cells << self.shift)[:, None, :]
        high = low + ((1 << self.shift) - 1)
        entries = self.books[position]
        inside = np.maximum(np.maximum(low - entries, entries - high), 0)
        outside = np.maximum(np.abs(entries - low), np.abs(entries - high))
        least, greatest = (inside ** 2).sum(axis=2), (outside ** 2).sum(axis=2)
        return least <= greatest.min(axis=1)[:, None]

    def _entries_of(self, position: np.ndarray, cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """For each part the entries its box leaves, from the kept boxes or worked out now."""
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        wanted = np.column_stack((position[first], cells[first]))
        rows = np.fromiter((self.row_of.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        found = np.zeros((len(distinct), self.books.shape[1]), bool)
        known = rows >= 0
        known[known] = (self.coordinates[rows[known]] == wanted[known]).all(axis=1)
        found[known] = self.possible[rows[known]]
        new = np.flatnonzero(~known)
        if len(new):
            found[new] = self._work_out(wanted[new, 0], wanted[new, 1:])
            keep = new[rows[new] < 0][:max(0, KEPT_CELLS - len(self.coordinates))]
            self.row_of.update(zip(distinct[keep].tolist(), range(len(self.coordinates), len(self.coordinates) + len(keep)), strict=True))
            self.coordinates = np.concatenate((self.coordinates, wanted[keep]))
            self.possible = np.concatenate((self.possible, found[keep]))
        found = found[of]
        # A box is known by its first part's coordinates; parts of another box under the same hash may be nearest to any entry.
        found[(wanted[of, 1:] != cells).any(axis=1) | (wanted[of, 0] != position)] = True
        return found

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every part, the lower index of equals."""
        n, positions, size = parts.shape
        if not size or not self.plain or parts.dtype == object:
            d = ((parts.astype(object)[:, :, None, :] - self.books.astype(object)) ** 2).sum(axis=3) if size else np.zeros((n, positions, self.books.shape[1]), np.int64)
            index = np.argmin(d, axis=2)
            return index, np.take_along_axis(d, index[:, :, None], axis=2)[:, :, 0]
        cells, hashes = part_cells(parts, self.shift)
        position = np.tile(np.arange(positions), n)
        possible = self._entries_of(position, cells.reshape(-1, size), hashes.ravel())
        part, entry = np.nonzero(possible)
        d = np.full(possible.shape, GREATEST, np.int64)
        d[part, entry] = ((parts.reshape(-1, size)[part] - self.books[position[part], entry]) ** 2).sum(axis=1)
        index = np.argmin(d, axis=1)
        return index.reshape(n, positions), d[np.arange(len(d)), index].reshape(n, positions)


def _book_array(books: list) -> np.ndarray:
    plain = all(abs(x) < PLAIN for b in books for e in b for x in e)
    return np.array(books, np.int64 if plain else object)


def _slices(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, SLICE // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list:
    """[position][entry][component]: the parts of the ``entries`` least kept vec_ids.

    Equal vec_ids stand in the order of their vectors, NULL ones after all others. The length of the least one's vector is the table's;
    without a vector, or with a length that ``parts`` doesn't divide, there are no books.
    """
    sound = F.expr("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    kept = vectors.where(sound)
    order = [F.asc_nulls_last("vec_id"), "embedding"]
    first = kept.orderBy(*order).select("embedding").limit(1).collect()
    if not first or len(first[0][0]) % parts:
        return []
    width = len(first[0][0])
    rows = kept.where(F.size("embedding") == width).orderBy(*order).select("embedding").limit(entries).collect()
    size = width // parts
    return [[[whole(x) for x in r[0][p * size:(p + 1) * size]] for r in rows] for p in range(parts)]


def next_books(vectors: DataFrame, books: list) -> list:
    """One round: every part goes to its nearest entry, every entry to the floor of its parts' mean; unused entries stay.

    A task hands on its sums per position, entry and component; they are added up before the driver sees them.
    """
    held = _book_array(books)
    positions, entries, size = held.shape

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid(held)
        counts = np.zeros((positions, entries), np.int64)
        sums = np.zeros((positions, entries, size), object)
        for batch in _slices(batches, positions * size):
            _, numbers = whole_vectors(batch.column(0), positions * size)
            parts = numbers.reshape(len(numbers), positions, size)
            index, _ = grid.nearest(parts)
            for p in range(positions):
                counts[p] += np.bincount(index[:, p], minlength=entries)
                part = np.zeros((entries, size), parts.dtype)
                np.add.at(part, index[:, p], parts[:, p])
                sums[p] += part.astype(object)
        rows = [(p, e, -1, 0, int(counts[p, e])) for p in range(positions) for e in range(entries) if counts[p, e]]
        for p, e, k in zip(*np.nonzero(sums), strict=True):
            left, sign, limb = abs(int(sums[p, e, k])), 1 if sums[p, e, k] > 0 else -1, 0
            while left:
                rows.append((int(p), int(e), int(k), limb, sign * (left & ((1 << LIMB) - 1))))
                left, limb = left >> LIMB, limb + 1
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["p", "e", "k", "limb", "value"])

    added = vectors.select("embedding").mapInArrow(add, "p bigint, e bigint, k bigint, limb bigint, value bigint")
    totals: dict[tuple[int, int, int], int] = {}
    for row in added.groupBy("p", "e", "k", "limb").agg(F.sum("value").alias("value")).collect():
        key = (row["p"], row["e"], row["k"])
        totals[key] = totals.get(key, 0) + (row["value"] << LIMB * row["limb"])
    return [[[totals.get((p, e, k), 0) // totals[p, e, -1] for k in range(size)] if (p, e, -1) in totals else old
             for e, old in enumerate(book)] for p, book in enumerate(books)]


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list:
    """Codebooks over all kept vectors, [position][entry][component]; what comes to the driver has the size of the books."""
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books else 0):
        books = next_books(vectors, books)
    return books


def books_digest(books: list) -> str:
    """SHA-256 of all components in decimal by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def assign(vectors: DataFrame, books: list) -> DataFrame:
    """vec_id, label, code, error of the kept vectors.

    ``code`` has two hex digits for each part; ``error`` is the sum of the parts' squared distances, the greatest BIGINT where it is larger.
    """
    schema = CODED.format(label=vectors.schema["label"].dataType.simpleString())
    if not books:
        return vectors.sparkSession.createDataFrame([], schema)
    held = _book_array(books)
    positions, _, size = held.shape

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid(held)
        for batch in _slices(batches, positions * size):
            rows, numbers = whole_vectors(batch.column(2), positions * size)
            index, distance = grid.nearest(numbers.reshape(len(numbers), positions, size))
            codes = [c.tobytes().hex() for c in index.astype(np.uint8)]
            errors = [min(GREATEST, int(e)) for e in distance.astype(object).sum(axis=1)]
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                names=["vec_id", "label", "code", "error"])

    return vectors.select(F.col("vec_id").cast("bigint"), "label", "embedding").mapInArrow(code, schema)


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: every kept vector's code against codebooks fitted over all of them.

    One row for every kept input row, repeated rows included. A vector that is NULL or has a NULL or non-finite component is left out, and
    so is one of another length than the vector of the least vec_id. Vectors of no components have code 00 for every part. NULL
    labels count together; a sum beyond BIGINT is its greatest value. An empty table, or one without usable vectors, gives no row.
    """
    books = fit(vectors, parts, entries, rounds)
    coded = settle(assign(vectors, books))
    sums = coded.groupBy("label").agg(F.coalesce(F.expr("try_sum(error)"), F.lit(GREATEST)).alias("label_error"))
    sums = settle(sums.withColumnRenamed("label", "other"))
    # A label's sum is one row, so copying the sums is cheap where labels are few; beyond, Spark splits a label that holds too many rows.
    sums = F.broadcast(sums) if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS else sums
    return coded.join(sums, coded.label.eqNullSafe(sums.other)).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL, by comparing every part with every entry."""
    nearest = """SELECT rn, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT x.rn, x.p, b.e, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d FROM parts x JOIN books{r} b USING (p, k) GROUP BY ALL) GROUP BY rn, p"""
    steps = "".join(f"""
near{r} AS (SELECT rn, p, e FROM ({nearest.format(r=r)})),
means{r} AS (SELECT p, e, k, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM parts JOIN near{r} USING (rn, p) GROUP BY ALL),
books{r + 1} AS (SELECT b.p, b.e, b.k, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, b.v) AS v FROM books{r} b LEFT JOIN means{r} USING (p, e, k)),""" for r in range(rounds))
    return f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT rn, (i - 1) // (w // {parts}) AS p, (i - 1) % (w // {parts}) AS k, floor(x::DOUBLE * {SCALE})::BIGINT AS v
  FROM (SELECT rn, len(embedding) AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept)),
books0 AS (SELECT p, rn - 1 AS e, k, v FROM parts WHERE rn <= {entries}),{steps}
last AS ({nearest.format(r=rounds)}),
coded AS (SELECT rn, lower(string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p)) AS code, sum(d)::BIGINT AS error FROM last GROUP BY rn),
told AS (SELECT vec_id, label, code, error FROM kept JOIN coded USING (rn)),
sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM told GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, k)) FROM books{rounds}) AS codebooks_sha256
FROM told JOIN sums ON told.label IS NOT DISTINCT FROM sums.label"""
