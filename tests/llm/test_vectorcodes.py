"""Vector codes against brute force and against SQL; odd vectors."""

import hashlib
import math

import numpy as np
import pytest
from oracle import compare, connect
from plumbline.llm import vectorcodes
from plumbline.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size, scale", [(8, 500), (1, 3), (3, 40), (2, 60_000_000)])
def test_nearest_like_brute_force(size, scale):
    rng = np.random.default_rng(5)
    books = rng.normal(0, scale, (8, 16, size)).astype(np.int64)
    books[0, 3] = books[0, 7]  # equals: the lower index
    if scale > vectorcodes.PLAIN:
        books = books.astype(object)
    grid = vectorcodes.Grid(books)
    for _ in range(2):
        parts = rng.normal(0, scale, (500, 8, size)).astype(np.int64)
        parts[5, 0] = books[0, 7]
        index, distance = grid.nearest(parts)
        every = ((parts.astype(object)[:, :, None, :] - books.astype(object)) ** 2).sum(axis=3)
        assert (index == every.argmin(axis=2)).all() and (distance == every.min(axis=2)).all()
        assert index[5, 0] <= 3


def test_clashing_hashes_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    books, parts = rng.integers(-900, 900, (8, 16, 4)), rng.integers(-900, 900, (300, 8, 4))
    plain = vectorcodes.Grid(books).nearest(parts)
    cells = vectorcodes.part_cells
    monkeypatch.setattr(vectorcodes, "part_cells", lambda p, s: (cells(p, s)[0], cells(p, s)[1] % np.uint64(5)))
    grid = vectorcodes.Grid(books)
    for _ in range(2):
        assert all((a == b).all() for a, b in zip(plain, grid.nearest(parts), strict=True))


def test_full_cache_changes_nothing(monkeypatch):
    rng = np.random.default_rng(7)
    books, parts = rng.integers(-900, 900, (8, 16, 4)), rng.integers(-900, 900, (300, 8, 4))
    plain = vectorcodes.Grid(books).nearest(parts)
    monkeypatch.setattr(vectorcodes, "KEPT_CELLS", 10)
    grid = vectorcodes.Grid(books)
    assert all((a == b).all() for a, b in zip(plain, grid.nearest(parts), strict=True))
    assert len(grid.coordinates) == 10


def by_hand(rows, rounds=6):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0]))
    size = len(kept[0][1]) // 8
    parts = [[[math.floor(4096 * x) for x in r[1][p * size:(p + 1) * size]] for p in range(8)] for r in kept]
    books = [[parts[i][p] for i in range(min(16, len(kept)))] for p in range(8)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            members = {}
            for x in parts:
                members.setdefault(near(x[p], books[p])[1], []).append(x[p])
            books[p] = [[sum(c) // len(c) for c in zip(*members[i], strict=True)] if i in members else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    found = [[near(x[p], books[p]) for p in range(8)] for x in parts]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for r, e in zip(kept, errors, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    return sorted((r[0], "".join(f"{i:02x}" for _, i in f), e, sums[r[2]], digest) for r, f, e in zip(kept, found, errors, strict=True))


def test_codes_like_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.2, 16).tolist(), None if i % 7 == 0 else i % 3) for i in range(3, 60)]
    rows += [(0, None, 1), (1, [1.0] * 15 + [None], 1), (2, [1.0] * 15 + [float("nan")], 1), (61, [float("-inf")] * 16, 2), (62, rows[5][1], 2)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, code string, other int").repartition(5)
    assert sorted(tuple(r) for r in vectorcodes.codes(df).collect()) == by_hand(rows)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    make = lambda rows: vectorcodes.codes(spark.createDataFrame(rows, schema)).collect()
    assert make([]) == [] and make([(1, None, 1)]) == [] and make([(1, [1.0, 2.0], 1)]) == []
    few = make([(5, [0.5] * 8, None), (5, [0.5] * 8, None), (None, [0.25] * 8, 3), (9, [1.0] * 16, 3)])  # another length is left out
    assert sorted((r.vec_id or -1, r.error) for r in few) == [(-1, 0), (5, 0), (5, 0)]
    huge = make([(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1), (3, [0.0] * 8, 1)])
    assert len(huge) == 3 and {r.error for r in huge} == {0}
    assert [r.code for r in make([(1, [], 1)])] == ["00" * 8]


def test_query_like_sql(spark):
    equal, message = compare(QUERIES["op11_vector_codes"](spark, SMALL), connect(SMALL), ORACLES["op11_vector_codes"])
    assert equal, message
