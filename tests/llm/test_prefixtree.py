"""The n-gram join against brute force and against SQL: small families, large ones dealt out, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect
from plumbline.llm import prefixtree
from plumbline.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def slow_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def slow_components(rows):
    sets = [slow_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("text", ["", " \t\n", "a", "A b c d", "a b c d e", "One two one two one two one two", "é È\x0bB c\xa0d e f g", "x " * 3000])
def test_sets(text):
    found = prefixtree.Shingles().of([prefixtree.normal(text)])[0]
    assert len(found) == len(slow_set(text))
    assert (found == prefixtree.Shingles().of([b"zz yy", prefixtree.normal(text), b"", b"q"])[1]).all()


def test_sets_of_a_long_text_in_pieces(monkeypatch):
    random.seed(2)
    texts = [" ".join(random.choices(["aa", "b", "cccc", "dd", "e"], k=n)) for n in (5, 37, 400, 401, 402, 403, 404, 405)]
    whole = [prefixtree.Shingles().of([t.encode()])[0] for t in texts]
    monkeypatch.setattr(prefixtree, "PIECE_BYTES", 50)
    for text, found in zip(texts, whole, strict=True):
        assert (prefixtree.Shingles().of_one(text.encode()) == found).all()
    assert all((a == b).all() for a, b in zip(prefixtree.shingle_sets(texts, prefixtree.Shingles()), whole, strict=True))


def sample():
    """Texts around the limit, copies, shared passages, chains."""
    random.seed(4)
    word = lambda: "".join(random.choices("abcdefghij", k=4))
    passages = [" ".join(word() for _ in range(40)) for _ in range(3)]
    rows = []
    for changes in (0, 1, 2, 3, 4, 5, 6):
        for length in (5, 12, 90):
            base = [word() for _ in range(length)]
            rows.append(" ".join(base))
            for _ in range(4):
                for place in random.sample(range(length), min(changes, length)):
                    base[place] = word()  # a chain: each copy differs from the one before
                rows.append(" ".join(base).title())
    rows += [f"{word()} {p} {word()}" for p in passages for _ in range(6)]
    rows += [f"{passages[0]} {passages[i % 3]} {word()}" for i in range(9)]
    rows += ["", None, " \n ", "one", "one", "two words", "Two  words", "one"]
    rows = [(3 * i % 1009, t) for i, t in enumerate(rows)]
    return [*rows, rows[3], (None, rows[0][1]), (None, "alone with no name at all here")]


@pytest.mark.parametrize("sizes", [{}, {"family": 3}, {"family": 2, "family_tokens": 50, "block_bytes": 300, "bucket_bytes": 2000, "hot": 2}])
def test_components_like_brute_force(spark, sizes):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'x' AS key", "2 AS component_id", "3 AS n", "4 AS tokens")
    found = prefixtree.like_components(df.repartition(3), **sizes).collect()
    assert sorted((tuple(r) for r in found), key=str) == slow_components(rows)


def test_empty_table(spark):
    assert prefixtree.like_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("values", [[], [0], [0] * 300, [5], [255, 256], [0, 1 << 63, 2 ** 64 - 1], list(range(7, 30000, 3)), [1] * 5000 + [1 << 40]])
def test_packed_numbers_come_back(values):
    values = np.array(values, np.uint64)
    assert (prefixtree.unpack(prefixtree.pack(values)) == values).all() and len(prefixtree.unpack(prefixtree.pack(values))) == len(values)
    assert (prefixtree.unpack_sorted(prefixtree.pack_sorted(np.sort(values))) == np.sort(values)).all()
    kinds = np.random.default_rng(5).choice(np.array([4, 9, 255], np.uint64), len(values))
    ordered = np.unique(kinds << np.uint64(56) | values >> np.uint64(8))
    assert (prefixtree.unpack_set(prefixtree.pack_set(ordered)) == ordered).all()


def test_bytes_on_their_way(spark):
    """What is sent for each shingle, and what its set keeps of it, in bytes: 10 and 8 would be over the disk's limit."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 56, 500).astype(np.uint64)) for _ in range(400)]
    sent = prefixtree._block_rows(0, list(range(400)), sets, 8)
    assert sum(sent.column(c).nbytes for c in range(2, 5)) < 7.5 * sum(map(len, sets))
    words = [[f"w{n}x{i}" for i in range(400)] for n in range(15)]
    rows = [(10 * n + k, " ".join(w[:396] + [f"{k}y{n}"] + w[397:])) for n, w in enumerate(words) for k in range(2)]
    kept = prefixtree.marked_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).where("tokens IS NOT NULL").collect()
    assert [r.shared for r in kept] == [len(prefixtree.unpack_set(r.tokens)) for r in kept] == [392] * 30
    written = [len(pa.compress(t, codec="lz4_raw", asbytes=True)) for t in (b"".join(bytes(r.tokens) for r in kept), b"".join(s.tobytes() for s in sets))]
    assert written[0] < 3 * 392 * 30 and written[1] > 7.5 * sum(map(len, sets))  # as shuffles compress; plain hashes stay about as they are


def test_tree_leaves_connected_crowds():
    """A crowd of like sets is linked by about as many links as it has members, in either role."""
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(1 << 40, 300, replace=False).astype(np.uint64))
    sets = [np.sort(np.append(np.delete(base, rng.integers(0, 300, 3)), rng.integers(1 << 41, 1 << 42, 3).astype(np.uint64))) for _ in range(300)]
    links = prefixtree.family_links([(i, len(s), s, i, True, True) for i, s in enumerate(sets)])
    assert len(links) == 299
    walked = prefixtree.family_links([(i, len(s), s, 0 if i < 250 else i, i > 5, i >= 250) for i, s in enumerate(sets)])
    assert len(walked) == 50


def test_query_like_sql(spark):
    equal, message = compare(QUERIES["op13_ngram_join"](spark, SMALL), connect(SMALL), ORACLES["op13_ngram_join"])
    assert equal, message
