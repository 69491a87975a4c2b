"""Fingerprints, links, components and repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from plumbline.llm import simhash, suffixes
from plumbline.llm.components import components


def slow_fingerprint(text):
    words = text.encode().lower().split()
    pieces = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", " \n", "a", "A b", "a b c", "x y z " * 50, "é È\x0bB c\xa0d e", "one two three four five"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("crowded", [1000, 3])
def test_links_connect_what_brute_force_connects(spark, crowded):
    random.seed(3)
    marks = {random.getrandbits(64) for _ in range(80)}
    for base in list(marks)[:25]:
        for _ in range(25):
            for _ in range(random.randrange(1, 5)):
                base ^= 1 << random.randrange(64)
            marks.add(base)
    marks = sorted(marks)
    parent = {m: m for m in marks}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(marks):
        for b in marks[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    links = simhash.links(spark.createDataFrame([(signed(m),) for m in marks], "fp long"), crowded)
    assert all(((r.a ^ r.b) & (2 ** 64 - 1)).bit_count() <= 3 for r in links.collect())
    roots = {r.node: r.root for r in components(links, "a", "b").collect()}
    mine, true = {}, {}
    for m in marks:
        mine.setdefault(roots.get(signed(m), signed(m)), set()).add(m)
        true.setdefault(root(m), set()).add(m)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, true.values()))


def test_components_of_a_long_path(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(500, 500), (600, None), (700, 701), (701, 700)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert all(found[i] == 0 for i in range(101))
    assert found[701] == 700 and 500 not in found


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, "same words stand here"), (9, "SAME words stand  here"), (7, None), (3, ""), (8, "other text altogether, nothing shared"), (5, "same words stand here"),
            (None, "same words stand here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS fingerprint")
    found = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in found) == [(-1, 5), (3, 3), (5, 5), (5, 5), (7, 3), (8, 8), (9, 5)]
    assert {r.fingerprint for r in found if r.doc_id in (3, 7)} == {"0" * 16}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [64, 4])
def test_likeness_groups(spark, crowded):
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    bases = [[word() for _ in range(300)] for _ in range(30)]
    rows = []
    for i, base in enumerate(bases):
        for _ in range(6):
            copy = list(base)
            for _ in range(3):  # about 0.9 alike
                copy[random.randrange(300)] = word()
            rows.append((len(rows) * 2, " ".join(copy), i))
    rows += [(1, None, -1), (3, "", -1), (None, " ".join(bases[0]), -2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int")
    found = {r.doc_id: r.component_id for r in simhash.like_groups(df, crowded=crowded).collect()}
    linked = sum(found[d] == min(x for x, _, c in rows if c == b) for d, _, b in rows if b >= 0)
    assert linked >= 0.9 * 180
    assert len({found[d] for d, _, b in rows if b >= 0}) >= 30  # none of different bases
    assert found[1] == found[3] == 1


def likeness(a, b):
    x, y = (set(simhash.shingle_set(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("crowded", [64, 2])
def test_likeness_groups_like_brute_force(spark, crowded):
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    texts = []
    for changes in range(2, 10):  # likeness around the limit: 0.93 to 0.68
        for _ in range(8):
            base = [word() for _ in range(250)]
            texts.append(" ".join(base))
            for _ in range(4):
                copy = list(base)
                for place in random.sample(range(250), changes):
                    copy[place] = word()
                texts.append(" ".join(copy))
    edges = [(i, j) for b in range(0, len(texts), 5) for i in range(b, b + 5) for j in range(i) if j >= b and likeness(texts[i], texts[j]) >= 0.8]
    expected = list(range(len(texts)))
    for _ in range(5):
        for i, j in edges:
            expected[i] = expected[j] = min(expected[i], expected[j])
    assert 0 < sum(likeness(texts[b], texts[b + 1]) < 0.8 for b in range(0, len(texts), 5)) < 64
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.like_groups(df, crowded=crowded).collect()}
    assert [found[i] for i in range(len(texts))] == expected


@pytest.mark.parametrize("crowded", [2000, 3])
def test_one_entry_of_many_groups_loses_no_link(spark, crowded):
    """Forty pairs, alike in themselves only, under one key: more groups than any number of rounds would peel."""
    random.seed(12)
    texts = []
    for _ in range(40):
        base = ["".join(random.choices("abcdefghij", k=5)) for _ in range(60)]
        texts += [" ".join(base), " ".join([*base, "more"])]
    sets = [simhash.shingle_set(t) for t in texts]
    rows = [(i, i, bytes(simhash.xxhash.xxh3_128_digest(s.tobytes())), len(s), simhash.wide_fingerprint(s).view(np.int64).tolist(), [7]) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, least long, key binary, n int, wide array<long>, entries array<long>")
    docs = spark.createDataFrame([*enumerate(texts), (4, "another text of that document")], "doc_id long, text string")
    found = {frozenset((r.a, r.b)) for r in simhash.like_links(nodes, docs, crowded=crowded).collect()}
    assert found == {frozenset((i, i + 1)) for i in range(0, 80, 2)}


def test_keys_of_alike_sets_meet():
    rng = np.random.default_rng(4)
    for common, own in ((4, 1), (40, 5), (400, 50)):  # likenesses of 0.8, as one of 5, and as 5 and 50 of each side's own
        met = 0
        for _ in range(300):
            pool = rng.integers(0, 1 << 63, common + 2 * own, np.uint64)
            x, y = np.unique(pool[:common + own]), np.unique(pool[:common] if common == 4 else np.r_[pool[:common], pool[common + own:]])
            met += bool(np.intersect1d(*(simhash.like_entries(s, simhash.wide_fingerprint(s)) for s in (x, y))).size)
        assert met >= 297


@pytest.mark.parametrize("n,symbols", [(1, 2), (2, 3), (30, 2), (300, 3), (400, 50)])
def test_suffix_array(n, symbols):
    random.seed(n)
    text = [random.randrange(1, symbols + 1) for _ in range(n)] + [0]
    assert suffixes.suffix_array(np.array(text)).tolist() == sorted(range(n + 1), key=lambda i: text[i:])


def test_order_of_names():
    random.seed(8)
    for n in (1, 2, 50, 400):
        names = [random.randrange(1, 4) for _ in range(n)] * 2 + [0]
        assert suffixes.order_of_names(np.array(names)).tolist() == sorted(range(2 * n + 1), key=lambda i: names[i:])


def test_suffix_array_goes_by_symbols():
    """A loop over suffixes took 3 to 4 microseconds for each; dealt out by symbols it is well under one."""
    import time

    text = np.append(np.random.default_rng(3).integers(1, 60, 1_000_000), 0)
    started = time.perf_counter()
    order = suffixes.suffix_array(text)
    assert time.perf_counter() - started < 1.5
    pairs = text[order[1:]] * 60 + text[np.minimum(order[1:] + 1, len(text) - 1)]
    assert (np.diff(pairs) >= 0).all() and (np.sort(order) == np.arange(len(text))).all()


def test_common_prefixes():
    text = np.frombuffer(b"abracadabra abracadabra", np.uint8).astype(np.int64) + 1
    order = suffixes.suffix_array(np.append(text, 0))[1:]
    found = suffixes.common_prefixes(text, order, 5)
    plain = bytes((text - 1).astype(np.uint8))
    for k in range(1, len(order)):
        a, b = plain[order[k]:], plain[order[k - 1]:]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert found[k] == min(5, same)


def brute_removal(rows):
    least, out = {}, []
    coded = [(suffixes.GREATEST if i is None else i, (t or "").encode(), i) for i, t in rows]
    for doc, data, _ in coded:
        for p in range(len(data) - 49):
            least[data[p:p + 50]] = min(doc, least.get(data[p:p + 50], doc))
    for doc, data, i in coded:
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if least[data[p:p + 50]] < doc:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for p in range(len(data)) if gone[p] and not (p and gone[p - 1]))
        out.append((-1 if i is None else i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("filter_keys,common,block", [(10 ** 9, 20_000, 1 << 24), (0, 20_000, 50_000), (10 ** 9, 3, 100_000)])
def test_repeats_like_brute_force(spark, read, monkeypatch, filter_keys, common, block):
    for name, value in (("COMMON", common), ("BLOCK_BYTES", block), ("SHARD_BYTES", 100_000), ("BUCKET_BYTES", 100_000)):
        monkeypatch.setattr(suffixes, name, value)
    texts = [(r.doc_id, r.text) for r in read("documents").select("doc_id", "text").orderBy("doc_id").limit(80).collect()]
    phrase = "The same passage of text that stands in every one of these documents"
    rows = texts + [(None, texts[0][1]), (5, texts[3][1]), (5, texts[3][1]), (-4, None), (99999, ""), (100000, "é" * 200), (100001, "xé" * 200),
                    (3, texts[3][1] + texts[7][1])] + [(2000 + i, f"{phrase}, {i % 7}. {texts[i][1][:70]}{phrase}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS mark", "2 AS spans", "3 AS key").repartition(5)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(df, filter_keys).collect())
    assert got == brute_removal(rows)


def test_kept_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a" * 120), (2, "b" * 10 + "a" * 60 + "c")], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(df).collect()}
    assert kept == {1: b"a" * 120, 2: b"b" * 10 + b"c"}
    assert suffixes.digests(df.limit(0)).count() == 0
