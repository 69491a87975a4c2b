"""Language, quality, toxicity and decontamination: held-out accuracy, odd rows, brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from plumbline.llm import decontaminate, language, quality, toxicity
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_best_paths_like_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(60):
        scores = rng.normal(size=(rng.integers(1, 4), 12)).astype(np.float32) * 3
        lengths = rng.integers(0, 6, size=rng.integers(1, 5))
        rows = rng.integers(0, 12, size=lengths.sum())
        got, at = language.best_paths(scores, rows, lengths, 2.0), 0
        for n in lengths:
            own = rows[at:at + n]
            value = lambda p: sum(scores[k, w] for k, w in zip(p, own, strict=True)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
            if n:
                assert value(got[at:at + n]) >= max(map(value, itertools.product(range(len(scores)), repeat=int(n)))) - 1e-4
            at += n


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op7_language"](spark, SF).collect() if r.held_out]
    assert len(rows) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.98


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, 4, 2)
    mixed = "The thing that was for the other and with this. Le la des que pour elle dans les avec une mentre eaux qui sur. The of and to that is was for with"
    rows = [(1, mixed, 7), (2, None, 1), (3, "123 !! ²", 1), (4, "", 0), (5, "İSTANBUL the of and", 1), (None, "the", 0), (5, "the", 0), (6, "Привет мир", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    found = language.predict(df, model).collect()
    assert len(found) == len(rows)
    first = next(r for r in found if r.doc_id == 1)
    assert [s.lang for s in first.spans] == ["en", "fr", "en"] and first.lang_pred == "en"
    assert mixed[first.spans[1].start:first.spans[1].end].startswith("Le la")
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (2, 3, 4))
    nothing = language.fit(docs.where("lang = 'none'"), 4, 2)
    assert {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"}
    assert language.predict(df.limit(0), model).count() == 0


def test_scripts_narrow(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in (("и в не на я быть он с что а", "ru"), ("the of and to in is you that", "en"))]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 4, 2)
    assert model.scripts["cyrillic"].tolist() == [False, True]
    assert model.scripts["latin"].tolist() == [True, False]
    (row,) = language.predict(spark.createDataFrame([(1, "щука the of")], "doc_id long, text string"), model).collect()
    assert "ru" in {s.lang for s in row.spans} or row.lang_pred == "en"


@pytest.mark.parametrize("name,label,cut,least", [("op6_quality", "quality", 0.7, 0.97), ("op1_toxicity", "toxic", 0.5, 0.95)])
def test_scores_held_out(spark, name, label, cut, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in QUERIES[name](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= s <= 1 and p == int(s >= cut) for s, p, _ in rows)
    assert sum(p == y for _, p, y in rows) / len(rows) > least


def test_quality_threshold_over_all_labelled_rows(spark):
    """A sample of thirty documents a label fits the ranking; the threshold is still that of a sort of all of them."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ranking = quality.fit(docs, labels, 4, 2, sample=30)
    known = {r.doc_id: r.quality for r in labels.where("quality IN (0, 1)").where(~quality.held_out(4, 2)).collect()}
    rows = [(r.text, known[r.doc_id]) for r in docs.collect() if r.doc_id in known]
    scores = np.sort(ranking.raw(np.array([quality.features(t) for t, _ in rows], float)))
    bad = sum(q == 0 for _, q in rows)
    assert ranking.threshold == pytest.approx((scores[bad - 1] + scores[bad]) / 2, abs=1e-9)


def test_scores_of_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "")], "doc_id long, text string").selectExpr("*", "'a' AS score", "'b' AS predicted")
    ranking = quality.fit(docs, labels, 4, 2)
    letters = toxicity.letter_model(docs)
    scorer = toxicity.fit(docs, labels, letters, 5, 0)
    for found in (quality.predict(odd, ranking), toxicity.predict(odd, letters, scorer)):
        scores = [r.score for r in found.collect()]
        assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
        assert found.limit(0).count() == 0
    assert quality.fit(docs, labels.where("quality = 1"), 4, 2) is None
    assert toxicity.fit(docs, labels.limit(0), letters, 5, 0) is None
    assert {r.score for r in quality.predict(odd, None).collect()} == {0.5}
    assert {r.score for r in toxicity.predict(odd, letters, None).collect()} == {0.0}


@pytest.fixture(scope="module")
def letters(spark):
    return toxicity.letter_model(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("said,meant", [("1d10t", "idiot"), ("m0r0n", "moron"), ("l0$er", "loser"), ("idioooot", "idiot"), ("tra$h", "trash"), ("c1own!!!", "clown"),
                                        ("the%%%", "the"), ("THE!!", "the"), ("hello", "hello"), ("1234", "1234"), ('"id.iot"', "idiot")])
def test_disguises(letters, said, meant):
    assert toxicity.restore_token(said, letters) == meant


def test_spaced_letters(letters):
    assert toxicity.restore("an i d i o t and m-o-r-o-n! a b ok", letters) == "an idiot and moron a b ok"


def edit_distance_inside(pattern, text):
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern, 1):
        new = np.concatenate(([i], np.minimum(row[:-1] + (text != c), row[1:] + 1)))
        steps = np.arange(len(new))
        row = np.minimum.accumulate(new - steps) + steps
    return row.min()


def scrambled(text, n):
    text = list(text)
    for _ in range(n):
        p, kind = random.randrange(len(text)), random.random()
        text[p:p + (kind < 0.6)] = [] if kind < 0.3 else [random.choice("abcxyz")]
    return "".join(text)


def test_decontamination_like_brute_force(spark):
    random.seed(2)
    word = lambda: "".join(random.choices("etaoinshr", k=random.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(random.choice((2, 5, 14, 30, 60))))) for i in range(25)]
    docs = []
    for d in range(100):
        text = " ".join(word() for _ in range(random.randrange(120)))
        if d % 3:
            item = random.choice(items)[1]
            text = text + " " + scrambled(item, random.randrange(len(item) // 9 + 1)).upper().replace(" ", "  - ") + "! " + text
        docs.append((d, text))
    docs += [(None, items[3][1]), (200, None), (201, ""), (202, "".join(t for _, t in items)), (0, docs[0][1])]
    index = decontaminate.index_of(items)
    want = set()
    for d, text in docs:
        data = decontaminate.normalized(text or "")
        for w in range(len(index.items)):
            if len(data) and edit_distance_inside(index.patterns[w][:index.lengths[w]], data) <= index.edits[w]:
                want.add((d, int(index.items[w])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items + [(99, None), (98, "ab")], "item_id long, text string")
    for block in (1 << 20, 600):
        assert {(r.doc_id, r.item_id) for r in decontaminate.hits(df, benchmark, block).collect()} == want
    clean = {r.doc_id for r in decontaminate.without_hits(df, benchmark).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.hits(df, benchmark.limit(0)).count() == 0
    assert decontaminate.without_hits(df.limit(0), benchmark).count() == 0


def test_hit_spans(spark):
    item = "Wer einen solchen Satz über Äpfel findet, der hat ihn abgeschrieben und nicht selbst erdacht, meine ich."
    text = "Vorher steht etwas ÜBER anderes. " + item.upper() + " Danach auch."
    (hit,) = decontaminate.hits(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(4, item)], "item_id long, text string")).collect()
    assert text[hit.start:hit.end].strip(" .") == item.upper().strip(" .")
    assert hit.edits == 0


def test_token_rules_take_linear_time():
    import time

    for word in ("ab" * 500_000, "-" * 1_000_000, "a" + "-" * 1_000_000 + "b", "1" * 999_999 + "a"):
        started = time.perf_counter()
        toxicity.suspect(toxicity.without_edges(word))
        assert time.perf_counter() - started < 2


def test_language_learns_many_words_in_little_memory(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(5)
    words = list(dict.fromkeys("".join(w) for w in rng.choice(list("abcdefghijklmnopé"), (60_000, 8))))
    model = language.Model(["a", "b"], rng.normal(size=(2, 1 << language.CELLS)).astype(np.float32), {n: np.array([True, True]) for n in language.NAMES})
    tracemalloc.start()
    whole = language.Words(model)
    rows = whole(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 << 20
    monkeypatch.setattr(language, "AT_ONCE", 7)
    small = language.Words(model)
    assert (small(words[:1000]) == rows[:1000]).all()
    assert (small.table[:, :1000] == whole.table[:, :1000]).all() and (small.letters[:1000] == whole.letters[:1000]).all()


def test_language_gets_texts_in_small_batches(spark):
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, f"{64 << 20}b")
    try:
        docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 2000) AS text", "'en' AS lang")
        language.predict(docs, language.Model([], np.zeros((0, 1 << language.CELLS), np.float32), {}))

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

        found = [r.n for r in docs.mapInArrow(sizes, "n bigint").collect()]
        assert sum(found) > 8 << 20 and max(found) < 3 << 20
    finally:
        spark.conf.set(conf, before)
