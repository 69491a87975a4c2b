"""The corpus pipeline: what each stage keeps, by brute force on a small table."""

import random

import corpus_pipeline
import pytest
from plumbline.llm import bpe, decontaminate, secrets
from plumbline.session import settle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def passed(spark):
    docs, out = corpus_pipeline.table(spark, SF, "documents"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = settle(stage(spark, docs, SF))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_columns(passed):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(passed[n].columns == passed["input"].columns for n in names[:-1])
    assert ids(passed["language_id"]) == ids(passed["input"])  # every sample text has letters


def test_copies_leave_one(passed):
    texts = {}
    for r in passed["language_id"].select("doc_id", "text").collect():
        texts.setdefault(r.text, set()).add(r.doc_id)
    kept = ids(passed["simhash_near_dedup"])
    assert all(len(kept & copies) <= 1 for copies in texts.values())
    assert len(kept) > 0.8 * len(texts)


def test_benchmark_goes(spark, passed):
    items = [decontaminate.normalized(r.text).tobytes().strip() for r in corpus_pipeline.table(spark, SF, "benchmark").collect()]
    before = {r.doc_id: decontaminate.normalized(r.text).tobytes() for r in passed["simhash_near_dedup"].collect()}
    holding = {d for d, text in before.items() if any(i in text for i in items)}
    assert holding and ids(passed["benchmark_decontamination"]) == set(before) - holding


def test_secrets_are_replaced(passed):
    before = {r.doc_id: r.text for r in passed["benchmark_decontamination"].collect()}
    after = {r.doc_id: r for r in passed["secret_scan"].collect()}
    assert before.keys() == after.keys()
    live = {r.doc_id: r.n_live for r in secrets.secrets(passed["benchmark_decontamination"]).collect()}
    for d, r in after.items():
        assert (r.text != before[d]) == (live[d] > 0)
        assert r.text == before[d] or (secrets.REDACTION in r.text and r.n_chars == len(r.text))


def test_last_stage_encodes_what_is_left(spark, passed):
    tokenizer = bpe.load(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY))
    left = {r.doc_id: r.text for r in passed["secret_scan"].collect()}
    found = {r.doc_id: r.n_tokens for r in passed["bpe"].collect()}
    assert found == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) for d, t in left.items()}


def test_odd_rows_pass(spark):
    schema = corpus_pipeline.table(spark, SF, "documents").schema
    rows = [(1, "ab cd ef", "en", "s", 8), (1, "ab cd ef", "en", "s", 8), (2, None, None, None, None), (None, "the end of", None, None, 3), (4, "", "en", "s", 0), (5, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF))
    assert sorted(r.doc_id or -1 for r in docs.collect()) == [-1, 1, 1]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = settle(stage(spark, empty, SF))
    assert empty.count() == 0


def item_words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_no_passage_spans_two_documents(spark, parts):
    item = item_words(1, 30)
    half = len(item) // 2
    docs = [(1, "x " * 40 + item[:half]), (2, item[half:] + " y" * 40), (3, "z " * 30 + item + " z" * 9), (4, None), (5, "")]
    found = decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    whole = {r.doc_id for r in found if r.n_windows > 10}
    assert whole == {3}
    one = decontaminate.hits(spark.createDataFrame(docs[:2], "doc_id long, text string").coalesce(1), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert all(docs[r.doc_id - 1][1][r.start:r.end].strip() in item for r in one)


def test_excerpts_from_anywhere_are_found(spark):
    items = [(i, item_words(i, 60)) for i in range(4)]
    rng = random.Random(2)
    docs, n = [], 0
    for item, text in items:
        for length in (96, 100, 106, 112):
            for _ in range(15):
                at = rng.randrange(20, len(text) - length - 20)
                docs.append((n, f"{item_words(1000 + n, 20)} {text[at:at + length]} {item_words(3000 + n, 20)}", item))
                n += 1
    df = spark.createDataFrame(docs, "doc_id long, text string, item long")
    found = {(r.doc_id, r.item_id) for r in decontaminate.hits(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(d, i) for d, _, i in docs}


def test_redaction_tells_rows_apart(spark):
    rows = [(1, "a", "b: password=aaaabbbbcccc1234 tail"), (1, "a:b", " password=aaaabbbbcccc1234 tail"), (2, None, None), (None, "s", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'r' AS __row", "'l' AS __live", "1 AS n_chars")
    found = secrets.redact(df, max_owners=2)
    assert found.columns == df.columns
    assert sorted((r.text or "" for r in found.collect())) == ["", "", f" {secrets.REDACTION} tail", f"b: {secrets.REDACTION} tail"]
