"""BPE against the tokenizer itself, secrets against SQL and by hand."""

import hashlib

import public_tokenizers
import pytest
from oracle import compare, connect
from plumbline.llm import bpe, secrets
from plumbline.llm.queries import ORACLES, QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Hello  World's 12é <|endoftext|>x a<|startoftext|>b", "", None, "  \n", "naïve🎉🎉 ÅΣΣ don't'S ''s !'s", "İstanbul ﬁ ǅ 你好　世界 a\xa0b\x85c\x1cd ½²",
       "é ́x ª º µ ÿŸ ß straße", "I'LL we'RE x''ll", "<| a |> <|endoftext|", "\x00 a\x0bb\x0cc", "rare " + "z" * 5000]


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.load(PATH)


@pytest.mark.parametrize("head_words", [500_000, 2])
def test_ids_and_texts(spark, tokenizer, head_words):
    rows = list(enumerate(ODD)) + [(None, "no id"), (0, ODD[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS mark", "3 AS word", "4 AS words")
    encoded = bpe.encode(df, PATH, head_words=head_words)
    found = encoded.collect()
    assert len(found) == len(rows)
    for r in found:
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(r.ids) == ids
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    key = lambda r: (r.doc_id is None, r.doc_id, r.decoded)
    assert sorted(map(key, bpe.decode(encoded, PATH).collect())) == sorted(map(key, found))
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_query_on_all_documents(spark, tokenizer, read):
    texts = {r.doc_id: r.text for r in read("documents").collect()}
    found = QUERIES["op3_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(texts)
    for r in found:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_driver_holds_no_words_of_its_own(spark):
    """20,000 words in the head: objects for each of them took the driver several MB, Arrow bytes take less than one."""
    import tracemalloc

    table = spark.range(20_000).selectExpr("translate(lpad(hex(id), 8, '0'), '0123456789', 'ghijklmnop') AS word", "1L AS n", "array(1, 2, 3) AS ids")
    tracemalloc.start()
    packed, _, left = bpe.head_of(table, 500_000, 16 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert isinstance(packed, bytes) and not left and peak < 2 << 20
    assert len(bpe._known({"packed": packed}, tuple)) == 20_000


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    equal, message = compare(QUERIES[name](spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), ORACLES[name])
    assert equal, message


ROWS = [(1, "token: secret: abcdefghijklmnop é AKIA" + "A" * 14 + " " + "a1" * 8, "s1", 5), (2, None, "s2", 0),
        (3, "password=aaaabbbbcccc1234 x password=aaaabbbbcccc1234", None, 1), (4, "zzzzzzzzzzzzzzzzzzzzzz1 api_key='Ab12345678901' !", "s1", 1),
        (4, "no", None, None), (None, "", "s", 0), (7, "AKIA" + "A" * 14, "s9", 1)]


def test_spans_by_hand(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, n_chars long").selectExpr("*", "1 AS owner", "2 AS hits", "3 AS row")
    found = secrets.secrets(df).collect()
    spans = {(r.doc_id, r.spans) for r in found}
    assert spans == {(1, "access:34:52,hex:53:69"), (2, ""), (3, "assign:0:25,hex:9:25,assign:28:53,hex:37:53"), (4, "owned:0:23,assign:24:46"), (4, ""), (None, ""),
                     (7, "access:0:18")}
    one = next(r for r in found if r.doc_id == 3)
    assert (one.n_assign, one.n_access, one.n_hex) == (2, 0, 2)
    assert one.base_sha256 == hashlib.sha256(b"assign:0:25,hex:9:25,assign:28:53,hex:37:53").hexdigest()
    # the access key of two owners is a copied example, all others look live
    assert [r.n_copied for r in sorted(found, key=lambda r: r.doc_id or 0) if r.doc_id in (1, 7)] == [1, 1]
    assert secrets.secrets(df.limit(0)).count() == 0


def test_redaction_keeps_rows_and_examples(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, n_chars long")
    found = [(r.doc_id, r.text, r.n_chars) for r in secrets.redact(df).collect()]
    assert len(found) == len(ROWS)
    assert (3, "[redacted] x [redacted]", 23) in found
    assert (7, "AKIA" + "A" * 14, 1) in found
    assert (2, None, 0) in found


def test_secret_scan_has_no_python(spark, read):
    plan = secrets.secrets(read("documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
