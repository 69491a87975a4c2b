"""Text expressions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions import text as tx
from plumbline.operators import rates


def column(spark, rows, schema, expression):
    df = spark.createDataFrame(rows, schema).withColumn("__row", F.monotonically_increasing_id()).coalesce(1)
    return [r["x"] for r in df.withColumn("x", expression).orderBy("__row").collect()]


@pytest.mark.parametrize("a,b,edits", [("kitten", "sitting", 3), ("", "abc", 3), ("abc", "abc", 0), ("é", "e", 1), ("flaw", "lawn", 2)])
def test_edits(spark, a, b, edits):
    assert column(spark, [(a, b)], "a string, b string", F.levenshtein("a", "b")) == [edits]


def test_error_rate_of_empty_targets(spark):
    rate = tx.error_rate(F.col("a"), F.col("b"))
    assert column(spark, [("", ""), ("x", ""), ("ab", "abcd")], "a string, b string", rate) == [0.0, 1.0, 0.5]


def alignment(reading, target):
    """Every span of the reading against the whole target; the least cost, then least outside."""
    read, text = "".join(reading.split()), "".join(target.split())

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
        return row[-1]

    n = len(read)
    spans = [(edits(read[i:j], text), max(i, n - j)) for i in range(n + 1) for j in range(i, n + 1)]
    return min(spans)[1]


def test_overrun(spark):
    rng = random.Random(3)
    cases = [("near a wood x.x. 9/", "near a wood"), ("stone .", "stone."), ("", "abc"), ("abc", ""), ("", ""), ("they they", "they"), ("xxabc", "abc")]
    cases += [("".join(rng.choices("ab c", k=rng.randint(0, 9))), "".join(rng.choices("ab c", k=rng.randint(0, 6)))) for _ in range(40)]
    got = column(spark, cases, "a string, b string", tx.overrun(F.col("a"), F.col("b")))
    assert got == [alignment(a, b) for a, b in cases]


def test_doubled(spark):
    cases = [
        ("by red red", "by bed", "red"), ("we sat sat up", "he sat sat up", None), ("Red red", "x", "red"), ("a b a b", "a", None),
        ("", "", None), ("one", "", None), ("x x y y", "x x", "y"), ("  the\tthe ", "the", "the"),
    ]
    got = column(spark, [c[:2] for c in cases], "a string, b string", tx.doubled_word(F.col("a"), F.col("b")))
    assert got == [c[2] for c in cases]


def test_leave_one_out(spark):
    df = spark.createDataFrame([(1, "a b  c"), (2, "one"), (3, "")], "id int, t string")
    assert sorted(map(tuple, rates.leave_one_out(df, ["id"], "t").collect())) == [(1, 0, "b c"), (1, 1, "a c")]


def test_alphabet(spark):
    english = tx.alphabet("english")
    assert len(english) == 81 and "a" in english and "é" not in english and "ab" not in english
    texts = [("Hello, World!",), ("café 𝒳",), ("",), (None,)]
    codes = column(spark, texts, "a string", english.encode(F.col("a")))
    position = {c: i + 2 for i, c in enumerate(english.characters)}
    assert codes == [[position.get(c, 1) for c in t] if t is not None else None for (t,) in texts]
    assert column(spark, texts[:3], "a string", english.decode(english.encode(F.col("a")))) == ["Hello, World!", "caf ", ""]
    assert column(spark, texts[1:2], "a string", english.decode(english.encode(F.col("a")), True)) == ["caf� �"]
    assert column(spark, texts[:3], "a string", english.unsupported(F.col("a"))) == [[], ["é", "𝒳"], []]
    assert column(spark, texts[:3], "a string", english.supports(F.col("a"))) == [True, False, True]
    assert column(spark, texts[:3], "a string", english.keep_only(F.col("a"))) == ["Hello, World!", "caf ", ""]
    with pytest.raises(Exception, match="outside the alphabet"):
        column(spark, [([999],)], "a array<int>", english.decode(F.col("a")))


def test_long_texts_are_encoded_in_pieces(spark):
    import pyarrow as pa

    texts = ["ab", None, "x" * 30, "", "é" * 10, "", "c"]
    cut = [p.to_pylist() for p in tx.pieces(pa.array(texts), 16)]
    assert len(cut) > 2 and sum(cut, []) == texts and [p.to_pylist() for p in tx.pieces(pa.array([], pa.string()), 16)] == [[]]
    held = max(sum(len((t or "").encode()) for t in p) for p in cut)
    assert held <= 30 + 16
    long = [(f"{i}" * 300_000,) for i in range(10)] + [(None,), ("",)]
    codes = column(spark, long, "a string", tx.alphabet("english").encode(F.col("a")))
    assert [c and (len(c), set(c)) for c in codes] == [(300_000, {tx.alphabet("english").characters.index(str(i)) + 2}) for i in range(10)] + [None, []]


def test_registry():
    for bad in ("", "aba"):
        with pytest.raises(ValueError):
            tx.register_alphabet("bad", bad)
    tx.register_alphabet("vowels", "aeiou", overwrite=True)
    assert "vowels" in tx.alphabets() and len(tx.alphabet("vowels")) == 7
    with pytest.raises(KeyError):
        tx.register_alphabet("vowels", "ae")
    with pytest.raises(KeyError):
        tx.alphabet("none")


def test_budget_and_coverage(spark):
    assert column(spark, [("",), ("x" * 10,), ("x" * 7,), ("x" * 500,)], "a string", tx.length_budget(F.col("a"))) == [32, 55, 39, 384]
    got = column(spark, [("ab b", "bc"), ("", "a"), ("  ", "a")], "a string, b string", tx.coverage(F.col("a"), F.col("b")))
    assert got == [0.5, 0.0, 0.0]


def test_join_texts(spark):
    joined = tx.join_texts(F.col("t"), F.col("i"))
    schema = "t array<string>, i array<string>"
    assert column(spark, [(["a", "b"], ["x", "y"]), (None, ["x"]), (["a"], ["x"])], schema, joined) == ["a b", None, "a"]
    for bad in ((["a"], ["x", "y"]), (["a"], [])):
        with pytest.raises(Exception, match="style"):
            column(spark, [bad], schema, joined)


def test_blank(spark):
    assert column(spark, [("",), (" \t\n",), ("  ",), ("x",)], "a string", tx.is_blank(F.col("a"))) == [True, True, True, False]


def test_reasons_are_distinct():
    reasons = [fixed.UNPARSED_NAME, fixed.NO_PARTS, fixed.EMPTY_TEXT, fixed.OUT_OF_CHARSET, fixed.INCOMPLETE, fixed.BAD_SEGMENTATION, fixed.MISSING_IMAGE]
    assert len(set(reasons)) == len(reasons)
