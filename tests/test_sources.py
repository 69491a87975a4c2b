"""File trees, forms, packs, runs and stored figures."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions import text as tx
from plumbline.operators import baselines, reasons
from plumbline.operators.reassemble import reassemble
from plumbline.session import fresh_path
from plumbline.sources import files, forms, packs, runs


def tree(root, names):
    for name in names:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as handle:
            handle.write("x")
    return str(root)


def test_pages(spark, tmp_path):
    root = tree(tmp_path, [
        "a/0001-2-cropped.tif", "b/0001-2.tif", "a/0002-1.PNG", "a/odd.jpg", "a/notes.txt", "a/words/0003-1-0-0-x.tif",
        "a/lines/0003-1-0.tif", "meta/page.xml",
    ])
    pages, unparsed, facts = files.scan_pages(files.list_files(spark, root))
    assert [(r["page_id"], r["writer_id"], r["text_id"], r["path"].rsplit("/", 2)[1]) for r in pages.collect()] == [
        ("0001-2", "0001", "2", "a"), ("0002-1", "0002", "1", "a"),
    ]
    assert [os.path.basename(r["path"]) for r in unparsed.collect()] == ["odd.jpg"]
    assert facts.first()["has_annotations"] and facts.first()["files"] == 8


def test_listing_reads_no_contents(spark, tmp_path):
    listed = files.list_files(spark, tree(tmp_path, ["x.tif"]))
    assert "content" not in listed._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


WORDS = [
    "trainset/words/0052-1-0-0-Imagine.tif", "trainset/words/0052-1-0-1-well-known.tif", "testset/words/0053-1-0-0-Grüße.tif",
    "testset/words/0431-1-0-0-Hidden.tif", "testset/words/broken.tif", "testset/words/0054-1-3-0-a.tif", "testset/words/0054-1-3-2-c.tif",
    "testset/words/0055-6-0-0-Deutsch.tif", "testset/words/0056-1-10-0-ten.tif", "testset/words/0056-1-9-0-nine.tif",
]
LINES = [
    "trainset/lines/0052-1-0.tif", "testset/lines/0053-1-0.tif", "testset/lines/0431-1-0.tif", "testset/lines/0054-1-3.tif",
    "testset/lines/0055-6-0.tif", "testset/lines/0057-1-0.tif", "testset/lines/unnamed.tif", "testset/lines/0056-1-10.tif", "testset/lines/0056-1-9.tif",
]


def test_parts(spark, tmp_path):
    listed = files.list_files(spark, tree(tmp_path, WORDS))
    scanned = files.scan_parts(listed, tx.alphabet("english"))
    by_reason = {r["reason"]: (r["kind"], r["n"]) for r in reasons.drop_report(scanned).collect()}
    assert by_reason == {
        "kept": ("kept", 7), fixed.UNPARSED_NAME: ("dropped", 1), fixed.EXCLUDED_GROUP: ("excluded", 1), fixed.OUT_OF_CHARSET: ("dropped", 1),
    }
    kept = files.stable_order(reasons.kept(scanned), places=["line_index", "word_index"]).collect()
    assert [(r["writer_id"], r["line_index"], r["text"], r["split"]) for r in kept][:2] == [
        ("0052", 0, "Imagine", "trainset"), ("0052", 0, "well-known", "trainset"),
    ]
    assert [r["line_index"] for r in kept if r["writer_id"] == "0056"] == [9, 10]
    assert files.scan_parts(listed, tx.alphabet("english"), (), True).where("reason is null").count() == 9


def test_lines(spark, tmp_path):
    listed = files.list_files(spark, tree(tmp_path, WORDS + LINES))
    scanned = files.scan_groups(listed, tx.alphabet("english"))
    found = {r["writer_id"]: r["reason"] for r in scanned.where("writer_id is null or writer_id <> '0056'").collect()}
    assert found == {
        "0052": None, "0053": fixed.OUT_OF_CHARSET, "0431": fixed.EXCLUDED_GROUP, "0054": fixed.INCOMPLETE, "0055": fixed.EXCLUDED_TEXT,
        "0057": fixed.NO_PARTS, None: fixed.UNPARSED_NAME,
    }
    text = {r["writer_id"]: (r["text"], r["word_count"], r["complete"]) for r in scanned.where("writer_id in ('0052', '0054')").collect()}
    assert text == {"0052": ("Imagine well-known", 2, True), "0054": ("a c", 2, False)}
    loose = files.scan_groups(listed, tx.alphabet("english"), keep_incomplete=True, keep_out_of_charset=True, exclude_texts=())
    assert {r["writer_id"]: r["complete"] for r in reasons.kept(loose).collect()}["0054"] is False
    assert reasons.reconciles(reasons.drop_report(scanned), scanned).first()["agree"]


def test_writers_past_four_digits(spark):
    listed = spark.createDataFrame([(f"/t/words/{w}-7-1-2-a.tif",) for w in ("0999", "10000", "59999", "999")] + [("/t/lines/10000-7-1.tif",)], "path string")
    scanned = {r["path"][9:].split("-")[0]: (r["writer_id"], r["reason"]) for r in files.scan_parts(listed, tx.alphabet("english"), ()).collect()}
    assert scanned == {"0999": ("0999", None), "10000": ("10000", None), "59999": ("59999", None), "999": (None, fixed.UNPARSED_NAME)}
    line = files.scan_groups(listed, tx.alphabet("english"), keep_incomplete=True).first()
    assert (line["writer_id"], line["text"]) == ("10000", "a")


def test_copies_of_parts_are_all_kept(spark):
    rows = [("g", 0, "a")] * 3 + [("g", 1, "b")] + [("h", 1, "x"), ("i", 0, "p"), ("i", 0, "q"), ("i", 2, "r")]
    built = reassemble(spark.createDataFrame(rows, "g string, i int, t string"), ["g"], "i", "t")
    assert {r["g"]: (r["text"], r["word_count"], r["complete"]) for r in built.collect()} == {
        "g": ("a a a b", 4, False), "h": ("x", 1, False), "i": ("p q r", 3, False),
    }


FORM = """<?xml version="1.0"?><form id="c03-000a" writer-id="000"><handwritten-part>
<line id="c03-000a-00" segmentation="ok"><word id="c03-000a-00-00" text="A"/><word id="c03-000a-00-01" text=" "/><word id="c03-000a-00-02" text="dé"/></line>
<line id="c03-000a-01" segmentation="err"><word id="c03-000a-01-00" text="lost"/></line></handwritten-part></form>"""


def test_forms(spark, tmp_path):
    (tmp_path / "c03-000a.xml").write_text(FORM, encoding="utf-8")
    (tmp_path / "bare.xml").write_text('<form id="z"><line id="z-0"><word text="q"/></line></form>', encoding="utf-8")
    read = forms.read_forms(spark, str(tmp_path))
    problems = {r["form"]: r["problems"] for r in forms.validate_forms(read).collect()}
    assert problems == {"z": ["form has no writer-id", "word has no id"]}
    images = spark.createDataFrame([("words/c03/c03-000a/c03-000a-00-00.png",)], "path string")
    good = read.where("`_writer-id` is not null")
    found = {r["word_id"]: r["reason"] for r in forms.scan_forms(good, tx.alphabet("english"), images).collect()}
    assert found == {"c03-000a-00-00": None, "c03-000a-00-01": fixed.EMPTY_TEXT, "c03-000a-00-02": fixed.OUT_OF_CHARSET, "c03-000a-01-00": fixed.BAD_SEGMENTATION}
    lenient = forms.scan_forms(good, tx.alphabet("english"), images, skip_bad_segmentation=False)
    assert {r["word_id"]: r["reason"] for r in lenient.collect()}["c03-000a-01-00"] == fixed.MISSING_IMAGE


def test_a_form_is_parsed_once(spark):
    texts = spark.createDataFrame([(1, FORM), (2, '<form id="z"><line id="z-0"><word text="q"/></line></form>')], "n int, xml string")
    found = forms.validate_forms(forms.forms_from_text(texts, F.col("xml"), ["n"]), "n")
    assert [(r["form"], len(r["problems"])) for r in found.collect()] == [(2, 2)]
    scanned = forms.scan_forms(forms.forms_from_text(texts, F.col("xml")), tx.alphabet("english"))
    for rows in (found, scanned):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1


def test_numbered_text_and_codes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n\nfour\n")
    rows = files.numbered_text(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["line_no"], r["text"]) for r in rows] == [(1, "one"), (2, "two"), (3, ""), (4, "four")]
    lines = spark.createDataFrame([("ANSWERS;ann;1A 12B",), ("hello",), ("  ANSWERS;bob;3A  ",), ("ANSWERS;short",)], "value string")
    got = sorted(map(tuple, files.parse_codes(lines, F.col("value")).collect()))
    assert got == [("ann", 1, "A"), ("ann", 12, "B"), ("bob", 3, "A")]


def records(spark, n=40):
    return spark.range(n).select(
        F.col("id").alias("ord"), F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("key"),
        (F.col("id") % 4).cast("string").alias("writer_id"), F.lit("text").alias("text"), F.lit("train").alias("split"),
        F.encode(F.lit("img"), "UTF-8").alias("image"), F.lit(64).alias("height"),
    )


def test_pack(spark):
    path = fresh_path(spark, "pack")
    with pytest.raises(Exception):
        packs.pack_read(spark, path)
    header = packs.pack_write(records(spark), path, 64, config={"a": "b"}, record_height=F.col("height")).first()
    assert (header["count"], header["writers"], header["config"]) == (40, 4, {"a": "b"})
    assert [r["ord"] for r in packs.pack_read(spark, path).orderBy("ord").collect()] == list(range(40))
    assert packs.pack_get(spark, path, "k007").first()["writer_id"] == "3"
    with pytest.raises(KeyError):
        packs.pack_get(spark, path, "nope")
    assert {r["writer_id"]: r["keys"] for r in packs.pack_groups(spark, path).collect()}["1"][:2] == ["k001", "k005"]
    smaller = fresh_path(spark, "pack")
    packs.pack_compact(spark, path, smaller)
    assert packs.pack_size(spark, smaller).first()["files"] == 1 and packs.is_complete(spark, smaller)
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,k007)]" in packs.pack_get(spark, path, "k007")._jdf.queryExecution().simpleString()
    packs.clear(spark, f"{path}/header")
    assert not packs.is_complete(spark, path)
    with pytest.raises(packs.PackError):
        packs.pack_read(spark, path)


def test_compact_into_files_asked_for(spark, monkeypatch, read):
    from plumbline.plans import stores

    path, split, whole = (fresh_path(spark, "pack") for _ in range(3))
    packs.pack_write(records(spark), path, 64, files=4)
    packs.pack_compact(spark, path, split, bytes_per_file=1500)
    packs.pack_compact(spark, path, whole, bytes_per_file=1500, files=1)
    assert packs.pack_size(spark, split).first()["files"] > 1 == packs.pack_size(spark, whole).first()["files"]
    assert [r["key"] for r in packs.pack_read(spark, whole).collect()] == sorted(r["key"] for r in packs.pack_read(spark, path).collect())
    monkeypatch.setattr(packs.pack_compact, "__defaults__", (1000, None))  # a pack of many times the size of a file
    assert stores.pack_compact(read).first()["files"] == 1


def test_pack_refusals(spark):
    path = fresh_path(spark, "pack")
    with pytest.raises(packs.PackError, match="twice"):
        packs.pack_write(records(spark).unionByName(records(spark, 1)), path, 64)
    assert not packs.is_complete(spark, path)
    with pytest.raises(Exception, match="is not the pack's 32"):
        packs.pack_write(records(spark), path, 32, record_height=F.col("height"))


def test_metrics_store_and_carry(spark):
    path = fresh_path(spark, "metrics")
    old = spark.createDataFrame([("a", "fid_floor", 1.0), ("a", "pack_records", 10.0), ("b", "cer_real", 0.1)], baselines.SCHEMA)
    baselines.save_metrics(old, path)
    assert baselines.load_metrics(spark, path, "c") is None
    new = spark.createDataFrame([("a", "fid_floor", 2.0), ("a", "retrieval_real", 0.5)], baselines.SCHEMA)
    merged = baselines.carry_over(baselines.load_metrics(spark, path, "a"), new)
    assert sorted(map(tuple, merged.collect())) == [("a", "fid_floor", 2.0, False), ("a", "pack_records", 10.0, True), ("a", "retrieval_real", 0.5, False)]
    baselines.save_metrics(merged, path)
    assert baselines.load_metrics(spark, path, "b").count() == 1
    sets = spark.createDataFrame([("a", 11), ("b", 3), ("c", 1)], "dataset string, records long")
    looked = baselines.baseline_lookup(sets, spark.read.schema(baselines.SCHEMA).parquet(path), {"fid_floor": 40.0, "cer_real": 0.2, "retrieval_real": 0.5})
    notes = {(r["dataset"], r["name"]): (r["value"], r["provenance"]) for r in looked.collect()}
    assert notes[("a", "fid_floor")] == (2.0, "stale") and notes[("b", "cer_real")] == (0.1, "measured, count not recorded")
    assert notes[("c", "cer_real")] == (0.2, "fallback")


def test_run_bundle(spark):
    path = fresh_path(spark, "run")
    rows = spark.range(5).withColumnRenamed("id", "key")
    runs.run_bundle_write(path, "one", per_sample=rows)
    runs.run_bundle_write(path, "two", per_sample=rows.limit(3))
    runs.run_bundle_write(path, "one", per_sample=rows.limit(2))
    back = runs.run_bundle_read(spark, path, "per_sample", "key bigint, run string")
    assert {r["run"]: r["count"] for r in back.groupBy("run").count().collect()} == {"one": 2, "two": 3}
    with pytest.raises(ValueError):
        runs.run_bundle_write(path, "one", images=rows)


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    from plumbline import session

    assert fresh_path(spark, "x") != fresh_path(spark, "x")

    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return type("C", (), {"get": staticmethod(lambda k, d=None: None)})

    class Fake:
        sparkContext = Cluster()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake())
    Fake.conf = type("C", (), {"get": staticmethod(lambda k, d=None: "hdfs://x/y/")})
    assert session.shared_folder(Fake()) == "hdfs://x/y"
