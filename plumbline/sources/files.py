"""File listings and the records their names encode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.text import Alphabet, is_blank
from plumbline.operators.reasons import EXCLUDED, Rule, first_reason
from plumbline.operators.reassemble import manifest_groups
from plumbline.operators.skew import first_per_group


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file below ``root``; contents are never read.

    Files of no bytes, and names beginning with ``_`` or ``.``, are not listed.
    """
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    )


def components(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def crop_stem(path: Column) -> Column:
    """Name of a ``.tif`` file without the suffix."""
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - 4)


def _inside(path: Column, folder: str) -> Column:
    return F.array_contains(components(path), folder)


def _side(path: Column) -> Column:
    return F.when(_inside(path, "trainset"), "trainset").otherwise("testset")


def scan_pages(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, unparsed paths, one row of facts) from a listing.

    Word and line crops belong to other scans and are passed over. A page present
    twice keeps its first path.
    """
    path = F.col("path")
    images = files.where(
        F.regexp_like(path, F.lit(fixed.IMAGE_SUFFIX)) & ~_inside(path, "words") & ~_inside(path, "lines")
    ).withColumn("__name", file_name(path))
    matched = F.regexp_like("__name", F.lit(fixed.PAGE_NAME))
    named = images.where(matched).select(
        F.concat_ws("-", F.regexp_extract("__name", fixed.PAGE_NAME, 1), F.regexp_extract("__name", fixed.PAGE_NAME, 2)).alias("page_id"),
        F.regexp_extract("__name", fixed.PAGE_NAME, 1).alias("writer_id"),
        F.regexp_extract("__name", fixed.PAGE_NAME, 2).alias("text_id"),
        path,
    )
    pages = first_per_group(named, ["page_id"], [components(path)]).orderBy("page_id")
    unparsed = images.where(~matched).select("path")
    facts = files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.bool_or(F.endswith(path, F.lit(".xml"))), F.lit(False)).alias("has_annotations"),
    )
    return pages, unparsed, facts


def parse_parts(files: DataFrame) -> DataFrame:
    """Word crops with the five fields of their names; NULL fields where the name does not parse."""
    path = F.col("path")
    stem = crop_stem(path)
    # Of the five fields only the last may hold hyphens.
    fields = F.when(F.regexp_like(stem, F.lit(fixed.PART_NAME)), F.split(stem, "-", 5))
    crops = files.where(F.endswith(path, F.lit(".tif")) & _inside(path, "words")).withColumn("__f", fields)
    ok = F.col("__f").isNotNull()

    def field(i: int) -> Column:
        return F.col("__f")[i - 1]

    return crops.select(
        field(1).alias("writer_id"),
        field(2).alias("text_id"),
        field(3).cast("int").alias("line_index"),
        field(4).cast("int").alias("word_index"),
        field(5).alias("text"),
        path,
        _side(path).alias("split"),
        ok.alias("parsed"),
    )


def scan_parts(
    files: DataFrame,
    alphabet: Alphabet,
    exclude_writers: tuple[str, ...] = fixed.DEFAULT_EXCLUDED_WRITERS,
    keep_out_of_charset: bool = False,
) -> DataFrame:
    """Word crops with the first reason each is set aside, if any."""
    rules = [
        Rule(fixed.UNPARSED_NAME, ~F.col("parsed")),
        Rule(fixed.EXCLUDED_GROUP, F.col("writer_id").isin(*exclude_writers), EXCLUDED),
        Rule(fixed.EMPTY_TEXT, is_blank(F.col("text"))),
    ]
    if not keep_out_of_charset:
        rules.append(Rule(fixed.OUT_OF_CHARSET, ~alphabet.supports(F.col("text"))))
    return first_reason(parse_parts(files), rules)


def scan_groups(files: DataFrame, alphabet: Alphabet, **options) -> DataFrame:
    """Line crops of a listing, each with the text its word crops spell."""
    path = F.col("path")
    crops = files.where(F.endswith(path, F.lit(".tif")) & _inside(path, "lines")).withColumn("__stem", crop_stem(path))
    ok = F.regexp_like("__stem", F.lit(fixed.LINE_NAME))

    def field(i: int) -> Column:
        return F.when(ok, F.split("__stem", "-")[i - 1])

    lines = crops.select(
        field(1).alias("writer_id"),
        field(2).alias("text_id"),
        field(3).cast("int").alias("line_index"),
        path,
        _side(path).alias("split"),
        ok.alias("parsed"),
    )
    parts = parse_parts(files).where("parsed")
    return manifest_groups(
        lines, parts, ["writer_id", "text_id", "line_index"], "word_index", "text", alphabet,
        parsed=F.col("parsed"), **options,
    )


def stable_order(df: DataFrame, ids: list[str] = ["writer_id", "text_id"], places: list[str] = ["line_index"]) -> DataFrame:
    """Total order by ids as text, then by places as numbers."""
    return df.orderBy(*[F.col(c).cast("string") for c in ids], *[F.col(c).cast("bigint") for c in places])


def numbered_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no from 1, text) of each line of the text files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return number_lines(whole, ["path"], F.col("value"))


def number_lines(df: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """Lines of ``text``, numbered from 1; an end-of-line at the very end adds no line."""
    body = F.regexp_replace(text, rf"(?:{fixed.LINE_END})\z", "")
    rows = df.where(F.length(text) > 0).select(*keep, F.posexplode(F.split(body, fixed.LINE_END)).alias("line_no", "text"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


def parse_codes(df: DataFrame, value: Column, prefix: str = fixed.CODE_PREFIX) -> DataFrame:
    """(judge, trial, choice) from answer codes that begin with ``prefix``, one code a line; other lines are passed over."""
    fields = F.split(F.trim(value), ";", 3)
    lines = df.select(fields.alias("f")).where((F.col("f")[0] == prefix) & (F.size("f") == 3))
    items = lines.select(
        F.col("f")[1].alias("judge"),
        F.explode(F.filter(F.split(F.col("f")[2], r"\s+"), lambda w: w != "")).alias("item"),
    )
    return items.select(
        "judge",
        F.expr("cast(substring(item, 1, length(item) - 1) as int)").alias("trial"),
        F.substring("item", -1, 1).alias("choice"),
    )


def limit_records(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` records in key order."""
    return df.orderBy(*order).limit(n)
