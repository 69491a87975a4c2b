"""Form descriptions in XML: one form holds lines, a line holds words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.text import Alphabet, is_blank
from plumbline.operators.reasons import Rule, first_reason

WORD = "struct<_id:string,_text:string>"
LINE = f"struct<_id:string,_segmentation:string,word:array<{WORD}>>"
FORM_SCHEMA = f"`_id` string, `_writer-id` string, line array<{LINE}>, `handwritten-part` struct<line:array<{LINE}>>"


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """One row per form; a malformed file stops the read."""
    return (
        spark.read.format("xml")
        .option("rowTag", "form")
        .option("mode", "FAILFAST")
        .schema(FORM_SCHEMA)
        .load(path)
        .select("*", F.col("_metadata.file_path").alias("path"))
    )


def forms_from_text(df: DataFrame, xml: Column, keep: list[str] | None = None) -> DataFrame:
    """The same rows from a column of XML documents.

    The row is exploded from an array of one, so that a document is parsed once: a later filter would be moved below a plain
    projection, with a parse for every field it asks for.
    """
    parsed = F.from_xml(xml, FORM_SCHEMA, {"mode": "FAILFAST", "rowTag": "form"})
    return df.select(*(keep or []), F.explode(F.array(parsed)).alias("__form")).select(*(keep or []), "__form.*")


def all_lines() -> Column:
    """A form's lines, directly below it or inside its written part."""
    nothing = F.array().cast(f"array<{LINE}>")
    return F.concat(F.coalesce("line", nothing), F.coalesce(F.col("`handwritten-part`.line"), nothing))


def validate_forms(forms: DataFrame, label: str = "_id") -> DataFrame:
    """(form, problems) for forms that lack what the parser needs; all problems at once."""
    lines = all_lines()
    words = F.flatten(F.transform(lines, lambda l: F.coalesce(l["word"], F.array().cast(f"array<{WORD}>"))))
    first = F.when(F.size(words) > 0, F.element_at(words, 1))
    problems = F.array_compact(
        F.array(
            F.when(F.col("`_writer-id`").isNull(), "form has no writer-id"),
            F.when(F.col("_id").isNull(), "form has no id"),
            F.when(F.size(lines) == 0, "no lines"),
            F.when(F.size(words) == 0, "no words"),
            F.when((F.size(words) > 0) & first["_id"].isNull(), "word has no id"),
            F.when((F.size(words) > 0) & first["_text"].isNull(), "word has no text"),
        )
    )
    return forms.select(F.col(label).alias("form"), problems.alias("problems")).where(F.size("problems") > 0)


def explode_words(forms: DataFrame) -> DataFrame:
    """One row per word with the ids of its line and form and where its image lies."""
    lines = forms.select("_id", F.col("`_writer-id`").alias("writer_id"), F.explode(all_lines()).alias("l"))
    words = lines.select("_id", "writer_id", "l._id", "l._segmentation", F.explode("l.word").alias("w")).toDF(
        "form_id", "writer_id", "line_id", "segmentation", "w"
    )
    word_id = F.coalesce("w._id", F.lit(""))
    return words.select(
        word_id.alias("word_id"),
        "form_id",
        F.coalesce("line_id", F.lit("")).alias("line_id"),
        "writer_id",
        F.coalesce("w._text", F.lit("")).alias("text"),
        F.coalesce("segmentation", F.lit("ok")).alias("segmentation"),
        F.concat(
            F.lit("words/"), F.substring_index("form_id", "-", 1), F.lit("/"), F.col("form_id"),
            F.lit("/"), word_id, F.lit(".png"),
        ).alias("image_path"),
    )


def scan_forms(
    forms: DataFrame,
    alphabet: Alphabet,
    images: DataFrame | None = None,
    skip_bad_segmentation: bool = True,
) -> DataFrame:
    """Words of the forms with the first reason each is set aside, if any.

    ``images`` holds the (relative) paths that exist; without it presence is not asked.
    """
    rows = explode_words(forms)
    rules = []
    if skip_bad_segmentation:
        rules.append(Rule(fixed.BAD_SEGMENTATION, F.col("segmentation") != "ok"))
    rules += [
        Rule(fixed.EMPTY_TEXT, is_blank(F.col("text"))),
        Rule(fixed.OUT_OF_CHARSET, ~alphabet.supports(F.col("text"))),
    ]
    if images is not None:
        there = images.select(F.col("path").alias("image_path"), F.lit(True).alias("__there")).dropDuplicates(["image_path"])
        rows = rows.join(there, "image_path", "left")
        rules.append(Rule(fixed.MISSING_IMAGE, F.col("__there").isNull()))
    return first_reason(rows, rules).drop("__there")
