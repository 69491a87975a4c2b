"""Texts rebuilt from indexed parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.text import Alphabet, is_blank
from plumbline.operators.reasons import EXCLUDED, Rule, first_reason


def reassemble(parts: DataFrame, by: list[str], index: str, text: str) -> DataFrame:
    """Per group: its parts' texts in index order, one space between, and whether none is missing.

    ``complete`` means the indices are exactly 0..n-1. Give it every part: filtering
    first would remove what shows a gap. Equal parts are combined before they are
    gathered, so a group of copies travels as one row and a count.
    """
    distinct = parts.groupBy(*by, F.col(index).alias("__i"), F.col(text).alias("__t")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    gathered = distinct.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("__i", "__t", "__n"))).alias("__parts"),
        F.sum("__n").alias("word_count"),
        F.min("__i").alias("__lo"),
        F.max("__i").alias("__hi"),
    )
    copies = F.flatten(F.transform("__parts", lambda p: F.array_repeat(p["__t"], p["__n"].cast("int"))))
    gapless = (
        (F.col("__lo") == 0)
        & (F.col("__hi") == F.col("word_count") - 1)
        & (F.size("__parts") == F.col("word_count"))
        & (F.size(F.array_distinct(F.transform("__parts", lambda p: p["__i"]))) == F.col("word_count"))
    )
    return gathered.select(*by, F.array_join(copies, " ").alias("text"), "word_count", gapless.alias("complete"))


def group_facts(parts: DataFrame, by: list[str], index: str, text: str, alphabet: Alphabet) -> DataFrame:
    """(by..., word_count, complete, blank, supported): what ``reassemble`` would find out about each group's text, without gathering it.

    Only flags and indices travel: a text is blank where all its parts are, and within the alphabet where they are and the space
    between two of them is. NULL parts count, but say nothing.
    """
    said = F.col(text).isNotNull()
    flags = parts.select(
        *by, F.col(index).alias("__i"), F.coalesce(is_blank(F.col(text)), F.lit(True)).alias("__blank"),
        F.coalesce(alphabet.supports(F.col(text)), F.lit(True)).alias("__fits"), said.cast("int").alias("__said"),
    )
    places = flags.groupBy(*by, "__i").agg(
        F.count(F.lit(1)).alias("__n"), F.bool_and("__blank").alias("__blank"), F.bool_and("__fits").alias("__fits"), F.sum("__said").alias("__said")
    )
    found = places.groupBy(*by).agg(
        F.sum("__n").alias("word_count"), F.count("__i").alias("__places"), F.min("__i").alias("__lo"), F.max("__i").alias("__hi"),
        F.bool_and("__blank").alias("blank"), F.bool_and("__fits").alias("__fits"), F.sum("__said").alias("__said"),
    )
    gapless = (F.col("__lo") == 0) & (F.col("__hi") == F.col("word_count") - 1) & (F.col("__places") == F.col("word_count"))
    fits = F.col("__fits") & ((F.col("__said") < 2) | alphabet.supports(F.lit(" ")))
    return found.select(*by, "word_count", gapless.alias("complete"), "blank", fits.alias("supported"))


def _group_rules(
    blank: Column, supported: Column, writer: str, passage: str, parsed: Column | None, exclude_writers: tuple[str, ...], exclude_texts: tuple[str, ...],
    keep_out_of_charset: bool, keep_incomplete: bool,
) -> list[Rule]:
    rules = [
        Rule(fixed.EXCLUDED_GROUP, F.col(writer).isin(*exclude_writers), EXCLUDED),
        Rule(fixed.EXCLUDED_TEXT, F.col(passage).isin(*exclude_texts), EXCLUDED),
        Rule(fixed.NO_PARTS, F.col("word_count").isNull()),
        Rule(fixed.EMPTY_TEXT, blank),
    ]
    if parsed is not None:
        rules.insert(0, Rule(fixed.UNPARSED_NAME, ~parsed))
    if not keep_out_of_charset:
        rules.append(Rule(fixed.OUT_OF_CHARSET, ~supported))
    if not keep_incomplete:
        rules.append(Rule(fixed.INCOMPLETE, ~F.col("complete")))
    return rules


def manifest_groups(
    groups: DataFrame,
    parts: DataFrame,
    by: list[str],
    index: str,
    text: str,
    alphabet: Alphabet,
    writer: str = "writer_id",
    passage: str = "text_id",
    parsed: Column | None = None,
    exclude_writers: tuple[str, ...] = fixed.DEFAULT_EXCLUDED_WRITERS,
    exclude_texts: tuple[str, ...] = fixed.DEFAULT_EXCLUDED_TEXTS,
    keep_out_of_charset: bool = False,
    keep_incomplete: bool = False,
    texts: bool = True,
) -> DataFrame:
    """Every group with its rebuilt text and the first reason it is set aside, if any.

    Order of the reasons: unparsed name, excluded writer, excluded passage, no parts,
    empty text, characters outside the alphabet, gaps. Without ``texts`` only the reasons are
    found out, and no text is gathered.
    """
    options = (writer, passage, parsed, exclude_writers, exclude_texts, keep_out_of_charset, keep_incomplete)
    if not texts:
        facts = groups.join(group_facts(parts, by, index, text, alphabet), by, "left")
        return first_reason(facts, _group_rules(F.col("blank"), F.col("supported"), *options)).drop("blank", "supported")
    joined = groups.join(reassemble(parts, by, index, text), by, "left")
    return first_reason(joined, _group_rules(is_blank(F.col("text")), alphabet.supports(F.col("text")), *options))
