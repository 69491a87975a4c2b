"""User models as plain functions of text, in the places where real ones plug in."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.vectors import vector_mean
from plumbline.operators import checks, rates, scorers
from plumbline.plans.registry import query, r6


def vowel_reader():
    return lambda texts: [t.replace("e", "") for t in texts]


def letter_counter():
    return lambda texts: [[t.count("a"), t.count("e"), t.count("t"), len(t)] for t in texts]


def long_word_finder():
    def look(images, texts):
        found = []
        for image, text in zip(images, texts, strict=True):
            absent = [(i, w) for i, w in enumerate(text.split(" ")) if w not in image]
            found.append((absent[0][1], absent[0][0], 12.0) if absent else None)
        return found

    return look


@query("read_with", """
SELECT p_brand, sum(levenshtein(replace(p_name, 'e', ''), p_name))::BIGINT AS errors, count(*) AS samples FROM part GROUP BY 1""")
def read_with(read):
    rows = scorers.read_with(read("part").select("p_brand", "p_name"), "p_name", vowel_reader)
    terms = rates.error_terms(rows, "reading", "p_name")
    return terms.groupBy("p_brand").agg(F.sum("errors").cast("bigint").alias("errors"), F.count(F.lit(1)).alias("samples"))


@query("embed_with", """
SELECT source, count(*) AS n, round(avg(length(text) - length(replace(text, 'a', ''))), 6) AS a, round(avg(length(text)), 6) AS chars
FROM documents GROUP BY 1""")
def embed_with(read):
    rows = scorers.embed_with(read("documents").select("source", "text"), "text", letter_counter)
    means = vector_mean(rows.select("source", "vector"), ["source"], "vector", d=4)
    return means.select("source", "n", r6(F.col("mean")[0]).alias("a"), r6(F.col("mean")[3]).alias("chars"))


@query("verify_with", """
SELECT p_partkey, CASE WHEN contains(p_type, split_part(p_name, ' ', 1)) THEN NULL ELSE split_part(p_name, ' ', 1) END AS word,
       CASE WHEN contains(p_type, split_part(p_name, ' ', 1)) THEN NULL ELSE 12.0::DOUBLE END AS support FROM part""")
def verify_with(read):
    rows = scorers.verify_with(read("part").select("p_partkey", "p_type", "p_name"), "p_type", "p_name", long_word_finder)
    return rows.select("p_partkey", "omission.word", "omission.support")


def bar_maker():
    """An output for each text, none for one that begins with b: a bar for each letter a, and one for the text."""
    return lambda texts, sizes: [None if t.startswith("b") else [float(size)] + [1.0] * t.count("a") for t, size in zip(texts, sizes, strict=True)]


@query("generate_with", """
SELECT p_partkey, CASE WHEN starts_with(p_name, 'b') THEN 'no output for the request' WHEN NOT contains(p_name, 'a') THEN 'flat' END AS fault,
       CASE WHEN NOT starts_with(p_name, 'b') THEN length(p_name) - length(replace(p_name, 'a', '')) + 1 END::INT AS width,
       CASE WHEN NOT starts_with(p_name, 'b') THEN p_size::DOUBLE END AS first FROM part WHERE p_size > 1""")
def generate_with(read):
    asked = read("part").where("p_size > 1").select("p_partkey", "p_name", "p_size")
    made = scorers.generate_with(asked, ["p_name", "p_size"], bar_maker)
    faults = checks.output_checks(made, "p_partkey", "output")
    return made.join(faults, "p_partkey", "left").select("p_partkey", "fault", F.when(F.col("output").isNotNull(), F.size("output")).alias("width"), F.get("output", F.lit(0)).alias("first"))
