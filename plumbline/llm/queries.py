"""The numbered queries: each operator bound to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat, decontaminate, language, prefixtree, quality, secrets, simhash, structure, suffixes, tiff, toxicity, vectorcodes
from plumbline.llm.common import held_out

VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    letters = toxicity.letter_model(docs)
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), letters, 5, 0)
    found = toxicity.predict(docs.select("doc_id", "text", held_out(5, 0).alias("held_out")), letters, scorer)
    return found.select("doc_id", "held_out", "score", "predicted")


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_secrets", secrets.sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranking = quality.fit(docs, table(spark, sf_dir, "labels"), 4, 2)
    found = quality.predict(docs.select("doc_id", "text", held_out(4, 2).alias("held_out")), ranking)
    return found.select("doc_id", "held_out", "score", "predicted")


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, 4, 2)
    found = language.predict(docs.select("doc_id", "text", held_out(4, 2).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


@query("op8_chat_format", chat.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


@query("op10_tiff")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(table(spark, sf_dir, "documents"))


@query("op11_vector_codes", vectorcodes.sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.codes(table(spark, sf_dir, "embeddings"))


@query("op12_structure_repair", structure.sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.damage_and_repair(table(spark, sf_dir, "conversations"))


@query("op13_ngram_join", prefixtree.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtree.like_components(table(spark, sf_dir, "documents"))
