"""A corpus pipeline of five stages, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import language, linededup, minhash, mixing, packing
from cairn.llm.common import materialize

#: The tokenizer of the packing stage.
TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in none of the languages learned from docs go, with those without text or a letter.

    Without labelled rows to learn from all documents with a letter stay;
    repeated rows stay or go together; an empty table gives no rows.
    """
    return language.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go; n_chars follows the text.

    A null text becomes the empty one; repeated rows lose the same lines; an
    empty table gives no rows.
    """
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return linededup.dedup_lines(docs).select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the first row of the one with the least doc_id.

    Rows without a word all stay, a null doc_id only where its group has no
    other; of repeated rows one stays; an empty table gives no rows.
    """
    return minhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources give documents up to their targets, some twice and some not at all.

    A null source is one of its own; null texts have no size and are taken with
    their source's whole epochs; ties at a cut are broken by the id's hash; an
    empty table gives no rows.
    """
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; null texts are an end id alone, repeated rows are packed each, an empty table gives no rows."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash_near_dedup", minhash_near_dedup), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: Language identification, MinHash and packing aren't SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all documents; each stage reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
