"""The corpus pipeline: language, near-duplicates, repeated passages, mix of sources, tokens.

Each stage works on all rows that the stage before it kept and its decisions take effect: documents without a known
language go, one document of each near-duplicate group stays, repeated passages are cut out of the texts, and documents
stay as often as the mix takes them. The last stage gives the token ids and whether they decode to the text.

All stages but the last keep the columns of documents, whatever others there are and whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.bytebpe import encoded
from seqloom.llm.langid import identified
from seqloom.llm.mixing import mixed_documents
from seqloom.llm.simhash import near_deduplicated
from seqloom.llm.substrings import deduplicated
from seqloom.sources import read_table, stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the field knows.

    Null, empty and other texts without a letter have none and go; a null lang is no example; repeated rows are judged alike; ties go to the label that sorts first.
    """
    return identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    Null and empty texts and texts without a word are one group; rows are told apart by doc_id and text, a null doc_id coming after all others; of repeated rows one stays.
    """
    return near_deduplicated(docs, words=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that start elsewhere too; n_chars follows.

    Null texts stay null; rows of equal texts lose all that their text repeats, whatever their ids; no row goes, though its text may become empty.
    """
    out = deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words and are taken as their source's whole epochs and their hash say; a null source is a source of its own, after all others;
    repeated rows have hashes of their own.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, exact of each document of the mix; a null text is an empty one, repeated rows each have one."""
    return encoded(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("tokens", tokens)]
#: The field, the fingerprints' hash and the encoder can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for at, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stage(docs)
    return docs
