"""A cleaning pipeline over ``documents``: five stages, each one of the training-data operators.

Language ID drops documents that no learned language describes; line dedup removes lines that an earlier
line repeats; the Jaccard join leaves one document of each group of near duplicates; benchmark
decontamination drops documents that hold a benchmark item; BPE encodes and decodes what is left.
Clean documents stay. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import bpe, decontaminate, jaccard, langid, line_dedup
from chronoloom.llm.common import row_hashes, written
from chronoloom.llm.queries import table, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go of which the learned languages hold under a tenth, noise the rest, and texts that are null or without a letter.

    Where no language can be learned, all rows with a letter stay. Very long texts are judged whole; a null doc_id is one like others.
    """
    return langid.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts, n_chars follows; a document that they leave without a word goes.

    A null text has no lines and stays; very long texts are whole; rows without a doc_id count as the last.
    """
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def _numbered(docs: DataFrame) -> DataFrame:
    """(key, row): a number for each row, written so that it stays; null and reused doc_ids name no row."""
    return written(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each component stays, null last; rows of equal doc_id and text become one."""
    rows = _numbered(docs)
    found = jaccard.jaccard_components(rows.select(F.col("key").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("key"), "n_shingles", "component_id")
    named = found.join(rows.select("key", "row.doc_id", *row_hashes("row.text")), "key")
    empty = F.col("n_shingles") == 0  # linked with nothing: such rows are one by doc_id and text
    group = [F.when(~empty, F.col("component_id")).alias("component"), *(F.when(empty, F.col(c)).alias(f"empty_{c}") for c in ("doc_id", "th", "tg"))]
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = named.groupBy(*group).agg(F.min(order).alias("first")).select("first.key")
    return rows.join(first, "key", "left_semi").select("row.*").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold 0.8 of a benchmark item's shingles go, whatever their doc_id; each row of benchmark is an item.

    Null texts hold nothing and stay, as all rows do if benchmark is empty; very long texts are whole.
    """
    rows = _numbered(docs)
    items = _numbered(table(spark, sf_dir, "benchmark")).select(F.col("key").alias("item_id"), "row.text")
    leaks = decontaminate.contained_items(rows.select(F.col("key").alias("doc_id"), "row.text"), items).select(F.col("doc_id").alias("key")).distinct()
    return rows.join(leaks, "key", "left_anti").select("row.*").select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every document that is left."""
    return bpe.bpe_encode(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: No SQL expresses language ID or BPE; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
