"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import lines, minhash, mixing, packing, quality
from tessella.llm.tables import prepared, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Per cent of shingles that near-duplicates share at least; op5's contract of 85 holds for its query only.
SIMILAR = 80
#: A document that loses lines stays if one in so many of its characters is left: a copy of similarity 0.8 has a fifth of its own at most.
REMNANT = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside fold 2 of 4. Null and empty texts are scored as such."""
    labels = table(prepared(spark), sf_dir, "labels").where(quality.fold("doc_id", 4) != 2)
    return quality.accepted(docs.select(COLUMNS), labels.select("doc_id", F.col("quality").alias("label")))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand earlier in the corpus; a document that loses lines and has no word left goes, and so does one
    that keeps less than one in ``REMNANT`` of its characters: what an earlier copy leaves of it is no document.

    Null texts stay. An empty table, or nulls in any column, give what the operator gives.
    """
    prepared(spark)
    given = docs.select(*COLUMNS, F.length(F.col("text").cast("string")).alias("chars_before"))
    shorter = lines.remove_repeated_lines(given)
    whole, left = F.col("lines_removed") == 0, F.trim(F.translate("text", "\n\t\r", "   ")) != ""
    length = F.when(~whole, F.length("text")).otherwise(F.col("n_chars"))
    kept = shorter.where(whole | (left & (REMNANT * F.length("text") >= F.col("chars_before"))))
    return kept.withColumn("n_chars", length.cast("long")).select(COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, linked from a similarity of 0.8 on: the one of the smallest id. Texts without
    words, and rows without id, stay."""
    prepared(spark)
    return minhash.distinct_documents(docs.select(COLUMNS), SIMILAR)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target shares of tokens; nulls are values of their own."""
    topics = table(prepared(spark), sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"))
    return mixing.sampled_documents(docs.select(COLUMNS), topics)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1,024 tokens, and their ids."""
    prepared(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL: trees, MinHash and byte-pair ids. The tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of the last one."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
