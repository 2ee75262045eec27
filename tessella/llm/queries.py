"""Registered queries of the text operators, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import audit, bpe, lines, minhash, mixing, negatives, neighbours, packing, quality, rules, sql, substrings, suffixes, toxicity
from tessella.llm.tables import prepared, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    """Register ``(spark, sf_dir) -> DataFrame`` by its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepared(spark), sf_dir)

    run.__name__, run.__doc__, run.__module__ = fn.__name__, fn.__doc__, fn.__module__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1,024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


@query
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product for every 20th vector, among all."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words that a document with a smaller id has as well, removed from all documents."""
    found = substrings.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", substrings.digest("kept_text").alias("kept_sha256"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside fold 0 of 5."""
    docs, held = table(spark, sf_dir, "documents"), quality.fold("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.score_toxicity(docs, labels).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that start more than once, removed from all documents."""
    found = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and risk-controlled cutoffs for every document."""
    found = rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", "kept")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside fold 2 of 4."""
    docs, held = table(spark, sf_dir, "documents"), quality.fold("doc_id", 4) == 2
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("quality").alias("label"))
    return quality.classify(docs, labels).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probabilities of all documents that meet the smoothed shares of source, language and topic, at the budget this allows."""
    topics = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"))
    return mixing.mix_documents(table(spark, sf_dir, "documents"), topics)


@query
def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand earlier in the corpus: short ones by equality, from 16 characters on up to one edit."""
    found = lines.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("lines_before").alias("n_lines"), F.col("lines_removed").alias("n_removed"), substrings.digest("text").alias("kept_sha256"))


@query
def op8_lines_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op8_lines``, with a threshold of one to three edits that grows with the length of a line."""
    found = lines.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), lines.GROWING)
    return found.select("doc_id", F.col("lines_before").alias("n_lines"), F.col("lines_removed").alias("n_removed"), substrings.digest("text").alias("kept_sha256"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector, among all; every seventh vector first gets the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label, "embedding")
    return negatives.mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in each of their 120 orders."""
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids, and back."""
    found = bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_tokens", F.sha2("packed_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


ORACLE["op11_hard_negatives"] = negatives.negatives_sql()
ORACLE["op12_filter_audit"] = audit.audit_sql()
ORACLE["op7_mixing"] = mixing.mixing_sql()
ORACLE["op8_lines"] = lines.LINES_SQL
ORACLE["op3_substrings"] = sql.SUBSTRINGS
ORACLE["op5_minhash"] = sql.MINHASH
ORACLE["op6_suffixes"] = sql.SUFFIXES
ORACLE["op9_quality_rules"] = sql.quality_rules()
