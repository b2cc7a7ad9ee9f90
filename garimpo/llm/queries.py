"""Queries and SQL of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import text as texts
from garimpo.llm import batch_dedup, boilerplate, frequencies, leaks, mixing, near_duplicates, quality, repeated_lines, residue, sql
from garimpo.session import prepared


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    since = F.to_timestamp(F.lit("2026-03-01 00:00:00+00:00"))
    rows = batch_dedup.repeated_rows(table(spark, folder, "documents_in"), "seq", "body", "collected_at", since, width=3, threshold=0.6, min_words=60)
    return rows.withColumnRenamed("id", "seq")


def p2_residue(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_rows(table(spark, folder, "documents_in"), "seq", "title", "body", "url").withColumnRenamed("id", "seq")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_residue(spark, folder).select("seq").distinct()


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    return frequencies.marked_terms(table(spark, folder, "postings"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_terms(spark, folder).where("mark IS NOT NULL").select("term", "mark")


def p3_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Every n-gram of up to three words of the titles, a page being a record."""
    pages = table(spark, folder, "documents_in").select("url_hash", texts.word_array(F.col("title")).alias("words"))
    return frequencies.ngram_counts(pages, "url_hash", "words", 3)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, folder, "documents_in"), "seq", "url", "url_hash", "body").withColumnRenamed("id", "seq")


def p4_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The bodies without the repeated lines."""
    rows = table(spark, folder, "documents_in")
    found = p4_found(spark, folder).withColumnRenamed("seq", "id")
    return repeated_lines.without_lines(rows, found, "seq", "body").select("seq", "body")


def p4_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated text by chunks alone, wherever lines begin or end."""
    found = repeated_lines.repeated_spans(table(spark, folder, "documents_in"), "seq", "url", "url_hash", "body")
    return found.withColumnRenamed("id", "seq")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, folder, "documents_in"), "seq", "title", "body", threshold=0.6, width=3, min_words=60)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.pairs_of_groups(p5_groups(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.boilerplate_lines(table(spark, folder, "documents_in"), "seq", "url", "title", "body").withColumnRenamed("id", "seq")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).withColumn("similarity", F.round("similarity", 6))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).where("exact_windows > 0").select("doc_id", "item_id")


#: Folder of the public tokenizers' vocabularies, and the one that counts tokens.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), f"{TOKENIZERS}/{VOCABULARY}")[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), f"{TOKENIZERS}/{VOCABULARY}")[1]


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_statistics(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "common_words")).withColumnRenamed("id", "doc_id")


def p9_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics that do not depend on the model."""
    shares = [F.round(c, 6).alias(c) for c in ("mean_word_length", "line_end_share", "common_share")]
    return p9_statistics(spark, folder).select("doc_id", "words", *shares)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.no_prose(p9_statistics(spark, folder).withColumnRenamed("doc_id", "id")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_residue": p2_residue,
    "p3_found": p3_found,
    "p3_terms": p3_terms,
    "p3_ngrams": p3_ngrams,
    "p4_found": p4_found,
    "p4_cut": p4_cut,
    "p4_spans": p4_spans,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_counts": p9_counts,
    "p9_statistics": p9_statistics,
}

SQL: dict[str, str] = sql.SQL
