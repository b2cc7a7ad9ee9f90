"""Documented ad-hoc figures and presentation helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.operators.context import phrase_weight, phrases_of

LEAST_KEYWORDS = 2


def keyword_scores(docs: DataFrame, lexicon: DataFrame, least: int = LEAST_KEYWORDS) -> DataFrame:
    """(url_hash, relevance) of documents whose title or body contains keywords of a
    total weight of at least ``least``; of a repeated keyword the largest weight holds."""
    keywords = phrases_of(lexicon.where("category = 'keyword'"), "term", "weight")
    scored = docs.select("url_hash", phrase_weight(docs.sparkSession, F.concat_ws(" ", "title", "body"), keywords).alias("relevance"))
    return scored.where(F.col("relevance") >= least)


def count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"))


def top(scores: DataFrame, n: int = 10) -> DataFrame:
    return scores.orderBy(F.col("relevance").desc(), "url_hash").limit(n)


def average(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("relevance").alias("relevance"))


def shown_title(title: Column) -> Column:
    return F.coalesce(F.when(F.trim(title) != "", title), F.lit("Sem título"))


def shown_date(time: Column) -> Column:
    return F.date_format(time, "dd/MM/yyyy")


def page_window(spark: SparkSession, page: int, total: int) -> DataFrame:
    """(position, label) of the page numbers to show: two on each side of the page,
    the first and last, and an ellipsis for a gap. One page or none shows nothing."""
    if total <= 1:
        return spark.createDataFrame([], "position long, label string")
    low, high = max(1, page - 2), min(total, page + 2)
    labels = (["1"] if low > 1 else []) + (["…"] if low > 2 else []) + [str(i) for i in range(low, high + 1)]
    labels += (["…"] if high < total - 1 else []) + ([str(total)] if high < total else [])
    return spark.createDataFrame(list(enumerate(labels)), "position long, label string")
