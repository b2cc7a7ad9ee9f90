"""The inverted index: positional postings, vocabulary, weights, replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions import text as texts


#: A term in more than 1 / HOT_SHARE of the documents, and in more than HOT_LEAST.
HOT_SHARE, HOT_LEAST = 100, 100


def tokens(docs: DataFrame, text: str = "body") -> DataFrame:
    """(url_hash, tokens) of rows with a text that is not blank."""
    return docs.where(F.trim(text) != "").select("url_hash", texts.analyzed_tokens(text).alias("tokens"))


def postings(docs: DataFrame, text: str = "body") -> DataFrame:
    """(term, url_hash, tf, positions): positions count the tokens of a document from 0.

    A document's rows all come from its own row, so equal (url_hash, term) pairs
    meet in one aggregation with map-side lists; several rows of one url_hash would
    add up, reduce them to the latest first."""
    each = tokens(docs, text).select("url_hash", F.posexplode("tokens").alias("position", "term"))
    found = each.groupBy("url_hash", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    return found.select("term", "url_hash", "tf", "positions")


def unique_postings(rows: DataFrame) -> DataFrame:
    """One row of each (term, url_hash), with the largest tf. Rows with a null or
    blank term or a null url_hash are dropped."""
    clean = rows.where("url_hash IS NOT NULL AND trim(term) != ''")
    return clean.groupBy("term", "url_hash").agg(F.max("tf").alias("tf"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """(term, df, cf): documents with the term and its occurrences."""
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def collected(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary without terms that no document holds any more."""
    return vocabulary.where("df > 0")


def add_counts(old: DataFrame, change: DataFrame) -> DataFrame:
    """Vocabulary counters after adding the (term, df, cf) of a change."""
    both = old.select("term", "df", "cf").union(change.select("term", "df", "cf"))
    return collected(both.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))


def removal_counts(rows: DataFrame, replaced: DataFrame) -> DataFrame:
    """(term, df, cf) to add when the documents (url_hash) in ``replaced`` lose their
    postings: the negative counts of these."""
    gone = rows.join(replaced.select("url_hash").distinct(), "url_hash", "left_semi")
    counts = vocabulary(gone)
    return counts.select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))


def replace(rows: DataFrame, new: DataFrame, replaced: DataFrame) -> DataFrame:
    """Postings after the documents in ``replaced`` got the postings ``new``."""
    kept = rows.join(replaced.select("url_hash").distinct(), "url_hash", "left_anti").select(rows.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def index_idf(n: Column, df: Column) -> Column:
    """ln(N / df); null where no document has the term."""
    return F.when(df > 0, F.ln(n / df))


def query_idf(n: Column, df: Column) -> Column:
    """ln((1 + N) / (1 + df)) + 1; 0 where no document has the term."""
    return F.when(df > 0, F.ln((1 + n) / (1 + df)) + 1).otherwise(0.0)


def weighted(rows: DataFrame, n: int) -> DataFrame:
    """Postings with tfidf = tf * ln(N / df), df counted from the rows, once each task
    has counted its own. A term in more than 1 / HOT_SHARE of the documents takes its
    count from a list sent to every task, so its postings stay where they are: there
    are at most HOT_SHARE times as many such terms as a document has on average.
    Other terms meet their count by term."""
    counts = rows.groupBy("term").agg(F.count("*").alias("__df"))
    hot = counts.where(F.col("__df") > max(HOT_LEAST, n // HOT_SHARE))
    common = rows.join(F.broadcast(hot), "term")
    others = rows.join(F.broadcast(hot.select("term")), "term", "left_anti").join(counts, "term")
    return common.unionByName(others).withColumn("tfidf", F.col("tf") * index_idf(F.lit(float(n)), F.col("__df"))).drop("__df")


def metrics(rows: DataFrame) -> DataFrame:
    """(documents, tokens, terms) of postings, from one row per term and document."""
    return rows.agg(F.count_distinct("url_hash").alias("documents"), F.sum("tf").alias("tokens"), F.count_distinct("term").alias("terms"))
