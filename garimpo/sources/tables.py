"""Readers of the engine's tables, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from garimpo.session import prepared

DOCUMENTS = StructType(
    [StructField("seq", LongType()), *[StructField(c, StringType()) for c in ("url_hash", "url", "title", "body")], StructField("collected_at", TimestampType()), StructField("indexed_at", TimestampType())]
)
SEEN = StructType([StructField("url_hash", StringType()), StructField("collected_at", TimestampType()), StructField("score", IntegerType())])
POSTINGS = StructType(
    [StructField("term", StringType()), StructField("url_hash", StringType()), StructField("tf", LongType()), StructField("positions", ArrayType(IntegerType())), StructField("tfidf", DoubleType())]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, path: str, schema: StructType = DOCUMENTS) -> DataFrame:
    """Rows of Parquet files that land in a folder."""
    return prepared(spark).readStream.schema(schema).parquet(path)


def lookup(docs: DataFrame, url_hash: str) -> DataFrame:
    """The row of one key; no row if it is unknown."""
    return docs.where(F.col("url_hash") == url_hash).limit(1)


def pending(docs: DataFrame) -> DataFrame:
    """Rows that wait for the index."""
    return docs.where(F.col("indexed_at").isNull())


def succeeded(pages: DataFrame, status: str = "status") -> DataFrame:
    """Pages fetched with a 2xx status."""
    return pages.where(F.col(status).between(200, 299))


def is_feed(media_type: Column, uri: Column) -> Column:
    """Whether a page is read as a feed: its media type holds ``xml`` or its address
    ``sitemap``, in any case; a null holds nothing."""
    return F.coalesce(F.lower(media_type).contains("xml"), F.lit(False)) | F.coalesce(F.lower(uri).contains("sitemap"), F.lit(False))


def rendered(url: Column, hosts: list[str]) -> Column:
    """Whether a page needs a rendering source: its host is one of ``hosts``."""
    from garimpo.functions.url import host

    return F.coalesce(host(url).isin(hosts), F.lit(False))
