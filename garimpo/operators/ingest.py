"""Landing of crawled rows: freshness gate and keyed replacement."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

HOURS = 24


def latest(rows: DataFrame, key: str = "url_hash", time: str = "collected_at", tie: str = "seq") -> DataFrame:
    """One row of each key, the latest by time, then by tie. A null key is a key; a
    null time is older than any. The limit of one row per key is applied before the
    shuffle, so a key with a third of all rows moves one row per task."""
    order = Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(tie).desc())
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` in place of rows with their key. New rows wait
    for the index again."""
    fresh = new.withColumn("indexed_at", F.lit(None).cast("timestamp"))
    return latest(old.unionByName(fresh, allowMissingColumns=True))


def saw(seen: DataFrame, rows: DataFrame) -> DataFrame:
    """``seen`` (url_hash, collected_at, score) after ``rows`` were landed: the newest
    entry of each key. A landed row has no score yet; of equal times the one with a
    score stays."""
    both = seen.select("url_hash", "collected_at", "score").union(rows.select("url_hash", "collected_at", F.lit(None).cast("int")))
    return both.groupBy("url_hash").agg(F.max(F.struct("collected_at", "score")).alias("x")).select("url_hash", "x.collected_at", "x.score")


def should_consume(urls: DataFrame, seen: DataFrame, now: datetime | Column, mode: str = "intended") -> DataFrame:
    """``urls`` (url_hash) with the flag ``consume``, against seen (url_hash,
    collected_at, score).

    intended: unknown, or last collected 24 hours ago or earlier. observed: unknown,
    or younger than 24 hours and without a score in the cache."""
    if mode not in ("intended", "observed"):
        raise ValueError(f"unknown mode {mode}")
    last = seen.groupBy("url_hash").agg(F.max("collected_at").alias("__at"), F.max("score").alias("__score"))
    moment = now if isinstance(now, Column) else F.lit(now)
    hours = (F.unix_micros(moment) - F.unix_micros("__at")) / F.lit(3_600_000_000.0)
    known = F.col("__at").isNotNull()
    flag = ~known | (hours >= HOURS) if mode == "intended" else ~known | ((hours < HOURS) & F.col("__score").isNull())
    return urls.join(last, "url_hash", "left").withColumn("consume", flag).drop("__at", "__score")


def mark_indexed(docs: DataFrame, done: DataFrame, now: datetime | Column) -> DataFrame:
    """``docs`` with indexed_at set for the versions (url_hash, collected_at) in
    ``done``; a version collected again meanwhile stays pending. A null key or time is
    a value as any other."""
    moment = now if isinstance(now, Column) else F.lit(now)
    state = done.select(F.col("url_hash").alias("__key"), F.col("collected_at").alias("__at")).distinct().withColumn("__done", moment)
    joined = docs.join(state, F.col("url_hash").eqNullSafe(F.col("__key")) & F.col("collected_at").eqNullSafe(F.col("__at")), "left")
    return joined.withColumn("indexed_at", F.coalesce("__done", "indexed_at")).select(docs.columns)
