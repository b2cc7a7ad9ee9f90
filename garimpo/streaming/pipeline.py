"""Structured Streaming: landing with replacement, keyed dedupe, index cycles.

No table format with MERGE is assumed. A landed table is kept in buckets by key; a
micro-batch rewrites only the buckets that it touches, under its own number, and then
writes a manifest that names the valid version of every bucket. A reader follows the
newest manifest and sees whole batches only; a batch that is run again after a failure
overwrites its own files. Versions that no kept manifest names are removed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from garimpo.operators import ingest
from garimpo.operators.stored import StoredIndex
from garimpo.session import written
from garimpo import files
from garimpo.sources.tables import DOCUMENTS, SEEN

MOST_PARTS = 16  # parts of the index that a lookup reads; beyond it they become one
BUCKETS, KEPT = 64, 4  # buckets of a table; manifests that stay, of two batches and their cycles


class Landed:
    """A keyed table in versioned buckets under one folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str = "url_hash", buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets

    def manifests(self) -> list[int]:
        found = files.names(self.spark, f"{self.folder}/manifest")
        return sorted(int(n) for n in found if files.complete(self.spark, f"{self.folder}/manifest/{n}"))

    def _valid(self, before: int | None = None) -> dict[int, int]:
        """Bucket to version by the newest manifest, or the newest below ``before``."""
        found = [n for n in self.manifests() if before is None or n < before]
        if not found:
            return {}
        rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.folder}/manifest/{found[-1]}")
        return {r["bucket"]: r["version"] for r in rows.collect()}

    def _read(self, valid: dict[int, int]) -> DataFrame:
        if not valid:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/v{v}/bucket={b}" for b, v in sorted(valid.items())])

    def read(self, before: int | None = None) -> DataFrame:
        """The table, or its state before a batch."""
        return self._read(self._valid(before))

    def merge(self, rows: DataFrame, batch: int, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the table by ``change(old, rows)`` where ``rows`` have keys: change
        must work key by key. Null keys have a bucket as any other."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows = written(rows, "landing")
        touched = {r["b"] for r in rows.select(bucket.alias("b")).distinct().collect()}  # at most ``buckets``
        valid = self._valid(batch)
        new = change(self._read({b: v for b, v in valid.items() if b in touched}), rows)
        new.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v{batch}")
        valid.update(dict.fromkeys(touched, batch))
        if valid:
            table = self.spark.createDataFrame(sorted(valid.items()), "bucket int, version int")
            table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{batch}")
        self._clean()

    def _clean(self) -> None:
        """Remove manifests but the last KEPT, and the versions that none of these names."""
        found = self.manifests()
        named = {}
        for n in found[-KEPT:]:
            for b, v in self._valid(n + 1).items():
                named.setdefault(v, set()).add(b)
        for n in found[:-KEPT]:
            files.remove(self.spark, f"{self.folder}/manifest/{n}")
        for name in files.names(self.spark, self.folder):
            if name.startswith("v") and int(name[1:]) <= (found[-1] if found else -1):
                kept = named.get(int(name[1:]), set())
                if not kept:
                    files.remove(self.spark, f"{self.folder}/{name}")
                    continue
                for part in files.names(self.spark, f"{self.folder}/{name}"):
                    if part.startswith("bucket=") and int(part[7:]) not in kept:
                        files.remove(self.spark, f"{self.folder}/{name}/{part}")


def land(rows: DataFrame, table: Landed, checkpoint: str, trigger: dict | None = None, seen: Landed | None = None, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Keep the latest row of every key of a stream of crawled rows, and in ``seen``
    when each key was last collected. ``after`` runs with the number of each batch, for
    an index cycle. The default trigger takes what has landed and stops; schedule it,
    or pass ``{"processingTime": "30 minutes"}``."""

    def batch(df: DataFrame, number: int) -> None:
        df = written(df, "batch")
        table.merge(df, 2 * number, ingest.upsert)
        if seen is not None:
            seen.merge(df.where("url_hash IS NOT NULL"), 2 * number, ingest.saw)
        if after is not None:
            after(number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fresh(rows: DataFrame, hours: int = ingest.HOURS) -> DataFrame:
    """The first row of a key within ``hours``: state older than that is dropped."""
    return rows.withWatermark("collected_at", f"{hours} hours").dropDuplicatesWithinWatermark(["url_hash"])


def index_cycle(table: Landed, stored: StoredIndex, number: int, now: datetime) -> None:
    """Index what is pending after batch ``number`` and mark it as indexed. Old postings
    are replaced; blank bodies and null keys are marked too. Landing writes the even
    versions of the table, its cycle the odd ones, so both may run again after a
    failure: each reads the state before its own version, and the index keeps a part
    that counts."""
    docs = table.read(before=2 * number + 1)
    waiting = written(docs.where(F.col("indexed_at").isNull()), "pending")
    stored.add(waiting, docs.count(), number)
    if len(stored.parts) > MOST_PARTS:
        stored.compact()
    table.merge(waiting, 2 * number + 1, lambda old, done: ingest.mark_indexed(old, done, now))


def cycle_after(table: Landed, stored: StoredIndex, now: Callable[[], datetime]) -> Callable[[int], None]:
    """An ``after`` for ``land`` that indexes every batch."""
    return lambda number: index_cycle(table, stored, number, now())


__all__ = ["DOCUMENTS", "SEEN", "Landed", "cycle_after", "fresh", "index_cycle", "land"]
