"""The inverted index kept in files, and its cycles.

Postings are stored twice, in buckets by term and in buckets by document, so a lookup
by a few terms or documents reads their buckets only. A posting keeps its tf; the
weight tf * ln(N / df) is made at lookup from the term's counters, which orders the
postings of a term as tf does. So nothing that is stored goes stale when N or a df
changes, and a cycle writes no more than its own documents:

    part=K/by_term, by_document   postings of the documents of cycle K
    part=K/counters               what the cycle adds to df and cf of each term
    part=K/removed                documents whose postings of earlier parts are void
    part=K/done                   number of documents; written last: the part counts

A part without ``done`` does not count and is written again. ``compact`` makes one part
of all.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.operators import index
from garimpo.session import written
from garimpo import files

BUCKETS = 64
POSTING = "term string, url_hash string, tf long, positions array<int>, bucket int"
COUNTER = "term string, df long, cf long, bucket int"


class StoredIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.parts: list[int] = []
        self._asked, self._df = None, {}
        self.documents = 0
        self.refresh()

    def refresh(self) -> None:
        """Take up what other writers have stored: the last whole part of all."""
        found = sorted(int(n[5:]) for n in files.names(self.spark, self.folder) if n.startswith("part=") and files.complete(self.spark, f"{self.folder}/{n}/done"))
        self.parts, self.documents = [], 0
        if found:
            last = self.spark.read.schema("documents long, first int").parquet(f"{self.folder}/part={found[-1]}/done").first()
            self.documents = last["documents"]
            self.parts = [k for k in found if k >= last["first"]]

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _numbers(self, values: list[str]) -> list[int]:
        """Buckets of a few values: Spark's xxhash64 of a text is XXH64 with seed 42."""
        signed = (((h := xxhash.xxh64_intdigest(v.encode(), 42)) ^ 1 << 63) - (1 << 63) for v in values)
        return sorted({h % self.buckets for h in signed})

    def _read(self, name: str, schema: str) -> DataFrame:
        """All parts of a table with their number ``part``."""
        out = self.spark.createDataFrame([], schema).withColumn("part", F.lit(0))
        for k in self.parts:
            each = self.spark.read.schema(schema).parquet(f"{self.folder}/part={k}/{name}").withColumn("part", F.lit(k))
            out = each if k == self.parts[0] else out.unionByName(each)
        return out

    def _live(self, rows: DataFrame) -> DataFrame:
        """Without the postings of documents that a later part replaced. Only
        documents collected again since the last ``compact`` are in that table."""
        if len(self.parts) < 2:
            return rows.drop("part")
        void = self._read("removed", "url_hash string").groupBy("url_hash").agg(F.max("part").alias("void"))
        return rows.join(void, "url_hash", "left").where("void IS NULL OR part >= void").drop("part", "void")

    def counters(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df, cf), of the given terms or of all."""
        rows = self._read("counters", COUNTER)
        if terms is not None:
            rows = rows.where(F.col("bucket").isin(self._numbers(terms)) & F.col("term").isin(terms))
        return index.collected(rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))

    def df(self, terms: list[str]) -> dict[str, int]:
        """df of the given terms; those that no document holds are left out."""
        asked = tuple(sorted(terms)), tuple(self.parts)
        if self._asked != asked:
            self._df = {r["term"]: r["df"] for r in self.counters(terms).select("term", "df").collect()}
            self._asked = asked
        return self._df

    def of_terms(self, terms: list[str]) -> DataFrame:
        """(term, url_hash, tf, tfidf) of a few terms."""
        rows = self._read("by_term", POSTING).where(F.col("bucket").isin(self._numbers(terms)) & F.col("term").isin(terms))
        found = self._live(rows.select("term", "url_hash", "tf", "part"))
        idf = F.lit(None).cast("double")
        for term, df in self.df(terms).items():
            idf = F.when(F.col("term") == term, F.log(F.lit(self.documents / df))).otherwise(idf)
        return found.withColumn("tfidf", F.col("tf") * idf)

    def of_documents(self, keys: list[str]) -> DataFrame:
        """(term, url_hash, tf) of a few documents."""
        rows = self._read("by_document", POSTING).where(F.col("bucket").isin(self._numbers(keys)) & F.col("url_hash").isin(keys))
        return self._live(rows.select("term", "url_hash", "tf", "part"))

    def with_terms(self, stems: DataFrame) -> DataFrame:
        """(url_hash) of the documents that hold any of many terms (stem)."""
        rows = self._read("by_term", POSTING).join(stems.withColumnRenamed("stem", "term"), "term", "left_semi")
        return self._live(rows.select("term", "url_hash", "tf", "part")).select("url_hash").distinct()

    def postings(self) -> DataFrame:
        """(term, url_hash, tf, positions) of the whole index."""
        return self._live(self._read("by_term", POSTING).drop("bucket"))

    def _write(self, rows: DataFrame, part: int, name: str, key: str, *order: Column) -> None:
        """Buckets are ranges of the key, so a term of many postings fills several
        files instead of one task."""
        keyed = rows.withColumn("bucket", self._bucket(key)).repartitionByRange("bucket", key, *order)
        keyed.sortWithinPartitions("bucket", key, *order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/part={part}/{name}")

    def _store(self, part: int, rows: DataFrame, counts: DataFrame, removed: DataFrame, documents: int, first: int) -> None:
        self._write(rows, part, "by_term", "term", F.col("tf").desc(), F.col("url_hash"))
        self._write(rows, part, "by_document", "url_hash", F.col("term"))
        self._write(counts, part, "counters", "term")
        removed.select("url_hash").write.mode("overwrite").parquet(f"{self.folder}/part={part}/removed")
        done = self.spark.createDataFrame([(documents, first)], "documents long, first int")
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/part={part}/done")
        self.refresh()

    def add(self, docs: DataFrame, documents: int, part: int | None = None) -> None:
        """Index ``docs`` (url_hash, body; one row per key), replacing what the index
        holds of them; ``documents`` is the size of the collection afterwards. Blank
        bodies have no postings, rows with a null key are left out. A part number, such as that of a micro-batch, makes
        the step repeatable: up to the last part that counts nothing is written again.
        Numbers double, for ``compact`` takes the odd ones."""
        number = (self.parts[-1] // 2 * 2 + 2 if self.parts else 0) if part is None else 2 * part
        if self.parts and number <= self.parts[-1]:
            return
        docs = written(docs.where("url_hash IS NOT NULL").select("url_hash", "body"), "waiting")
        rows = written(index.postings(docs), "postings")
        added = index.vocabulary(rows)
        removed = docs.select("url_hash").limit(0)
        if self.parts:
            held = self._read("by_document", POSTING)
            if docs.limit(self.buckets * 8 + 1).count() <= self.buckets * 8:
                held = held.where(F.col("bucket").isin([r["b"] for r in docs.select(self._bucket("url_hash").alias("b")).distinct().collect()]))
            old = self._live(held.select("term", "url_hash", "tf", "part").join(docs.select("url_hash"), "url_hash", "left_semi"))
            old = written(old, "replaced")
            removed = old.select("url_hash").distinct()
            less = index.vocabulary(old)
            added = added.union(less.select("term", -F.col("df"), -F.col("cf"))).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        self._store(number, rows, added, removed, documents, self.parts[0] if self.parts else number)

    def compact(self) -> None:
        """One part of all, without void postings and terms that no document holds.
        Nothing to do if nothing was added since. The parts it replaces stay for those
        who read them now, until the next time."""
        if not self.parts or (len(self.parts) == 1 and self.parts[0] % 2):
            return
        old, part = list(self.parts), self.parts[-1] // 2 * 2 + 1
        rows = written(self.postings(), "postings")
        self._store(part, rows, self.counters(), rows.select("url_hash").limit(0), self.documents, part)
        for name in files.names(self.spark, self.folder):
            if name.startswith("part=") and int(name[5:]) < part and int(name[5:]) not in old:
                files.remove(self.spark, f"{self.folder}/{name}")


class PlainIndex:
    """The same lookups over a table of weighted postings."""

    def __init__(self, rows: DataFrame, documents: int) -> None:
        self.spark, self.rows, self.documents = rows.sparkSession, rows, documents

    def counters(self, terms: list[str]) -> DataFrame:
        return index.vocabulary(self.rows.where(F.col("term").isin(terms)))

    def df(self, terms: list[str]) -> dict[str, int]:
        return {r["term"]: r["df"] for r in self.counters(terms).select("term", "df").collect()}

    def of_terms(self, terms: list[str]) -> DataFrame:
        return self.rows.where(F.col("term").isin(terms)).select("term", "url_hash", "tf", "tfidf")

    def of_documents(self, keys: list[str]) -> DataFrame:
        table = self.rows.sparkSession.createDataFrame([(k,) for k in keys], "url_hash string")
        return self.rows.join(table, "url_hash", "left_semi").select("term", "url_hash", "tf")

    def with_terms(self, stems: DataFrame) -> DataFrame:
        return self.rows.join(stems.withColumnRenamed("stem", "term"), "term", "left_semi").select("url_hash").distinct()
