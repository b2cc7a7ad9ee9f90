"""Frequency of every distinct value or term (problem 3).

Method: suffix array with common-prefix intervals, cut to a depth of n tokens and
spread over the cluster. A suffix goes to the partition of its first token and
record, so all suffixes of one record that share a prefix meet in one partition
while a frequent token is spread over all of them. Spark sorts each partition's
suffixes, on disk where they are many; the common prefix of neighbours bounds the
intervals, an interval's size is the occurrence count of its n-gram, and for the
record count every suffix is subtracted whose predecessor of the same record shares
the prefix: the least common prefix between the two. Partial counts are added up.
The terms of an inverted index are texts of one token: depth one of the same array.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RARE, COMMON = 2, 0.25  # df <= RARE is rare, df > COMMON * N is common


@F.arrow_udf(StringType())
def clean_term(term: pa.Array) -> pa.Array:
    """NFC, trimmed and lower-cased; every distinct value of a batch is cleaned once."""
    coded = pc.dictionary_encode(term)
    values = [None if v is None else unicodedata.normalize("NFC", v).strip().lower() for v in coded.dictionary.to_pylist()]
    return pa.array(values, pa.string()).take(coded.indices)


def record_key(column: Column) -> Column:
    """128 bits that stand for a record's key."""
    return F.struct(F.xxhash64(F.lit(1), column).alias("x"), F.xxhash64(F.lit(2), column).alias("y"))


def common_prefixes(codes: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order. ``codes`` holds
    a row of token codes per suffix, -1 behind its end."""
    out = np.zeros(len(codes), np.int16)
    out[1:] = np.cumprod((codes[1:] == codes[:-1]) & (codes[1:] >= 0), axis=1, dtype=np.int16).sum(axis=1)
    return out


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first .. last] for many ranges, by a table of powers of two."""
    level, table = np.zeros(len(first), np.int64), [values]
    size = last - first + 1
    np.floor(np.log2(size, where=size > 0, out=np.zeros(len(size))), out=level, casting="unsafe")
    for k in range(int(level.max(initial=0))):
        table.append(np.minimum(table[-1][: -(1 << k)], table[-1][1 << k :]))
    out = np.zeros(len(first), values.dtype)
    for k, row in enumerate(table):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[first[at]], row[last[at] - (1 << k) + 1])
    return out


def repeat_depths(prefix: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Depth to which a suffix repeats an earlier one of its own record (x, y)."""
    order = np.lexsort((np.arange(len(x)), y, x))
    same = (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])
    before, after = order[:-1][same], order[1:][same]
    out = np.zeros(len(x), prefix.dtype)
    out[after] = range_minima(prefix, before + 1, after)
    return out


def interval_counts(prefix: np.ndarray, length: np.ndarray, repeats: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first suffix, occurrences, records) of the intervals of one depth."""
    long = np.flatnonzero(length >= depth)
    starts = np.flatnonzero(prefix[long] < depth)
    if not len(starts):
        return starts, starts, starts
    sizes = np.diff(np.append(starts, len(long)))
    return long[starts], sizes, sizes - np.add.reduceat((repeats[long] >= depth).astype(np.int64), starts)


def _blocks(batches: Iterator[pa.RecordBatch], ends: Callable[[pa.Table], np.ndarray], rows: int = 200_000) -> Iterator[pa.Table]:
    """Sorted batches as tables of at least ``rows`` rows, cut where ``ends`` says
    that a row does not belong with the one before it."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cuts = np.flatnonzero(ends(table))
        if not len(cuts):
            held, rows = table.to_batches(), 2 * size  # one group so far: ask again when it has doubled
            continue
        yield table.slice(0, cuts[-1])
        held = pa.Table.from_batches(table.slice(cuts[-1]).to_batches()).combine_chunks().to_batches()
        size = sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _new(values: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before it; the first does not count."""
    values = values.combine_chunks()
    out = np.zeros(len(values), bool)
    out[1:] = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth-one intervals of sorted (term, x, y, tf): partial (term, occurrences,
    records). A record's repeats of a term are neighbours, of which the largest tf
    counts."""

    def ends(table: pa.Table) -> np.ndarray:
        x, y = _numbers(table, "x"), _numbers(table, "y")
        out = _new(table.column("term"))
        out[1:] |= (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        return out

    for table in _blocks(batches, ends):
        term = table.column("term").combine_chunks()
        new = _new(table.column("term"))
        prefix = (~new).astype(np.int16)
        prefix[0] = 0
        fresh = ends(table)
        fresh[0] = True
        repeats = np.where(fresh, 0, prefix)
        first, _, records = interval_counts(prefix, np.ones(len(prefix), np.int16), repeats, 1)
        heads = np.flatnonzero(fresh)
        weight = np.zeros(len(prefix), np.int64)
        weight[heads] = np.maximum.reduceat(_numbers(table, "tf"), heads)
        yield pa.RecordBatch.from_arrays([term.take(pa.array(first)), pa.array(np.add.reduceat(weight, first)), pa.array(records)], ["term", "occurrences", "records"])


def term_counts(postings: DataFrame, term: str = "term", record: str = "url_hash", weight: str = "tf") -> DataFrame:
    """(term, occurrences, records) of every distinct term.

    Terms are equal after NFC, trimming and lower-casing. Rows with a null or
    blank term or a null record are no use of a term. A repeated (term, record)
    counts once, with its largest weight; a null weight counts 0. An empty table
    gives no rows."""
    rows = postings.select(clean_term(F.col(term)).alias("term"), F.col(record).alias("record"), F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("tf"))
    rows = rows.where("record IS NOT NULL AND term != ''").select("term", record_key(F.col("record")).alias("r"), "tf").select("term", "r.x", "r.y", "tf")
    sorted_ = rows.repartition("term", "x").sortWithinPartitions("term", "x", "y")
    partial = sorted_.mapInArrow(_terms, "term string, occurrences long, records long")
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(postings: DataFrame, term: str = "term", record: str = "url_hash", weight: str = "tf", rare: int = RARE, common: float = COMMON) -> DataFrame:
    """(term, occurrences, records, mark): mark is ``rare`` for terms in at most
    ``rare`` records, ``common`` for those in more than the share ``common`` of
    all records with a non-null key, null otherwise. ``rare`` wins a tie."""
    n = postings.select(record_key(F.col(record)).alias("r")).where(F.col(record).isNotNull()).distinct().count()
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common * n), "common")
    return term_counts(postings, term, record, weight).withColumn("mark", mark)


def ngram_counts(docs: DataFrame, record: str, tokens: str, max_n: int = 3) -> DataFrame:
    """(n, ngram, occurrences, records) of every n-gram up to ``max_n`` tokens.

    ``tokens`` is an array column; null tokens break no n-gram but are skipped, a
    null array counts as empty, rows with a null record are left out, and rows of one
    record are one record, though no n-gram reaches from one to the next. N-grams are
    their tokens joined by a blank."""
    clean = docs.where(F.col(record).isNotNull()).select(record_key(F.col(record)).alias("r"), F.filter(F.col(tokens), lambda t: t.isNotNull()).alias("t"))
    suffix = clean.select("r.x", "r.y", F.posexplode("t").alias("i", "first"), "t").select("x", "y", "first", F.slice("t", F.col("i") + 1, max_n).alias("s"))
    rows = suffix.repartition("first", "x").sortWithinPartitions("first", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, lambda t: _new(t.column("first"))):
            suffixes = table.column("s").combine_chunks()
            length = pc.list_value_length(suffixes).to_numpy()
            flat = suffixes.flatten().dictionary_encode().indices.to_numpy()
            codes = np.full((len(length), max_n), -1, np.int64)
            codes[np.arange(max_n) < length[:, None]] = flat
            prefix = common_prefixes(codes)
            repeats = repeat_depths(prefix, _numbers(table, "x"), _numbers(table, "y"))
            for n in range(1, max_n + 1):
                first, occurrences, records = interval_counts(prefix, length, repeats, n)
                if len(first):
                    grams = pc.binary_join(pc.list_slice(suffixes.take(pa.array(first)), 0, n), " ")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), n)), grams.cast(pa.string()), pa.array(occurrences), pa.array(records)], ["n", "ngram", "occurrences", "records"])

    partial = rows.mapInArrow(run, "n long, ngram string, occurrences long, records long")
    return partial.groupBy("n", "ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
