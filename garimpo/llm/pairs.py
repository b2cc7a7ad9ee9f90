"""Exact verification of candidate pairs, and groups from verified links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.batches import hasher, pieces, shingles
from garimpo.session import discard, written


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, text) to (id, shingles): the sorted distinct shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = hasher()
        for batch in batches:
            ids, out = batch.column(0), []
            for _, piece in pieces(batch.column(1).to_pylist()):
                flat, ends = hashed(piece)
                values, inside = shingles(flat, width)
                start = 0
                for end in ends.tolist():
                    stop = max(start, end - width + 1)
                    out.append(np.unique(values[start:stop]).tobytes())
                    start = end + 1
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles binary")


def pair_sets(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``shingle_sets`` of the texts (id, text) that occur in a pair (a, b)."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return shingle_sets(texts.join(ids, "id", "left_semi"), width)


def similar_pairs(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose texts (id, text) have a Jaccard similarity
    of shingle sets of at least ``threshold``; adds ``similarity``. Only texts that
    occur in a pair are cut into shingles. Two texts without any shingle are not
    similar."""
    return compared(pairs, written(pair_sets(pairs, texts, width), "shingles"), threshold)


def compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``similar_pairs`` by the ``pair_sets`` of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x = np.frombuffer(left[i].as_buffer(), np.uint64)
                y = np.frombuffer(right[i].as_buffer(), np.uint64)
                if len(x) and len(y) and min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    found[i] = shared / (len(both) - shared)
            keep = pa.array(found >= threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(found[found >= threshold])],
                ["a", "b", "similarity"],
            )

    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): (id, component), component being
    the smallest id. Alternates large-star and small-star steps, which need a
    number of rounds in the logarithm of the longest chain; every round is one
    aggregation and one join, nothing is gathered on the driver but a checksum."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, mark = written(edges, "links"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(small.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "links")
        discard(old)
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
