"""Evaluation texts leaking into training text (problem 7).

Method: every window of the size of an item's leak unit (13 words, or the whole
passage if that is shorter) gets a 64-bit SimHash. A multi-index over four blocks
of 16 bits finds all item windows within a Hamming distance of 3 of a corpus
window: two fingerprints that differ in at most three bits agree in a block. An
exact weighted-shingle similarity then verifies the candidates.

A fingerprint moves by about seven bits when one of thirteen words is replaced, so
only about one in sixteen such windows lies within the radius: windows of equal
words are found for certain, near windows are a bonus. A shingle's weight is 1 plus the logarithm of the share of all
passages without it, so that stock wordings weigh less than wordings of one item.

The item index is bounded: items are taken in blocks of at most ``BLOCK_CHARS``
characters, the corpus is streamed past each block, and nothing is shuffled but
the verified rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.batches import U64, Hasher, hasher, pieces, shingles
from garimpo.llm.shared import Shared
from garimpo.session import written

UNIT, RADIUS, BLOCKS, SHINGLE = 13, 3, 4, 3
#: Passages of one index, in characters; its arrays take about 40 bytes for each.
BLOCK_CHARS = 4_000_000
ONES = 0x0101010101010101


def simhashes(flat: np.ndarray, width: int, spread: np.ndarray) -> np.ndarray:
    """64-bit SimHashes of all windows of ``width`` < 128 words: each bit is the
    majority of the words' hash bits. Eight bits are summed at once, one in each
    byte of a 64-bit lane."""
    n = len(flat) - width + 1
    out = np.zeros(max(n, 0), U64)
    if n <= 0:
        return out
    raise_by = U64((127 - width // 2) * ONES)
    for k in range(8):
        power, size = spread[(flat >> U64(8 * k)) & U64(255)], 1
        total, done = None, 0
        while True:  # windows of 1, 2, 4 ... words make up any width
            if width & size:
                part = power[done : done + n]
                total = part if total is None else total + part
                done += size
            if size * 2 > width:
                break
            power = power[: len(power) - size] + power[size:]
            size *= 2
        bits = (((total + raise_by) & U64(0x80 * ONES)) >> U64(7)) * U64(0x0102040810204080) >> U64(56)
        out |= bits << U64(8 * k)
    return out


def spread_table() -> np.ndarray:
    """Byte value to a lane with one of its bits in each byte."""
    values = np.arange(256, dtype=np.uint64)
    return sum(((values >> U64(j)) & U64(1)) << U64(8 * j) for j in range(8))


class Index:
    """Multi-index of the windows of one width of the items' passages."""

    def __init__(self, width: int, flats: list[np.ndarray], numbers: list[int], weights: dict[int, float]) -> None:
        self.width, self.step = width, min(SHINGLE, width)
        spread = spread_table()
        exact, prints, grams, owner = [], [], [], []
        for flat, number in zip(flats, numbers):
            whole, _ = shingles(flat, width)
            parts, _ = shingles(flat, self.step)
            per = width - self.step + 1
            exact.append(whole)
            prints.append(simhashes(flat, width, spread))
            grams.append(np.lib.stride_tricks.sliding_window_view(parts, per))
            owner.append(np.full(len(whole), number))
        exact, owner = np.concatenate(exact), np.concatenate(owner)
        self.exact, first, group = np.unique(exact, return_index=True, return_inverse=True)
        self.prints, self.grams = np.concatenate(prints)[first], np.concatenate(grams)[first]
        self.weight = np.vectorize(lambda g: weights.get(int(g), 1.0), otypes=[float])(self.grams)
        pairs = np.unique(np.stack([group.ravel(), owner]), axis=1)
        self.item, self.item_start = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.exact) + 1))
        self.blocks = []
        for k in range(BLOCKS):
            part = ((self.prints >> U64(16 * k)) & U64(0xFFFF)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            self.blocks.append((order, np.searchsorted(part[order], np.arange(0x10001))))

    def search(self, flat: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position, window, similarity, same words) of all corpus windows within
        the radius of an item window."""
        whole, inside = shingles(flat, self.width)
        prints = simhashes(flat, self.width, spread)
        at_all, window_all = [], []
        for k, (order, start) in enumerate(self.blocks):
            part = ((prints >> U64(16 * k)) & U64(0xFFFF)).astype(np.int64)
            count = (start[1:] - start[:-1])[part]
            at = np.flatnonzero((count > 0) & inside)
            count = count[at]
            at_each = np.repeat(at, count)
            offset = np.arange(len(at_each)) - np.repeat(np.cumsum(count) - count, count)
            window = order[start[part[at_each]] + offset]
            near = np.bitwise_count(prints[at_each] ^ self.prints[window]) <= RADIUS
            at_all.append(at_each[near])
            window_all.append(window[near])
        both = np.unique(np.stack([np.concatenate(at_all), np.concatenate(window_all)]), axis=1)
        at, window = both
        parts, _ = shingles(flat, self.step)
        mine = parts[at[:, None] + np.arange(self.width - self.step + 1)]
        theirs, weight = self.grams[window], self.weight[window]
        shared = (theirs[:, :, None] == mine[:, None, :]).any(axis=2)
        extra = ~(mine[:, :, None] == theirs[:, None, :]).any(axis=2)
        common = (weight * shared).sum(axis=1)
        similarity = common / (weight.sum(axis=1) + extra.sum(axis=1))
        return at, window, similarity, whole[at] == self.exact[window]


def indexes(passages: list[str | None], numbers: list[int], unit: int, weights: dict[int, float] | None = None) -> list[Index]:
    """An index for each width that the passages ask for; a shingle without a weight
    weighs 1."""
    weights, hashed = weights or {}, Hasher()
    by_width: dict[int, list[tuple[np.ndarray, int]]] = {}
    for passage, number in zip(passages, numbers):
        flat, ends = hashed([passage or ""])
        if ends[0]:
            by_width.setdefault(min(unit, int(ends[0])), []).append((flat[: ends[0]], number))
    return [Index(w, [flat for flat, _ in rows], [n for _, n in rows], weights) for w, rows in sorted(by_width.items())]


def shingle_rows(items: DataFrame) -> DataFrame:
    """(item, block, passage) to one row (item, block, shingle) per distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = hasher()
        for batch in batches:
            for first, piece in pieces(batch.column(2).to_pylist()):
                flat, ends = hashed(piece)
                values, inside = shingles(flat, SHINGLE)
                owner = np.searchsorted(ends, np.flatnonzero(inside))
                both = np.unique(np.stack([owner.astype(U64), values[inside]]), axis=1)
                rows = pa.array(first + both[0].astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(both[1].view(np.int64))], ["item", "block", "shingle"])

    return items.select("item", "block", "passage").mapInArrow(run, "item long, block int, shingle long")


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", *, unit: int = UNIT, least: float = 0.5, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, windows, exact_windows, similarity) of every document that
    holds a window of an item's passage, fully or nearly.

    windows counts the positions of the text within the radius of a window of the
    passage and at least ``least`` similar, exact_windows those with equal words,
    similarity is the best weighted-shingle similarity. Null and wordless passages
    and texts leak nothing; equal passages leak together. Rows with a null id are
    left out; rows that repeat an id are taken together."""
    clean = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(passage).alias("passage"))
    size, n = clean.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0)), F.count("*")).first()
    blocks = int(size // block_chars) + 1
    clean = clean.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    # over all items, so that a shingle weighs the same in whatever block it stands
    grams = written(shingle_rows(clean), "item-shingles")
    counts = written(grams.groupBy("shingle").agg(F.count_distinct("item").alias("n")), "shingle-counts")
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    schema = "doc long, item long, windows long, exact_windows long, similarity double"
    out = None
    for block in range(blocks):
        rows = clean.where(F.col("block") == block).collect()  # at most about block_chars characters
        own = counts.join(grams.where(F.col("block") == block), "shingle", "left_semi").collect()
        weights = {r["shingle"] & 0xFFFFFFFFFFFFFFFF: 1.0 + float(np.log(max(1.0, n / r["n"]))) for r in own}
        shared = Shared(docs.sparkSession, indexes([r["passage"] for r in rows], [r["item"] for r in rows], unit, weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashed, spread = hasher(), spread_table()
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for first, piece in pieces(batch.column(1).to_pylist()):
                    flat, ends = hashed(piece)
                    for index in shared.get():
                        at, window, similarity, same = index.search(flat, spread)
                        good = similarity >= least
                        at, window, similarity, same = at[good], window[good], similarity[good], same[good]
                        if not len(at):
                            continue
                        n = index.item_start[window + 1] - index.item_start[window]
                        each = np.repeat(np.arange(len(at)), n)
                        offset = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                        item = index.item[index.item_start[window[each]] + offset]
                        doc = ids[first + np.searchsorted(ends, at[each])]
                        key, group = np.unique(np.stack([doc, item]), axis=1, return_inverse=True)
                        group = group.ravel()
                        best = np.zeros(key.shape[1])
                        np.maximum.at(best, group, similarity[each])
                        exact = np.bincount(group, same[each], key.shape[1]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1]), pa.array(np.bincount(group, minlength=key.shape[1])), pa.array(exact), pa.array(best)], ["doc", "item", "windows", "exact_windows", "similarity"])

        part = source.mapInArrow(run, schema)
        if blocks > 1:
            part = written(part, "leaks")
            shared.drop()
        out = part if out is None else out.union(part)
    total = out.groupBy("doc", "item").agg(F.sum("windows").alias("windows"), F.sum("exact_windows").alias("exact_windows"), F.max("similarity").alias("similarity"))
    return total.withColumnsRenamed({"doc": doc_id, "item": item_id})
