"""Lines repeated across one site's documents (problem 4).

Method: content-defined chunking with a rolling hash over characters. A chunk ends
where the hash of the last eight characters says so, so equal text gives equal
chunks wherever it stands; distinct documents are counted per chunk and site, and
chunks in too many of them are cut. A line of text also ends a chunk, since the
result is asked by line: every line is then a whole number of chunks, all chunks of
an excessive line are excessive, and an exact count of the few lines made of
excessive chunks follows. ``repeated_spans`` knows no lines: it finds text that a site
repeats inside a line or across line breaks, and cuts it by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StringType

from garimpo.functions import url as urls
from garimpo.llm.batches import STEP, U64, mix, pieces
from garimpo.session import written

WINDOW, MEAN_CHARS = 8, 48
LEAST_DOCS, LEAST_SHARE = 5, 0.05
#: Visible characters of a chunk that counts by itself; a smaller one goes with the
#: chunks on both sides of it. Characters between two spans that become one.
LEAST_CHARS, GAP = 16, 24
SPAN_CHARS = 24  # mean visible characters of a chunk that knows no lines


def normal_line(line: str) -> str:
    """Trimmed, runs of white space joined to one blank, lower case."""
    return " ".join(line.split()).lower()


class Chunker:
    """Chunks of a string by a rolling hash: (starts, stops, hashes), and hashes of
    any spans of it, all from one prefix sum."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)
        self.base = 0x9FB21C651E98DF25
        self.inverse = pow(self.base, -1, 1 << 64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, size, 1 << 64))])

    def open(self, text: str | np.ndarray) -> np.ndarray:
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if isinstance(text, str) else text
        n = len(self.points)
        self._powers(n + 1)
        self.total = np.zeros(n + 1, U64)
        np.cumsum(mix(self.points.astype(U64) + STEP) * self.up[:n], out=self.total[1:])
        return self.points

    def spans(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.total[stops] - self.total[starts]) * self.down[starts] + (stops - starts).astype(U64))

    def cuts(self, mean: int = MEAN_CHARS) -> np.ndarray:
        """Positions at which the last WINDOW characters end a chunk."""
        n = len(self.points)
        ends = np.arange(WINDOW, n + 1)
        return ends[self.spans(ends - WINDOW, ends) % U64(mean) == 0]


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, site, doc, text) to one row per line that is not blank: (id, line_no,
    site, doc, line, chunks), line a 128-bit key and chunks the hashes in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker()
        for batch in batches:
            for first, piece in pieces(batch.column("text").to_pylist()):
                rows, numbers, lines = [], [], []
                for i, text in enumerate(piece, first):
                    for number, line in enumerate(text.split("\n")):
                        if line := normal_line(line):
                            rows.append(i)
                            numbers.append(number)
                            lines.append(line)
                if not lines:
                    continue
                sizes = np.fromiter(map(len, lines), np.int64, len(lines))
                chunker.open("".join(lines))
                stops = np.cumsum(sizes)
                starts = stops - sizes
                key = chunker.spans(starts, stops)
                other = mix(chunker.spans(starts, stops - (sizes > 1)) + mix(sizes.astype(U64)) + key)
                cut = chunker.cuts()
                owner = np.searchsorted(stops, cut - 1, side="right")
                cut = cut[cut - WINDOW >= starts[owner]]  # the window lies in one line
                ends = np.union1d(cut, stops)
                begins = np.concatenate([[0], ends[:-1]])
                hashes = chunker.spans(begins, ends)
                bounds = np.searchsorted(begins, np.append(starts, stops[-1])).astype(np.int32)
                index = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(index),
                        pa.array(numbers, pa.int32()),
                        batch.column("site").take(index),
                        batch.column("doc").take(index),
                        pa.array(key.view(np.int64)),
                        pa.array(other.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes.view(np.int64))),
                    ],
                    ["id", "line_no", "site", "doc", "line", "line2", "chunks"],
                )

    return docs.select("id", "site", "doc", "text").mapInArrow(run, "id long, line_no int, site long, doc long, line long, line2 long, chunks array<long>")


def _prepared(docs: DataFrame, id_col: str, url: str, record: str, text: str) -> DataFrame:
    site = F.xxhash64(urls.domain(F.col(url)))
    return docs.select(F.col(id_col).cast("long").alias("id"), site.alias("site"), F.xxhash64(F.col(record)).alias("doc"), F.col(text).alias("text"), F.col(record).isNotNull().alias("known"))


def excessive(counted: DataFrame, sites: DataFrame, keys: list[str], least_docs: int, least_share: float) -> DataFrame:
    """(site, *keys) that stand in enough distinct documents of the site. A document
    is first reduced to one row per key, before and after the shuffle; a key held
    by a third of all rows is spread by document."""
    per_doc = counted.select("site", *keys, "doc").groupBy("site", *keys, "doc").agg(F.lit(1).alias("one"))
    counts = per_doc.groupBy("site", *keys).agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)
    return counts.join(sites, "site").where(F.col("docs") >= least_share * F.col("n")).select("site", *keys, "docs")


def repeated_lines(
    docs: DataFrame, id_col: str, url: str, record: str, text: str, *, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE
) -> DataFrame:
    """(id, line_no) of each occurrence of a line that stands in at least
    ``least_docs`` distinct records of its site and in at least ``least_share`` of
    the site's distinct records.

    Blank lines never count. A null text has no lines; rows with a null record are
    no document of a site but their repeated lines are found; a null URL is a site
    of its own. Rows of one record (re-crawls, rows landed twice) count once."""
    source = _prepared(docs, id_col, url, record, text)
    sites = source.where("known").select("site", "doc").distinct().groupBy("site").agg(F.count("*").alias("n"))
    lines = written(lines_of(source), "lines")
    known = F.xxhash64(F.lit(None).cast("string"))
    usable = lines.where(F.col("doc") != known)
    chunks = excessive(usable.select("site", "doc", F.explode("chunks").alias("chunk")), sites, ["chunk"], least_docs, least_share)
    # the first chunk of an excessive line is excessive: only such lines are counted
    anchored = lines.select("id", "line_no", "site", "doc", "line", "line2", F.element_at("chunks", 1).alias("chunk"))
    likely = written(anchored.join(chunks.select("site", "chunk"), ["site", "chunk"], "left_semi"), "likely")
    bad = excessive(likely.where(F.col("doc") != known), sites, ["line", "line2"], least_docs, least_share)
    return likely.join(bad, ["site", "line", "line2"], "left_semi").select("id", "line_no").distinct()


def visible_table() -> np.ndarray:
    """Code point to its lower case, 0 for white space."""
    out = np.arange(0x10000, dtype=np.uint32)
    for point in range(0x10000):
        if not 0xD800 <= point < 0xE000:
            low = chr(point).lower()
            out[point] = 0 if low.isspace() else ord(low) if len(low) == 1 else point
    return out


def chunks_of(docs: DataFrame) -> DataFrame:
    """(id, site, doc, text) to (id, site, doc, chunks): hash, start and stop (code
    points of the text) of its chunks of LEAST_CHARS visible characters or more. White
    space and case do not count, so a chunk reaches over line breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker, table = Chunker(), visible_table()
        for batch in batches:
            for first, piece in pieces(batch.column("text").to_pylist()):
                sizes = np.fromiter(map(len, piece), np.int64, len(piece))
                points = np.frombuffer("".join(piece).encode("utf-32-le", "surrogatepass"), np.uint32)
                low = np.where(points > 0xFFFF, points, table[np.minimum(points, 0xFFFF)])
                place = np.flatnonzero(low)
                chunker.open(low[place])
                after = np.cumsum(sizes)
                stops = np.searchsorted(place, after)  # the texts, counted in visible characters
                starts = np.concatenate([[0], stops[:-1]])
                cut = chunker.cuts(SPAN_CHARS)
                owner = np.searchsorted(stops, cut - 1, side="right")
                cut = cut[cut - WINDOW >= starts[owner]]
                ends = np.union1d(cut, stops[stops > starts])
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                keep = ends - begins >= LEAST_CHARS
                begins, ends = begins[keep], ends[keep]
                owner = np.searchsorted(stops, ends - 1, side="right")
                base = (after - sizes)[owner]
                bounds = np.searchsorted(owner, np.arange(len(piece) + 1)).astype(np.int32)
                parts = [pa.array(chunker.spans(begins, ends).view(np.int64)), pa.array((place[begins] - base).astype(np.int32)), pa.array((place[ends - 1] + 1 - base).astype(np.int32))]
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(parts, ["chunk", "start", "stop"]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(piece)) for k in ("id", "site", "doc")), lists], ["id", "site", "doc", "chunks"])

    return docs.select("id", "site", "doc", "text").mapInArrow(run, "id long, site long, doc long, chunks array<struct<chunk: bigint, start: int, stop: int>>")


def repeated_spans(
    docs: DataFrame, id_col: str, url: str, record: str, text: str, *, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE
) -> DataFrame:
    """(id, start, stop) of the text, in code points, that stands in at least
    ``least_docs`` distinct records of its site and in at least ``least_share`` of them,
    wherever lines begin or end; neighbouring spans are one.

    A repeated text is found but for the chunks at its two ends, which reach into what
    stands around it: a text of fewer than about 60 visible characters may have none of
    its own. Null and blank texts have no spans; rows with a null record are no
    document of a site but their spans are found; a null URL is a site of its own."""
    source = _prepared(docs, id_col, url, record, text)
    sites = source.where("known").select("site", "doc").distinct().groupBy("site").agg(F.count("*").alias("n"))
    rows = written(chunks_of(source), "spans").select("id", "site", "doc", F.explode("chunks").alias("x")).select("id", "site", "doc", "x.*")
    unknown = F.xxhash64(F.lit(None).cast("string"))
    bad = excessive(rows.where(F.col("doc") != unknown).select("site", "doc", "chunk"), sites, ["chunk"], least_docs, least_share)
    found = rows.join(bad.select("site", "chunk"), ["site", "chunk"], "left_semi").select("id", "start", "stop").distinct()
    order = Window.partitionBy("id").orderBy("start", "stop")  # the spans of one text
    begins = F.coalesce((F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)) + GAP).cast("int"), F.lit(0))
    marked = found.withColumn("begins", begins).withColumn("span", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("id", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("id", "start", "stop")


@F.arrow_udf(StringType())
def cut_spans(text: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
    out = []
    for t, a, b in zip(text.to_pylist(), starts.to_pylist(), stops.to_pylist()):
        at, kept = 0, []
        for low, high in zip(a, b):
            kept.append(t[at:low])
            at = high
        out.append("".join([*kept, t[at:]]))
    return pa.array(out, pa.string())


def without_spans(docs: DataFrame, found: DataFrame, id_col: str, text: str) -> DataFrame:
    """``docs`` with the found spans (id, start, stop) taken out of ``text``; documents
    without a span keep their text untouched, other columns stay. Ids are unique."""
    spans = found.groupBy(F.col("id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__cut"))
    joined = docs.join(spans, F.col(id_col) == F.col("__id"), "left")
    whole = joined.where(F.col("__cut").isNull())
    cut = joined.where(F.col("__cut").isNotNull()).withColumn(text, cut_spans(F.col(text), F.col("__cut.start"), F.col("__cut.stop")))
    return whole.unionByName(cut).drop("__id", "__cut")


def without_lines(docs: DataFrame, found: DataFrame, id_col: str, text: str) -> DataFrame:
    """``docs`` with the found lines (id, line_no) taken out of ``text``; documents
    without a found line keep their text untouched, other columns stay."""
    numbers = found.groupBy(F.col("id").alias("__id")).agg(F.collect_set("line_no").alias("__cut"))
    joined = docs.join(numbers, F.col(id_col) == F.col("__id"), "left")
    kept = F.expr(f"array_join(filter(split(`{text}`, '\\n'), (l, i) -> NOT array_contains(__cut, i)), '\\n')")
    return joined.withColumn(text, F.when(F.col("__cut").isNull(), F.col(text)).otherwise(kept)).drop("__id", "__cut")
