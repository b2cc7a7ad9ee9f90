"""Lines of the house: what a site repeats from page to page.

A line is one of the house if it stands in enough different pages of its site, or of
several sites. Pages whose running text is near-equal count as one page, so that the
copies of an article, edited or not, do not make its sentences lines of the house.
Such pages are found by min-hash sketches of the running text: a band of equal
registers proposes a pair, the share of equal registers accepts it, and pages
connected by accepted pairs are one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.batches import STEP, U64, fold, hasher, mix, shingles
from garimpo.llm.pairs import components
from garimpo.session import written

#: A site's own line: in so many different pages of it and in this share of them.
HOUSE_PAGES, HOUSE_SHARE = 5, 0.01
#: A line of many sites: in so many pages, sites, and in this share of all pages.
COMMON_PAGES, COMMON_SITES, COMMON_SHARE = 5, 3, 0.001
#: Sketch: hash functions, buckets of each, words of a shingle, share of equal
#: registers from which two pages are one. A band is one bucket of all functions.
REPEATS, BUCKETS, WIDTH, ALIKE = 3, 16, 3, 0.55
REGISTERS = REPEATS * BUCKETS

FUNCTION_WORDS = frozenset("o a os as um uma de do da dos das em no na nos nas por para pelo pela com e que se foi não el la los las del y en un una con the of and to in was for on that is by with".split())
FOLDED = frozenset(map(fold, FUNCTION_WORDS))
DIGITS, ASCII_DIGITS = re.compile(r"\d+"), re.compile(rb"[0-9]+")
#: The bytes that may begin a digit beyond ASCII in UTF-8: there is none below U+0660
#: nor from U+2000 to U+9FFF.
DIGIT_LEADS = bytes([*range(0xD9, 0xE2), *range(0xEA, 0x100)])


def key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def line_key(low: str) -> int:
    """Key of a line with single blanks, in lower case: equal apart from case and numbers."""
    raw = low.encode("utf-8", "surrogatepass")
    if len(raw.translate(None, DIGIT_LEADS)) < len(raw):
        return key(DIGITS.sub("0", low))
    return xxhash.xxh3_64_intdigest(ASCII_DIGITS.sub(b"0", raw)) - (1 << 63)


def ends_sentence(line: str) -> bool:
    return line.rstrip("”\"»’')").endswith((".", "!", "?", "…"))


def running_text(line: str, low: str) -> bool:
    """Whether a line is running text: it ends as a sentence and holds a function
    word, or is long and rich in them. ``low`` is the line in lower case."""
    found = low.split()
    if len(found) < 5:
        return False
    ends, plain = ends_sentence(line), sum(map(str.isascii, found))
    # words without accents are what they are when folded, and settle most lines
    if plain >= 5 and not FOLDED.isdisjoint(found) if ends else plain >= 14 and sum(map(FOLDED.__contains__, found)) >= 0.2 * len(found):
        return True
    found = fold(line).split()
    functions = sum(map(FOLDED.__contains__, found))
    if len(found) < 5 or not ends:
        return len(found) >= 14 and functions >= 0.2 * len(found)
    return functions > 0


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(registers, bands) of each text: 16 bits of the smallest hash in every bucket,
    0 for an empty one; and a key of each band, 0 where one of its registers is
    empty. The last key is that of the whole text."""
    flat, ends = hasher()(texts)
    values, inside = shingles(flat, WIDTH)
    owner = np.searchsorted(ends, np.flatnonzero(inside))
    values, n = values[inside], len(texts)
    out = np.zeros((n, BUCKETS, REPEATS), np.uint16)
    for r in range(REPEATS):
        h = mix(values + U64((r + 1) * int(STEP) & 0xFFFFFFFFFFFFFFFF))
        low = np.full(n * BUCKETS, ~U64(0), U64)
        np.minimum.at(low, owner * BUCKETS + (h & U64(BUCKETS - 1)).astype(np.int64), h >> U64(4))
        out[:, :, r] = np.where(low == ~U64(0), U64(0), (mix(low) | U64(1)) & U64(0xFFFF)).astype(np.uint16).reshape(n, BUCKETS)
    bands = np.full((n, BUCKETS), 0, U64)
    for r in range(REPEATS):
        bands = mix(bands * STEP + out[:, :, r].astype(U64) + U64(1))
    bands = np.where((out == 0).any(axis=2), U64(0), mix(bands + np.arange(BUCKETS, dtype=U64)) | U64(1)).view(np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    whole = np.array([xxhash.xxh3_64_intdigest(flat[a:b].tobytes()) | 1 for a, b in zip(starts, ends)], U64).view(np.int64)
    return out.reshape(n, REGISTERS), np.concatenate([bands, whole[:, None]], axis=1)


def _alike(pairs: DataFrame) -> DataFrame:
    """Of (a, b, sa, sb), the pairs whose sketches agree in a share ALIKE of the
    registers that are not empty in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("sa", "sb"))
            used = ((x != 0) | (y != 0)).sum(axis=1)
            keep = pa.array(((x == y) & (x != 0)).sum(axis=1) >= ALIKE * used)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def page_groups(pages: DataFrame) -> DataFrame:
    """(row, bands, sketch) of the pages with running text to (row, page): ``page``
    names a group of near-equal pages; pages without a partner have no row."""
    bands = pages.where("sketch IS NOT NULL").select("row", F.explode("bands").alias("band")).where("band != 0")
    first = bands.groupBy("band").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("band", "first")
    pairs = written(bands.join(first, "band").where("row != first").select(F.col("row").alias("a"), F.col("first").alias("b")).distinct(), "page-pairs")
    known = pages.where("sketch IS NOT NULL").select("row", "sketch")
    both = pairs.join(known.withColumnsRenamed({"row": "a", "sketch": "sa"}), "a").join(known.withColumnsRenamed({"row": "b", "sketch": "sb"}), "b")
    return components(written(_alike(both), "page-links")).select(F.col("id").alias("row"), F.xxhash64("component").alias("page"))


def house_lines(pages: DataFrame) -> DataFrame:
    """(row, site, own, bands, sketch, lines) to the distinct (site, line) of the
    house. ``own`` is the key of a page's running text, or of its longest line if it
    has none. A third of all rows may be copies of one page: they are one before the
    count, and a line's count is pre-aggregated by page."""
    groups = written(page_groups(pages), "page-groups")
    named = pages.join(groups, "row", "left").withColumn("page", F.coalesce("page", "own"))
    per_page = written(named.select("site", "page", F.explode("lines").alias("line")).distinct(), "page-lines")
    counts = per_page.groupBy("site", "line").agg(F.count("*").alias("n")).where("n >= 2")
    size = named.where(F.size("lines") > 0).select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("pages"))
    counts = written(counts.join(size, "site"), "line-counts")
    total = size.agg(F.sum("pages").alias("n")).first()["n"] or 0
    own = counts.where((F.col("n") >= HOUSE_PAGES) & (F.col("n") >= HOUSE_SHARE * F.col("pages"))).select("site", "line")
    many = counts.groupBy("line").agg(F.sum("n").alias("n"), F.count("*").alias("sites"))
    many = many.where((F.col("n") >= COMMON_PAGES) & (F.col("n") >= COMMON_SHARE * total) & (F.col("sites") >= COMMON_SITES)).select("line")
    # a line of many sites is one of the house wherever it stands, once on a site too
    everywhere = per_page.select("site", "line").join(many, "line", "left_semi").select("site", "line")
    return written(own.union(everywhere).distinct(), "house")
