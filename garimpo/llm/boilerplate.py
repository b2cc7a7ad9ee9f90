"""Page boilerplate mixed with main content (problem 6).

Method: tag-path ratios. A plain-text page has no tags, so a line's root-to-leaf
path is read from its layout: page, the zone between the pieces of running text
around it, and the form of the line (its words reduced to classes, its punctuation
kept). Over the whole collection each path aggregates text length, punctuation and
the share of its lines that stand within running text; the ratio of a rare path is
smoothed by that of its coarser path, fused with the zone of the line, and
thresholded. Lines that a site repeats from page to page, and lines in the form of
a headline (the forms are taken from the titles), are boilerplate on any path.
Pages with near-equal running text count as one page when such lines are counted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.house import FUNCTION_WORDS, ends_sentence, key
from garimpo.llm.residue import LineFeatures, judged, without_article
from garimpo.llm.shared import Shared
from garimpo.session import written

#: A headline form is the form of at least this share of the titles.
TITLE_SHARE = 0.002
#: Weight of the coarser path, and least fused ratio of content.
SMOOTH, CONTENT = 4.0, 0.15

WORD = re.compile(r"[^\W\d_]+|\d+")
SMALL, RUN = re.compile(r"[a-zà-ú]+"), re.compile(r"([xX0])(?:\W+\1)+")
LEAD = re.compile(r"^(?:\d{1,2}(?:[:h]\d{2})?[.)]?\s+|[^:–—»|>]{2,24}[:–—»|]\s+)")


def _class(match: re.Match) -> str:
    word = match.group()
    if word[0].isdigit():
        return "0"
    low = word.lower()
    if low in FUNCTION_WORDS or len(low) <= 2:
        return low
    return "X" if word[0].isupper() else "x"


def form(line: str) -> str:
    """Words reduced to classes: function words stay, others are X or x by their
    first letter, numbers 0. A line in capitals has the form of its lower case."""
    if line.isupper():
        line = line.capitalize()
    return WORD.sub(_class, line)


def coarse(shape: str) -> str:
    """The coarser path: runs of equal classes are one, function words are x."""
    return RUN.sub(r"\1+", SMALL.sub("x", shape))


def line_features(titles: Shared) -> LineFeatures:
    """Path, headline form, length and end of a line; a line of running text has no
    path, since its place is never asked for."""

    def function() -> Callable[[str, bool], tuple]:
        forms = titles.get()

        def features(line: str, running: bool) -> tuple:
            if running:
                return True, False, 0, 0, len(line), True
            formed = form(line)
            headline = formed in forms or ((rest := LEAD.sub("", line, count=1)) != line and form(rest) in forms)
            return False, headline, key(formed), key(coarse(formed)), len(line), ends_sentence(line)

        return features

    schema = "running: boolean, headline: boolean, form: bigint, coarse: bigint, length: int, ends: boolean"
    return LineFeatures(schema, [pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()], function)


def title_forms(docs: DataFrame, title: str) -> frozenset[str]:
    """Forms of at least TITLE_SHARE of the titles: at most 1 / TITLE_SHARE of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([form(" ".join(t.split())) for t in batch.column(0).to_pylist()], pa.string())], ["form"])

    filled = docs.where(F.col(title).isNotNull()).select(F.col(title).alias("t"))
    counts = filled.mapInArrow(run, "form string").groupBy("form").count()
    n = filled.count()
    return frozenset(r["form"] for r in counts.where((F.col("count") >= max(2, TITLE_SHARE * n)) & (F.length("form") > 6)).collect())


ZONED = "id long, line_no int, form long, coarse long, kind string, length int, ends boolean, inner double"


def zones(pages: DataFrame) -> DataFrame:
    """(id, features, gone) to one row per line of the pages that hold running text of
    their own. ``kind`` is F for a line of the house (a place in ``gone``) or a
    headline, C for other running text, null for an open line; ``inner`` is 1 if the
    nearest lines above and below that are not open are C."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, gone = batch.column("features"), batch.column("gone")
            counts = pc.list_value_length(features).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(counts)
            starts, n = ends - counts, int(counts.sum())
            owner, line = np.repeat(np.arange(len(counts)), counts), np.arange(n)
            lines = features.flatten()
            column = {name: lines.field(k) for k, name in enumerate(f.name for f in lines.type)}
            outside = column["headline"].to_numpy(zero_copy_only=False).astype(bool)
            outside[starts[pc.list_parent_indices(gone).to_numpy()] + gone.flatten().to_numpy()] = True
            text = column["running"].to_numpy(zero_copy_only=False).astype(bool) & ~outside
            known = outside | text
            above = np.concatenate([[-1], np.maximum.accumulate(np.where(known, line, -1))])[:-1]
            below = np.append(np.minimum.accumulate(np.where(known, line, n)[::-1])[::-1], n)[1:]
            text_at = np.append(text, False)  # at -1 and at n
            inner = (above >= starts[owner]) & text_at[above] & (below < ends[owner]) & text_at[below]
            kind = pc.if_else(pa.array(outside), "F", pc.if_else(pa.array(text), "C", pa.scalar(None, pa.string())))
            ids = batch.column("id").take(pa.array(owner))
            arrays = [ids, column["line_no"], column["form"], column["coarse"], kind, column["length"], column["ends"], pa.array(inner.astype(float))]
            real = np.bincount(owner, text, len(counts)) > 0
            yield pa.RecordBatch.from_arrays(arrays, [p.split()[0] for p in ZONED.split(", ")]).filter(pa.array(real[owner]))

    return pages.select("id", "features", "gone").mapInArrow(run, ZONED)


def boilerplate_lines(docs: DataFrame, id_col: str, url: str, title: str, body: str) -> DataFrame:
    """(id, line_no) of each non-blank line of the body that is no part of the article.

    A page without any article, because residue covers it or no line of it is
    running text of its own, gives no rows; nor do null and blank bodies. Rows with
    a null id are left out, a null URL is a site of its own. Pages whose running text
    is near-equal, directly or by a chain, count as one page when a site's own lines
    are counted, so copies of an article, edited or not, do not make its sentences
    lines of the house."""
    features = line_features(Shared(docs.sparkSession, title_forms(docs, title)))
    pages, gone, verdicts = judged(docs, id_col, title, body, url, features=features)
    empty = verdicts.where(without_article()).select("row")
    zoned = written(zones(pages.join(empty, "row", "left_anti").join(gone, "row", "left")), "zoned")

    open_ = zoned.where("kind IS NULL")
    measures = [F.count("*").alias("n"), F.sum("inner").alias("inside"), F.avg("length").alias("text"), F.avg(F.col("ends").cast("double")).alias("ended")]
    fine = open_.groupBy("form").agg(*measures)
    rough = open_.groupBy("coarse").agg(F.count("*").alias("rough_n"), F.sum("inner").alias("rough_inside"))
    ratio = (F.col("inside") + SMOOTH * (F.col("rough_inside") + 0.5 * F.col("inner")) / (F.col("rough_n") + 0.5)) / (F.col("n") + SMOOTH)
    dense = F.least(F.lit(0.3), F.col("text") * F.col("ended") / 400)  # long, punctuated paths hold text
    low = open_.join(fine, "form").join(rough, "coarse").where(ratio + dense < CONTENT)
    return zoned.where("kind = 'F'").select("id", "line_no").union(low.select("id", "line_no")).distinct()
