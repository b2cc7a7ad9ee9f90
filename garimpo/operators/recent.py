"""Feeds of the newest documents, plain and by context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions import text as texts
from garimpo.functions import url as urls
from garimpo.operators import context as contexts
from garimpo.operators.stored import PlainIndex, StoredIndex
from garimpo.session import written

COUNT, MOST, POOL, LEAST_CONTEXT, PREVIEW = 12, 50, 50, 0.2, 300


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("url_hash").alias("id"), "url", urls.domain(F.col("url")).alias("domain"), "title", texts.preview(F.col("body"), PREVIEW).alias("preview"), "collected_at")


def recent(docs: DataFrame, count: int | None = COUNT) -> DataFrame:
    """The newest documents; count is clamped to 1 .. 50."""
    size = min(MOST, max(1, COUNT if count is None else count))
    return _shown(docs.orderBy(F.col("collected_at").desc(), "url_hash").limit(size))


def recent_filtered(docs: DataFrame, postings: DataFrame | StoredIndex, lexicon: DataFrame, trust: DataFrame, triggers: list[str] | None = None, limit: int = COUNT, pool: int = POOL, least: float = LEAST_CONTEXT) -> DataFrame:
    """Of the ``pool`` newest documents with a context stem, those that are not
    ambiguous and have a context score of at least ``least``, newest first."""
    source = PlainIndex(postings, 0) if isinstance(postings, DataFrame) else postings
    stems = contexts.lexicon_stems(lexicon)
    newest = written(docs.join(source.with_terms(contexts.context_stems(stems)), "url_hash", "left_semi").orderBy(F.col("collected_at").desc(), "url_hash").limit(pool), "newest")
    near = source.of_documents([r["url_hash"] for r in newest.select("url_hash").collect()])  # at most the pool
    analysis = contexts.analysis(newest, near, lexicon, trust, triggers or [])
    good = newest.join(analysis.where((~F.col("is_ambiguous")) & (F.col("score") >= least)).select("url_hash", "score"), "url_hash")
    return _shown(good.orderBy(F.col("collected_at").desc(), F.col("score").desc(), "url_hash").limit(limit))
