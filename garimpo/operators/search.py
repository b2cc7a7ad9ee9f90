"""Ranked search: query terms, coverage-weighted scores, pools, re-ranking, pages.

The large inputs are read once by the query's few terms; scores are one aggregation
by document, and texts are joined only to the pool that survives it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from garimpo.functions import text as texts
from garimpo.functions import url as urls
from garimpo.operators import context as contexts
from garimpo.operators.index import query_idf
from garimpo.operators.stored import PlainIndex, StoredIndex
from garimpo.session import local_table, written

#: Fixed values of the ranking.
TOP_POSTINGS, POOL, POOL_FILTERED, CASCADE, FALLBACK = 5000, 500, 5000, 100, 500
LEAST_SCORE, LEAST_SCORE_FILTERED = 0.02, 0.01
BASE_WEIGHT, CONTEXT_WEIGHT, FULL_MATCH = 0.75, 0.25, 1.4
PREVIEW, PAGE_SIZE, MOST_PAGE_SIZE = 400, 10, 50


@dataclass
class Query:
    """A query's terms: groups of variants of one word, and the raw words."""

    groups: list[list[str]]
    raw: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Query:
        if not text or not text.strip():
            raise ValueError("the query is blank")
        raw = texts.raw_words(text)
        try:
            stemmed = texts.analyze(text)
        except Exception:
            stemmed = []
        return cls(texts.term_groups(stemmed, raw), raw)

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(t for group in self.groups for t in group))


def clamp_page(page: int | None) -> int:
    return max(1, page or 1)


def clamp_size(size: int | None, default: int = PAGE_SIZE) -> int:
    return min(MOST_PAGE_SIZE, max(1, default if size is None else size))


def term_table(spark: SparkSession, query: Query) -> DataFrame:
    """(term, groups): the query's terms with the numbers of their groups."""
    rows = [(t, [i for i, g in enumerate(query.groups) if t in g]) for t in query.terms]
    return local_table(spark, rows, "term string, groups array<int>")


def in_range(time: Column, start: date | None, end: date | None) -> Column:
    """From the start day to the end of the end day, UTC."""
    found = F.lit(True)
    if start:
        found = found & (time >= F.to_timestamp(F.lit(f"{start} 00:00:00+00:00")))
    if end:
        found = found & (time < F.to_timestamp(F.lit(f"{end + timedelta(days=1)} 00:00:00+00:00")))
    return found


def query_df(postings: DataFrame | PlainIndex | StoredIndex, query: Query) -> DataFrame:
    """(term, df) of every query term, 0 for terms that no posting has."""
    source = PlainIndex(postings, 0) if isinstance(postings, DataFrame) else postings
    known = source.df(query.terms)
    return local_table(source.spark, [(t, known.get(t, 0)) for t in query.terms], "term string, df long")


def query_vector(df: DataFrame, n: int) -> DataFrame:
    """(term, weight) of the terms with a positive idf; weight 1 for all if there
    is none."""
    weight = query_idf(F.lit(float(n)), F.col("df"))
    known = df.withColumn("weight", weight)
    some = F.max("weight").over(Window.partitionBy())  # over the few query terms
    return known.withColumn("most", some).where("weight > 0 OR most <= 0").select("term", F.when(F.col("most") > 0, F.col("weight")).otherwise(1.0).alias("weight"))


def top_postings(postings: DataFrame, query: Query, k: int | None = TOP_POSTINGS) -> DataFrame:
    """The query terms' postings, the ``k`` of the largest weight of each term; all
    without k. The limit is applied in every task before the shuffle by term."""
    found = postings.where(F.col("term").isin(query.terms)).select("term", "url_hash", "tf", "tfidf")
    if k is None:
        return found
    order = Window.partitionBy("term").orderBy(F.col("tfidf").desc(), "url_hash")
    return found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def base_scores(hits: DataFrame, vector: DataFrame, query: Query) -> DataFrame:
    """(url_hash, matched, coverage, score) of documents with a positive product.

    product / (norm of the query * sqrt(matched terms)) * (0.3 + 0.7 * share of
    groups matched squared), times 1.4 if all of several groups match."""
    n = len(query.groups)
    terms = term_table(hits.sparkSession, query).join(vector, "term", "left")
    # one row per query term: bounded by the length of the query
    terms = terms.withColumn("norm", F.sqrt(F.sum(F.coalesce(F.col("weight") * F.col("weight"), F.lit(0.0))).over(Window.partitionBy())))
    joined = hits.join(F.broadcast(terms), "term")
    found = joined.groupBy("url_hash").agg(
        F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("tfidf")).alias("product"),
        F.count("*").alias("matched"),
        F.size(F.array_distinct(F.flatten(F.collect_list("groups")))).cast("long").alias("coverage"),
        F.max("norm").alias("norm"),
    )
    share = F.col("coverage") / n
    score = F.col("product") / (F.col("norm") * F.sqrt("matched")) * (0.3 + 0.7 * share * share)
    boost = F.when((F.col("coverage") == n) & F.lit(n > 1), FULL_MATCH).otherwise(1.0)
    return found.where("product > 0").select("url_hash", "matched", "coverage", (score * boost).alias("score"))


def coverage_histogram(scores: DataFrame) -> DataFrame:
    return scores.groupBy("coverage").agg(F.count("*").alias("documents"), F.max("score").alias("best"), F.avg("score").alias("mean"))


def matched_terms(hits: DataFrame) -> DataFrame:
    """(url_hash, matched_terms), sorted; at most the query's terms."""
    return hits.groupBy("url_hash").agg(F.sort_array(F.collect_set("term")).alias("matched_terms"))


def pool(scores: DataFrame, size: int = POOL) -> DataFrame:
    """The first documents by coverage, then score."""
    return scores.orderBy(F.col("coverage").desc(), F.col("score").desc(), "url_hash").limit(size)


def blend(candidates: DataFrame, docs: DataFrame, analysis: DataFrame) -> DataFrame:
    """Hydrated candidates with ``final``; a document without context has context 0,
    a candidate without a document is dropped."""
    joined = candidates.join(docs, "url_hash").join(analysis.select("url_hash", F.col("score").alias("context")), "url_hash", "left")
    return joined.withColumn("final", F.col("score") * BASE_WEIGHT + F.coalesce("context", F.lit(0.0)) * CONTEXT_WEIGHT)


def cascade(ranked: DataFrame, least: float) -> DataFrame:
    """Rows of at least ``least``; if there is none, the best 100. ``ranked`` is the
    pool, so the window is over at most a few thousand rows."""
    everywhere = Window.partitionBy()
    passed = F.max((F.col("final") >= least).cast("int")).over(everywhere)
    place = F.row_number().over(Window.orderBy(F.col("final").desc(), "url_hash"))
    kept = ranked.withColumn("__any", passed).withColumn("__n", place)
    return kept.where((F.col("final") >= least) | ((F.col("__any") == 0) & (F.col("__n") <= CASCADE))).drop("__any", "__n")


def page_of(rows: DataFrame, page: int, size: int, sort: str = "relevance") -> DataFrame:
    first = F.col("final").desc() if sort == "relevance" else F.col("collected_at").desc()
    return rows.orderBy(first, "url_hash").offset((clamp_page(page) - 1) * clamp_size(size)).limit(clamp_size(size))


def page_meta(rows: DataFrame, page: int, size: int) -> DataFrame:
    """(total, page, total_pages)."""
    return rows.agg(F.count("*").alias("total")).select("total", F.lit(clamp_page(page)).cast("long").alias("page"), F.ceil(F.col("total") / clamp_size(size)).alias("total_pages"))


def hit(rows: DataFrame) -> DataFrame:
    """The result columns of a hit."""
    return rows.select(F.col("url_hash").alias("id"), "url", urls.domain(F.col("url")).alias("domain"), "title", texts.preview(F.col("body"), PREVIEW).alias("preview"), F.col("final").alias("score"), "collected_at", "matched_terms")


def fallback_matches(docs: DataFrame, raw: list[str], limit: int = FALLBACK) -> DataFrame:
    """Documents with one of the raw words as a whole word in body or title: the
    first by key. Words are runs of letters, digits and underscores. Only texts that
    contain a word's letters are cut into words."""
    text = F.concat_ws(" ", "body", "title")
    wanted = [t.lower() for t in raw]
    if not wanted:
        return docs.limit(0)
    near = F.lit(False)
    for token in wanted:
        near = near | F.contains(F.lower(text), F.lit(token))
    found = docs.where(near).where(F.arrays_overlap(texts.word_array(text), F.array(*map(F.lit, wanted))))
    return found.orderBy("url_hash").limit(limit)


def fallback_scores(docs: DataFrame, raw: list[str]) -> DataFrame:
    """``docs`` with ``final`` and ``matched_terms``: per word ln(count + 1), doubled
    if the title contains it; times the share of words found if there are several."""
    rows = docs.withColumn("__w", texts.word_array(F.concat_ws(" ", "body", "title")))
    total, found, names = F.lit(0.0), F.lit(0), []
    for token in (t.lower() for t in raw):
        count = F.size(F.expr(f"filter(__w, w -> w = {texts.quoted(token)})"))
        inside = F.coalesce(F.lower("title").contains(token), F.lit(False))
        total = total + F.when(count > 0, F.ln(count + 1.0) * F.when(inside, 2.0).otherwise(1.0)).otherwise(0.0)
        found = found + (count > 0).cast("int")
        names.append(F.when(count > 0, F.lit(token)))
    if len(raw) > 1:
        total = total * found / len(raw)
    terms = F.sort_array(F.array_compact(F.array(*names))) if names else F.array().cast("array<string>")
    return rows.withColumn("final", total).withColumn("matched_terms", terms).where("final > 0").drop("__w")


def search(
    docs: DataFrame,
    postings: DataFrame | StoredIndex,
    lexicon: DataFrame,
    trust: DataFrame,
    text: str | Query,
    *,
    page: int | None = 1,
    page_size: int | None = PAGE_SIZE,
    start: date | None = None,
    end: date | None = None,
    sort: str = "relevance",
    triggers: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(hits, meta) of a query over docs (one row per url_hash) and their postings: a
    stored index, of which only the buckets of the query's terms and of the pool's
    documents are read, or a table of weighted postings.

    Without any matching posting the whole-word scan of the texts answers; a date
    range without documents gives no hit. ``sort`` is relevance or latest."""
    if sort not in ("relevance", "latest"):
        raise ValueError(f"unknown sort {sort}")
    query = text if isinstance(text, Query) else Query.parse(text)
    source = PlainIndex(postings, docs.count()) if isinstance(postings, DataFrame) else postings
    dated = bool(start or end)
    allowed = docs.where(in_range(F.col("collected_at"), start, end)) if dated else docs
    found: list[str] = []
    if query.terms:
        rows = source.of_terms(query.terms)
        if dated:
            rows = rows.join(allowed.select("url_hash"), "url_hash", "left_semi")
        hits = written(top_postings(rows, query, None if dated else TOP_POSTINGS), "hits")
        vector = query_vector(query_df(source, query), source.documents)
        candidates = written(pool(base_scores(hits, vector, query), POOL_FILTERED if dated else POOL), "pool")
        found = [r["url_hash"] for r in candidates.select("url_hash").collect()]  # at most the pool
    if not found:
        final = fallback_scores(fallback_matches(allowed, query.raw), query.raw)
    else:
        pooled = written(docs.where(F.col("url_hash").isin(found)), "pooled")
        analysis = contexts.analysis(pooled, source.of_documents(found), lexicon, trust, triggers or [])
        final = cascade(blend(candidates, pooled, analysis), LEAST_SCORE_FILTERED if dated else LEAST_SCORE)
        final = final.join(matched_terms(hits), "url_hash", "left")
    shown = page_of(final, page, page_size, sort)
    return hit(shown), page_meta(final, page, page_size)
