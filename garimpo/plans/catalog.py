"""Queries of the core operators, each with its SQL.

Every query runs over its whole tables. ``docs`` is the latest row of each
url_hash of documents_in; the index is built from them; timestamps are given as
microseconds so that both engines compare alike.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import html as pages
from garimpo.functions import text as texts
from garimpo.functions import url as urls
from garimpo.operators import adhoc, context, index, ingest, recent, search
from garimpo.operators.stored import StoredIndex
from garimpo.plans import sql
from garimpo.session import local_table, prepared, temporary, written
from garimpo.sources import tables
from garimpo.sources.tables import DOCUMENTS, SEEN, table
from garimpo.streaming import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TEXT = "investigação da licitação em Casaópolis"
QUERY = search.Query.parse(TEXT)
NO_INDEX = search.Query(groups=[["robô"], ["javascript"], ["não"]], raw=["robô", "javascript", "não"])
TRIGGERS = ["justiça suspende", "filme"]
NOW, START, END = "2026-03-08 00:00:00+00:00", date(2026, 1, 10), date(2026, 2, 20)
DATES = "collected_at >= TIMESTAMPTZ '2026-01-10 00:00:00+00' AND collected_at < TIMESTAMPTZ '2026-02-21 00:00:00+00'"
PARTS = sql.pieces(QUERY, TRIGGERS)
DATED = sql.pieces(QUERY, TRIGGERS, DATES, limit=False)
PLAIN = sql.pieces(NO_INDEX, TRIGGERS)
PAGE, SIZE = 2, 10
HREFS = ["/a/../b?x=1#y", "p.html", "../q/", "//C.example/k", "https://d.example/x", "#top", "", "mailto:x@y.example", "?z=2", " ./r "]


def query(statement: str | None = None, parts: dict[str, str] = PARTS):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if statement is not None:
            SQL[f.__name__] = sql.compose(parts, statement)
        return f

    return add


def micros(name: str) -> Column:
    return F.unix_micros(name).alias(name)


def landed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents_in")


def docs_of(s: SparkSession, d: str) -> DataFrame:
    return ingest.latest(landed(s, d))


def built(s: SparkSession, d: str) -> DataFrame:
    return index.postings(docs_of(s, d))


def index_of(s: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    """Weighted postings, written once, since every step of a search reads them."""
    docs = docs_of(s, d) if docs is None else docs
    rows = written(index.postings(docs).select("term", "url_hash", "tf"), "postings")
    return written(index.weighted(rows, docs.count()), "index")


_served: dict[tuple[str, str], tuple[DataFrame, StoredIndex]] = {}


def served(s: SparkSession, d: str) -> tuple[DataFrame, StoredIndex]:
    """The documents, and the index stored of them by the first query that asks."""
    place = (s.sparkContext.applicationId, d)
    if place not in _served:
        docs = written(docs_of(s, d).repartitionByRange("url_hash").sortWithinPartitions("url_hash"), "docs")
        stored = StoredIndex(s, temporary(s, "index"), buckets=32)
        stored.add(docs, docs.count())
        _served[place] = docs, stored
    return _served[place]


def searched(s: SparkSession, d: str, query: search.Query = QUERY, **options) -> tuple[DataFrame, DataFrame]:
    docs, stored = served(s, d)
    return search.search(docs, stored, table(s, d, "lexicon"), table(s, d, "domain_trust"), query, triggers=TRIGGERS, **options)


def shown_hits(rows: DataFrame) -> DataFrame:
    return rows.select("id", "url", "domain", "title", "preview", F.round("score", 6).alias("score"), micros("collected_at"), F.array_join("matched_terms", " ").alias("matched_terms"))


# sources and sinks


@query("SELECT seq, url_hash, url, title, body, epoch_us(collected_at) AS collected_at FROM documents_in")
def scan_documents(s, d):
    return landed(s, d).select("seq", "url_hash", "url", "title", "body", micros("collected_at"))


@query(f"SELECT seq, url, {sql.html()} AS html FROM documents_in")
def scan_pages(s, d):
    return landed(s, d).select("seq", "url", html_of().alias("html"))


def html_of() -> Column:
    lines = F.replace(F.coalesce("body", F.lit("")), F.lit("\n"), F.lit('</p><p class="x">'))
    head = F.concat(F.lit('<html><body><nav><p>menu</p></nav><h1 class="t">'), F.coalesce("title", F.lit("")), F.lit('</h1><script>var t="</p>";</script><a class="l" href="'), F.coalesce("url", F.lit("")))
    return F.concat(head, F.lit('">x</a><p>'), lines, F.lit("<footer><p>end</p></footer></body></html>"))


@query("SELECT url_hash, title, epoch_us(collected_at) AS collected_at FROM docs WHERE url_hash = (SELECT min(url_hash) FROM documents_in)")
def lookup_by_hash(s, d):
    first = landed(s, d).agg(F.min("url_hash")).first()[0]
    return tables.lookup(docs_of(s, d), first).select("url_hash", "title", micros("collected_at"))


@query("SELECT seq, url_hash FROM documents_in WHERE indexed_at IS NULL")
def pending_docs(s, d):
    return tables.pending(landed(s, d)).select("seq", "url_hash")


@query("SELECT seq, url_hash FROM documents_in WHERE seq % 7 BETWEEN 2 AND 4")
def http_success(s, d):
    status = F.element_at(F.array(*map(F.lit, (199, 300, 200, 204, 299, 404, 503))), (F.col("seq") % 7 + 1).cast("int"))
    return tables.succeeded(landed(s, d).withColumn("status", status)).select("seq", "url_hash")


@query("SELECT seq, url_hash, url, title, epoch_us(collected_at) AS at FROM docs")
def upsert_latest(s, d):
    rows = landed(s, d)
    since = F.to_timestamp(F.lit("2026-03-01 00:00:00+00:00"))
    return ingest.upsert(rows.where(F.col("collected_at") < since), rows.where(F.col("collected_at") >= since)).select("seq", "url_hash", "url", "title", F.unix_micros("collected_at").alias("at"))


@query("SELECT term, df, cf FROM vocab")
def vocab_stats(s, d):
    return index.vocabulary(built(s, d))


@query(f"SELECT url_hash, epoch_us(coalesce(CASE WHEN indexed_at IS NULL THEN TIMESTAMPTZ '{NOW}' END, indexed_at)) AS indexed_at FROM docs")
def mark_indexed(s, d):
    docs = docs_of(s, d)
    return ingest.mark_indexed(docs, tables.pending(docs), F.to_timestamp(F.lit(NOW))).select("url_hash", micros("indexed_at"))


REPLACED = "SELECT url_hash FROM docs WHERE indexed_at IS NULL"


@query(f"SELECT term, url_hash, tf FROM raw_index WHERE url_hash NOT IN ({REPLACED}) UNION ALL SELECT term, url_hash, tf FROM built WHERE url_hash IN ({REPLACED})")
def reindex_postings(s, d):
    waiting = tables.pending(docs_of(s, d))
    old = index.unique_postings(table(s, d, "postings"))
    return index.replace(old, index.postings(waiting).select("term", "url_hash", "tf"), waiting)


@query(f"SELECT term, -count(*) AS df, -CAST(sum(tf) AS BIGINT) AS cf FROM raw_index WHERE url_hash IN ({REPLACED}) GROUP BY term")
def vocab_deltas(s, d):
    return index.removal_counts(index.unique_postings(table(s, d, "postings")), tables.pending(docs_of(s, d)))


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM raw_index WHERE url_hash NOT IN ({REPLACED}) GROUP BY term")
def vocab_gc(s, d):
    rows = index.unique_postings(table(s, d, "postings"))
    return index.add_counts(index.vocabulary(rows), index.removal_counts(rows, tables.pending(docs_of(s, d))))


# extraction and scalar functions


@query("SELECT seq, base64(from_hex(sha256(url))) AS key, url_hash = base64(from_hex(sha256(url))) AS same FROM documents_in")
def url_hash(s, d):
    return landed(s, d).select("seq", urls.url_hash(F.col("url")).alias("key"), (F.col("url_hash") == urls.url_hash(F.col("url"))).alias("same"))


@query(f"SELECT seq, {sql.domain('url')} AS domain FROM documents_in")
def url_domain(s, d):
    return landed(s, d).select("seq", urls.domain(F.col("url")).alias("domain"))


@query("SELECT url_hash, domain_trust FROM trusted")
def domain_trust(s, d):
    return context.with_trust(docs_of(s, d), table(s, d, "domain_trust")).select("url_hash", "domain_trust")


@query(f"SELECT seq, {sql.strip(sql.html())} AS html FROM documents_in")
def html_strip(s, d):
    return landed(s, d).select("seq", pages.stripped(html_of()).alias("html"))


@query(f"SELECT seq, trim(regexp_replace(regexp_extract({sql.strip(sql.html())}, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS title FROM documents_in")
def html_title(s, d):
    return landed(s, d).select("seq", pages.title(html_of()).alias("title"))


@query(
    f"SELECT seq, array_to_string(list_transform(list_slice(regexp_split_to_array({sql.strip(sql.html())}, {sql.quote(pages.PARAGRAPH)}), 2, 1000000), lambda x: trim(regexp_replace(regexp_extract(x, {sql.quote(pages.CUT)}, 1), '<[^>]*>', '', 'g'))), ' ') AS body FROM documents_in"
)
def html_paragraphs(s, d):
    return landed(s, d).select("seq", pages.paragraphs(html_of()).alias("body"))


@query(f"SELECT seq, unnest(regexp_extract_all({sql.html()}, {sql.quote(pages.HREF)}, 1)) AS link FROM documents_in")
def html_links(s, d):
    return landed(s, d).select("seq", F.explode(pages.links(html_of())).alias("link"))


@query(f"SELECT seq, url, h AS href, {sql.resolved('h', 'url')} AS link FROM documents_in, (SELECT unnest([{sql.listed(HREFS)}]) AS h)")
def links_resolved(s, d):
    rows = landed(s, d).select("seq", "url", F.explode(F.array(*map(F.lit, HREFS))).alias("href"))
    return rows.select("seq", "url", "href", pages.resolved(F.col("href"), F.col("url")).alias("link"))


@query("SELECT seq, coalesce(contains(lower(m), 'xml'), FALSE) OR coalesce(contains(lower(url), 'sitemap'), FALSE) AS feed FROM (SELECT seq, CASE WHEN seq % 5 = 0 THEN url || '/Sitemap.txt' ELSE url END AS url, CASE seq % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/RSS+XML' WHEN 2 THEN 'text/xml; charset=utf-8' END AS m FROM documents_in)")
def feed_route(s, d):
    kind = F.when(F.col("seq") % 4 == 0, "text/html").when(F.col("seq") % 4 == 1, "application/RSS+XML").when(F.col("seq") % 4 == 2, "text/xml; charset=utf-8")
    address = F.when(F.col("seq") % 5 == 0, F.concat("url", F.lit("/Sitemap.txt"))).otherwise(F.col("url"))
    return landed(s, d).select("seq", tables.is_feed(kind, address).alias("feed"))


def full_page_of() -> Column:
    """A page with entities, removed classes on several tags, nested markup, a comment
    and, in every other row, a content element before paragraphs outside it."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    lines = F.replace(safe("body"), F.lit("\n"), F.lit("</b></p>\n<p class='t'><b>"))
    head = F.concat(F.lit("<!DOCTYPE html><html><body><div class='a site-header'><div><p>menu</p><h1>fora</h1></div></div><!-- <p>x</p> --><h1>"), safe("title"), F.lit("</h1>"))
    inside = F.when(F.col("seq") % 2 == 0, F.lit("<div class='x entry-content'>")).otherwise(F.lit("<div>"))
    after = F.lit("</b></p><section class='most-read b'><p>1</p></section><nav><p>n</p></nav></div><p>autor<br>e data</p><div class='newsletter-embed'><p>assine</p></div></body></html>")
    return F.concat(head, inside, F.lit("<p><b>"), lines, after)


def _trimmed(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


LINES = f"list_transform(string_split(coalesce(body, ''), chr(10)), lambda x: {_trimmed('x')})"


@query(f"SELECT seq, {_trimmed('title')} AS title, array_to_string({LINES}, ' ') || CASE WHEN seq % 2 = 0 THEN '' ELSE ' autore data' END AS body FROM (SELECT seq, coalesce(title, '') AS title, body FROM documents_in)")
def html_extract(s, d):
    return landed(s, d).select("seq", pages.extract(full_page_of()).alias("x")).select("seq", "x.title", "x.body")


@query("SELECT seq, trim(url) AS link FROM documents_in WHERE regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]')")
def rss_links(s, d):
    safe = F.replace(F.coalesce("url", F.lit("")), F.lit("&"), F.lit("&amp;"))
    feed = F.concat(F.lit('<rss xmlns:a="urn:a"><channel><link>/</link><item><title>t</title><link> '), safe, F.lit(" </link></item><item><title>u</title></item></channel></rss>"))
    return landed(s, d).select("seq", F.explode(pages.rss_links(feed)).alias("link"))


@query(
    f"SELECT seq, trim(h) <> '' AND length(h) >= 500 AND NOT ({' OR '.join(f'contains(h, {sql.quote(m)})' for m in pages.SPA_MARKERS)}) AND len(regexp_extract_all(h, '<p[^>]*>.{{80,}}</p>')) >= 2 AS enough FROM (SELECT seq, {sql.html()} AS h FROM documents_in)"
)
def content_sufficient(s, d):
    return landed(s, d).select("seq", pages.content_sufficient(html_of()).alias("enough"))


@query(f"SELECT seq, coalesce({sql.host('url')} IN ('boletim-municipal.example', 'notas-da-capital.example'), FALSE) AS rendered FROM documents_in")
def spa_route(s, d):
    return landed(s, d).select("seq", tables.rendered(F.col("url"), ["boletim-municipal.example", "notas-da-capital.example"]).alias("rendered"))


@query(f"SELECT seq, {sql.preview('body', 400)} AS long, {sql.preview('body', 300)} AS short FROM documents_in")
def preview(s, d):
    return landed(s, d).select("seq", texts.preview(F.col("body"), 400).alias("long"), texts.preview(F.col("body"), 300).alias("short"))


@query("SELECT seq, coalesce(contains(lower(title), 'justiça suspende') OR contains(lower(title), 'filme'), FALSE) AS cue FROM documents_in")
def title_cues(s, d):
    return landed(s, d).select("seq", context.holds_any(F.col("title"), TRIGGERS).alias("cue"))


@query(f"SELECT seq, regexp_replace({sql.preview('body', 400)}, '(?i)(licitação|prefeitura)', '<mark>\\1</mark>', 'g') AS shown FROM documents_in")
def highlight(s, d):
    return landed(s, d).select("seq", texts.highlight(texts.preview(F.col("body"), 400), ["licitação", "prefeitura"]).alias("shown"))


@query("SELECT seq FROM documents_in WHERE trim(body) <> ''")
def nonblank_docs(s, d):
    return landed(s, d).where(F.trim("body") != "").select("seq")


@query("SELECT seq, coalesce(CASE WHEN trim(title) <> '' THEN title END, 'Sem título') AS title, strftime(timezone('UTC', collected_at), '%d/%m/%Y') AS day FROM documents_in")
def shown_fields(s, d):
    return landed(s, d).select("seq", adhoc.shown_title(F.col("title")).alias("title"), adhoc.shown_date(F.col("collected_at")).alias("day"))


# text analysis


@query(f"SELECT seq, array_to_string({sql.tokens('body')}, ' ') AS tokens FROM documents_in")
def tokenize(s, d):
    return landed(s, d).select("seq", F.array_join(texts.analyzed_tokens("body"), " ").alias("tokens"))


@query(f"SELECT DISTINCT seq, unnest({sql.raw('body')}) AS token FROM documents_in")
def raw_tokens(s, d):
    return landed(s, d).select("seq", F.explode(texts.raw_tokens("body")).alias("token"))


@query(f"SELECT seq, array_to_string({sql.tokens('title')}, ' ') AS stemmed, coalesce((SELECT string_agg(token, ' ' ORDER BY first) FROM (SELECT token, min(i) AS first FROM (SELECT unnest(r) AS token, unnest(range(len(r))) AS i) GROUP BY token)), CASE WHEN title IS NOT NULL THEN '' END) AS raw FROM (SELECT seq, title, {sql.raw('title')} AS r FROM documents_in)")
def dual_tokens(s, d):
    return landed(s, d).select("seq", F.array_join(texts.analyzed_tokens("title"), " ").alias("stemmed"), F.array_join(texts.raw_tokens("title"), " ").alias("raw"))


@query(f"SELECT CAST(i AS BIGINT) AS position, list_transform(s, lambda x: x)[i + 1] AS stem, r[i + 1] AS raw FROM (SELECT {sql.tokens(sql.quote(TEXT))} AS s, {sql.raw(sql.quote(TEXT))} AS r), range(greatest(len(s), len(r))) AS x(i)")
def term_groups(s, d):
    stemmed, raw = texts.analyze(TEXT), texts.raw_words(TEXT)
    rows = [(i, stemmed[i] if i < len(stemmed) else None, raw[i] if i < len(raw) else None) for i in range(max(len(stemmed), len(raw)))]
    return s.createDataFrame(rows, "position long, stem string, raw string")


@query("SELECT category, stem, weight FROM lex")
def lexicon_stems(s, d):
    return context.lexicon_stems(table(s, d, "lexicon"))


@query("SELECT stem, weight FROM lex WHERE category = 'keyword'")
def lexicon_weights(s, d):
    return context.lexicon_stems(table(s, d, "lexicon")).where("category = 'keyword'").select("stem", "weight")


@query("SELECT DISTINCT stem FROM lex")
def context_stems(s, d):
    return context.context_stems(context.lexicon_stems(table(s, d, "lexicon")))


@query(f"SELECT token, {sql.stem('token')} AS stem FROM (SELECT DISTINCT unnest({sql.raw('body')}) AS token FROM documents_in)")
def stem_vocab(s, d):
    words = landed(s, d).select(F.explode(texts.raw_tokens("body")).alias("token")).distinct()
    return words.select("token", texts.stem("token").alias("stem"))


# index


@query("SELECT term, url_hash, tf, array_to_string(positions, ' ') AS positions FROM built")
def postings(s, d):
    return built(s, d).select("term", "url_hash", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query("SELECT count(*) AS documents FROM docs")
def doc_count(s, d):
    return adhoc.count(docs_of(s, d))


@query("SELECT term, round(ln(n / df), 6) AS idf FROM vocab, corpus")
def index_idf(s, d):
    n = docs_of(s, d).count()
    return index.vocabulary(built(s, d)).select("term", F.round(index.index_idf(F.lit(float(n)), F.col("df")), 6).alias("idf"))


@query("SELECT term, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM vocab, corpus")
def query_idf(s, d):
    n = docs_of(s, d).count()
    return index.vocabulary(built(s, d)).select("term", F.round(index.query_idf(F.lit(float(n)), F.col("df")), 6).alias("idf"))


@query("SELECT term, url_hash, round(tfidf, 6) AS tfidf FROM idx")
def tfidf(s, d):
    rows = written(built(s, d).select("term", "url_hash", "tf"), "postings")
    return index.weighted(rows, docs_of(s, d).count()).select("term", "url_hash", F.round("tfidf", 6).alias("tfidf"))


@query("SELECT count(DISTINCT url_hash) AS documents, CAST(sum(tf) AS BIGINT) AS tokens, count(DISTINCT term) AS terms FROM built")
def index_metrics(s, d):
    return index.metrics(built(s, d))


@query("SELECT term, df FROM dfs")
def query_df(s, d):
    return search.query_df(built(s, d), QUERY)


# ranking


@query("SELECT term, url_hash, tf FROM raw_index WHERE term IN ('prefeitur', 'licitaçã')")
def postings_by_term(s, d):
    return index.unique_postings(table(s, d, "postings").where(F.col("term").isin("prefeitur", "licitaçã")))


@query("SELECT term, url_hash, tf FROM raw_index WHERE url_hash IN (SELECT url_hash FROM docs)")
def semi_in(s, d):
    return index.unique_postings(table(s, d, "postings")).join(docs_of(s, d).select("url_hash"), "url_hash", "left_semi").select("term", "url_hash", "tf")


@query("SELECT url_hash FROM docs WHERE " + DATES)
def date_filter(s, d):
    return docs_of(s, d).where(search.in_range(F.col("collected_at"), START, END)).select("url_hash")


@query("SELECT term, url_hash, tf FROM hits0", DATED)
def semi_postings(s, d):
    docs = docs_of(s, d).where(search.in_range(F.col("collected_at"), START, END)).select("url_hash")
    return built(s, d).where(F.col("term").isin(QUERY.terms)).join(docs, "url_hash", "left_semi").select("term", "url_hash", "tf")


@query("SELECT term, round(weight, 6) AS weight FROM weights")
def query_vector(s, d):
    return search.query_vector(search.query_df(built(s, d), QUERY), docs_of(s, d).count()).select("term", F.round("weight", 6).alias("weight"))


@query("SELECT term, url_hash, round(tfidf, 6) AS tfidf FROM hits")
def topk_postings(s, d):
    return search.top_postings(index_of(s, d), QUERY).select("term", "url_hash", F.round("tfidf", 6).alias("tfidf"))


def scored(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = index_of(s, d)
    hits = search.top_postings(rows, QUERY)
    return hits, search.base_scores(hits, search.query_vector(search.query_df(rows, QUERY), docs_of(s, d).count()), QUERY)


@query("SELECT url_hash, matched, coverage, round(score, 6) AS score FROM scores")
def base_score(s, d):
    return scored(s, d)[1].select("url_hash", "matched", "coverage", F.round("score", 6).alias("score"))


@query("SELECT url_hash, coverage FROM covered")
def coverage(s, d):
    return scored(s, d)[1].select("url_hash", "coverage")


@query("SELECT coverage, count(*) AS documents, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM scores GROUP BY coverage")
def coverage_histogram(s, d):
    return search.coverage_histogram(scored(s, d)[1]).select("coverage", "documents", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"))


@query("SELECT url_hash, matched_terms FROM named")
def matched_terms(s, d):
    return search.matched_terms(scored(s, d)[0]).select("url_hash", F.array_join("matched_terms", " ").alias("matched_terms"))


@query("SELECT url_hash, coverage, round(score, 6) AS score FROM pool")
def tier_pool(s, d):
    return search.pool(scored(s, d)[1]).select("url_hash", "coverage", F.round("score", 6).alias("score"))


@query("SELECT p.url_hash, d.title, d.url FROM pool p JOIN docs d USING (url_hash)")
def hydrate(s, d):
    return search.pool(scored(s, d)[1]).join(docs_of(s, d), "url_hash").select("url_hash", "title", "url")


@query("SELECT url_hash, person_hits, operation_hits, institution_hits, keyword_tf_sum FROM ctx_hits")
def context_hits(s, d):
    return context.hits(docs_of(s, d), built(s, d), context.lexicon_stems(table(s, d, "lexicon")))


@query("SELECT DISTINCT url_hash FROM idx WHERE term IN (SELECT stem FROM lex)")
def context_docs(s, d):
    return context.context_documents(built(s, d), context.lexicon_stems(table(s, d, "lexicon")))


def analysed(s: SparkSession, d: str) -> DataFrame:
    return context.analysis(docs_of(s, d), built(s, d), table(s, d, "lexicon"), table(s, d, "domain_trust"), TRIGGERS)


@query("SELECT url_hash, is_ambiguous FROM ambig")
def ambiguity(s, d):
    return analysed(s, d).select("url_hash", "is_ambiguous")


@query("SELECT url_hash, round(context, 6) AS score, domain_trust FROM context")
def context_score(s, d):
    return analysed(s, d).select("url_hash", F.round("score", 6).alias("score"), "domain_trust")


def blended(s: SparkSession, d: str) -> DataFrame:
    return search.blend(search.pool(scored(s, d)[1]), docs_of(s, d), analysed(s, d))


@query("SELECT url_hash, round(final, 6) AS final FROM blended")
def blend(s, d):
    return blended(s, d).select("url_hash", F.round("final", 6).alias("final"))


@query(f"SELECT url_hash, round(score, 6) AS score FROM scores WHERE score >= {search.LEAST_SCORE}")
def threshold(s, d):
    return scored(s, d)[1].where(F.col("score") >= search.LEAST_SCORE).select("url_hash", F.round("score", 6).alias("score"))


@query("SELECT url_hash, round(final, 6) AS final FROM blended ORDER BY final DESC, url_hash LIMIT 100")
def threshold_cascade(s, d):
    return search.cascade(blended(s, d), 1e9).select("url_hash", F.round("final", 6).alias("final"))


HIT = f"url_hash AS id, url, {sql.domain('url')} AS domain, title, {sql.preview('body', 400)} AS preview, round(final, 6) AS score, epoch_us(collected_at) AS collected_at, matched_terms"


@query(f"SELECT {HIT} FROM ranked LEFT JOIN named USING (url_hash) ORDER BY final DESC, url_hash LIMIT 10")
def search_relevance(s, d):
    return shown_hits(searched(s, d)[0])


@query(f"SELECT {HIT} FROM ranked LEFT JOIN named USING (url_hash) ORDER BY collected_at DESC, url_hash LIMIT 10")
def search_latest(s, d):
    return shown_hits(searched(s, d, sort="latest")[0])


@query(f"SELECT {HIT} FROM ranked LEFT JOIN named USING (url_hash) ORDER BY final DESC, url_hash LIMIT 10", DATED)
def search_dated(s, d):
    return shown_hits(searched(s, d, start=START, end=END)[0])


@query(f"SELECT {HIT} FROM ranked LEFT JOIN named USING (url_hash) ORDER BY final DESC, url_hash LIMIT {SIZE} OFFSET {(PAGE - 1) * SIZE}")
def page_relevance(s, d):
    return shown_hits(searched(s, d, page=PAGE, page_size=SIZE)[0])


@query(f"SELECT {HIT} FROM ranked LEFT JOIN named USING (url_hash) ORDER BY collected_at DESC, url_hash LIMIT {SIZE} OFFSET {(PAGE - 1) * SIZE}")
def page_latest(s, d):
    return shown_hits(searched(s, d, page=PAGE, page_size=SIZE, sort="latest")[0])


@query(f"SELECT count(*) AS total, CAST({PAGE} AS BIGINT) AS page, CAST(ceil(count(*) / {SIZE}.0) AS BIGINT) AS total_pages FROM ranked")
def page_meta(s, d):
    return searched(s, d, page=PAGE, page_size=SIZE)[1]


@query("SELECT position, label FROM (VALUES (0::BIGINT, '1'), (1, '…'), (2, '4'), (3, '5'), (4, '6'), (5, '7'), (6, '8'), (7, '…'), (8, '20')) AS t(position, label)")
def page_window(s, d):
    return adhoc.page_window(s, 6, 20)


ASKED = [(p, z) for p in (None, -3, 0, 1, 7, 1000) for z in (None, -1, 0, 1, 10, 50, 51, 9999)]


ASKED_SQL = ", ".join(f"({'NULL' if p is None else p}, {'NULL' if z is None else z})" for p, z in ASKED)


@query(f"SELECT CAST(p AS BIGINT) AS page, CAST(z AS BIGINT) AS size, CAST(greatest(1, coalesce(p, 1)) AS BIGINT) AS shown_page, CAST(least(50, greatest(1, coalesce(z, 10))) AS BIGINT) AS shown_size FROM (VALUES {ASKED_SQL}) AS t(p, z)")
def page_clamps(s, d):
    rows = [(p, z, search.clamp_page(p), search.clamp_size(z)) for p, z in ASKED]
    return local_table(s, rows, "page bigint, size bigint, shown_page bigint, shown_size bigint")


@query("SELECT url_hash FROM fb_docs", PLAIN)
def fallback_filter(s, d):
    return search.fallback_matches(docs_of(s, d), NO_INDEX.raw).select("url_hash")


def _count(token: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{token}'))"


FALLBACK = " + ".join(f"CASE WHEN {_count(t)} > 0 THEN ln({_count(t)} + 1.0) * CASE WHEN contains(lower(title), '{t}') THEN 2.0 ELSE 1.0 END ELSE 0.0 END" for t in NO_INDEX.raw)
FOUND = " + ".join(f"CASE WHEN {_count(t)} > 0 THEN 1 ELSE 0 END" for t in NO_INDEX.raw)


@query(f"SELECT url_hash, round(({FALLBACK}) * ({FOUND}) / {len(NO_INDEX.raw)}, 6) AS score FROM fb_docs", PLAIN)
def fallback_score(s, d):
    docs = search.fallback_matches(docs_of(s, d), NO_INDEX.raw)
    return search.fallback_scores(docs, NO_INDEX.raw).select("url_hash", F.round("final", 6).alias("score"))


FALLBACK_TERMS = f"array_to_string(list_sort(list_filter([{sql.listed(NO_INDEX.raw)}], lambda t: list_contains(w, t))), ' ')"


@query(f"SELECT url_hash AS id, url, {sql.domain('url')} AS domain, title, {sql.preview('body', 400)} AS preview, round(final, 6) AS score, epoch_us(collected_at) AS collected_at, {FALLBACK_TERMS} AS matched_terms FROM (SELECT *, ({FALLBACK}) * ({FOUND}) / {len(NO_INDEX.raw)} AS final FROM fb_docs) f WHERE final > 0 ORDER BY final DESC, url_hash LIMIT 10", PLAIN)
def search_fallback(s, d):
    return shown_hits(searched(s, d, search.Query(groups=[["zzrobôzz"]], raw=NO_INDEX.raw))[0])


@query(f"SELECT b.url_hash AS id, url, {sql.domain('url')} AS domain, round(b.final, 6) AS score FROM blended b")
def search_hits(s, d):
    rows = blended(s, d).withColumn("matched_terms", F.array().cast("array<string>"))
    return search.hit(rows).select("id", "url", "domain", F.round("score", 6).alias("score"))


# ingest and feeds

AGE = f"(epoch_us(TIMESTAMPTZ '{NOW}') - epoch_us(l.at)) / 3600000000.0"


@query(f"SELECT d.url_hash, l.at IS NULL OR {AGE} >= 24 AS intended, l.at IS NULL OR ({AGE} < 24 AND l.score IS NULL) AS observed FROM (SELECT DISTINCT url_hash FROM documents_in) d LEFT JOIN (SELECT url_hash, max(collected_at) AS at, max(score) AS score FROM last_seen GROUP BY url_hash) l USING (url_hash)")
def should_consume(s, d):
    rows, seen, now = landed(s, d).select("url_hash").distinct(), table(s, d, "last_seen"), F.to_timestamp(F.lit(NOW))
    both = ingest.should_consume(rows, seen, now).withColumnRenamed("consume", "intended")
    return ingest.should_consume(both, seen, now, "observed").withColumnRenamed("consume", "observed")


RECENT = f"url_hash AS id, url, {sql.domain('url')} AS domain, title, {sql.preview('body', 300)} AS preview, epoch_us(collected_at) AS collected_at"


@query(f"SELECT {RECENT} FROM docs ORDER BY docs.collected_at DESC, url_hash LIMIT 12")
def recent_documents(s, d):
    return recent.recent(docs_of(s, d)).withColumn("collected_at", F.unix_micros("collected_at"))


@query(f"SELECT {RECENT} FROM (SELECT * FROM (SELECT * FROM context c WHERE url_hash IN (SELECT url_hash FROM idx WHERE term IN (SELECT stem FROM lex)) ORDER BY c.collected_at DESC, url_hash LIMIT 50) p WHERE NOT is_ambiguous AND context >= 0.2 ORDER BY p.collected_at DESC, context DESC, url_hash LIMIT 12) q")
def recent_filtered(s, d):
    docs, stored = served(s, d)
    rows = recent.recent_filtered(docs, stored, table(s, d, "lexicon"), table(s, d, "domain_trust"), TRIGGERS)
    return rows.withColumn("collected_at", F.unix_micros("collected_at"))


# stored index and landing


@query("SELECT term, url_hash, tf, array_to_string(positions, ' ') AS positions FROM built")
def stored_postings(s, d):
    """Postings read back from the stored index, after a compaction."""
    docs, first, _ = landing(s, d)
    stored = StoredIndex(s, first.folder, first.buckets)
    return stored.postings().select("term", "url_hash", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query("SELECT term, df, cf FROM vocab")
def stored_counters(s, d):
    return landing(s, d)[1].counters()


@query("SELECT term, url_hash, tf, round(tfidf, 6) AS tfidf FROM idx WHERE term IN (SELECT term FROM terms)")
def stored_lookup(s, d):
    """Postings of a few terms: only their buckets are read."""
    return served(s, d)[1].of_terms(QUERY.terms).select("term", "url_hash", "tf", F.round("tfidf", 6).alias("tfidf"))


_landed: dict[tuple[str, str], tuple[pipeline.Landed, StoredIndex, pipeline.Landed]] = {}


def landing(s: SparkSession, d: str) -> tuple[pipeline.Landed, StoredIndex, pipeline.Landed]:
    """(documents, index, last seen) after documents_in was streamed in four batches,
    each with an index cycle."""
    place = (s.sparkContext.applicationId, d)
    if place not in _landed:
        folder = temporary(s, "landing")
        quarter = F.pmod(F.col("seq"), F.lit(4))
        for k in range(4):
            landed(s, d).where(quarter == k).coalesce(1).write.parquet(f"{folder}/in/{k}")
        docs, seen = pipeline.Landed(s, f"{folder}/documents", DOCUMENTS, buckets=8), pipeline.Landed(s, f"{folder}/seen", SEEN, buckets=8)
        stored = StoredIndex(s, f"{folder}/index", buckets=8)
        rows = prepared(s).readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
        after = pipeline.cycle_after(docs, stored, lambda: datetime.fromisoformat(NOW))
        pipeline.land(rows, docs, f"{folder}/checkpoint", seen=seen, after=after).awaitTermination()
        stored.compact()
        _landed[place] = docs, stored, seen
    return _landed[place]


@query(f"SELECT seq, url_hash, url, title, body, epoch_us(collected_at) AS collected_at, epoch_us(TIMESTAMPTZ '{NOW}') AS indexed_at FROM docs")
def stream_landing(s, d):
    return landing(s, d)[0].read().select("seq", "url_hash", "url", "title", "body", micros("collected_at"), micros("indexed_at"))


@query("SELECT url_hash, epoch_us(max(collected_at)) AS collected_at FROM documents_in WHERE url_hash IS NOT NULL GROUP BY url_hash")
def stream_seen(s, d):
    return landing(s, d)[2].read().select("url_hash", micros("collected_at"))


KEYWORDS = "SELECT url_hash, CAST(coalesce((SELECT sum(weight) FROM (SELECT lower(term) AS term, max(weight) AS weight FROM lexicon WHERE category = 'keyword' AND term IS NOT NULL GROUP BY 1) k WHERE contains(lower(concat_ws(' ', d.title, d.body)), k.term)), 0) AS BIGINT) AS relevance FROM docs d"


@query(f"SELECT url_hash, relevance FROM ({KEYWORDS}) k WHERE relevance >= 2")
def keyword_score(s, d):
    return adhoc.keyword_scores(docs_of(s, d), table(s, d, "lexicon"))


@query("SELECT count(*) AS documents FROM documents_in")
def adhoc_count(s, d):
    return adhoc.count(landed(s, d))


@query(f"SELECT url_hash, relevance FROM ({KEYWORDS}) k WHERE relevance >= 2 ORDER BY relevance DESC, url_hash LIMIT 10")
def adhoc_top10(s, d):
    return adhoc.top(adhoc.keyword_scores(docs_of(s, d), table(s, d, "lexicon")))


@query(f"SELECT round(avg(relevance), 6) AS relevance FROM ({KEYWORDS}) k WHERE relevance >= 2")
def adhoc_avg(s, d):
    return adhoc.average(adhoc.keyword_scores(docs_of(s, d), table(s, d, "lexicon"))).select(F.round("relevance", 6).alias("relevance"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    return search_relevance(s, d)
