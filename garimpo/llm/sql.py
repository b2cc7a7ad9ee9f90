"""SQL of the operators for training data that SQL can express, for DuckDB. Each is the
problem's plain definition: no sketch, chunk or suffix array."""

from __future__ import annotations

from garimpo.functions import text as texts
from garimpo.plans.sql import domain, quote

CLEAN = r"regexp_replace(lower(nfc_normalize(term)), '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
USES = f"""uses AS (SELECT term, url_hash, max(tf) AS tf FROM (SELECT {CLEAN} AS term, url_hash, coalesce(tf, 0) AS tf FROM postings WHERE url_hash IS NOT NULL) WHERE term <> '' GROUP BY term, url_hash),
counted AS (SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS records FROM uses GROUP BY term),
marked AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > (SELECT count(DISTINCT url_hash) FROM postings) / 4.0 THEN 'common' END AS mark FROM counted)"""


def folded_words(text: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({text})), '[\pL\pN]+')"


def windows(words: str, size: str) -> str:
    """All sequences of ``size`` words, as one string each."""
    return f"list_transform(range(greatest(len({words}) - ({size}) + 1, 0)), lambda i: array_to_string(list_slice({words}, i + 1, i + ({size})), ' '))"


def alike(head: str) -> str:
    """Links (a, b) of rows of documents_in whose text (``head`` and body) is alike."""
    return f"""rows_ AS (SELECT seq, collected_at, {folded_words(f"concat({head}, chr(10), coalesce(body, ''))")} AS w FROM documents_in WHERE len({folded_words("coalesce(body, '')")}) >= 60),
grams AS (SELECT DISTINCT seq, unnest({windows('w', '3')}) AS g FROM rows_),
sizes AS (SELECT seq, count(*) AS n FROM grams GROUP BY seq),
met AS (SELECT x.seq AS a, y.seq AS b, count(*) AS shared FROM grams x JOIN grams y USING (g) WHERE x.seq <> y.seq GROUP BY x.seq, y.seq),
links AS (SELECT a, b FROM met JOIN sizes x ON x.seq = a JOIN sizes y ON y.seq = b WHERE shared >= 0.6 * (x.n + y.n - shared))"""


GROUPS = f"""{alike("coalesce(title, '')")},
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)"""

#: One row after another in order of arrival: it repeats an accepted one or is accepted.
ARRIVAL = f"""{alike("''")},
late AS (SELECT seq, row_number() OVER (ORDER BY collected_at, seq) AS i FROM rows_ WHERE collected_at >= TIMESTAMPTZ '2026-03-01 00:00:00+00'),
near AS MATERIALIZED (SELECT late.seq, i, list(b) AS partners FROM late LEFT JOIN links ON a = late.seq GROUP BY late.seq, i),
steps AS (SELECT CAST(0 AS BIGINT) AS i, (SELECT list(seq) FROM rows_ WHERE collected_at IS NULL OR collected_at < TIMESTAMPTZ '2026-03-01 00:00:00+00') AS accepted, CAST(NULL AS BIGINT) AS seq
  UNION ALL SELECT near.i, CASE WHEN list_has_any(partners, accepted) THEN accepted ELSE list_append(accepted, near.seq) END, CASE WHEN list_has_any(partners, accepted) THEN near.seq END FROM steps JOIN near ON near.i = steps.i + 1)"""

LINES = rf"""rows_ AS (SELECT seq, url_hash, {domain('url')} AS site, string_split(body, chr(10)) AS parts FROM documents_in),
each AS (SELECT seq, url_hash, site, unnest(parts) AS raw, unnest(range(len(parts))) AS line_no FROM rows_),
clean AS (SELECT seq, url_hash, site, CAST(line_no AS INT) AS line_no, lower(trim(regexp_replace(raw, '[\s\pZ]+', ' ', 'g'))) AS line FROM each),
pages AS (SELECT site, count(DISTINCT url_hash) AS n FROM rows_ GROUP BY site),
stands AS (SELECT site, line, count(DISTINCT url_hash) AS n FROM clean WHERE line <> '' GROUP BY site, line)"""

LEAKS = f"""units AS (SELECT item_id, w, least(13, len(w)) AS size FROM (SELECT item_id, {folded_words('passage')} AS w FROM eval_items) WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, size, unnest({windows('w', 'size')}) AS g FROM units),
texts_ AS (SELECT doc_id, {folded_words('text')} AS w FROM documents),
held AS (SELECT DISTINCT doc_id, size, unnest({windows('w', 'size')}) AS g FROM texts_, (SELECT DISTINCT size FROM units))"""

STATISTICS = rf"""texts_ AS (SELECT doc_id, {folded_words('text')} AS w, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
frequent AS (SELECT list(DISTINCT w) AS f FROM (SELECT unnest({folded_words('word')}) AS w FROM common_words))"""
ENDS = ", ".join(quote(c) for c in ".!?…:;\"”»’)")

TITLES = f"SELECT url_hash, regexp_extract_all(lower(title), {quote(texts.WORD)}) AS w FROM documents_in WHERE url_hash IS NOT NULL"

SQL = {
    "p1_found": f"WITH RECURSIVE {ARRIVAL} SELECT seq FROM steps WHERE seq IS NOT NULL",
    "p3_found": f"WITH {USES} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_terms": f"WITH {USES} SELECT term, occurrences, records, mark FROM marked",
    "p3_ngrams": f"SELECT n, ngram, count(*) AS occurrences, count(DISTINCT url_hash) AS records FROM (SELECT url_hash, CAST(n AS BIGINT) AS n, unnest({windows('w', 'n')}) AS ngram FROM ({TITLES}), (VALUES (1), (2), (3)) AS t(n)) GROUP BY n, ngram",
    "p4_found": f"WITH {LINES} SELECT DISTINCT seq, line_no FROM clean JOIN stands USING (site, line) JOIN pages USING (site) WHERE stands.n >= 5 AND stands.n >= 0.05 * pages.n",
    "p4_cut": f"WITH {LINES}, bad AS (SELECT DISTINCT seq, line_no FROM clean JOIN stands USING (site, line) JOIN pages USING (site) WHERE stands.n >= 5 AND stands.n >= 0.05 * pages.n) SELECT d.seq, CASE WHEN d.body IS NOT NULL THEN coalesce(string_agg(raw, chr(10) ORDER BY each.line_no) FILTER (bad.seq IS NULL), '') END AS body FROM documents_in d LEFT JOIN each USING (seq) LEFT JOIN bad ON bad.seq = d.seq AND bad.line_no = each.line_no GROUP BY d.seq, d.body",
    "p5_found": f"WITH RECURSIVE {GROUPS} SELECT DISTINCT a AS seq_a, b AS seq_b FROM reached WHERE a < b",
    "p5_groups": f"WITH RECURSIVE {GROUPS} SELECT a AS id, min(b) AS group_id FROM reached GROUP BY a",
    "p9_counts": f"WITH {STATISTICS} SELECT doc_id, coalesce(len(w), 0) AS words, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / CAST(len(w) AS DOUBLE) END, 6) AS mean_word_length, round(CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: right(x, 1) IN ({ENDS}))) / CAST(len(l) AS DOUBLE) END, 6) AS line_end_share, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(f, x))) / CAST(len(w) AS DOUBLE) END, 6) AS common_share FROM texts_, frequent",
    "p7_found": f"WITH {LEAKS} SELECT DISTINCT doc_id, item_id FROM held JOIN wanted USING (size, g)",
}
