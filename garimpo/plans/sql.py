"""SQL of the core queries for DuckDB, composed of named common table expressions."""

from __future__ import annotations

import re

from garimpo.functions import html as pages
from garimpo.functions import text as texts
from garimpo.operators import context as contexts
from garimpo.operators import search as ranking


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return ", ".join(quote(x) for x in items)


def stem(column: str) -> str:
    fold = f"translate({column}, {quote(texts.ACCENTED)}, {quote(texts.PLAIN)})"
    return f"CASE WHEN length({column}) >= {texts.LEAST_STEMMED} THEN regexp_replace({fold}, {quote(texts.STEM)}, '\\1') ELSE {fold} END"


def stems(column: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(lower({column}), {quote(texts.TOKEN)}), lambda t: t NOT IN ({listed(texts.STOP_WORDS)})), lambda t: {stem('t')})"


def tokens(column: str) -> str:
    return f"list_filter({stems(column)}, lambda t: length(t) BETWEEN 3 AND 40 AND NOT regexp_full_match(t, '\\p{{Nd}}+'))"


def raw(column: str) -> str:
    return f"regexp_extract_all(lower({column}), {quote(texts.RAW)})"


def host(url: str) -> str:
    return f"nullif(regexp_replace(lower(regexp_extract({url}, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\\.', ''), '')"


def domain(url: str) -> str:
    return f"coalesce({host(url)}, {url})"


def preview(column: str, size: int) -> str:
    return f"CASE WHEN length({column}) > {size} THEN substring({column}, 1, {size}) || '...' ELSE {column} END"


def html(title: str = "title", body: str = "body", url: str = "url") -> str:
    """A page made of a row, as text of both engines."""
    return (
        f"concat('<html><body><nav><p>menu</p></nav><h1 class=\"t\">', coalesce({title}, ''), '</h1><script>var t=\"</p>\";</script><a class=\"l\" href=\"', coalesce({url}, ''), "
        f"'\">x</a><p>', replace(coalesce({body}, ''), chr(10), '</p><p class=\"x\">'), '<footer><p>end</p></footer></body></html>')"
    )


ROOT = quote(pages.ROOT)


def resolved(href: str, base: str) -> str:
    """An href against its page, for pages and hrefs whose dots lie in the path."""
    link = f"regexp_replace(trim({href}), '#.*$', '')"
    root, path = f"regexp_extract({base}, {ROOT}, 1)", f"regexp_replace(regexp_replace({base}, {ROOT}, ''), '[?#].*$', '')"
    folder = f"{root} || CASE WHEN {path} = '' THEN '/' ELSE regexp_replace({path}, '[^/]*$', '') END"
    joined = (
        f"CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {link} WHEN {root} = '' THEN NULL WHEN {link} LIKE '//%' THEN regexp_extract({root}, '^[^:]*:') || {link} "
        f"WHEN {link} LIKE '/%' THEN {root} || {link} WHEN {link} LIKE '?%' THEN {root} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {link} ELSE {folder} || {link} END"
    )
    clean = f"regexp_replace(regexp_replace(regexp_replace({joined}, '/\\./', '/'), '(://[^/]*(?:/[^/?]+)*?)/[^/?]+/\\.\\./', '\\1/'), '(://[^/]*)/\\.\\./', '\\1/')"
    return f"CASE WHEN {link} <> '' AND regexp_matches({joined}, '^(?i:https?)://[^/?#]') THEN {clean} END"


def strip(column: str) -> str:
    return f"regexp_replace({column}, {quote(pages.STRIP)}, ' ', 'g')"


CLASS_HITS = ", ".join(f"count(*) FILTER (category = '{c}') AS {c}_hits" for c in contexts.CLASSES[:3])


def phrases(column: str, items) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {quote(x.lower())})" for x in items) + ")"


def pieces(query: ranking.Query, triggers: list[str], dates: str = "TRUE", limit: bool = True) -> dict[str, str]:
    """All named expressions of a query."""
    terms = query.terms
    n = len(query.groups)
    groups = ", ".join(f"({quote(t)}, {i})" for t in terms for i, g in enumerate(query.groups) if t in g)
    size = ranking.POOL if limit else ranking.POOL_FILTERED
    least = ranking.LEAST_SCORE if limit else ranking.LEAST_SCORE_FILTERED
    w = contexts.WEIGHTS
    parts = " + ".join(f"least({c} * {w[k][0]}, {w[k][1]})" for k, c in (("keyword", "keyword_tf_sum"), ("person", "person_hits"), ("operation", "operation_hits"), ("institution", "institution_hits")))
    return {
        "docs": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY collected_at DESC, seq DESC) AS rn FROM documents_in) WHERE rn = 1",
        "corpus": "SELECT CAST(count(*) AS DOUBLE) AS n FROM docs",
        "toks": f"SELECT url_hash, {tokens('body')} AS a FROM docs WHERE trim(body) <> ''",
        "flat": "SELECT url_hash, unnest(a) AS term, unnest(range(len(a))) AS position FROM toks",
        "built": "SELECT term, url_hash, count(*) AS tf, list_sort(list(position)) AS positions FROM flat GROUP BY term, url_hash",
        "raw_index": "SELECT term, url_hash, max(tf) AS tf FROM postings WHERE trim(term) <> '' AND url_hash IS NOT NULL GROUP BY term, url_hash",
        "vocab": "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM built GROUP BY term",
        "idx": "SELECT term, url_hash, tf, tf * ln(n / df) AS tfidf FROM built JOIN vocab USING (term), corpus",
        "terms": f"SELECT * FROM (VALUES {groups}) AS t(term, g)",
        "dfs": "SELECT t.term, count(i.term) AS df FROM (SELECT DISTINCT term FROM terms) t LEFT JOIN idx i ON i.term = t.term GROUP BY t.term",
        "weights0": "SELECT term, CASE WHEN df > 0 THEN ln((1 + n) / (1 + df)) + 1 ELSE 0.0 END AS w FROM dfs, corpus",
        "weights": "SELECT term, CASE WHEN (SELECT max(w) FROM weights0) > 0 THEN w ELSE 1.0 END AS weight FROM weights0 WHERE w > 0 OR (SELECT max(w) FROM weights0) <= 0",
        "norm": "SELECT sqrt(sum(weight * weight)) AS norm FROM weights",
        "allowed": f"SELECT url_hash FROM docs WHERE {dates}",
        "hits0": "SELECT i.* FROM idx i WHERE term IN (SELECT term FROM terms) AND url_hash IN (SELECT url_hash FROM allowed)",
        "hits": "SELECT term, url_hash, tf, tfidf FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tfidf DESC, url_hash) AS rn FROM hits0)" + (f" WHERE rn <= {ranking.TOP_POSTINGS}" if limit else ""),
        "products": "SELECT url_hash, sum(coalesce(weight, 0) * tfidf) AS product, count(*) AS matched FROM hits LEFT JOIN weights USING (term) GROUP BY url_hash",
        "covered": "SELECT url_hash, count(DISTINCT g) AS coverage FROM hits JOIN terms USING (term) GROUP BY url_hash",
        "scores": f"SELECT url_hash, matched, coverage, product / (norm * sqrt(matched)) * (0.3 + 0.7 * (coverage / {n}.0) * (coverage / {n}.0)) * CASE WHEN coverage = {n} AND {n} > 1 THEN {ranking.FULL_MATCH} ELSE 1.0 END AS score FROM products JOIN covered USING (url_hash), norm WHERE product > 0",
        "pool": f"SELECT * FROM scores ORDER BY coverage DESC, score DESC, url_hash LIMIT {size}",
        "stems0": f"SELECT category, unnest({stems('term')}) AS stem, weight FROM lexicon WHERE category IN ({listed(contexts.CLASSES)})",
        "lex": f"SELECT category, stem, max(weight) AS weight FROM stems0 WHERE length(stem) >= {contexts.LEAST_STEM} GROUP BY category, stem",
        "found": f"SELECT url_hash, {CLASS_HITS}, sum(CASE WHEN category = 'keyword' THEN tf * weight ELSE 0 END) AS keyword_tf_sum FROM idx JOIN lex ON lex.stem = idx.term GROUP BY url_hash",
        "ctx_hits": "SELECT d.url_hash, d.url, d.title, d.collected_at, d.body, coalesce(person_hits, 0) AS person_hits, coalesce(operation_hits, 0) AS operation_hits, coalesce(institution_hits, 0) AS institution_hits, CAST(coalesce(keyword_tf_sum, 0) AS BIGINT) AS keyword_tf_sum FROM docs d LEFT JOIN found USING (url_hash)",
        "trusted": f"SELECT c.*, coalesce(t.trust, 1.0) AS domain_trust FROM (SELECT *, coalesce({host('url')}, '') AS dom FROM ctx_hits) c LEFT JOIN (SELECT lower(domain) AS dom, max(trust) AS trust FROM domain_trust WHERE domain IS NOT NULL GROUP BY 1) t USING (dom)",
        "cues": "SELECT DISTINCT lower(term) AS cue FROM lexicon WHERE category = 'nontopical' AND term IS NOT NULL",
        "ambig": f"SELECT t.*, coalesce({phrases('title', triggers)}, FALSE) AND EXISTS (SELECT 1 FROM cues WHERE contains(lower(t.title), cue)) AND NOT (person_hits > 0 OR operation_hits > 1 OR institution_hits > 0) AS is_ambiguous FROM trusted t",
        "context": f"SELECT *, CASE WHEN is_ambiguous THEN {contexts.AMBIGUOUS} ELSE {parts} END * domain_trust AS context FROM ambig",
        "blended": f"SELECT p.*, c.url, c.title, c.body, c.collected_at, c.context, {ranking.BASE_WEIGHT} * p.score + {ranking.CONTEXT_WEIGHT} * coalesce(c.context, 0) AS final FROM pool p JOIN context c USING (url_hash)",
        "ranked": f"SELECT * FROM (SELECT *, max(CASE WHEN final >= {least} THEN 1 ELSE 0 END) OVER () AS passed, row_number() OVER (ORDER BY final DESC, url_hash) AS rn FROM blended) WHERE final >= {least} OR (passed = 0 AND rn <= {ranking.CASCADE})",
        "named": "SELECT url_hash, array_to_string(list_sort(list(DISTINCT term)), ' ') AS matched_terms FROM hits GROUP BY url_hash",
        "fb_words": f"SELECT *, regexp_extract_all(lower(concat_ws(' ', body, title)), {quote(texts.WORD)}) AS w FROM docs",
        "fb_docs": f"SELECT * FROM fb_words WHERE list_has_any(w, [{listed(query.raw) or quote('')}]) ORDER BY url_hash LIMIT {ranking.FALLBACK}",
    }


def compose(parts: dict[str, str], final: str) -> str:
    """``final`` with the expressions it needs, in order."""
    needed, queue = set(), [final]
    while queue:
        sql = queue.pop()
        for name in parts:
            if name not in needed and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", sql):
                needed.add(name)
                queue.append(parts[name])
    heads = [f"{name} AS ({sql})" for name, sql in parts.items() if name in needed]
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + final
