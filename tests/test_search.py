from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from garimpo.operators import adhoc, context, index, recent, search

LEXICON = "category string, term string, weight int"


def q(*groups):
    return search.Query([list(g) for g in groups], [g[-1] for g in groups])


def hits(spark, rows):
    return spark.createDataFrame(rows, "term string, url_hash string, tf long, tfidf double")


def vector(spark, **weights):
    return spark.createDataFrame(list(weights.items()), "term string, weight double")


def score(spark, rows, query, **weights):
    return {r["url_hash"]: r for r in search.base_scores(hits(spark, rows), vector(spark, **weights), query).collect()}


def test_base_score(spark):
    one = score(spark, [("a", "d", 1, 2.0)], q("a", "b"), a=3.0, b=4.0)
    assert one["d"]["score"] == pytest.approx(0.57)
    both = score(spark, [("a", "d", 1, 2.0), ("b", "d", 1, 1.0)], q("a", "b"), a=3.0, b=4.0)
    assert both["d"]["score"] == pytest.approx(1.979899, abs=1e-6) and both["d"]["coverage"] == 2
    single = score(spark, [("a", "d", 1, 2.0)], q("a"), a=2.0)
    assert single["d"]["score"] == pytest.approx(2.0)
    assert score(spark, [("a", "d", 1, 0.0)], q("a"), a=2.0) == {}


def test_vector_falls_back_to_equal_weights(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "term string, df long")
    assert {r["term"]: r["weight"] for r in search.query_vector(df, 5).collect()} == {"a": 1.0, "b": 1.0}


def test_pool_prefers_coverage(spark):
    rows = spark.createDataFrame([("A", 1, 9.0), ("B", 2, 1.0)], "url_hash string, coverage long, score double")
    assert [r["url_hash"] for r in search.pool(rows, 1).collect()] == ["B"]


def test_cascade(spark):
    rows = spark.createDataFrame([(f"d{i:03}", i / 1e5) for i in range(150)], "url_hash string, final double")
    assert search.cascade(rows, 1.0).count() == 100
    assert search.cascade(rows, 0.00149).count() == 1


def test_pages_and_clamps(spark):
    rows = spark.createDataFrame([(f"d{i:02}", float(-i)) for i in range(21)], "url_hash string, final double")
    pages = [[r["url_hash"] for r in search.page_of(rows, p, 10).collect()] for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [10, 10, 1, 0] and sum(pages, []) == [f"d{i:02}" for i in range(21)]
    assert tuple(search.page_meta(rows, 4, 10).first()) == (21, 4, 3)
    assert (search.clamp_size(0), search.clamp_size(99), search.clamp_page(-1), search.clamp_size(None)) == (1, 50, 1, 10)
    with pytest.raises(ValueError):
        search.Query.parse("  ")


def test_date_range_is_inclusive_by_day(spark):
    times = [datetime(2024, 1, 5, 0, 0, 0, tzinfo=timezone.utc), datetime(2024, 1, 5, 23, 59, 59, tzinfo=timezone.utc), datetime(2024, 1, 6, tzinfo=timezone.utc)]
    rows = spark.createDataFrame([(t,) for t in times], "t timestamp")
    day = date(2024, 1, 5)
    assert [r[0] for r in rows.select(search.in_range(F.col("t"), day, day)).collect()] == [True, True, False]


def test_fallback(spark):
    docs = spark.createDataFrame([("a", "réu réu RÉU", "x"), ("b", "nada", "o réu"), ("c", None, None), ("d", "réus", "")], "url_hash string, body string, title string")
    two = search.fallback_scores(docs, ["réu", "fim"])
    assert {r["url_hash"]: round(r["final"], 6) for r in two.collect()}["a"] == pytest.approx(0.693147)
    one = {r["url_hash"]: r["final"] for r in search.fallback_scores(docs, ["réu"]).collect()}
    assert one["b"] == pytest.approx(1.386294, abs=1e-6) and set(one) == {"a", "b"}
    assert {r["url_hash"] for r in search.fallback_matches(docs, ["réu"]).collect()} == {"a", "b"}
    assert search.fallback_matches(docs, []).count() == 0


def lexicon(spark):
    rows = [("person", "Ther Thorat", 1), ("operation", "inhat", 1), ("keyword", "fraud", 3), ("keyword", "FRAUD", 2), ("nontopical", "filme", 1), (None, "x", 1), ("keyword", None, 1)]
    return spark.createDataFrame(rows, LEXICON)


def test_lexicon_stems(spark):
    found = {(r["category"], r["stem"]): r["weight"] for r in context.lexicon_stems(lexicon(spark)).collect()}
    assert found == {("person", "ther"): 1, ("person", "thorat"): 1, ("operation", "inhat"): 1, ("keyword", "fraud"): 3}


def test_context_score_and_ambiguity(spark):
    frame = spark.createDataFrame([(1, 2, 5, 10, 1.5, False), (0, 1, 0, 0, 1.5, True)], "person_hits long, operation_hits long, institution_hits long, keyword_tf_sum long, t double, amb boolean")
    assert [round(r[0], 6) for r in frame.select(context.score(F.col("amb"), F.col("t"))).collect()] == [3.45, 0.15]
    titles = spark.createDataFrame([("Lava Filme", 0, 1, 0), ("lava filme", 0, 2, 0), ("lava", 0, 0, 0), (None, 0, 0, 0)], "t string, person_hits long, operation_hits long, institution_hits long")
    assert [r[0] for r in titles.select(context.ambiguous(F.col("t"), ["lava"], context.phrase_weight(spark, F.col("t"), {"filme": 1}) > 0)).collect()] == [True, False, False, False]


def corpus(spark):
    time = datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = [
        ("a", "https://www.x.example/1", "fraud na obra", "fraud fraud thorat contrato", time, "extra"),
        ("b", "https://y.example/2", "outro", "contrato simples", time.replace(day=2), None),
        ("c", "sem host", None, None, None, None),
    ]
    return spark.createDataFrame(rows, "url_hash string, url string, title string, body string, collected_at timestamp, score string")


def test_search_end_to_end_with_nulls_and_clashing_columns(spark):
    docs = corpus(spark).drop("score")
    postings = index.weighted(index.postings(docs), docs.count())
    trust = spark.createDataFrame([("x.example", 1.5), (None, 2.0), ("y.example", None)], "domain string, trust double")
    found, meta = search.search(docs, postings, lexicon(spark), trust, "fraud contrato")
    rows = found.collect()
    assert [r["id"] for r in rows] == ["a", "b"] and rows[0]["domain"] == "x.example" and meta.first()["total"] == 2
    nothing, meta = search.search(docs, postings, lexicon(spark), trust, "fraud", start=date(2027, 1, 1))
    assert nothing.collect() == [] and tuple(meta.first()) == (0, 1, 0)
    plain, _ = search.search(docs, postings.limit(0), lexicon(spark), trust, "simples")
    assert [r["id"] for r in plain.collect()] == ["b"]
    assert [r["id"] for r in recent.recent(docs, 99).collect()] == ["b", "a", "c"]
    assert [r["id"] for r in recent.recent_filtered(docs, postings, lexicon(spark), trust).collect()] == ["a"]
    hits = {r["url_hash"]: r for r in context.hits(docs, postings, context.lexicon_stems(lexicon(spark))).collect()}
    assert hits["a"]["keyword_tf_sum"] == 6 and hits["a"]["person_hits"] == 1 and hits["c"]["keyword_tf_sum"] == 0


def test_page_window_and_figures(spark):
    labels = [r["label"] for r in adhoc.page_window(spark, 6, 20).orderBy("position").collect()]
    assert labels == ["1", "…", "4", "5", "6", "7", "8", "…", "20"]
    assert adhoc.page_window(spark, 1, 1).count() == 0
    scores = adhoc.keyword_scores(corpus(spark), lexicon(spark))
    assert [tuple(r) for r in scores.collect()] == [("a", 3)]
    assert adhoc.average(scores).first()[0] == 3.0


def test_phrases_are_found_once_each_and_may_be_none(spark):
    frame = spark.createDataFrame([("Filme e filmes da LICITAÇÃO",), ("",), (None,), ("nada",)], "t string")
    table = spark.createDataFrame([("filme", 2), ("FILME", 5), ("licitação", 1), (None, 9), ("", 9)], "term string, weight int")
    phrases = context.phrases_of(table, "term", "weight")
    assert phrases == {"filme": 5, "licitação": 1}
    assert [r[0] for r in frame.select(context.phrase_weight(spark, F.col("t"), phrases)).collect()] == [6, 0, None, 0]
    assert [r[0] for r in frame.select(context.phrase_weight(spark, F.col("t"), {})).collect()] == [0, 0, None, 0]


def test_the_fallback_cuts_only_texts_that_contain_a_word(spark):
    docs = spark.createDataFrame([("a", "t", "robô aqui"), ("b", "t", "robôs"), ("c", "Robô", None), ("d", None, None)], "url_hash string, title string, body string")
    assert [r["url_hash"] for r in search.fallback_matches(docs, ["robô"]).collect()] == ["a", "c"]
    assert search.fallback_matches(docs, []).collect() == []
