from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from garimpo.operators import index, ingest

DOC = "url_hash string, body string"


def at(day, hour=0):
    return datetime(2026, 1, day, hour, tzinfo=timezone.utc)


def as_dict(df, key="term"):
    return {r[key]: r for r in df.collect()}


def test_positions_and_invariants(spark):
    docs = spark.createDataFrame([("a", "foo bar foo"), ("b", "foo"), ("c", "  "), ("d", None), ("e", "")], DOC)
    rows = index.postings(docs)
    found = {(r["url_hash"], r["term"]): (r["tf"], r["positions"]) for r in rows.collect()}
    assert found == {("a", "foo"): (2, [0, 2]), ("a", "bar"): (1, [1]), ("b", "foo"): (1, [0])}
    words = as_dict(index.vocabulary(rows))
    assert (words["foo"]["df"], words["foo"]["cf"]) == (2, 3)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC)
    assert index.weighted(index.postings(docs), 0).collect() == []
    assert index.vocabulary(index.postings(docs)).collect() == []


def test_weights(spark):
    frame = spark.createDataFrame([(4.0, 1), (4.0, 4), (4.0, 0)], "n double, df long")
    got = frame.select(index.index_idf(F.col("n"), F.col("df")).alias("i"), index.query_idf(F.col("n"), F.col("df")).alias("q")).collect()
    assert got[0]["i"] == pytest.approx(1.386294, abs=1e-6) and got[1]["i"] == 0 and got[2]["i"] is None
    assert [round(r["q"], 6) for r in got] == [1.916291, 1.0, 0.0]


def test_full_and_incremental_index_agree(spark):
    old = spark.createDataFrame([("a", "foo bar"), ("b", "foo baz")], DOC)
    new = spark.createDataFrame([("a", "foo foo")], DOC)
    before, after = index.postings(old), index.postings(new)
    merged = index.replace(before, after, new)
    full = index.postings(spark.createDataFrame([("a", "foo foo"), ("b", "foo baz")], DOC))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, full.collect()))
    counts = index.add_counts(index.vocabulary(before), index.removal_counts(before, new).union(index.vocabulary(after)))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, index.vocabulary(full).collect()))
    assert "bar" not in as_dict(counts)


def test_unique_postings_drop_nulls_and_repeats(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 3), (None, "x", 1), (" ", "x", 1), ("a", None, 1)], "term string, url_hash string, tf long")
    assert [tuple(r) for r in index.unique_postings(rows).collect()] == [("a", "x", 3)]


def test_latest_and_upsert(spark):
    schema = "seq long, url_hash string, body string, collected_at timestamp, indexed_at timestamp, extra string"
    old = spark.createDataFrame([(1, "a", "x", at(1), at(2), "e"), (2, "b", "y", at(1), at(2), None), (3, None, "n", None, None, None)], schema)
    new = spark.createDataFrame([(4, "a", "z", at(3), at(3), None), (5, "a", "w", at(3), None, None)], schema)
    found = {r["url_hash"]: r for r in ingest.upsert(old, new).collect()}
    assert found["a"]["body"] == "w" and found["a"]["indexed_at"] is None
    assert found["b"]["indexed_at"] is not None and found[None]["body"] == "n"
    assert ingest.latest(old.limit(0)).collect() == []


@pytest.mark.parametrize(("mode", "want"), [("intended", {"new": True, "young": False, "old": True, "cached": False}), ("observed", {"new": True, "young": True, "old": False, "cached": False})])
def test_should_consume(spark, mode, want):
    seen = spark.createDataFrame([("young", at(2, 23), None), ("old", at(1, 23), None), ("cached", at(2, 23), 1), (None, at(1), None)], "url_hash string, collected_at timestamp, score int")
    urls = spark.createDataFrame([(k,) for k in want], "url_hash string")
    assert {r["url_hash"]: r["consume"] for r in ingest.should_consume(urls, seen, at(3), mode).collect()} == want
    with pytest.raises(ValueError):
        ingest.should_consume(urls, seen, at(3), "other")


def test_mark_indexed_leaves_newer_versions_pending(spark):
    docs = spark.createDataFrame([("a", at(2), None), ("b", at(1), None)], "url_hash string, collected_at timestamp, indexed_at timestamp")
    done = spark.createDataFrame([("a", at(1)), ("b", at(1))], "url_hash string, collected_at timestamp")
    found = {r["url_hash"]: r["indexed_at"] for r in ingest.mark_indexed(docs, done, at(5)).collect()}
    assert found["a"] is None and found["b"] is not None


def test_a_term_of_all_documents_is_weighted_where_it_stands(spark):
    docs = spark.range(3000).selectExpr("concat('d', id) AS url_hash", "concat('hot raro', id % 700, ' palavra', id) AS body")
    rows = index.postings(docs)
    found = index.weighted(rows, 3000)
    assert found.count() == 9000 and found.where("term = 'hot' AND tfidf = 0").count() == 3000
    other = found.where("term != 'hot'").select("term", F.round("tfidf", 6).alias("w"))
    counts = index.vocabulary(rows).select("term", F.round(F.ln(F.lit(3000.0) / F.col("df")), 6).alias("w"))
    assert other.distinct().exceptAll(counts).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_metrics(spark):
    rows = index.postings(spark.createDataFrame([("a", "foo bar foo"), ("b", "foo")], DOC))
    assert tuple(index.metrics(rows).first()) == (2, 4, 2)
