import pytest
from pyspark.sql import functions as F

from garimpo.operators import index
from garimpo.operators.stored import PlainIndex, StoredIndex

DOC = "url_hash string, body string"


def contents(stored):
    rows = sorted((r["term"], r["url_hash"], r["tf"], tuple(r["positions"])) for r in stored.postings().collect())
    return rows, sorted(map(tuple, stored.counters().collect()))


def full(spark, docs):
    rows = index.postings(spark.createDataFrame(docs, DOC))
    return sorted((r["term"], r["url_hash"], r["tf"], tuple(r["positions"])) for r in rows.collect()), sorted(map(tuple, index.vocabulary(rows).collect()))


def test_cycles_equal_a_full_build(spark, tmp_path):
    stored = StoredIndex(spark, f"file://{tmp_path}/index", buckets=4)
    assert stored.postings().collect() == [] and stored.counters(["foo"]).collect() == [] and stored.of_terms(["foo"]).collect() == []
    stored.add(spark.createDataFrame([("a", "foo bar"), ("b", "foo baz foo"), ("c", "  "), ("d", None)], DOC), 4)
    stored.add(spark.createDataFrame([("a", "foo foo qux"), ("e", "baz")], DOC), 5)
    stored.add(spark.createDataFrame([("a", "nova versão"), ("b", "")], DOC), 5)
    now = [("a", "nova versão"), ("b", ""), ("c", "  "), ("d", None), ("e", "baz")]
    assert contents(stored) == full(spark, now)
    stored.compact()
    assert contents(stored) == full(spark, now) and len(stored.parts) == 1 and stored.documents == 5
    stored.compact()
    assert sorted(p.name for p in (tmp_path / "index").glob("part=*")) == ["part=0", "part=2", "part=4", "part=5"]
    stored.add(spark.createDataFrame([("f", "foo"), (None, "sem chave")], DOC), 6)
    again = StoredIndex(spark, f"file://{tmp_path}/index", buckets=4)
    assert again.parts == stored.parts and contents(again) == full(spark, [*now, ("f", "foo")])
    again.compact()
    assert contents(again) == full(spark, [*now, ("f", "foo")])
    assert sorted(p.name for p in (tmp_path / "index").glob("part=*")) == ["part=5", "part=6", "part=7"]


def test_a_part_counts_once(spark, tmp_path):
    stored = StoredIndex(spark, f"file://{tmp_path}/index", buckets=4)
    docs = spark.createDataFrame([("a", "foo bar")], DOC)
    stored.add(docs, 1, part=0)
    stored.add(docs, 1, part=0)
    assert [tuple(r) for r in stored.counters(["foo"]).collect()] == [("foo", 1, 1)]
    (tmp_path / "index/part=2").mkdir()  # a part that broke off
    assert StoredIndex(spark, f"file://{tmp_path}/index", buckets=4).parts == [0]


def test_lookups_equal_a_table_and_read_their_buckets(spark, tmp_path):
    docs = spark.range(200).selectExpr("concat('d', id) AS url_hash", "concat('hot mod', id % 7, ' palavra', id) AS body")
    stored = StoredIndex(spark, f"file://{tmp_path}/index", buckets=16)
    stored.add(docs, 200)
    plain = PlainIndex(index.weighted(index.postings(docs), 200), 200)
    terms = ["hot", "mod3", "palavra17", "nada"]
    for name, argument in (("of_terms", terms), ("of_documents", ["d1", "d77", "x"])):
        rows = [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in getattr(x, name)(argument).collect()) for x in (stored, plain)]
        assert rows[0] == rows[1] and rows[0]
    assert sorted(map(tuple, stored.counters(terms).collect())) == sorted(map(tuple, plain.counters(terms).collect()))
    files = stored.of_terms(["palavra17"]).where("tf > 0").inputFiles()
    assert "PartitionFilters: [isnotnull(bucket" in stored.of_terms(["palavra17"])._jdf.queryExecution().executedPlan().toString() and files
    assert stored.with_terms(spark.createDataFrame([("mod3",), ("mod4",)], "stem string")).count() == len([i for i in range(200) if i % 7 in (3, 4)])


def test_a_term_of_many_postings_fills_several_files(spark, tmp_path):
    docs = spark.range(4000).select(F.concat(F.lit("d"), "id").alias("url_hash"), F.lit("hot").alias("body"))
    stored = StoredIndex(spark, f"file://{tmp_path}/index", buckets=2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored.add(docs, 4000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [p for p in (tmp_path / "index/part=0/by_term").rglob("*.parquet")]
    assert len(parts) >= 3 and stored.of_terms(["hot"]).count() == 4000
    assert stored.of_terms(["hot"]).agg(F.max("tfidf")).first()[0] == pytest.approx(0.0)
