from datetime import datetime, timedelta, timezone

from garimpo.operators import ingest, search
from garimpo.operators.index import postings, weighted
from garimpo.operators.stored import StoredIndex
from garimpo.sources.tables import DOCUMENTS, SEEN, stream
from garimpo.streaming import pipeline
from garimpo.streaming.pipeline import KEPT, Landed, cycle_after, fresh, index_cycle, land

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def rows(spark, items):
    return spark.createDataFrame([(i, k, f"https://{k}.example", "t", body, START + timedelta(hours=h), None) for i, k, body, h in items], DOCUMENTS)


PARTS = [[(1, "a", "foo bar", 0), (2, "b", "foo", 1)], [(3, "a", "foo baz", 2)], [(4, "b", "late", 0), (5, "c", "", 3)], [(6, None, "sem chave", 1)]]


def test_landing_cycle_and_search_equal_a_full_build(spark, tmp_path):
    results = []
    for name, batches in (("one", [sum(PARTS, [])]), ("many", PARTS)):
        base = f"file://{tmp_path}/{name}"
        table, seen, stored = Landed(spark, f"{base}/table", DOCUMENTS, buckets=4), Landed(spark, f"{base}/seen", SEEN, buckets=4), StoredIndex(spark, f"{base}/index", buckets=4)
        now = START + timedelta(days=1)
        for part in batches:
            rows(spark, part).coalesce(1).write.mode("append").parquet(f"{base}/in")
            land(stream(spark, f"{base}/in"), table, f"{base}/checkpoint", seen=seen, after=cycle_after(table, stored, lambda: now)).awaitTermination()
        docs = table.read()
        assert docs.where("indexed_at IS NULL").count() == 0
        landed = sorted((r["url_hash"] or "", r["seq"]) for r in docs.collect())
        last = sorted((r["url_hash"], r["collected_at"]) for r in seen.read().collect())
        counts = sorted(map(tuple, stored.counters().collect()))
        lexicon = spark.createDataFrame([], "category string, term string, weight int")
        trust = spark.createDataFrame([], "domain string, trust double")
        found = [[r["id"] for r in search.search(docs, x, lexicon, trust, "foo baz")[0].collect()] for x in (stored, weighted(postings(docs.where("url_hash IS NOT NULL")), docs.count()))]
        assert found[0] == found[1] == ["a", "b"]
        again = ingest.should_consume(docs.select("url_hash"), seen.read(), now)
        assert {r["url_hash"]: r["consume"] for r in again.collect()} == {"a": False, "b": False, "c": False, None: True}
        results.append((landed, last, counts))
    assert results[0] == results[1]
    assert results[0][0] == [("", 6), ("a", 3), ("b", 2), ("c", 5)] and [k for k, _ in results[0][1]] == ["a", "b", "c"]


def test_a_repeated_batch_changes_nothing_and_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "MOST_PARTS", 1)  # the index is compacted on the way
    table, stored = Landed(spark, f"file://{tmp_path}/table", DOCUMENTS, buckets=4), StoredIndex(spark, f"file://{tmp_path}/index", buckets=4)
    for number, part in enumerate(PARTS[:3]):
        for _ in range(2):  # as after a failure
            table.merge(rows(spark, part), 2 * number, ingest.upsert)
            index_cycle(table, stored, number, START)
    assert sorted((r["url_hash"], r["seq"]) for r in table.read().collect()) == [("a", 3), ("b", 2), ("c", 5)]
    assert table.read().where("indexed_at IS NULL").count() == 0
    assert sorted(map(tuple, stored.counters().collect())) == [("baz", 1, 1), ("foo", 2, 2)]
    assert len(table.manifests()) == KEPT
    named = {(f"v{v}", f"bucket={b}") for n in table.manifests() for b, v in table._valid(n + 1).items()}
    left = {(p.parent.name, p.name) for p in (tmp_path / "table").glob("v*/bucket=*")}
    assert left == named and table.read(before=0).collect() == []


def test_fresh_drops_repeats_within_a_day(spark, tmp_path):
    rows(spark, [(1, "a", "x", 0), (2, "a", "x", 1), (3, "b", "x", 0)]).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    query = fresh(stream(spark, f"file://{tmp_path}/in")).writeStream.format("memory").queryName("kept").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["url_hash"] for r in spark.table("kept").collect()) == ["a", "b"]
