import numpy as np
import pytest

from garimpo.llm import leaks, mixing
from garimpo.llm.batches import U64, Hasher, words
from tests.llm import helpers as h

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def test_simhash_matches_majority():
    flat, _ = Hasher()(["um dois três quatro cinco seis sete oito nove dez onze doze treze catorze"])
    for width in (1, 2, 5, 8, 13):
        got = leaks.simhashes(flat, width, leaks.spread_table())
        for i, value in enumerate(got.tolist()):
            bits = sum(1 << k for k in range(64) if ((flat[i : i + width] >> U64(k)) & U64(1)).sum() > width // 2)
            assert value == bits


def test_multi_index_finds_everything_within_the_radius():
    rng = np.random.default_rng(1)
    hashed = Hasher()
    passages = [" ".join(rng.choice(h.VOCABULARY, 30)) for _ in range(5)]
    index = leaks.indexes(passages, list(range(5)), 13)[0]
    text = " ".join(rng.choice(h.VOCABULARY, 200)) + " " + passages[2][30:] + " " + passages[4]
    flat, _ = hashed([text])
    spread = leaks.spread_table()
    prints = leaks.simhashes(flat, 13, spread)
    want = {(i, j) for i in range(len(prints)) for j in range(len(index.prints)) if bin(int(prints[i] ^ index.prints[j])).count("1") <= leaks.RADIUS and not (flat[i : i + 13] == 0).any()}
    at, window, _, _ = index.search(flat, spread)
    assert set(zip(at.tolist(), window.tolist())) == want


def test_leaks_match_brute_force(spark):
    rng = h.rng(4)
    passages = [h.article(rng, 3) for _ in range(6)] + ["bem curta assim", "", None, "..."]
    passages.append(passages[0])
    items = [(i, p) for i, p in enumerate(passages)]
    docs = []
    for i in range(40):
        text = h.article(rng, 3)
        source = words(passages[i % 6])
        start, n = rng.randrange(10), rng.choice([5, 12, 13, 14, 25])
        docs.append((i, text + "\n" + " ".join(source[start : start + n]).upper() + "\n" + h.sentence(rng)))
    docs += [(40, "é BEM, curta assim!"), (41, None), (42, ""), (43, "bem curta")]
    want = set()
    for d, text in docs:
        w = words(text)
        for i, p in items:
            pw = words(p)
            n = min(13, len(pw))
            runs = {tuple(pw[k : k + n]) for k in range(len(pw) - n + 1)} if n else set()
            if any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)):
                want.add((d, i))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, passage string")
    for block in (leaks.BLOCK_CHARS, 300):
        got = leaks.leaks(frame, table, block_chars=block).where("exact_windows > 0")
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert leaks.leaks(frame.limit(0), table).collect() == [] and leaks.leaks(frame, table.limit(0)).collect() == []


@pytest.fixture(scope="module")
def mixed(spark):
    rng = h.rng(8)
    docs = [(i, h.article(rng, rng.randrange(1, 6)), ["big.example", "WWW.Small.example ", "other", None][0 if i % 10 < 7 else i % 10 - 6]) for i in range(400)]
    docs += [(1000 + i, docs[1][1], "big.example") for i in range(200)] + [(2000, None, "big.example"), (2001, "  ", "big.example")]
    targets = [("big.example", 0.6, 1), ("small.example", 0.3, 3), ("none.example", 0.1, 2), (None, 0.5, 1), ("big.example", 0.2, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    return frame, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mix_keeps_caps_and_shares(mixed):
    uses, shares = mixing.mix(*mixed, RANKS)
    rows = {r["source"]: r for r in shares.collect()}
    assert rows["none.example"]["used_tokens"] == 0 and rows["big.example"]["texts"] < 300  # copies are one text
    ratio = rows["big.example"]["used_tokens"] / rows["small.example"]["used_tokens"]
    assert ratio == pytest.approx(2.0, rel=0.03)
    assert sum(r["actual_share"] for r in rows.values()) == pytest.approx(1.0)
    for r in uses.collect():
        assert 1 <= r["uses"] <= rows[r["source"]]["max_repeats"]
    again = {(r["doc_id"], r["uses"]) for r in mixing.mix(*mixed, RANKS)[0].collect()}
    assert again == {(r["doc_id"], r["uses"]) for r in uses.collect()}


def test_mix_with_more_than_there_is_uses_everything(mixed):
    uses, shares = mixing.mix(*mixed, RANKS, total_tokens=10**9)
    assert {r["uses"] for r in uses.where("source = 'small.example'").collect()} == {3}
    empty, none = mixing.mix(mixed[0].limit(0), mixed[1], RANKS)
    assert empty.collect() == [] and {r["used_tokens"] for r in none.collect()} == {0}


def test_weights_make_inclusion_unequal(spark):
    rng = h.rng(5)
    docs = [(i, h.sentence(rng) + str(i), "a.example", 1.0 if i % 2 else 3.0) for i in range(2000)] + [(5000, "sem peso", "a.example", None), (5001, "peso zero", "a.example", 0.0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, weight double")
    targets = spark.createDataFrame([("a.example", 1.0, 2)], "source string, target_share double, max_repeats int")
    for total in (20_000, 90_000):
        uses, shares = mixing.mix(frame, targets, RANKS, total_tokens=total, weight="weight")
        rows = {r["doc_id"]: r for r in uses.collect()}
        row = shares.first()
        assert row["used_tokens"] == pytest.approx(row["planned_tokens"], rel=0.005) and max(r["uses"] for r in rows.values()) <= 2
        heavy, light = (sum(rows[i]["uses"] for i in range(k, 2000, 2) if i in rows) for k in (0, 1))
        assert heavy > light and not {5000, 5001} & set(rows)
        if total == 20_000:
            assert heavy / light == pytest.approx(3.0, rel=0.25)


def test_similarity_does_not_depend_on_the_blocks(spark):
    rng = h.rng(14)
    passages = [h.article(rng, 4) for _ in range(8)]
    stock = "segundo a nota divulgada pela prefeitura nesta semana"
    items = spark.createDataFrame([(i, f"{stock} {p}") for i, p in enumerate(passages)], "item_id long, passage string")
    docs = spark.createDataFrame([(i, h.edited(rng, f"{stock} {passages[i % 8]}", i % 5)) for i in range(40)], "doc_id long, text string")
    whole = sorted(map(tuple, leaks.leaks(docs, items).collect()))
    assert whole and whole == sorted(map(tuple, leaks.leaks(docs, items, block_chars=400).collect()))
