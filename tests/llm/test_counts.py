import random
import unicodedata
from collections import defaultdict

from garimpo.llm import frequencies, repeated_lines
from tests.llm import helpers as h


def test_terms_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["Água", "água", " água ", "rio", "mar", "hot", None, " "]), rng.choice([f"d{i}" for i in range(20)] + [None]), rng.randrange(1, 5)) for _ in range(600)]
    rows += [("hot", f"h{i}", 1) for i in range(300)] + [("um", "d1", None), ("um", "d2", 2), ("raro", "d3", 1)]
    frame = spark.createDataFrame(rows, "term string, url_hash string, tf long")
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in frequencies.marked_terms(frame).collect()}
    largest = defaultdict(dict)
    for term, doc, tf in rows:
        term = unicodedata.normalize("NFC", term).strip().lower() if term else ""
        if term and doc:
            largest[term][doc] = max(largest[term].get(doc, 0), tf or 0)
    n = len({d for _, d, _ in rows if d})
    want = {t: (sum(x.values()), len(x), "rare" if len(x) <= 2 else "common" if len(x) > n / 4 else None) for t, x in largest.items()}
    assert got == want and got["hot"][2] == "common" and got["raro"][2] == "rare"


def test_terms_of_nothing(spark):
    frame = spark.createDataFrame([], "term string, url_hash string, tf long")
    assert frequencies.marked_terms(frame).collect() == []


def test_ngrams_match_brute_force(spark):
    rng = random.Random(5)
    docs = [(f"d{i}", [rng.choice("abc") for _ in range(rng.randrange(0, 12))]) for i in range(30)] + [("n", None), (None, ["a"]), ("x", ["a", None, "b"])]
    frame = spark.createDataFrame(docs, "doc string, tokens array<string>")
    got = {(r["n"], r["ngram"]): (r["occurrences"], r["records"]) for r in frequencies.ngram_counts(frame, "doc", "tokens", 3).collect()}
    count, where = defaultdict(int), defaultdict(set)
    for doc, tokens in docs:
        if doc is None or tokens is None:
            continue
        tokens = [t for t in tokens if t is not None]
        for n in (1, 2, 3):
            for i in range(len(tokens) - n + 1):
                key = (n, " ".join(tokens[i : i + n]))
                count[key] += 1
                where[key].add(doc)
    assert got == {k: (count[k], len(where[k])) for k in count}


def pages(rng):
    rows = []
    for i in range(60):
        host = ["https://www.A.example:80", "http://b.example", "sem host"][i % 3]
        lines = [h.sentence(rng) for _ in range(3)]
        lines += [f"  Copie   o link  {'' if i % 2 else 'x'}"] if i % 3 == 0 else []
        lines += ["Menu"] * 2 if i % 3 < 2 and i < 45 else []
        lines += ["", "\t\r"]
        rng.shuffle(lines)
        rows.append((i, host + ("/x" if i % 3 < 2 else ""), f"u{i // 2}", "\n".join(lines)))
    return rows + [(60, None, "z", "a\nb"), (61, "http://b.example", None, "menu"), (62, "http://b.example", "y", None), (63, "http://b.example", "y", "")]


def test_repeated_lines_match_brute_force(spark):
    rows = pages(h.rng(9))
    frame = spark.createDataFrame(rows, "seq long, url string, url_hash string, body string")
    found = repeated_lines.repeated_lines(frame, "seq", "url", "url_hash", "body", least_docs=5, least_share=0.3)
    got = {tuple(r) for r in found.collect()}
    site = lambda u: "a.example" if u and "A.ex" in u else "b.example" if u and "b.ex" in u else u
    docs, where = defaultdict(set), defaultdict(set)
    for _, u, d, b in rows:
        if d:
            docs[site(u)].add(d)
            for line in (b or "").split("\n"):
                where[site(u), repeated_lines.normal_line(line)].add(d)
    want = set()
    for s, u, _, b in rows:
        for i, line in enumerate((b or "").split("\n")):
            n = len(where[site(u), repeated_lines.normal_line(line)])
            if repeated_lines.normal_line(line) and n >= 5 and n >= 0.3 * len(docs[site(u)]):
                want.add((s, i))
    assert got == want and want
    cut = repeated_lines.without_lines(frame.withColumn("line_no", frame.seq), found, "seq", "body")
    kept = {r["seq"]: r["body"] for r in cut.collect()}
    for s, _, _, b in rows:
        expected = None if b is None else "\n".join(x for i, x in enumerate(b.split("\n")) if (s, i) not in want)
        assert kept[s] == expected


def test_repeated_lines_of_nothing(spark):
    frame = spark.createDataFrame([], "seq long, url string, url_hash string, body string")
    assert repeated_lines.repeated_lines(frame, "seq", "url", "url_hash", "body").collect() == []


def test_spans_are_found_inside_lines_and_across_breaks(spark):
    rng = h.rng(31)
    notice = "Este conteúdo é protegido pela lei de direitos autorais e não pode ser copiado sem autorização por escrito da redação, que responde pelos textos publicados neste endereço e atende o leitor em dias úteis."
    rows, planted = [], {}
    for i in range(60):
        before, after = h.article(rng, 3), h.article(rng, 2)
        if i % 3 == 0:
            text = notice if i % 2 else notice.upper().replace(" ", "\n", 7)
            planted[i] = (len(before) + 1, len(before) + 1 + len(text))
            rows.append((i, "https://a.example/x", f"u{i}", f"{before} {text} {after}"))
        else:
            rows.append((i, "https://a.example/x", f"u{i}", f"{before}\n{after}"))
    rows += [(100, "https://a.example/x", None, notice), (101, None, "n", None), (102, "https://a.example/x", "o", ""), (103, "https://b.example/x", "p", notice)]
    frame = spark.createDataFrame(rows, "seq long, url string, url_hash string, body string")
    spans = repeated_lines.repeated_spans(frame, "seq", "url", "url_hash", "body")
    found = defaultdict(list)
    for r in spans.collect():
        found[r["id"]].append((r["start"], r["stop"]))
    assert set(found) == {*planted, 100}
    for i, (low, high) in planted.items():
        assert all(low <= a < b <= high for a, b in found[i]), (i, found[i], low, high)
        assert sum(b - a for a, b in found[i]) >= 0.6 * (high - low)
    kept = {r["seq"]: r["body"] for r in repeated_lines.without_spans(frame.withColumn("id", frame.seq).withColumn("start", frame.seq), spans, "seq", "body").collect()}
    for i, _, _, body in rows:
        want = body
        for a, b in sorted(found.get(i, []), reverse=True):
            want = want[:a] + want[b:]
        assert kept[i] == want
    assert repeated_lines.repeated_spans(frame.limit(0), "seq", "url", "url_hash", "body").collect() == []
