import json

import numpy as np
from pyspark.sql import functions as F

from garimpo.llm import boilerplate, quality, residue
from tests.llm import helpers as h

COMMON = ["o", "a", "de", "do", "da", "que", "e", "em", "para", "com", "não", "foi"]


def prose(rng, n=4):
    out = []
    for _ in range(n):
        w = [rng.choice(h.VOCABULARY) for _ in range(6)]
        out.append(f"O {w[0]} de {w[1]} informou que a {w[2]} não foi {w[3]} para o {w[4]} da {w[5]}.")
    return " ".join(out)


def test_line_model_on_held_out_texts(spark):
    rng = h.rng(2)
    kinds = {
        "prose": lambda: "\n".join(prose(rng, 2) for _ in range(4)),
        "list": lambda: "\n".join(f"- {rng.choice(h.VOCABULARY)} {rng.choice(h.VOCABULARY)}" for _ in range(20)),
        "table": lambda: "\n".join(f"{rng.choice(h.VOCABULARY)};{rng.randrange(9999)};{rng.randrange(9999)},{rng.randrange(99)}" for _ in range(20)),
        "junk": lambda: "\n".join("if(x>%d){return f(%d);}" % (rng.randrange(9), rng.randrange(99)) for _ in range(20)),
    }
    rows = [(i, kinds[k](), k) for i, k in enumerate(list(kinds) * 30)]
    rows += [(500, None, ""), (501, " \n ", ""), (502, prose(rng, 3000), "prose"), (503, prose(rng, 8) + "\n- um\n- dois", "prose")]
    frame = spark.createDataFrame(rows, "id long, text string, words string")
    common = spark.createDataFrame([(w,) for w in COMMON] + [(None,)], "word string")
    found = {r["id"]: r for r in quality.text_statistics(frame, "id", "text", common).collect()}
    assert len(found) == len(rows)
    for i, text, kind in rows:
        if kind:
            assert (found[i]["prose_share"] >= 0.5) == (kind == "prose"), (kind, text[:80], found[i])
    assert found[500]["words"] == 0 and found[501]["prose_share"] is None
    assert {r["id"] for r in quality.no_prose(spark.createDataFrame(list(found.values()), quality.SCHEMA)).collect()} == {i for i, _, k in rows if k not in ("prose", "")}
    one = found[0]
    words = [w for w in h.words(rows[0][1])]
    assert one["words"] == len(words) and abs(one["mean_word_length"] - np.mean([len(w) for w in words])) < 1e-9
    assert one["line_end_share"] == 1.0 and abs(one["common_share"] - sum(w in {h.words(c)[0] for c in COMMON} for w in words) / len(words)) < 1e-9
    assert quality.text_statistics(frame.limit(0), "id", "text", common).collect() == []


def site(rng):
    menus = ["Início", "Fale conosco", "Pular para o conteúdo principal", "© 2021 Jornal. Todos os direitos reservados."]
    rows = []
    for i in range(150):
        lines = [prose(rng, 2) for _ in range(3)]
        title = f"Entenda a {rng.choice(h.VOCABULARY)} que {rng.choice(h.VOCABULARY)} o {rng.choice(h.VOCABULARY)}"
        teaser = f"{i % 4} Entenda a {rng.choice(h.VOCABULARY)} que {rng.choice(h.VOCABULARY)} o {rng.choice(h.VOCABULARY)}"
        body = [menus[0], menus[1 + i % 2], lines[0], f"Próximos passos em {rng.choice(h.VOCABULARY).capitalize()}", lines[1], lines[2], teaser, menus[3]]
        rows.append((i, "https://j.example/1", title, "\n".join(body)))
    bad = [
        ("Erro 404", "Início\nErro 404. A página que você procura não existe ou foi removida."),
        ("x", "Ative o JavaScript no seu navegador para continuar."),
        ("x", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod."),
        ("{{titulo}}", rows[0][3]),
        ("x", rows[1][3] + "\nPor ${autor}"),
    ]
    good = [("x", rows[2][3] + "\nNo código, a variável ${valor} era trocada."), ("x", rows[3][3] + "\nO portal exibia “Erro 404. Página não encontrada” a quem buscava o contrato."), ("x", None), ("x", ""), (None, rows[4][3])]
    for k, (t, b) in enumerate(bad):
        rows.append((200 + k, "https://j.example/2", t, b))
    for k, (t, b) in enumerate(good):
        rows.append((300 + k, None, t, b))
    return rows


def test_residue_and_boilerplate(spark):
    rows = site(h.rng(6))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "seq long, url string, title string, body string, id string")
    found = {r["id"] for r in residue.residue_rows(frame, "seq", "title", "body").collect()}
    assert found == {200, 201, 202, 203, 204}
    cut = {(r["id"], r["line_no"]) for r in boilerplate.boilerplate_lines(frame, "seq", "url", "title", "body").collect()}
    assert {n for s, n in cut if s < 150} == {0, 1, 6, 7} and len([1 for s, _ in cut if s < 150]) == 600
    assert not [1 for s, _ in cut if s in (200, 201, 202, 302, 303)]
    empty = frame.limit(0)
    assert residue.residue_rows(empty, "seq", "title", "body").collect() == []
    assert boilerplate.boilerplate_lines(empty, "seq", "url", "title", "body").collect() == []


def test_edited_copies_make_no_house_lines(spark):
    rng = h.rng(9)
    rows = [r for r in site(rng) if r[0] < 150]
    base = [prose(rng, 2) for _ in range(8)]
    for k in range(75):  # a third of the site
        lines = list(base)
        for at in rng.sample(range(8), 3):
            parts = lines[at].split(" ")
            parts[1 + rng.randrange(len(parts) - 2)] = rng.choice(h.VOCABULARY)
            lines[at] = " ".join(parts)
        rows.append((1000 + k, "https://j.example/1", "Outra", "\n".join(["Início", "Fale conosco", *lines, "© 2021 Jornal. Todos os direitos reservados."])))
    frame = spark.createDataFrame(rows, "seq long, url string, title string, body string")
    cut = {(r["id"], r["line_no"]) for r in boilerplate.boilerplate_lines(frame, "seq", "url", "title", "body").collect()}
    assert {(s, n) for s, n in cut if s >= 1000} == {(1000 + k, n) for k in range(75) for n in (0, 1, 10)}
    assert {n for s, n in cut if s < 150} == {0, 1, 6, 7}


def test_viterbi_matches_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    model = quality.LineModel(np.zeros(0, np.uint64))
    model.start, model.move = np.log(rng.dirichlet(np.ones(4))), np.log(rng.dirichlet(np.ones(4), 4))
    counts = np.array([3, 0, 5, 1])
    scores = rng.normal(size=(counts.sum(), 4))
    got, base = model.label(scores, counts), 0
    for n in counts.tolist():
        if n:
            part = scores[base : base + n]
            best = max(product(range(4), repeat=n), key=lambda p: model.start[p[0]] + sum(part[i, s] for i, s in enumerate(p)) + sum(model.move[a, b] for a, b in zip(p, p[1:])))
            assert json.dumps(got[base : base + n].tolist()) == json.dumps(list(best))
        base += n


def outside_the_first_rows(spark):
    """A table of more than 4,000 rows in which two wordings of prose stand in one row
    each: a page of more than 20,000 characters, and the page whose hashed id is last.
    Two short pages in these wordings end with a notice."""
    rng = h.rng(12)
    menus = [" | ".join(rng.choice(h.VOCABULARY).capitalize() for _ in range(6)) for _ in range(40)]
    rows = [r for r in site(rng) if r[0] < 150] + [(i, "https://j.example/3", "x", f"{menus[i % 40]}\n{prose(rng, 1)}") for i in range(1000, 5400)]
    last = spark.createDataFrame([(r[0],) for r in rows], "seq long").orderBy(F.xxhash64("seq").desc()).first()["seq"]
    bodies = {}
    for k, syllables in enumerate((("wyk", "zvo", "xqu", "pwy"), ("kjø", "þry", "gwæ", "hßu"))):
        words = [a + b for a in syllables for b in syllables]

        def said(n):
            return " ".join(f"O {rng.choice(words)} de {rng.choice(words)} não foi {rng.choice(words)}." if n == 1 else f"O {rng.choice(words)} de {rng.choice(words)} não foi {rng.choice(words)}, e a {rng.choice(words)} da {rng.choice(words)} foi {rng.choice(words)} para o {rng.choice(words)}." for _ in range(n))

        bodies[k] = "\n".join(said(3) for _ in range(130))
        rows.append((9000 + k, "https://j.example/4", "x", "\n".join(["Início", "Fale conosco", *(said(1) for _ in range(5)), "O conteúdo solicitado não está mais disponível."])))
    assert len(bodies[0]) > 20_000
    rows = [(s, u, t, bodies[1][:18_000] if s == last else b) for s, u, t, b in rows] + [(8000, "https://j.example/5", "x", bodies[0])]
    return spark.createDataFrame(rows, "seq long, url string, title string, body string")


def test_models_are_fitted_to_all_rows_and_whole_texts(spark):
    pages = outside_the_first_rows(spark)
    found = {r["id"]: r for r in residue.judged(pages, "seq", "title", "body", "url")[2].collect()}
    assert found[9000]["prose_chars"] > 60 and found[9001]["prose_chars"] > 60
    assert not {r["id"] for r in residue.residue_rows(pages, "seq", "title", "body", "url").collect()} & {9000, 9001}
    same = [residue.fit(part, "body").ratio for part in (pages.coalesce(1), pages.repartition(7, "seq"))]
    assert (same[0] == same[1]).all()


def test_a_page_in_a_wording_of_one_other_row_keeps_its_article(spark):
    cut = {(r["id"], r["line_no"]) for r in boilerplate.boilerplate_lines(outside_the_first_rows(spark), "seq", "url", "title", "body").collect()}
    assert {(9000, 0), (9000, 1), (9001, 0), (9001, 1)} <= cut and not [n for s, n in cut if s >= 9000 and 2 <= n < 7]
