from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from garimpo.functions import text as texts


def rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, t string")


def test_token_guard(spark):
    text = "ab abc " + "x" * 37 + "zzz " + "y" * 41 + " 123 1.000"
    found = rows(spark, [text, None, ""]).select(texts.analyzed_tokens("t")).collect()
    assert found[0][0] == ["abc", "x" * 37 + "zzz", "1.000"]
    assert found[1][0] is None and found[2][0] == []


def test_raw_tokens_cut_long_words_and_drop_repeats(spark):
    word = "".join(chr(97 + i % 26) for i in range(43))
    found = rows(spark, [f"{word} Água água"]).select(texts.raw_tokens("t")).first()[0]
    assert found == [word[:40], word[40:], "água"]


def test_stop_words_are_dropped_before_stemming(spark):
    found = rows(spark, ["As investigações sobre licitação"]).select(texts.analyzed_tokens("t")).first()[0]
    assert found == ["investig", "licit"]


def test_driver_and_column_agree(spark):
    values = ["A Licitação nº 12/2020, de R$ 1.000,00!", "d'água pé-de-moleque", "ÁÉÍ õ ç 42 x_y", "casas casa casinhas"]
    found = [r[0] for r in rows(spark, values).orderBy("id").select(texts.analyzed_tokens("t")).collect()]
    assert found == [texts.analyze(v) for v in values]


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60))
def test_stems_are_never_longer(text):
    assert all(3 <= len(t) <= 40 for t in texts.analyze(text))


def test_term_groups_pair_by_index():
    assert texts.term_groups(["a", "b"], ["x"]) == [["a", "x"], ["b"]]
    assert texts.term_groups(["a"], ["a", "c"]) == [["a"], ["c"]]


def test_preview_and_highlight(spark):
    found = rows(spark, ["a" * 400, "b" * 401, None]).orderBy("id").select(texts.preview(F.col("t"), 400)).collect()
    assert [r[0] for r in found] == ["a" * 400, "b" * 400 + "...", None]
    marked = rows(spark, ["A LICITAÇÃO (x)"]).select(texts.highlight(F.col("t"), ["licitação", "(x)"])).first()[0]
    assert marked == "A <mark>LICITAÇÃO</mark> <mark>(x)</mark>"


def test_stems_by_hand(spark):
    by_hand = {
        "prefeituras": "prefeitur", "operações": "oper", "rapidamente": "rapida", "investigado": "investig", "investigadas": "investig", "cidade": "cidad",
        "público": "public", "câmara": "camar", "lei": "lei", "leis": "leis", "contratos": "contrat", "corruptores": "corruptor", "existência": "exist",
        "notáveis": "not", "capitalismo": "capital", "jornalistas": "jornal", "pagando": "pag", "venderam": "vend", "decidiu": "decidiu", "pão": "pao", "mães": "maes",
    }
    found = spark.createDataFrame(list(by_hand), "string").toDF("t").select("t", texts.stem("t").alias("s")).collect()
    assert {r["t"]: r["s"] for r in found} == by_hand
    assert {w: texts.analyze(w)[0] for w in by_hand if w not in texts.STOP_WORDS} == by_hand
