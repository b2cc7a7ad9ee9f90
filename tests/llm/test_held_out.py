"""Wordings that the residue models' examples do not hold, and executors that do not
have the package."""

import subprocess
import sys
import textwrap
from pathlib import Path

from garimpo.llm import residue
from tests.llm import helpers as h
from tests.llm.test_models import site

NOTICES = """A rota acessada foi desativada pelo administrador do domínio.
Opa, esta notícia saiu do ar. Procure por outra na busca.
HTTP Status 500 – a exceção impediu o processamento da solicitação.
Erro de execução do servidor: tempo limite esgotado (504).
O acesso a este recurso foi negado pelo administrador.
Detectamos tráfego incomum na sua rede. Marque a caixa para provar que é uma pessoa.
Para visualizar a matéria, permita que o navegador execute JavaScript.
Fatal error: call to undefined function render() in /home/www/pagina.php on line 33.
Navegador incompatível. Instale a versão mais recente do seu navegador.
Ligue os scripts do navegador e carregue novamente a página.
Estamos fora do ar para manutenção do servidor. Tente novamente mais tarde.
Requisição bloqueada por regras de segurança do servidor. Código 1020.
404 – documento não localizado neste servidor.
Sua sessão terminou por inatividade. Faça login de novo para continuar a leitura.
Service temporarily unavailable, please try again in a few minutes.""".split("\n")
FILLERS = """Lorem ipsum dolor sit amet, ut labore consequat nulla pariatur officia mollit.
Texto provisório. Substituir pelo texto final antes de publicar a página.
Duis aute irure dolor in voluptate, cupidatat non proident laborum.
Escreva neste espaço o texto do artigo. Coloque aqui a legenda.
TODO: escrever o texto. TODO: colocar foto e legenda.
Blá blá blá blá, blá blá blá. Blá blá.
Este é um texto de teste para preencher o espaço do artigo.
xxxx xxxxx xxxx xxx xxxx xxxxx. xxxx xx xxx.
asdfasdf qwerty asdf qwer asdfgh asdf.
Insert your text here. This is only sample text to be replaced later.""".split("\n")
#: Articles that speak of such things.
REPORTS = """O portal da prefeitura mostrava a quem procurava o contrato o aviso “404 – documento não localizado neste servidor”, e o secretário não explicou por que a página saiu do ar na semana da licitação.
A auditoria encontrou no edital um trecho de “lorem ipsum dolor sit amet” que a empresa não tinha trocado, e o tribunal pediu que o documento fosse refeito antes da abertura das propostas.
Segundo a equipe de tecnologia, o sistema de consulta não abre em navegadores antigos, e os moradores da cidade que não têm outro aparelho foram atendidos por telefone durante o mês.
A página de transparência do município ficou fora do ar por três dias, e o vereador disse que a manutenção do servidor não foi informada à câmara nem aos moradores da região.""".split("\n")


def test_held_out_wordings(spark):
    rows = [r for r in site(h.rng(21)) if r[0] < 150]
    seeds = (residue.FILLER + residue.NOTICE).lower()
    assert not any(x.lower() in seeds for x in NOTICES + FILLERS)
    bad = {}
    for k, text in enumerate(NOTICES + FILLERS):
        bad[1000 + k] = text
        rows.append((1000 + k, "https://j.example/x", "Página", f"Início\nFale conosco\n{text}\n© 2021 Jornal. Todos os direitos reservados."))
    for k, text in enumerate(REPORTS):
        rows.append((2000 + k, "https://j.example/y", "Página", f"Início\n{rows[k][3]}\n{text}"))
        rows.append((2100 + k, "https://j.example/z", "Página", text))
    frame = spark.createDataFrame(rows, "seq long, url string, title string, body string")
    found = {r["id"] for r in residue.residue_rows(frame, "seq", "title", "body", "url").collect()}
    right = found & set(bad)
    print(len(right), "of", len(bad), [bad[i] for i in set(bad) - right], sorted(found - set(bad)))
    assert len(right) >= 0.9 * len(bad) and len(right) >= 0.9 * len(found)


def test_a_long_page_goes_by_coverage_too(spark):
    rows = [r for r in site(h.rng(22)) if r[0] < 150]
    long = " ".join(NOTICES)
    rows += [(1000, "https://j.example/x", "x", long), (1001, "https://j.example/x", "x", "Início\n" + long + "\nFale conosco"), (1002, "https://j.example/x", "x", rows[0][3] + "\n" + NOTICES[0])]
    frame = spark.createDataFrame(rows, "seq long, url string, title string, body string")
    assert {r["id"] for r in residue.residue_rows(frame, "seq", "title", "body", "url").collect()} == {1000, 1001}


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The driver finds the package on its own path only; the workers do not."""
    code = """
        import sys
        sys.path.insert(0, sys.argv[1])
        import __spark_entry__
        from garimpo.session import local_session
        spark = local_session(cores=4, partitions=4, memory="3g")
        spark.sparkContext.setLogLevel("ERROR")
        for name in "p1_found p2_found p3_ngrams p4_found p5_groups p6_found p7_found p8_mix p9_found keyword_score search_relevance html_extract".split():
            print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
    """
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code), root], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", **{k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}}, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.strip().split("\n")) == 12
