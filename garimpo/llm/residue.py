"""Template residue and error-page text (problem 2).

Method: character n-gram models of natural prose, page furniture, filler, error
notices and unfilled slots. Every position of a text gets the log-likelihood ratio
of each class against prose; means over a window localise residue, and a text goes
by the share of its prose-or-residue characters that residue covers. Slots are
localised by a short window and then checked against the placeholder notations.
A text that holds both residue and prose is measured without the lines of the page
around it, which are counted over all rows (``house``).

The prose and furniture models are fitted to all rows and whole texts; filler,
notices and slots start from the example wordings below and take up, once, what the
texts without any prose hold. The counts are exact sums over the tasks, brought to
the weight of FIT_ROWS rows, so that the models do not depend on the table's size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions import url as urls
from garimpo.llm.batches import fold, pieces, single_blanks
from garimpo.llm.house import FUNCTION_WORDS, house_lines, key, line_key, running_text, sketches
from garimpo.llm.shared import Shared
from garimpo.session import discard, written

# Example wordings: text of our own that shows what each class looks like.
FILLER = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor
in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident
sunt in culpa qui officia deserunt mollit anim id est laborum vivamus sagittis lacus vel augue laoreet rutrum faucibus
isto é um texto de exemplo. este texto é provisório e deve ser trocado pelo definitivo
escreva aqui. escreva seu texto neste espaço. coloque aqui o conteúdo. digite o título. cole o texto aqui
espaço reservado para o texto. espaço reservado para a foto. espaço para o subtítulo. nome do autor. título do artigo
legenda da imagem. descrição da imagem. subtítulo do artigo. resumo do artigo. conteúdo provisório, não publicar
rascunho: substituir antes da publicação. remover este bloco. modelo de página, preencher os campos
em construção. página em construção. em breve novidades. conteúdo em breve
TODO: completar. TODO: revisar texto. FIXME. TBD. a definir. a preencher
teste. texto de teste. testando 1 2 3. post de teste. isto é só um teste
blá blá blá. bla bla bla bla. blablablá
asdf asdf asdfasdf. qwerty qwertyuiop. zxcv. xxxxx xxxx. aaaa bbbb cccc. abc abc abc
your text here. insert text here. placeholder text. sample text to be replaced. this is dummy text. hello world
texto de relleno. escriba aquí su texto. contenido de ejemplo. texto de prueba"""
NOTICE = """erro 404. página não encontrada. não foi possível encontrar a página solicitada. o conteúdo solicitado não está mais disponível
o endereço digitado não existe. confira o link ou volte para a página inicial. o artigo foi removido ou mudou de endereço
desculpe, não encontramos o que você procura. ops, ocorreu um erro. algo deu errado, tente novamente em alguns minutos
404 not found. 500 internal server error. 502 bad gateway. 503 service unavailable. 504 gateway timeout. 403 forbidden. 410 gone
nginx/1.18.0. apache/2.4.41 server at localhost port 80. openresty. iis detailed error
serviço indisponível no momento. o servidor não respondeu. o site está temporariamente fora do ar. erro interno do servidor
site em manutenção. estamos fazendo manutenção, volte mais tarde. manutenção programada, retornaremos em poucos minutos
falha na conexão com o banco de dados. error establishing a database connection. código do erro: 1045
traceback (most recent call last): file main.py line 10. exception in thread main java.lang.nullpointerexception at app.page.render(page.java:10)
warning: include(header.php): failed to open stream: no such file or directory in /var/www/html/index.php on line 10. fatal error: uncaught exception
undefined variable in template. stack trace: at object.render. erro na linha 10 do arquivo. syntax error, unexpected token
acesso negado. você não tem permissão para acessar esta página. access denied. you don't have permission to view this resource
acesso bloqueado por motivos de segurança. sua solicitação foi bloqueada. bloqueado pelo firewall. identificador da requisição 00. ray id: 00
limite de solicitações excedido. muitas requisições em pouco tempo, aguarde e tente de novo. too many requests. rate limit exceeded
prove que você não é um robô. confirme que é humano. seu endereço ip 0.0.0.0 foi registrado. verificação de segurança. resolva o captcha
checking your browser before accessing. verificando seu navegador. aguarde enquanto verificamos a conexão
sua sessão expirou. entre novamente. faça login para continuar. conteúdo exclusivo para assinantes cadastrados
esta página precisa de JavaScript. é necessário habilitar o JavaScript para ver este conteúdo. ative os scripts do navegador e atualize a página
o javascript está desativado no seu navegador. habilite scripts e cookies para continuar
you need to enable JavaScript to run this app. please enable JavaScript and cookies to continue. noscript
seu navegador está desatualizado ou não é compatível. use um navegador mais recente. navegador sem suporte, atualize-o
your browser is not supported. please upgrade your browser. this site requires scripts
página no encontrada. acceso denegado. servicio no disponible. active JavaScript para continuar"""
SLOT_NAMES = "titulo title texto text nome name autor author corpo body resumo legenda editoria chapeu subtitulo valor valor_total usuario.nome item.descricao noticia.texto post.title page.body data_publicacao descricao"
SLOT_FORMS = ["{{%s}}", "{{ %s }}", "{{%s|default('')}}", "${%s}", "#{%s}", "{%s}", "{0}", "[[%s]]", "[inserir %s aqui]", "<%%= %s %%>", "{%% block %s %%}{%% endblock %%}", "%%%%%s%%%%", "@@%s@@", "__%s__", "[%s]", "&lt;%s&gt;", "undefined", "[object Object]", "%%(%s)s"]
#: The placeholder notations, for the check that follows the windows.
SLOT = re.compile(
    r"\{\{[^{}\n]{1,80}\}\}|[$#]\{[^{}\n]{1,60}\}|\{%[^%\n]{1,60}%\}|<%[^%\n]{1,60}%>|%%[A-Za-z_.]{2,40}%%|@@[A-Za-z_.]{2,40}@@"
    r"|__[A-Z][A-Z_]{1,40}__|\[\[[^\[\]\n]{1,60}\]\]|\[(?:inserir|insira|inserte|insert)\s[^\]\n]{1,40}\]|\[[A-Z]{2,}(?:_[A-Z]+)*\]"
    r"|(?<![\w$#{])\{(?:\d|[a-z_]+(?:\.[a-z_]+)*)\}|&lt;[a-z_.]{2,40}&gt;|%\([a-z_.]+\)s|\[object Object\]|(?<![\w“\"'])undefined(?![\w”\"'])"
)
#: What every notation but the bare word begins with.
SLOT_HEADS = np.isin(np.arange(128), [ord(c) for c in "{$#<%@_[&"])
#: Words that speak about a slot: text after them reports it.
MENTION = re.compile(r"(?:vari[aá]ve(?:l|is)|express(?:ão|ao|ões)|marcador(?:es)?|campos?|c[oó]digo|sintaxe|termos?|palavras?|trechos?|s[ií]mbolos?|placeholders?|variables?|expressions?|expresi[oó]n|se l[eê]|lia-se)\W{1,3}$", re.I)

QUOTED = re.compile("“[^”\n]{2,300}”")

PROSE, FURNITURE, FILL, NOTE, SLOTS = range(5)
ORDER, TABLE_BITS = 4, 18
#: Counts of larger tables are scaled to so many rows, so that STRENGTH and the example
#: wordings keep their part in the models.
FIT_ROWS = 4000
#: Furniture: a line in so many pages with prose and in this share of all rows. There
#: are at most 1 / FURNITURE_SHARE * (mean lines of a page) of them.
FURNITURE_PAGES, FURNITURE_SHARE = 4, 0.001
WINDOW, SLOT_WINDOW, SLOT_REACH = 32, 8, 90  # in characters
STRENGTH = 3000.0  # weight of the common background in a class model
CLIP, SCALE = 4.0, 256
COVERAGE, LEAST_CHARS = 0.6, 3
PROSE_CHARS = 70  # a shorter line is no prose


def char_table() -> np.ndarray:
    """Code point to folded character: letters without accents in lower case, any
    digit as 0, any white space as a blank."""
    out = np.zeros(0x10000, np.uint32)
    for point in range(0x10000):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        low = fold(char)
        out[point] = 48 if char.isdigit() else 32 if char.isspace() else ord(low) if len(low) == 1 else point
    return out


def grams(text: str, table: np.ndarray) -> np.ndarray:
    """Hash of the ORDER characters that end at each position."""
    return grams_of(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), table)


def grams_of(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    code = table[np.minimum(points, 0xFFFF)]
    code = np.concatenate([np.full(ORDER - 1, 32, np.uint32), code])
    n = len(points)
    h = np.zeros(n, np.uint32)
    for k in range(ORDER):
        h = (h ^ code[k : k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - TABLE_BITS)).astype(np.intp)


class Residue:
    """The fitted models: ``ratio[k]`` is the log-likelihood ratio of class k to
    prose, in SCALE-ths, so that sums over windows are exact integers."""

    def __init__(self, counts: np.ndarray) -> None:
        background = counts.sum(axis=0) + 0.5
        background /= background.sum()
        log = [np.log((c + STRENGTH * background) / (c.sum() + STRENGTH)) for c in counts]
        self.ratio = np.stack([np.rint(np.clip(x - log[PROSE], -CLIP, CLIP) * SCALE) for x in log]).astype(np.int32)
        self.table = char_table()

    @staticmethod
    def _sums(values: np.ndarray, width: int) -> np.ndarray:
        """Sum of the ``width`` values about each position but the last ones."""
        total = np.zeros(len(values) + 1, np.int32)
        np.cumsum(values, out=total[1:])
        out = np.zeros(len(values), np.int32)
        out[width // 2 : len(values) - width // 2 + 1] = total[width:] - total[:-width]
        return out

    @staticmethod
    def _joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The texts with blanks about each, their code points, where each begins and ends."""
        pad = " " * WINDOW
        joined = pad + pad.join([*texts, ""])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + WINDOW) - sizes
        return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts, starts + sizes

    def measure(self, texts: list[str], slots: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(residue characters, prose characters, open slots) of each text, the last
        if asked for. Text in quotation marks is no residue: it reports what it quotes."""
        joined, points, starts, ends = self._joined(texts)
        h = grams_of(points, self.table)
        house, filler, note = (self._sums(self.ratio[k].take(h), WINDOW) for k in (FURNITURE, FILL, NOTE))
        visible = points > 32
        both = np.maximum(filler, note)
        speaks = both > 0
        residue = visible & speaks & (both > house)
        prose = visible & ~speaks & (house <= -WINDOW * SCALE // 2)
        for match in QUOTED.finditer(joined):
            residue[match.start() : match.end()] = False
        total = np.zeros((2, len(points) + 1), np.int32)
        np.cumsum(residue, out=total[0, 1:])
        np.cumsum(prose, out=total[1, 1:])
        counts = (total[:, ends] - total[:, starts]).astype(np.int64)
        return counts[0], counts[1], self._open(joined, points, h, starts) if slots else None

    def open_slots(self, texts: list[str]) -> np.ndarray:
        """Whether each text holds an open slot."""
        joined, points, starts, _ = self._joined(texts)
        return self._open(joined, points, grams_of(points, self.table), starts)

    def _open(self, joined: str, points: np.ndarray, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        slots = np.zeros(len(starts), bool)
        for low, high in self._slots(joined, points, h):
            before, after = joined[max(0, low - 40) : low], joined[high : high + 40]
            quoted = (before.rfind("“") > before.rfind("”")) or (before.endswith(('"', "'", "‘", "«")) and after[:1] in "\"'’»")
            if not quoted and not MENTION.search(before):
                slots[np.searchsorted(starts, low, side="right") - 1] = True
        return slots

    def _slots(self, joined: str, points: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """Spans in a placeholder notation at positions whose window speaks for a slot.
        Notations are looked for only where a character of SLOT_HEADS or the bare word stands."""
        heads, at = np.flatnonzero(SLOT_HEADS[np.minimum(points, 127)]), joined.find("undefined")
        bare = []
        while at >= 0:
            bare.append(at)
            at = joined.find("undefined", at + 1)
        if bare:
            heads = np.sort(np.concatenate([heads, bare]))
        if not len(heads):
            return
        hot = np.flatnonzero(self._sums(self.ratio[SLOTS].take(h), SLOT_WINDOW) > 0)
        if not len(hot):
            return
        parts = np.flatnonzero(np.diff(hot) > SLOT_REACH)
        firsts, lasts = hot[np.concatenate([[0], parts + 1])], hot[np.append(parts, len(hot) - 1)]
        begin, end = np.searchsorted(heads, firsts - SLOT_REACH), np.searchsorted(heads, lasts + SLOT_REACH)
        done = 0
        for k in np.flatnonzero(begin < end).tolist():
            first, last = int(firsts[k]), int(lasts[k])
            at, stop = max(done, first - SLOT_REACH), min(len(joined), last + SLOT_REACH)
            for head in heads[begin[k] : end[k]].tolist():
                if head >= at and (match := SLOT.match(joined, head, stop)):
                    low, at = match.span()
                    if at + SLOT_WINDOW >= first and low - 1 <= last:
                        done = at
                        yield low, at


def is_prose(line: str) -> bool:
    """A long line that ends as a sentence and in which function words are frequent."""
    if len(line) < PROSE_CHARS or line[-1] not in ".!?":
        return False
    found = line.lower().split()
    return sum(map(FUNCTION_WORDS.__contains__, found)) >= 0.2 * len(found)


def _without_digits(line: str) -> str:
    return re.sub(r"\d", "0", line).lower()


#: Kinds of rows that the passes of ``fit`` count.
PAGES, GRAM, LINE = range(3)
COUNTS = "kind int, gram int, line string, n long"


def _counts(rows: list[tuple[int, np.ndarray | None, list[str] | None, np.ndarray]]) -> pa.RecordBatch:
    kinds = [pa.array(np.full(len(n), kind, np.int32)) for kind, _, _, n in rows]
    grams_ = [pa.array(g.astype(np.int32)) if g is not None else pa.nulls(len(n), pa.int32()) for _, g, _, n in rows]
    lines = [pa.array(x, pa.string()) if x is not None else pa.nulls(len(n), pa.string()) for _, _, x, n in rows]
    numbers = [pa.array(n.astype(np.int64)) for *_, n in rows]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in (kinds, grams_, lines, numbers)], ["kind", "gram", "line", "n"])


def _grams_of_pages(pages: list[str], table: np.ndarray) -> np.ndarray:
    """How often each gram stands in the pages; none reaches from one page to the next."""
    gap = "\n" * (ORDER - 1)
    return np.bincount(grams(gap.join([*pages, ""]), table), minlength=1 << TABLE_BITS)


def _prose_and_lines(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """(text) to the numbers of rows, of grams of prose, and of pages with prose that
    hold a line that is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages, prose, lines = 0, np.zeros(1 << TABLE_BITS, np.int64), Counter()
        for batch in batches:
            for _, piece in pieces(batch.column(0).to_pylist(), 500_000):
                pages += len(piece)
                own = []
                for text in piece:
                    page = [line for x in text.split("\n") if (line := single_blanks(x))]
                    running = [x for x in page if is_prose(x)]
                    if running:
                        own.append("\n".join(running))
                        lines.update(set(page).difference(running))
                if own:
                    prose += _grams_of_pages(own, table)
            if len(lines) > 100_000:
                yield _counts([(LINE, None, [_without_digits(x) for x in lines], np.fromiter(lines.values(), np.int64))])
                lines.clear()
        used = np.flatnonzero(prose)
        yield _counts([(PAGES, None, None, np.array([pages])), (GRAM, used, None, prose[used]), (LINE, None, [_without_digits(x) for x in lines], np.fromiter(lines.values(), np.int64))])

    return texts.mapInArrow(run, COUNTS)


def _without_prose(texts: DataFrame, shared: Shared, table: np.ndarray) -> DataFrame:
    """(text) to the numbers of grams in the texts without any prose, apart from the
    lines of furniture, by the class they resemble."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, furniture = shared.get()
        found = {FILL: np.zeros(1 << TABLE_BITS, np.int64), NOTE: np.zeros(1 << TABLE_BITS, np.int64)}
        known: dict[str, int | None] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                page = text.split("\n")
                if any(is_prose(single_blanks(x)) for x in page if len(x) >= PROSE_CHARS):
                    continue
                body = " ".join(line for x in page if (line := single_blanks(x)) and _without_digits(line) not in furniture)
                if not body:
                    continue
                if body not in known:
                    if len(known) > 10_000:
                        known.clear()
                    at = grams(body, table)
                    means = [float(model.ratio[k][at].mean()) / SCALE for k in (FURNITURE, FILL, NOTE, SLOTS)]
                    best = int(np.argmax(means))
                    known[body] = best + 1 if best in (1, 2) and means[best] > 0.5 else None
                if known[body] is not None:
                    np.add.at(found[known[body]], grams(body + "\n", table), 1)
        for kind, n in found.items():
            used = np.flatnonzero(n)
            yield _counts([(kind, used, None, n[used])])

    return texts.mapInArrow(run, COUNTS)


def fit(docs: DataFrame, text: str) -> Residue:
    """Fit the models to all rows. Only counts reach the driver: of grams, at most
    2 ** TABLE_BITS of a class, and of the lines of furniture."""
    table, size = char_table(), 1 << TABLE_BITS
    texts = docs.where(F.length(text) > 0).select(text)

    def count(lines: list[str]) -> np.ndarray:
        return np.bincount(grams("\n".join(lines) + "\n", table), minlength=size).astype(float) if lines else np.zeros(size)

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("kind", "gram", "line").agg(F.sum("n").alias("n"))

    def tables(rows: DataFrame, kind: int) -> np.ndarray:
        out, found = np.zeros(size), rows.where(F.col("kind") == kind).select("gram", "n").toArrow()
        out[found["gram"].to_numpy()] = found["n"].to_numpy()
        return out

    first = written(summed(_prose_and_lines(texts, table)), "fit-counts")
    n = first.where(F.col("kind") == PAGES).agg(F.sum("n").alias("n")).first()["n"] or 0
    scale = min(1.0, FIT_ROWS / max(1, n))
    least = max(FURNITURE_PAGES, FURNITURE_SHARE * n)
    furniture = sorted(r["line"] for r in first.where((F.col("kind") == LINE) & (F.col("n") >= least)).select("line").collect())
    names = SLOT_NAMES.split()
    slots = [form % tuple([name if i % 2 else name.upper()] * form.replace("%%", "").count("%s")) for form in SLOT_FORMS for i, name in enumerate(names)]
    counts = np.stack([scale * tables(first, GRAM), 3.0 * count(furniture), 3.0 * count(FILLER.split("\n")), 3.0 * count(NOTICE.split("\n")), count(slots)])
    # what texts without any prose hold, apart from furniture, joins the class it resembles
    shared = Shared(docs.sparkSession, (Residue(counts), frozenset(furniture)))
    more = written(summed(_without_prose(texts, shared, table)), "fit-more")
    for k in (FILL, NOTE):
        counts[k] += scale * tables(more, k)
    shared.drop()
    discard(first)
    discard(more)
    return Residue(counts)


class LineFeatures:
    """What a caller wants to know of every line, from one function of the line."""

    def __init__(self, schema: str, types: list[pa.DataType], function: Callable[[], Callable[[str, bool], tuple]]) -> None:
        self.schema, self.types, self.function = schema, types, function
        self.names = [part.split(":")[0] for part in schema.split(", ")]


PAGE = "row long, id long, site long, own long, residue int, prose int, slot boolean, bands array<long>, sketch binary, lines array<long>, text string"


def scored_pages(docs: DataFrame, model: Shared, features: LineFeatures | None = None) -> DataFrame:
    """(row, id, site, title, body) to one row per page: residue and prose characters
    of the body, open slots in title or body, what ``house_lines`` reads, and the
    ``features`` of each line, if asked for. The text stays with the pages that hold
    both residue and prose."""
    schema = PAGE + (f", features array<struct<line_no: int, {features.schema}>>" if features else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        residue_of = model.get()
        more = features.function() if features else lambda line, running: ()
        known: dict[str, tuple] = {}
        for batch in batches:
            titles = batch.column(3).to_pylist()
            for first, piece in pieces(batch.column(4).to_pylist(), 500_000):
                residue, prose, slot = residue_of.measure(piece)
                slot |= residue_of.open_slots([t or "" for t in titles[first : first + len(piece)]])
                own, runs, numbers, flat, bounds = [], [], [], [], [0]
                for text in piece:
                    running, longest = [], ""
                    for number, line in enumerate(text.split("\n")):
                        line = single_blanks(line)
                        if not line:
                            continue
                        if len(line) > len(longest):
                            longest = line
                        found = known.get(line)
                        if found is None:
                            if len(known) > 100_000:
                                known.clear()
                            low = line.lower()
                            is_running = running_text(line, low)
                            found = known[line] = (line_key(low), is_running, *more(line, is_running))
                        numbers.append(number)
                        flat.append(found)
                        if found[1]:
                            running.append(line)
                    runs.append("\n".join(running))
                    own.append(key(runs[-1] or longest))
                    bounds.append(len(flat))
                registers, bands = sketches(runs)
                without = [not r for r in runs]
                both = (residue >= LEAST_CHARS) & (prose > 0)
                offsets = pa.array(bounds, pa.int32())
                columns = list(zip(*flat)) or [[]] * (2 + (len(features.types) if features else 0))
                arrays = [
                    *(batch.column(k).slice(first, len(piece)) for k in range(3)),
                    pa.array(own, pa.int64()),
                    pa.array(residue.astype(np.int32)),
                    pa.array(prose.astype(np.int32)),
                    pa.array(slot),
                    pa.array([None if no else b for b, no in zip(bands.tolist(), without)], pa.list_(pa.int64())),
                    pa.array([None if no else r.tobytes() for r, no in zip(registers, without)], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(columns[0], pa.int64())),
                    pa.array([t if b else None for t, b in zip(piece, both)], pa.string()),
                ]
                if features:
                    parts = [pa.array(numbers, pa.int32()), *(pa.array(c, t) for c, t in zip(columns[2:], features.types))]
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, ["line_no", *features.names])))
                yield pa.RecordBatch.from_arrays(arrays, [p.split()[0] for p in PAGE.split(", ")] + ["features"] * bool(features))

    return docs.select("row", "id", "site", "title", "body").mapInArrow(run, schema)


def judged(docs: DataFrame, id_col: str, title: str, body: str, url: str | None = None, *, features: LineFeatures | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, gone, verdicts): the written ``scored_pages``; (row, gone) with the places
    in ``lines`` of a page's lines of the house, if it has any; and (row, id,
    residue_chars, prose_chars, slot) of every page, where a page that holds both
    residue and prose was measured again without the lines of the house.
    Without ``url`` all rows are one site."""
    model = Shared(docs.sparkSession, fit(docs, body))  # five tables of 2 ** TABLE_BITS ratios
    site = F.xxhash64(urls.domain(F.col(url))) if url else F.lit(0).cast("long")
    source = docs.where(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), site.alias("site"), F.col(title).alias("title"), F.col(body).alias("body"))
    pages = written(scored_pages(source, model, features), "pages")
    house = house_lines(pages)
    mixed = (F.col("residue") >= LEAST_CHARS) & (F.col("prose") > 0)
    open_ = pages.where(mixed)
    placed = pages.select("row", "site", F.posexplode("lines").alias("place", "line"))
    gone = written(placed.join(house, ["site", "line"], "left_semi").groupBy("row").agg(F.collect_list("place").alias("gone")), "gone")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        residue_of = model.get()
        for batch in batches:
            cut = batch.column("gone").to_pylist()
            for first, piece in pieces(batch.column("text").to_pylist(), 500_000):
                own = []
                for text, out in zip(piece, cut[first : first + len(piece)]):
                    lines = [line for x in text.split("\n") if (line := single_blanks(x))]
                    out = set(out or ())
                    own.append("\n".join(x for i, x in enumerate(lines) if i not in out))
                residue, prose, _ = residue_of.measure(own, slots=False)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, len(piece)), batch.column("id").slice(first, len(piece)), pa.array(residue), pa.array(prose), batch.column("slot").slice(first, len(piece))], ["row", "id", "residue_chars", "prose_chars", "slot"])

    second = open_.select("row", "id", "text", "slot").join(gone, "row", "left").mapInArrow(again, "row long, id long, residue_chars long, prose_chars long, slot boolean")
    plain = pages.where(~mixed).select("row", "id", F.col("residue").cast("long").alias("residue_chars"), F.col("prose").cast("long").alias("prose_chars"), "slot")
    return pages, gone, plain.union(second)


def without_article() -> Column:
    """``no_article`` of the verdicts' columns."""
    residue, prose = F.col("residue_chars"), F.col("prose_chars")
    return (residue >= LEAST_CHARS) & (residue >= COVERAGE * (residue + prose))


def residue_rows(docs: DataFrame, id_col: str, title: str, body: str, url: str | None = None) -> DataFrame:
    """(id, residue_chars, prose_chars, slot) of the rows to exclude: an open slot in
    title or body, or a body covered by residue.

    Null titles and bodies count as empty; an empty or blank body is no residue but
    its title may hold a slot. Rows with a null id are left out; rows that repeat an
    id are judged each. ``url`` names the column whose site's repeated lines are left
    out of the measure; a null URL is a site of its own, and without the column all
    rows are one site."""
    verdicts = judged(docs, id_col, title, body, url)[2]
    return verdicts.where(F.col("slot") | without_article()).drop("row")
