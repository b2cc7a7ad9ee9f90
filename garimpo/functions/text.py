"""Text analysis: tokens, stop words, a light Portuguese stemmer, previews.

Every function works on columns with built-in expressions; ``analyze`` and
``raw_words`` are the same rules for a query string on the driver.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

RAW = r"\p{L}{3,40}"
TOKEN = r"[\p{L}\p{N}_]+(?:['’.,][\p{L}\p{N}_]+)*"
WORD = r"[\p{L}\p{N}_]+"
#: Frequent function words of Portuguese.
STOP_WORDS = tuple(
    """a à às ao aos aquela aquelas aquele aqueles aquilo as até com como contra da das de dela delas dele deles depois desde do dos
    e é ela elas ele eles em entre era eram essa essas esse esses esta está estão estas este estes eu foi foram há isso isto já lhe
    lhes mais mas me mesmo meu minha muito na não nas nem no nos nossa nosso num numa o os ou para pela pelas pelo pelos por porque
    qual quando que quem se sem ser será seu seus só sobre sua suas também te tem têm teu toda todo todos tu tua um uma umas uns você""".split()
)
ACCENTED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"
#: Endings that the stemmer takes off, from common Portuguese derivation and inflection.
SUFFIXES = tuple(
    """amentos amento imentos imento adoras adora adores ador acoes acao icoes icao ancias ancia encias encia idades idade ismos ismo
    istas ista mente aveis avel iveis ivel osos osas oso osa ivos ivas ivo iva ados adas ado ada idos idas ido ida ando endo indo
    aram eram iram ou ei ar er ir as os es is a o e s""".split()
)


def alternatives(words: set[str]) -> str:
    """A pattern for any of the words, branching by letter, so that a position is
    given up at its first letter."""
    branches = {}
    for word in words - {""}:
        branches.setdefault(word[0], set()).add(word[1:])
    parts = [letter + alternatives(rest) for letter, rest in sorted(branches.items())]
    body = parts[0] if len(parts) == 1 and "" not in words else f"(?:{'|'.join(parts)})" if parts else ""
    return body + "?" if "" in words and parts else body


#: The shortest stem of three letters or more, that is the longest ending, goes first.
STEM = f"^(.{{3,}}?){alternatives(set(SUFFIXES))}$"
MIN_TOKEN, MAX_TOKEN, LEAST_STEMMED = 3, 40, 5


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def folded(column: str) -> str:
    return f"translate({column}, '{ACCENTED}', '{PLAIN}')"


def stem_sql(column: str) -> str:
    """Spark SQL for the stem of a lower-case token: accents folded, then the longest
    ending that leaves three letters taken off tokens of at least five."""
    fold = folded(column)
    return f"if(length({column}) >= {LEAST_STEMMED}, regexp_replace({fold}, {quoted(STEM)}, '$1'), {fold})"


def stem(column: str) -> Column:
    return F.expr(stem_sql(column))


def raw_tokens(column: str) -> Column:
    """Distinct runs of 3 to 40 letters in order; longer words are cut. Null gives null."""
    return F.expr(f"array_distinct(regexp_extract_all(lower({column}), {quoted(RAW)}, 0))")


def stems(column: str) -> Column:
    """Tokens without stop words, stemmed; duplicates and order kept."""
    stop = ", ".join(quoted(w) for w in STOP_WORDS)
    return F.expr(f"transform(filter(regexp_extract_all(lower({column}), {quoted(TOKEN)}, 0), t -> t NOT IN ({stop})), t -> {stem_sql('t')})")


def analyzed_tokens(column: str) -> Column:
    """The index tokens: stems of 3 to 40 characters that are not all digits."""
    return F.filter(stems(column), lambda t: F.length(t).between(MIN_TOKEN, MAX_TOKEN) & ~t.rlike(r"^\p{Nd}+$"))


def word_array(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))


def preview(column: Column, size: int) -> Column:
    return F.when(F.length(column) > size, F.concat(F.substring(column, 1, size), F.lit("..."))).otherwise(column)


def highlight(column: Column, terms: list[str]) -> Column:
    """Case-insensitive marks around the terms; without terms the text stays."""
    if not terms:
        return column
    return F.regexp_replace(column, "(?iu)(" + "|".join(regex.escape(t) for t in terms) + ")", "<mark>$1</mark>")


def analyze(text: str | None) -> list[str]:
    """``analyzed_tokens`` of a string on the driver."""
    table = str.maketrans(ACCENTED, PLAIN)
    found = []
    for token in regex.findall(TOKEN, (text or "").lower()):
        if token in STOP_WORDS:
            continue
        plain = token.translate(table)
        plain = regex.sub(STEM, r"\1", plain) if len(token) >= LEAST_STEMMED else plain
        if MIN_TOKEN <= len(plain) <= MAX_TOKEN and not regex.fullmatch(r"\p{Nd}+", plain):
            found.append(plain)
    return found


def raw_words(text: str | None) -> list[str]:
    """``raw_tokens`` of a string on the driver."""
    return list(dict.fromkeys(regex.findall(RAW, (text or "").lower())))


def term_groups(stemmed: list[str], raw: list[str]) -> list[list[str]]:
    """The i-th stem and the i-th raw word form group i, as sets."""
    pairs = [[*stemmed[i : i + 1], *raw[i : i + 1]] for i in range(max(len(stemmed), len(raw)))]
    return [list(dict.fromkeys(pair)) for pair in pairs]
