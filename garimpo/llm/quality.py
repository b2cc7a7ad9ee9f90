"""Per-document text quality statistics (problem 9).

Method: each line is labelled prose, list, table or junk by a hidden Markov model
over discretised line statistics (share of function words, symbols, digits, words,
word length, separators, repeats ...); the labels' shares of the characters tell
natural prose from the rest. Lines longer than SEGMENT characters are labelled by
segments, so a text without line breaks is judged by the same evidence.

The model is fitted to a bounded sample of SAMPLE_ROWS texts: lines with one clear
statistic seed the four labels; from then on Viterbi training labels all lines,
the seeds too, so the model can turn against a rule that started it. A seed's first
label stays as one more piece of evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.batches import Hasher, fold, hasher, pieces
from garimpo.llm.samples import sampled
from garimpo.llm.shared import Shared

PROSE, LIST, TABLE, JUNK = range(4)
#: A longer list of common words is refused; 8 bytes of each go to every task.
MOST_WORDS = 2_000_000
SEGMENT, SAMPLE_ROWS, SAMPLE_CHARS, ROUNDS = 240, 3000, 20_000, 4
#: Upper bounds of the bins of each statistic; shares are of words or of visible characters.
BINS = {
    "common": [0.02, 0.08, 0.14, 0.2, 0.26, 0.32, 0.4],
    "symbols": [0.005, 0.03, 0.08, 0.15, 0.3],
    "digits": [0.005, 0.04, 0.1, 0.2, 0.4],
    "ends": [0.5, 1.5],  # neither, a digit, the end of a sentence
    "words": [0.5, 1.5, 2.5, 4.5, 7.5, 14.5, 30.5],
    "length": [2.0, 3.0, 3.8, 5.0, 7.0, 10.0, 16.0],
    "separators": [0.05, 0.15, 0.3, 0.6],
    "single": [0.1, 0.2, 0.35, 0.6],
    "repeats": [0.05, 0.2, 0.4, 0.6],
    "capitals": [0.1, 0.25, 0.5, 0.8],
    "vowels": [0.1, 0.25, 0.36, 0.44, 0.52],
}
LETTER, DIGIT, UPPER, VOWEL, SYMBOL, SEPARATOR, SPACE, END = (1 << i for i in range(8))


def kinds() -> np.ndarray:
    """Bit set of character kinds for each code point of the first plane."""
    out = np.zeros(0x10000, np.uint16)
    for point in range(0x10000):
        c = chr(point)
        k = 0
        if c.isalpha():
            k |= LETTER | (UPPER if c.isupper() else 0) | (VOWEL if fold(c)[:1] in tuple("aeiou") else 0)
        elif c.isdigit():
            k |= DIGIT
        elif c.isspace():
            k |= SPACE | (SEPARATOR if c == "\t" else 0)
        elif 0x300 <= point < 0x370:
            k = 0
        else:
            k |= 0 if c in ".,;:!?'\"()-–—…“”‘’%$ºª§/•" else SYMBOL
            k |= SEPARATOR if c in ";|=_•" else 0
            k |= END if c in ".!?…”\"»’:)" else 0
        out[point] = k
    return out


def segments(text: str) -> list[str]:
    """The lines that are not blank, long ones cut at blanks."""
    out = []
    for line in text.split("\n"):
        if not (line := line.strip()):
            continue
        while len(line) > SEGMENT * 3 // 2:
            cut = line.find(" ", SEGMENT)
            if cut < 0 or cut > SEGMENT * 2:
                cut = SEGMENT
            out.append(line[:cut])
            line = line[cut:].strip()
        if line:
            out.append(line)
    return out


class Statistics:
    """Line statistics of many lines at once."""

    def __init__(self, common: np.ndarray, hashed: Hasher) -> None:
        self.kinds, self.common, self.hashed = kinds(), common, hashed

    def is_common(self, flat: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.common, flat), max(len(self.common) - 1, 0))
        return (self.common[at] == flat) & (flat != 0) if len(self.common) else np.zeros(len(flat), bool)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, letters and digits in them, common words) of each text."""
        flat, ends = self.hashed(texts)
        length, starts = self.hashed.lengths, np.concatenate([[0], ends[:-1] + 1])

        def summed(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return (total[ends] - total[starts]).astype(float)

        return (ends - starts).astype(float), summed(length), summed(self.is_common(flat))

    def __call__(self, lines: list[str]) -> dict[str, np.ndarray]:
        flat, ends = self.hashed(lines)
        length = self.hashed.lengths
        starts = np.concatenate([[0], ends[:-1] + 1])
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[np.minimum(points, 0xFFFF)]
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        stop = np.cumsum(sizes)
        start = stop - sizes

        def chars(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[stop] - total[start]

        def terms(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[ends] - total[starts]

        space = (kind & SPACE) > 0
        double = np.zeros(len(kind), bool)
        double[1:] = (space[1:] & space[:-1]) | ((points[1:] == 46) & (points[:-1] == 46))
        count = ends - starts
        words, visible, letters = np.maximum(count, 1), np.maximum(chars(~space), 1), np.maximum(chars((kind & LETTER) > 0), 1)
        owner = np.searchsorted(ends, np.arange(len(flat)))
        order = np.lexsort((flat, owner))
        again = np.zeros(len(flat), bool)
        if len(flat) > 1:
            again[1:] = (flat[order][1:] == flat[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        return {
            "common": terms(self.is_common(flat)) / words,
            "symbols": chars((kind & SYMBOL) > 0) / visible,
            "digits": chars((kind & DIGIT) > 0) / visible,
            "ends": np.where((kind[stop - 1] & END) > 0, 2.0, np.where((kind[stop - 1] & DIGIT) > 0, 1.0, 0.0)),
            "words": count.astype(float),
            "length": terms(length) / words,
            "separators": (chars((kind & SEPARATOR) > 0) + chars(double)) / words,
            "single": terms((length == 1) & (flat != 0)) / words,
            "repeats": np.bincount(owner[order][again], minlength=len(lines))[: len(lines)] / words,
            "capitals": chars((kind & UPPER) > 0) / words,
            "vowels": chars((kind & VOWEL) > 0) / letters,
            "chars": sizes,
            "symbol_chars": chars((kind & SYMBOL) > 0),
            "visible": chars(~space),
        }


def seeds(s: dict[str, np.ndarray]) -> np.ndarray:
    """Labels of lines with one clear statistic; -1 for the others."""
    out = np.full(len(s["words"]), -1)
    few = (s["common"] < 0.12) & (s["symbols"] < 0.03)
    out[few & (s["words"] >= 1) & (s["words"] <= 5) & (s["digits"] < 0.2) & (s["ends"] < 2)] = LIST
    out[few & (s["separators"] >= 0.15) & (s["digits"] < 0.1) & (s["words"] > 5)] = LIST
    out[(s["common"] < 0.12) & (s["digits"] >= 0.2) & (s["words"] >= 2)] = TABLE
    out[(s["common"] < 0.12) & (s["separators"] >= 0.5) & (s["digits"] >= 0.05)] = TABLE
    out[(s["symbols"] >= 0.12) | ((s["common"] < 0.03) & (s["words"] >= 8) & ((s["repeats"] >= 0.3) | (s["vowels"] < 0.2)))] = JUNK
    out[(s["length"] > 20) | (s["single"] > 0.6) & (s["words"] >= 6)] = JUNK
    out[(s["common"] >= 0.28) & (s["words"] >= 6) & (s["symbols"] < 0.04) & (s["single"] < 0.4) & (s["repeats"] < 0.45)] = PROSE
    out[(s["common"] < 0.4) & (s["ends"] == 1) & (s["digits"] > 0.1) & (s["words"] >= 6) & (s["symbols"] < 0.03)] = LIST
    return out


class LineModel:
    """The hidden Markov model: log start, transition and per-statistic emission."""

    def __init__(self, common: np.ndarray) -> None:
        self.common = common
        self.start = np.log(np.full(4, 0.25))
        self.move = np.log(np.where(np.eye(4, dtype=bool), 0.85, 0.05))
        self.emit = {k: np.zeros((4, len(b) + 1)) for k, b in BINS.items()}

    def scores(self, s: dict[str, np.ndarray]) -> np.ndarray:
        """Log emission of each line under each label."""
        return sum(self.emit[k][:, np.searchsorted(b, s[k])].T for k, b in BINS.items())

    def count(self, s: dict[str, np.ndarray], labels: np.ndarray, owner: np.ndarray, seeds: np.ndarray | None = None) -> None:
        """Set the model from labelled lines; ``seeds`` count once more as evidence of
        what a label's lines look like."""
        known = labels >= 0
        for k, b in BINS.items():
            table = np.full((4, len(b) + 1), 1.0)
            cell = np.searchsorted(b, s[k])
            np.add.at(table, (labels[known], cell[known]), 1.0)
            if seeds is not None:
                np.add.at(table, (seeds[seeds >= 0], cell[seeds >= 0]), 1.0)
            self.emit[k] = np.log(table / table.sum(axis=1, keepdims=True))
        first = np.ones(len(labels), bool)
        first[1:] = owner[1:] != owner[:-1]
        start, move = np.full(4, 5.0), np.full((4, 4), 5.0)
        np.add.at(start, labels[first & known], 1.0)
        pair = np.flatnonzero(~first[1:] & known[1:] & known[:-1])
        np.add.at(move, (labels[pair], labels[pair + 1]), 1.0)
        self.start, self.move = np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True))

    def label(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Most likely labels (Viterbi) of many texts at once; counts has the lines
        of each text. Step t handles the t-th line of every text that has one."""
        out = np.zeros(len(scores), np.int64)
        order = np.argsort(-counts, kind="stable")
        base = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        live = int((sizes > 0).sum())
        if not live:
            return out
        best = self.start + scores[base[:live]]
        back = np.zeros((len(scores), 4), np.int8)
        final = best.copy()
        for t in range(1, int(sizes[0])):
            n = int(np.searchsorted(-sizes, -t, side="left"))  # texts with more than t lines
            if n == 0:
                break
            through = best[:n, :, None] + self.move
            back[base[:n] + t] = through.argmax(axis=1)
            best = through.max(axis=1) + scores[base[:n] + t]
            final[:n] = best
        state = final.argmax(axis=1)
        for t in range(int(sizes[0]) - 1, -1, -1):
            n = int(np.searchsorted(-sizes, -t, side="left"))
            out[base[:n] + t] = state[:n]
            if t:
                state[:n] = back[base[:n] + t, state[:n]]
        return out


def fit(docs: DataFrame, id_col: str, text: str, common: np.ndarray, sample_rows: int = SAMPLE_ROWS) -> LineModel:
    """Fit the model to the ``sample_rows`` texts with the smallest hashed ids, of at
    most SAMPLE_CHARS characters."""
    rows = sampled(docs, id_col, text, sample_rows, SAMPLE_CHARS)
    model = LineModel(common)
    parts = [segments(r["t"]) for r in rows]
    lines = [x for part in parts for x in part]
    if not lines:
        return model
    counts = np.array([len(part) for part in parts])
    owner = np.repeat(np.arange(len(parts)), counts)
    stats = Statistics(common, Hasher())(lines)
    fixed = seeds(stats)
    model.count(stats, fixed, owner)
    for _ in range(ROUNDS):
        labels = model.label(model.scores(stats), counts)
        model.count(stats, labels, owner, fixed)
    return model


SCHEMA = "id long, words long, mean_word_length double, symbol_share double, line_end_share double, common_share double, prose_share double, list_share double, table_share double, junk_share double"


def text_statistics(docs: DataFrame, id_col: str, text: str, common_words: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per text: word count, mean word length (letters and digits), share of
    symbols among visible characters, share of lines that end in punctuation, share
    of common words, and the shares of characters in lines labelled prose, list,
    table and junk.

    Symbols are visible characters other than letters, digits and ordinary
    punctuation. A null or blank text has no words and null shares. Rows with a null
    id are left out; rows that repeat an id give a row each. More than MOST_WORDS
    common words are an error."""
    known = common_words.where("word IS NOT NULL").select("word").distinct()
    if (n := known.count()) > MOST_WORDS:
        raise ValueError(f"{n} common words; at most {MOST_WORDS} can be sent to the tasks")
    items = [r[0] for r in known.collect()]
    common = Hasher().word_set(items) if items else np.zeros(0, np.uint64)
    model = Shared(docs.sparkSession, fit(docs, id_col, text, common, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = model.get()
        statistics = Statistics(hmm.common, hasher())
        for batch in batches:
            for first, piece in pieces(batch.column(1).to_pylist(), 1_000_000):
                parts = [segments(t) for t in piece]
                counts = np.fromiter(map(len, parts), np.int64, len(parts))
                lines = [x for part in parts for x in part]
                total = {k: np.zeros(len(parts)) for k in ("words", "letters_of_words", "symbol_chars", "visible", "common_words", "ends", "lines", "chars", 0, 1, 2, 3)}
                if lines:
                    stats = statistics(lines)
                    labels = hmm.label(hmm.scores(stats), counts)
                    owner = np.repeat(np.arange(len(parts)), counts)
                    for k in ("symbol_chars", "visible", "chars"):
                        total[k] = np.bincount(owner, stats[k], len(parts))
                    for k in range(4):
                        total[k] = np.bincount(owner, stats["chars"] * (labels == k), len(parts))
                # words of the whole texts: a segment may end within a long word
                total["words"], total["letters_of_words"], total["common_words"] = statistics.words(piece)
                for i, text_ in enumerate(piece):
                    ends = [line.rstrip()[-1] for line in text_.split("\n") if line.strip()]
                    total["lines"][i] = len(ends)
                    total["ends"][i] = sum(e in ".!?…:;\"”»’)" for e in ends)

                def share(a: str | int, b: str) -> pa.Array:
                    return pa.array(total[a] / np.maximum(total[b], 1), mask=total[b] == 0)

                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(piece)),
                        pa.array(total["words"].astype(np.int64)),
                        share("letters_of_words", "words"),
                        share("symbol_chars", "visible"),
                        share("ends", "lines"),
                        share("common_words", "words"),
                        *(share(k, "chars") for k in range(4)),
                    ],
                    [part.split()[0] for part in SCHEMA.split(", ")],
                )

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(run, SCHEMA)


def no_prose(statistics: DataFrame) -> DataFrame:
    """(id) of the texts that are, by more than half of their characters, no prose."""
    return statistics.where("prose_share < 0.5").select("id").distinct()
