"""Vectorised word and shingle hashing over Arrow batches of texts.

Words are the maximal runs of letters or digits of the lower-cased text without
accents. A batch of texts becomes one array of code points; a table folds each
to its base letter, and a prefix sum of a polynomial over them gives the hash of
every word at once, so no Python code runs per word. In the flat array of word
hashes a zero marks the end of each text.
"""

from __future__ import annotations

import re
import sys
import types
import unicodedata
from collections.abc import Iterator

import numpy as np
import xxhash

U64 = np.uint64
#: Odd multipliers of the splitmix64 finaliser.
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
STEP = U64(0x9E3779B97F4A7C15)
#: Texts are handled in pieces of about this many characters, which bounds memory.
PIECE_CHARS = 1_500_000
TOKEN = re.compile(r"[^\W_]+")
#: The combining marks below U+10000, and all that lies above.
MARKS = re.compile("[%s]+" % "".join(chr(point) for point in range(0x300, 0x10000) if unicodedata.combining(chr(point))))
HIGH = re.compile("[\U00010000-\U0010ffff]")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    if HIGH.search(text):
        return "".join(c for c in text if not unicodedata.combining(c))
    return MARKS.sub("", text)


def single_blanks(line: str) -> str:
    """The words of a line with one blank between them. What is printable holds no
    white space but blanks, so most lines are seen to be so already."""
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":
        return line
    return " ".join(line.split())


def words(text: str | None) -> list[str]:
    """The words of one text, the plain way; for small inputs and for tests."""
    return TOKEN.findall(fold(text or ""))


def pieces(texts: list[str | None], limit: int = PIECE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) pieces of bounded total length; nulls become empty."""
    start, size, piece = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if piece and size + len(text) > limit:
            yield start, piece
            start, size, piece = i, 0, []
        piece.append(text)
        size += len(text)
    if piece:
        yield start, piece


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the result depends on all of x."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


class Hasher:
    """Word hashes of texts. Holds the folding table and the powers of the base."""

    DROP, SLOW = 1, 2  # a combining mark; a character that folds to several

    def __init__(self) -> None:
        folded = np.zeros(0x10000, np.uint32)
        self.kind = np.zeros(0x10000, np.uint8)
        for point in range(0x10000):
            char = chr(point)
            if 0xD800 <= point < 0xE000:
                continue
            out = fold(char)
            if not out:
                self.kind[point] = self.DROP
            elif len(out) > 1 or char == "Σ":  # sigma's lower case depends on its place
                self.kind[point] = self.SLOW
            elif out.isalnum():
                folded[point] = ord(out)
        self.value = np.where(folded > 0, mix(folded.astype(U64) * STEP) | U64(1), U64(0))
        base = np.array([0xD6E8FEB86659FD93], U64)
        inverse = np.array([pow(int(base[0]), -1, 1 << 64)], U64)
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, U64)

    def powers(self, n: int) -> None:
        while len(self.up) < n:
            size = U64(len(self.up))
            self.up = np.concatenate([self.up, self.up * self.base[0] ** size])
            self.down = np.concatenate([self.down, self.down * self.inverse[0] ** size])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat word hashes with a 0 after each text, and the positions of those 0s."""
        joined = "\0".join([*(t.replace("\0", " ") if "\0" in t else t for t in texts), ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(points, 0xFFFF)
        kind = self.kind[low] if low.max(initial=0) > 0x2FF else None
        if kind is not None and (kind == self.SLOW).any():
            joined = fold(joined)
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            low = np.minimum(points, 0xFFFF)
            kind = self.kind[low]
        value = self.value[low]
        high = np.flatnonzero(points > 0xFFFF)
        if len(high):
            drop = []
            for point in np.unique(points[high]):
                out, at = fold(chr(point)), high[points[high] == point]
                if out:
                    value[at] = mix(np.array([ord(out[0])], U64) * STEP)[0] | U64(1) if out[0].isalnum() else U64(0)
                else:
                    drop.append(at)
            if drop:
                kind = self.kind[low]
                kind[np.concatenate(drop)] = self.DROP
        if kind is not None and (kind == self.DROP).any():
            keep = kind != self.DROP
            value, points = value[keep], points[keep]
        n = len(value)
        self.powers(n + 1)
        letter = np.zeros(n + 2, bool)
        letter[1:-1] = value != 0
        starts = np.flatnonzero(letter[1:-1] & ~letter[:-2])
        stops = np.flatnonzero(letter[1:-1] & ~letter[2:]) + 1
        total = np.zeros(n + 1, U64)
        np.cumsum(value * self.up[:n], out=total[1:])
        hashes = mix((total[stops] - total[starts]) * self.down[starts]) | U64(1)
        before = np.searchsorted(starts, np.flatnonzero(points == 0))
        flat = np.insert(hashes, before, U64(0))
        self.lengths = np.insert(stops - starts, before, 0)  # letters of each word of this call
        return flat, before + np.arange(len(before))

    def word_set(self, items: list[str]) -> np.ndarray:
        """Sorted hashes of the words in ``items``."""
        flat, _ = self(list(items))
        return np.unique(flat[flat != 0])


def hasher() -> Hasher:
    """One hasher for each Python worker process, however many tasks it runs."""
    holder = sys.modules.setdefault("_garimpo_worker", types.ModuleType("_garimpo_worker"))
    if not hasattr(holder, "hasher"):
        holder.hasher = Hasher()
    return holder.hasher


def shingles(flat: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words, and whether each lies in one text."""
    n = len(flat) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    total, inside = np.zeros(n, U64), np.ones(n, bool)
    for k in range(width):
        part = flat[k : k + n]
        total = mix(total + part * U64(2 * k + 3) + STEP)
        inside &= part != 0
    return total, inside


def sequence_key(flat: np.ndarray) -> bytes:
    """128-bit key of a word sequence: equal for texts with equal words in order."""
    return xxhash.xxh3_128_digest(flat.tobytes())
