"""What the fast paths of problems 2 and 6 give is what the plain definitions give,
and the work per character stays small."""

import cProfile
import pstats
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from garimpo.llm import batches, boilerplate, house, residue
from tests.llm import helpers as h

ODD = ["", " ", "\xa0a", "a b", "a  b", " a", "a ", "a\tb", "́ um dois de três quatro.", "O ́ ̂ de não é.", "é à às não até ó.", "\U0001d400 \U0001e130́ de uma não foi.", "İSTANBUL ΣΑΣ de não é.", "a١2 ٣٤ １x 12٠5", "1“2”3", "x\ud800 7"]


class Sent:
    def __init__(self, value):
        self.value = value

    def get(self):
        return self.value


class Pass:
    """Takes the place of a DataFrame; keeps the function of mapInArrow."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


@pytest.fixture(scope="module")
def model():
    table, size = residue.char_table(), 1 << residue.TABLE_BITS
    names = residue.SLOT_NAMES.split()
    slots = [form % tuple([name] * form.replace("%%", "").count("%s")) for form in residue.SLOT_FORMS for name in names]
    texts = [[article(h.rng(1)) for _ in range(20)], ["Início", "Fale conosco"], residue.FILLER.split("\n"), residue.NOTICE.split("\n"), slots]
    return residue.Residue(np.stack([np.bincount(residue.grams("\n".join(x) + "\n", table), minlength=size).astype(float) for x in texts]))


def article(rng, lines=8):
    return "\n".join(" ".join(f"O {rng.choice(h.VOCABULARY)} não foi {rng.choice(h.VOCABULARY)} para a {rng.choice(h.VOCABULARY)}, às {rng.randrange(24)}h de {rng.choice(h.VOCABULARY)}." for _ in range(4)) for _ in range(lines))


def test_fast_paths_equal_the_plain_definitions():
    def fold(text):
        return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))

    def running(line):
        found = fold(line).split()
        functions = sum(w in house.FOLDED for w in found)
        if len(found) < 5 or not re.search(r"[.!?…][”\"»’')]*$", line):
            return len(found) >= 14 and functions >= 0.2 * len(found)
        return functions > 0

    marks, rng = [chr(p) for p in range(sys.maxunicode + 1) if unicodedata.combining(chr(p))], h.rng(4)
    blanks = [chr(p) for p in range(sys.maxunicode + 1) if chr(p).isspace()]
    letters = ["de", "não", "foi", "à", "ó", "x", "y1", "é.", "fim.”", "\U0001d400", "nã̃o", "٣", "Δς", *rng.sample(marks, 40), *rng.sample(blanks, 10)]
    lines = ODD + marks + ["a" + b + "b" for b in blanks] + [rng.choice(["", " ", "́"]).join(rng.choice(letters) + rng.choice([" ", ""]) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for line in lines:
        assert batches.fold(line) == fold(line)
        assert batches.single_blanks(line) == " ".join(line.split())
        line = " ".join(line.split())
        assert house.line_key(line.lower()) == house.key(re.sub(r"\d+", "0", line.lower()))
        assert house.running_text(line, line.lower()) == running(line)
    for point in range(sys.maxunicode + 1):
        if unicodedata.category(chr(point)) == "Nd":
            assert house.line_key(f"a {chr(point)}") == house.line_key("a 0")


def test_slots_are_those_of_a_plain_scan(model):
    rng = h.rng(5)
    parts = ["{{titulo}}", "${autor}", "{0}", "{%", "%}", "%%NOME%%", "[[x]]", "[inserir texto aqui]", "__NOME__", "undefined", "undefinedx", "{{", "}}", "[", "&lt;nome&gt;", "um de ", " não foi ", "x" * 60, "palavra comum " * 12, "@@x.y@@", "#{a}", "<%= nome %>", "%(a.b)s", "[object Object]"]
    for _ in range(300):
        joined = " " * 32 + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) + " " * 32
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        grams = residue.grams_of(points, model.table)
        hot = np.flatnonzero(model._sums(model.ratio[residue.SLOTS][grams], residue.SLOT_WINDOW) > 0)
        spans, done = [], 0
        for part in np.split(hot, np.flatnonzero(np.diff(hot) > residue.SLOT_REACH) + 1) if len(hot) else []:
            first, last = int(part[0]), int(part[-1])
            for match in residue.SLOT.finditer(joined, max(done, first - residue.SLOT_REACH), min(len(joined), last + residue.SLOT_REACH)):
                low, high = match.span()
                if high + residue.SLOT_WINDOW >= first and low - 1 <= last:
                    done = high
                    spans.append((low, high))
        assert list(model._slots(joined, points, grams)) == spans


def test_zones_equal_a_loop_over_the_lines():
    rng = h.rng(8)
    pages = [[(rng.random() < 0.3, rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.choice([0, 1, 4, 12]))] for _ in range(200)]
    features = [[{"line_no": 2 * k, "running": r, "headline": t, "form": k, "coarse": k, "length": 9, "ends": r} for k, (r, t, _) in enumerate(page)] for page in pages]
    gone = [[k for k, line in enumerate(page) if line[2]] or None for page in pages]
    kinds = pa.struct([("line_no", pa.int32()), ("running", pa.bool_()), ("headline", pa.bool_()), ("form", pa.int64()), ("coarse", pa.int64()), ("length", pa.int32()), ("ends", pa.bool_())])
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(features, pa.list_(kinds)), pa.array(gone, pa.list_(pa.int32()))], ["id", "features", "gone"])
    run = boilerplate.zones(Pass())
    want = []
    for i, page in enumerate(pages):
        kind = ["F" if t or g else "C" if r else None for r, t, g in page]
        for k in range(len(page) if "C" in kind else 0):
            above, below = [x for x in kind[:k] if x], [x for x in kind[k + 1 :] if x]
            want.append((i, 2 * k, kind[k], float(above[-1:] == ["C"] and below[:1] == ["C"])))
    found = [(r["id"], r["line_no"], r["kind"], r["inner"]) for b in run(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert found == want and len(want) > 300


def test_pages_cost_few_calls_a_character(model):
    """a page's lines were folded character by character, 2 calls a character and more."""
    rng = h.rng(3)
    bodies = [article(rng) for _ in range(200)]
    ids = pa.array(range(200), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(["Título da página"] * 200), pa.array(bodies)], ["row", "id", "site", "title", "body"])
    run = residue.scored_pages(Pass(), Sent(model), boilerplate.line_features(Sent(frozenset())))
    batches.hasher()
    profile = cProfile.Profile()
    profile.enable()
    out = list(run(iter([batch])))
    profile.disable()
    assert sum(b.num_rows for b in out) == 200
    assert pstats.Stats(profile).total_calls < 0.3 * sum(map(len, bodies))
