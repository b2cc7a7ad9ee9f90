import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from garimpo.llm.batches import Hasher, pieces, shingles, words

HASHER = Hasher()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_hashes_follow_the_words(texts):
    flat, ends = HASHER(texts)
    assert len(ends) == len(texts) and (flat[ends] == 0).all()
    seen, start = {}, 0
    for text, end in zip(texts, ends.tolist()):
        found = words(text.replace("\0", " "))
        values = flat[start:end].tolist()
        assert len(found) == len(values) and 0 not in values
        for word, value in zip(found, values):
            assert seen.setdefault(word, value) == value
        start = end + 1
    assert len(set(seen.values())) == len(seen)


def test_accents_case_and_composition_do_not_matter():
    flat, ends = HASHER(["LICITAÇÃO", "licitação", "licitação", "Σας ΣΑΣ"])
    assert len(set(flat[ends[:3] - 1].tolist())) == 1


def test_shingles_stay_in_one_text():
    flat, _ = HASHER(["a b c", "d e", ""])
    values, inside = shingles(flat, 3)
    assert inside.sum() == 1 and len(values) == len(flat) - 2
    assert shingles(flat[:1], 3)[0].size == 0


def test_pieces_cover_all_texts():
    texts = ["a" * 10, None, "b" * 25, "", "c"]
    found = [(start + i, t) for start, piece in pieces(texts, 12) for i, t in enumerate(piece)]
    assert found == [(i, t or "") for i, t in enumerate(texts)]
    assert np.array_equal(list(pieces([])), [])
