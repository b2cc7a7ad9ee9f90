"""Brute-force versions of the operators, and small texts."""

import random
from collections import defaultdict

from garimpo.llm.batches import words

VOCABULARY = [f"{a}{b}{c}" for a in ("con", "pre", "sal", "mur", "tev", "lon") for b in ("ta", "bi", "ro", "me", "gu") for c in ("do", "ção", "ura", "es", "im", "al")]


def sentence(rng, n=12):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


def article(rng, sentences=8):
    return " ".join(sentence(rng) for _ in range(sentences))


def edited(rng, text, edits):
    parts = text.split()
    for _ in range(edits):
        parts[rng.randrange(len(parts))] = rng.choice(VOCABULARY)
    return " ".join(parts)


def grams(text, width):
    found = words(text)
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def groups_of(texts, width, threshold):
    """Pairs of one group among (id, text)."""
    sets = {i: grams(t, width) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    keys = {i: tuple(words(t)) for i, t in texts}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if keys[a] == keys[b] or jaccard(sets[a], sets[b]) >= threshold:
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for i in ids:
        members[find(i)].append(i)
    return {(a, b) for m in members.values() for a in m for b in m if a < b}


def accepted_in_order(history, batch, width, threshold):
    """Ids of the batch that repeat an accepted text."""
    taken = [grams(t, width) for _, t in history]
    repeated = set()
    for i, text in batch:
        mine = grams(text, width)
        if any(jaccard(mine, other) >= threshold for other in taken):
            repeated.add(i)
        else:
            taken.append(mine)
    return repeated


def rng(seed=7):
    return random.Random(seed)
