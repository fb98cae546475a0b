import random

import pytest

from boxloom.llm.near_duplicates import NO_ID, ascii_words, near_duplicates
from tests.llm.conftest import DOCS


def brute(rows, size, percent=80):
    """Component and set size of each id by comparing all pairs."""
    sets = {}
    for d, t in rows:
        w = ascii_words(t)
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                a1, b1 = top(a), top(b)
                parent[max(a1, b1)] = min(a1, b1)
    return {d: (len(sets[d]), top(d), top(d) == d) for d in ids}


def corpus(seed, groups=8, copies=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7)))
    boiler = " ".join(word() for _ in range(12))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rnd.choice((6, 40, 150)))]
        for _ in range(copies if g < 2 else rnd.randrange(1, 6)):
            w = list(base)
            for _ in range(rnd.randrange(0, 5)):
                w[rnd.randrange(len(w))] = word()
            rows.append((boiler + "\n" if rnd.random() < 0.5 else "") + " ".join(w))
    rows += [boiler + " " + word() for _ in range(70)] + ["", None, "one", "ONE", "x y", boiler]
    rnd.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,size", [(1, 4), (2, 5)])
def test_equals_all_pairs_with_large_groups(spark, make, seed, size):
    rows = corpus(seed)
    got = near_duplicates(make([(d, t, "en", "s", 1) for d, t in rows], DOCS), size)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, size)


def test_edges(make):
    rows = [(5, "a b c d e", None, None, None), (5, "a b c d e", None, None, None), (None, "a b c d e", None, None, None), (2, "A B C D E", None, None, None), (9, None, None, None, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make(rows, DOCS), 5).collect())
    assert got == [(0, 1, None, True), (2, 1, 2, True), (5, 1, 2, False), (5, 1, 2, False), (9, 0, 9, True)]
    assert near_duplicates(make([], DOCS), 5).count() == 0
    assert NO_ID > 2**62
