import random

from boxloom.llm.common import plain_words
from boxloom.llm.decontamination import matches
from tests.llm.conftest import DOCS
from tests.llm.test_passages import words

ITEMS = "item_id bigint, text string"


def shingles(text, size):
    w = plain_words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_equals_brute_force(make):
    rnd = random.Random(8)
    items = [(i, words(rnd, rnd.choice((2, 6, 14, 30, 59)))) for i in range(40)] + [(90, None), (91, ""), (92, "..."), (93, "The Same?"), (93, "The Same?")]
    docs = []
    for i in range(150):
        text = words(rnd, rnd.choice((3, 100, 2000)))
        if i % 3 == 0 and items[i % 40][1]:
            w = items[i % 40][1].upper().split()
            if i % 2:
                w[rnd.randrange(len(w))] = "changed"
            text = words(rnd, rnd.randrange(500)) + "\n" + ", ".join(w) + "! " + words(rnd, rnd.randrange(900))
        docs.append((i, text, "en", "s", 1))
    docs += [(None, "x the same y", None, None, None), (500, None, None, None, None)]
    want = []
    for d, t, *_ in docs:
        for i, x in items:
            s = shingles(x, 5)
            if s:
                n = min(5, len(plain_words(x)))
                share = len(s & shingles(t, n)) / len(s) if len(plain_words(t)) >= n else 0
                if share >= 0.8:
                    want.append((d, i, round(share, 9)))
    got = [(r.doc_id, r.item_id, round(r.containment, 9)) for r in matches(make(docs, DOCS), make(items, ITEMS)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 30
    # several blocks of items give the same
    assert sorted([(r.doc_id, r.item_id, round(r.containment, 9)) for r in matches(make(docs, DOCS), make(items, ITEMS), block_shingles=60).collect()], key=str) == sorted(want, key=str)
    assert matches(make([], DOCS), make(items, ITEMS)).count() == 0 and matches(make(docs, DOCS), make([], ITEMS)).count() == 0
