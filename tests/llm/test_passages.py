import random

from boxloom.llm.passages import remove_repeats
from tests.llm.conftest import DOCS


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(n))


def test_passages_lines_and_clean_text(make):
    rnd = random.Random(4)
    passages, line = [words(rnd, 60) for _ in range(20)], words(rnd, 9) + "."
    rows, clean = [], {}
    for i in range(120):
        own = [words(rnd, 30), words(rnd, 25)]
        if i % 3 == 0:
            text = f"{own[0]} {passages[i // 3 % 20]} {own[1]}"
        elif i % 3 == 1:
            text = f"{own[0]}\n{line}\n{own[1]}"
        else:
            text = clean[i] = "\n".join(own) + "\nyes of it"
        rows.append((i, text, "en", "s", len(text)))
    got = {r.doc_id: r for r in remove_repeats(make(rows, DOCS)).collect()}
    for i, text, *_ in rows:
        r = got[i]
        edges = [0, *(x for s in r.removed for x in (s.start, s.end)), len(text)]
        assert r.text == "".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)) and r.n_removed == sum(s.end - s.start for s in r.removed)
    assert all(got[i].text == t for i, t in clean.items())
    for p in passages:
        assert sum(p in r.text for r in got.values()) == 1
    assert [i for i, r in got.items() if line in r.text] == [1]
    first = [i for i in range(0, 60, 3)]
    assert all(got[i].n_removed == 0 for i in first) and all(got[i].n_removed > 100 for i in range(60, 120, 3))


def test_edges(make):
    line = "one two three four five six seven"
    rows = [(7, line, None, None, None), (7, line, None, None, None), (None, line, None, None, None), (9, None, None, None, None), (10, line + "\n" + line, None, None, None), (11, "", None, None, None)]
    got = sorted(((r.doc_id or 0), r.text or "", r.text is None) for r in remove_repeats(make(rows, DOCS)).collect())
    assert got == [(0, "", False), (7, line, False), (7, line, False), (9, "", True), (10, "", False), (11, "", False)]
    assert remove_repeats(make([], DOCS)).count() == 0
