import random

from pyspark.sql import functions as F

from boxloom.llm.language import identify
from boxloom.llm.toxicity import BLOCK, keep_clean, score, train
from tests.llm.conftest import DOCS

LABELS = "doc_id bigint, quality int, toxic int"


def text(rnd, letters, n=40):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 7))) for _ in range(n))


def test_language(make):
    rnd = random.Random(2)
    alphabets = {"xx": "abcdef", "yy": "defghi", "zz": "àéîklm"}
    rows = [(i, text(rnd, alphabets[lang]), lang, "s", 1) for i, lang in enumerate(["xx", "yy", "zz"] * 60)]
    known = make(rows, DOCS)
    fresh = [(1000 + i, text(rnd, alphabets[lang]).upper(), lang, "s", 1) for i, lang in enumerate(["xx", "yy", "zz"] * 10)] + [(1, None, None, None, None), (2, "12 34!", None, None, None), (None, "abc fed", None, None, None), (3, "", None, None, None), (4, "²½ ① Ⅷ", None, None, None)]
    got = {r.doc_id: r for r in identify(make(fresh, DOCS), known).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang, *_ in fresh[:30])
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in identify(make(fresh, DOCS), make([], DOCS)).collect()} == {"und"}
    assert identify(make([], DOCS), known).count() == 0


def test_toxicity(make):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        t = text(rnd, "abcdefgh").split()
        if toxic:
            for w in rnd.sample(["grumbor", "zorkly", "vexpat", "grumbing"], 2):
                t.insert(rnd.randrange(len(t)), w)
        rows.append((i, " ".join(t), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (1000, 1, None), (5000, 1, 1)]
    docs = make(rows + [(900, None, None, None, None), (901, "", None, None, None), (None, "zorkly grumbor", None, None, None)], DOCS)
    model = train(docs, make(labels[:300] + labels[400:], LABELS), per_class=200)
    got = {r.doc_id: r for r in score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(400))
    assert got[None].predicted == 1 and got[900].predicted == 0 and got[901].score == got[900].score < 0.3
    assert {e.label for e in got[0].evidence} == {1}
    assert {r.doc_id for r in keep_clean(docs, model).select("doc_id").collect()} == {i for i in range(400) if i % 5} | {900, 901}
    # the index equals a search over all examples
    index = model.load().index
    for i in range(0, 400, 7):
        v = index.vector(index.known_terms(rows[i][1]))
        every = []
        for terms, places, weights in index.postings:
            sums = [0.0] * BLOCK
            for t, p, w in zip(terms.tolist(), places.tolist(), weights.tolist()):
                sums[p] += v.get(t, 0.0) * w
            every += [(round(x, 12), 0) for x in sums]
        every.sort(reverse=True)
        assert [c for c, _ in index.nearest(v)] == [c for c, _ in every[:15] if c > 0]
    assert {r.score for r in score(docs, train(docs, make([], LABELS))).collect()} == {0.0}
    assert docs.where(F.col("doc_id") == 901).count() == 1


def test_toxicity_uses_all_terms(make):
    """A word without a tie to the label gives neighbours and counts in the cosine; a rarer toxic word is found."""
    rnd = random.Random(5)
    rows = [(i, text(rnd, "abcdefgh") + (" quiblor quiblor" if i % 4 == 0 and i < 48 else ""), "en", "s", 1) for i in range(400)]
    model = train(make(rows, DOCS), make([(i, 1, int(i % 4 == 0)) for i in range(400)], LABELS))
    word = max((w for w in rows[1][1].split() if sum(w in t.split() for _, t, *_ in rows) > 1), key=len)
    fresh = [(1000, word, "en", "s", 1), (1001, word + " unheard", "en", "s", 1), (1002, text(rnd, "abcdefgh", 10) + " quiblor", "en", "s", 1), (1003, "unheard", "en", "s", 1), (1, rows[1][1], "en", "s", 1)]
    got = {r.doc_id: r for r in score(make(fresh, DOCS), model).collect()}
    assert got[1000].evidence and got[1000].evidence == got[1001].evidence and not got[1003].evidence
    assert all(word in rows[e.doc_id][1].split() for e in got[1000].evidence) and got[1000].evidence[0].cosine < 1
    assert got[1002].predicted == 1 and got[1000].predicted == 0
    assert got[1].evidence[0].doc_id == 1 and abs(got[1].evidence[0].cosine - 1) < 1e-6 and got[1].evidence[1].cosine < 1
