"""Runs against a comparison of every word with every later one."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from boxloom.llm.periodic_runs import periodic_runs, runs_of
from boxloom.llm.queries import QUERIES, planted_tail
from tests.llm.conftest import DOCS

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        a = 0
        while a + q < n:
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            if b - a >= q and b + q - a >= max(least, 2 * q):
                found.setdefault((a, b + q - a), q)
            a = b + 1
    return sorted((a, length, q) for (a, length), q in found.items())


def collapsed(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


@pytest.mark.parametrize("seed", range(40))
def test_random_streams(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(5):
        n, letters = rng.choice([0, 1, 2, 3, 5, 10, 30, 100, 300]), rng.choice([1, 2, 3, 5])
        t = [rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.5 and n > 3:
            t = t[: n // 3] + (t[: rng.randint(1, n // 3)] * n)[: n - n // 3]
            t[rng.randrange(n)] = 9
        texts.append(t)
    for piece in (1, 7, 64, 10_000):
        found = runs_of([np.array(t, dtype=np.int64) for t in texts], piece)
        assert [[tuple(r) for r in f.tolist()] for f in found] == [brute_runs(t, 1) for t in texts]


def test_structured_words():
    fibonacci, thue = [0], [bin(i).count("1") % 2 for i in range(600)]
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    for t in (b, thue, [0] * 700, ([0] * 40 + [1]) * 9):
        assert [tuple(r) for r in runs_of([np.array(t, dtype=np.int64)])[0].tolist()] == brute_runs(t, 1)
    # a very long text, appended piece by piece
    runs = runs_of([np.tile(np.arange(1000), 300)], piece=1 << 12)[0]
    assert runs.tolist() == [[0, 300_000, 1000]]


def test_cases(spark, make):
    loop = " ".join(["x", "y"] * 10)
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, loop, "en", "a", 0), (4, loop, "en", "a", 0), (4, loop, "en", "a", 0), (5, " \t\n ", None, None, None)]
    out = [r.asDict(recursive=True) for r in periodic_runs(make(rows, DOCS)).collect()]
    assert len(out) == 6
    for r in out:
        has = r["doc_id"] in (None, 4)
        assert r["runs"] == ([{"start": 0, "length": 20, "period": 2}] if has else []) and r["collapsed"] == ("x y" if has else "")
    assert periodic_runs(make([], DOCS)).count() == 0


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    documents = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(documents)
    for d in documents:
        words = planted_tail(d["doc_id"], (d["text"] or "").encode().split())
        if len(words) > 1500:
            continue
        runs, r = brute_runs(words), got[d["doc_id"]]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(top or (None,) * 3))
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if top else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 and bool(r["n_runs"]) for d, r in got.items()) > 5
