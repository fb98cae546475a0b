"""Trie nodes against prefixes listed one by one."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from boxloom.llm.conversation_trie import keyed_turns, prefix_trie

TURNS = "conv_id bigint, turn int, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, ids):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    sequences = {c: [(r, x) for _, _, r, x in sorted(own[c])] for c in ids}
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(path))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [1, 6, 40, 100_000])
def test_equals_listing(spark, limit):
    rng = random.Random(limit)
    rows = []
    for c in range(60):
        length = rng.choice([0, 1, 2, 3, 5, 9])
        for t in range(length):
            rows.append((c * 7, t, rng.choice(["user", "bot"]) if t > 2 else "user", rng.choice(["a b", "c", "", "d  e\tf"]) if rng.random() < 0.6 else "hot turn"))
    rows += [(1000 + k, t, "user", f"same {t}") for k in range(30) for t in range(4)] + [(2000, t, "u", "long way") for t in range(60)]
    ids = sorted({r[0] for r in rows} | {5000, 5001})
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    got = prefix_trie(keyed_turns(turns), spark.createDataFrame([(i,) for i in ids], "conv_id bigint"), limit)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, ids)


def test_cases(spark, make):
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (2, 5, "", ""), (3, 0, "user", "w " * 50_000)]
    got = prefix_trie(keyed_turns(make(rows, TURNS).withColumnRenamed("n", "head")), make([(1,), (1,), (2,), (3,), (None,)], "conv_id bigint"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, [1, 2, 3])
    empty = make([], TURNS)
    assert prefix_trie(keyed_turns(empty), empty.select("conv_id")).count() == 0
