import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from boxloom.llm import common
from boxloom.llm.byte_pairs import BytePairs, decode, encode, round_trip
from tests.llm.conftest import DOCS

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pairs():
    return BytePairs(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(5)
    fixed = ["", None, "a" * 3000, "=====" * 50, " " * 300 + "x", "a  b   c \n  d\n\n e ", "\t\n x\x1c y  z w \x85 q", "don't  we'll I'D", "日本語のテキスト" * 100, "🙂👨‍👩‍👧 x", "<|endoftext|>", "a \n", "a\n ", " \n \n"]
    fixed += ["".join(rnd.choice(letters) for _ in range(2000)) for letters in ("abcdefgh", "ab")]
    return fixed + ["".join(rnd.choice(" \n\tab.,1é' ") for _ in range(rnd.randrange(14))) for _ in range(800)]


def test_equals_library(pairs, reference):
    got = pairs.encode(texts())
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [reference.encode_ordinary(t or "") for t in texts()]
    assert pairs.decode(got) == [(t or "").encode() for t in texts()]
    with pytest.raises(ValueError):
        pairs.decode([np.array([60000], dtype="<u4").tobytes()])


def test_operator(make, reference):
    rows = [(1, "hello  world", "en", "s", 1), (1, "hello  world", "en", "s", 1), (None, None, None, None, None), (3, "", None, None, None)]
    got = decode(encode(make(rows, DOCS), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, np.frombuffer(r.ids, dtype="<u4").tolist(), bytes(r.decoded)) for r in got) == [
        (0, [], b""), (1, reference.encode_ordinary("hello  world"), b"hello  world"), (1, reference.encode_ordinary("hello  world"), b"hello  world"), (3, [], b"")]
    assert encode(make([], DOCS), PATH, public_tokenizers.PATTERN).count() == 0


def test_full_memory_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr("boxloom.llm.byte_pairs.KNOWN_UNITS", 40)
    own, rnd = BytePairs(PATH, public_tokenizers.PATTERN), random.Random(8)
    for _ in range(6):
        batch = [" ".join(rnd.choice(["zu", "wörter", "don't", "x1y2", "quagmires,", "."]) + str(rnd.randrange(9)) for _ in range(30)) for _ in range(3)]
        assert [np.frombuffer(g, dtype="<u4").tolist() for g in own.encode(batch)] == [reference.encode_ordinary(t) for t in batch]
    assert 0 < len(own.units) <= 40


def test_round_trip_in_one_worker(make, reference):
    rows = [(1, "hello  world ", "en", "s", 1), (None, None, None, None, None), (3, "a b\nc", None, None, None)]
    found = round_trip(make(rows, DOCS), PATH, public_tokenizers.PATTERN)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id or 0, np.frombuffer(r.ids, dtype="<u4").tolist(), bytes(r.decoded)) for r in found.collect()) == [
        (0, [], b""), (1, reference.encode_ordinary("hello  world "), b"hello  world "), (3, reference.encode_ordinary("a b\nc"), b"a b\nc")]


def test_a_worker_holds_one_model():
    common.release()
    assert common.resident("one", list) is common.resident("one", list)
    common.resident("two", list)
    assert list(common._RESIDENT) == ["two"]
    common.release()


def test_rows_are_decoded_in_groups(pairs, monkeypatch):
    monkeypatch.setattr("boxloom.llm.byte_pairs.DECODED_IDS", 5)
    coded = pairs.encode(texts()[:60])
    assert pairs.decode(coded) == [(t or "").encode() for t in texts()[:60]]
    assert pairs.decode([]) == []
