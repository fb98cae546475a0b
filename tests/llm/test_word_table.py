"""Ids and texts against the tokenizers library on whole texts."""

import random

import public_tokenizers
import pytest

from boxloom.llm import word_table
from tests.llm.conftest import DOCS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def unpacked(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def test_words_are_cut_between_tokens(library):
    rng = random.Random(3)
    signs = [" ", " ", " ", "\n", "\n", "\t", "\r", "\x1c", "\x85", " ", " ", "　", "​", "a", "b", "é", "'s", "'", "7", "½", "!", "。", "字", "🙂", "̈", "﻿", "\x00"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        words = word_table.split_words(text)
        assert "".join(words) == text
        assert [i for w in words for i in library.encode(w, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


def test_equals_library(spark, make, library, monkeypatch):
    monkeypatch.setattr(word_table, "BLOCK_CHARACTERS", 3000)
    monkeypatch.setattr(word_table, "BUCKET_CHARACTERS", 9000)
    texts = [None, "", "plain words here", "plain words here", "a <|endoftext|> b", "<|endoftext|>", " lead", "tail ", "two  blanks\n\nand lines\nhere", "naïve 'quoted' don't 12 ½", "字 字。\n字", "w" * 40_000, "x y " * 9000]
    rows = [(k if k else None, t, "en", "s", 1) for k, t in enumerate(texts)] + [(k, t, "en", "s", 1) for k, t in enumerate(texts) if k in (3, 4)]
    out = word_table.decode(word_table.encode(make(rows, DOCS).repartition(3), PATH), PATH).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    for r in out:
        text = texts[r["doc_id"] or 0] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert unpacked(r["ids"]) == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False) == text


def test_empty_table(spark, make):
    assert word_table.decode(word_table.encode(make([], DOCS), PATH), PATH).count() == 0


def test_only_empty_texts(spark, make):
    out = word_table.encode(make([(1, "", "en", "s", 0), (2, None, "en", "s", 0)], DOCS), PATH).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2] and all(r["ids"] == b"" for r in out)


def test_pieces_that_are_no_text(spark, library):
    coded = spark.createDataFrame([(1, bytearray(b"".join(i.to_bytes(4, "little") for i in (50256, 222, 64, 60_000))))], "doc_id bigint, ids binary")
    assert word_table.decode(coded, PATH).first()["decoded"] == library.decode([50256, 222, 64, 60_000], skip_special_tokens=False)
