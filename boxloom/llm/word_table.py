"""Byte-level BPE through a table of distinct words.

A text is split into words at white space where the tokenizer certainly begins a new token, so the ids of a text are the ids of
its words in order.  Documents are gathered into blocks; a block numbers its distinct words and keeps each document as a list
of numbers.  The words of all blocks are dealt to buckets by their hash; a bucket encodes each of its distinct words once with
the tokenizers library and answers every block; blocks join these ids back by word number.  Decoding joins ids with the
vocabulary's pieces, whose size the vocabulary bounds, so they are sent to every task.

Word numbers depend on the order of rows, so a block's documents and words are written to the shared folder before anything
reads them.  A block ends after ``BLOCK_WORDS`` distinct words or ``BLOCK_CHARACTERS`` characters; there is a bucket for every
``BUCKET_CHARACTERS`` of the corpus.  A frequent word comes once a block, not once an occurrence.

Defined cases: null text is empty and has no ids; repeated rows are encoded each; a null id is kept; texts that hold an added
token's string (found by the library before it splits) and very long words are words of their own; an empty table gives an
empty result; columns besides ``doc_id`` and ``text`` are ignored; ids outside the vocabulary decode to nothing, as in the library.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import file_system, fresh_folder, stored

BLOCK_WORDS, BLOCK_CHARACTERS = 500_000, 32_000_000
BUCKET_CHARACTERS = 12_000_000
# documents of one result batch hold about this many ids
BATCH_IDS = 1_000_000
# White space (and signs that some tables count as white space) on which no word begins or ends, and before which none begins.
ODD = r"\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
# A word begins at a blank or line end that is followed by a sign other than white space: the last sign of white space never
# shares a token with those before it, and a blank belongs to the letters, digits or marks behind it.
BEGIN = re.compile(f"(?=[ \\n][^ \\n{ODD}])")
# texts in which some blank or line end may begin no word
UNEVEN = re.compile(f"[{ODD}]|[ \\n](?:[ \\n]|$)")


def split_words(text: str) -> list[str]:
    """The words of a text; joined they are the text."""
    if not text:
        return []
    if UNEVEN.search(text):
        return [w for w in BEGIN.split(text) if w]
    first, *rest = text.replace("\n", " \n").split(" ")
    words = [w if w[0] == "\n" else " " + w for w in rest]
    return [first, *words] if first else words


def added_tokens(path: str) -> list[str]:
    """Strings of the tokenizer's added tokens."""
    with open(path, encoding="utf-8") as file:
        return [t["content"] for t in json.load(file)["added_tokens"]]


class _Numbers(dict):
    """Words in the order in which they came."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


def _squeezed(values: np.ndarray) -> bytes:
    """Integers by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the items of each stretch, one stretch after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class _Block:
    """Documents as lists of word numbers, and the numbered words."""

    def __init__(self):
        self.known, self.ids, self.sizes, self.numbers, self.characters = _Numbers(), [], [], [], 0

    def add(self, doc_id: int | None, text: str, words: list[str]) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.numbers.append(np.fromiter(map(self.known.__getitem__, words), dtype=np.uint32, count=len(words)))
        self.characters += len(text)

    def full(self) -> bool:
        return len(self.known) >= BLOCK_WORDS or self.characters >= BLOCK_CHARACTERS

    def documents(self) -> pa.Table:
        flat = np.concatenate(self.numbers)
        return pa.table({"doc_ids": pa.array([self.ids], pa.list_(pa.int64())), "sizes": pa.array([self.sizes], pa.list_(pa.int64())), "numbers": pa.array([_squeezed(flat)], pa.large_binary())})

    def packs(self, block: str, buckets: int) -> pa.RecordBatch:
        """The words by bucket: their numbers as steps, their sizes in bytes, and the bytes."""
        words = pa.array(list(self.known), pa.large_binary())
        bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in self.known), dtype=np.int64, count=len(words))
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cuts))
        if not len(some):  # a block without words is answered all the same
            some = np.zeros(1, dtype=np.int64)
        words = words.take(pa.array(order))
        ends, data = np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1], words.buffers()[2]
        squeeze = zstandard.ZstdCompressor(level=3).compress
        parts = [(order[cuts[b] : cuts[b + 1]], ends[cuts[b] : cuts[b + 1] + 1]) for b in some]
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array(some, pa.int64()), "block": pa.array([block] * len(some), pa.string()), "numbers": pa.array([_squeezed(np.diff(n, prepend=0)) for n, _ in parts], pa.binary()),
            "sizes": pa.array([_squeezed(np.diff(e)) for _, e in parts], pa.binary()),
            "words": pa.array([squeeze(data[int(e[0]) : int(e[-1])].to_pybytes() if len(n) else b"") for n, e in parts], pa.binary())})


def word_blocks(documents: DataFrame, path: str, folder: str, buckets: int) -> DataFrame:
    """Write each block's documents to a file of ``folder``; return its distinct words by bucket.

    Rows: ``bucket``, ``block`` (the file), ``numbers``, ``sizes`` and ``words`` (compressed).  A file is named by its attempt, so the
    rows of a committed attempt always speak of their own file.
    """
    odd = added_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet
        from pyspark import TaskContext

        context, serial, block = TaskContext.get(), 0, _Block()
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)

        def finished() -> pa.RecordBatch:
            name = f"block-{context.partitionId()}-{context.taskAttemptId()}-{serial}.parquet"
            with system.open_output_stream(f"{place}/{name}") as file:
                parquet.write_table(block.documents(), file, compression="none")
            return block.packs(name, buckets)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                block.add(doc_id, text, [text] if any(t in text for t in odd) else split_words(text))
                if block.full():
                    yield finished()
                    block, serial = _Block(), serial + 1
        if block.ids:
            yield finished()

    rows = documents.select(documents["doc_id"].cast("long"), documents["text"])
    return rows.mapInArrow(run, "bucket bigint, block string, numbers binary, sizes binary, words binary")


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The library's tokenizer, once a worker; whatever the file says, it neither truncates nor pads."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encoded(dealt: DataFrame, path: str) -> DataFrame:
    """Each distinct word of a bucket encoded once: ``block``, ``numbers``, and ``sizes`` and ``ids`` of its words (compressed)."""

    def run(table: pa.Table) -> pa.Table:
        tokenizer = _tokenizer(path)
        known, ids, places = _Numbers(), [], []
        spread = zstandard.ZstdDecompressor().decompress
        for sizes, data in zip(table.column("sizes").to_pylist(), table.column("words").to_pylist()):
            ends = np.cumsum(np.concatenate([[0], _spread(sizes)]))
            words = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(spread(data))]).to_pylist()
            places.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
        words = list(known)
        for at in range(0, len(words), 2000):
            ids += [x.ids for x in tokenizer.encode_batch_fast(words[at : at + 2000], add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        flat, starts = np.array([x for word in ids for x in word], dtype=np.int64), np.cumsum(sizes) - sizes
        return pa.table({
            "block": table.column("block"), "numbers": table.column("numbers"), "sizes": pa.array([_squeezed(sizes[p]) for p in places], pa.binary()),
            "ids": pa.array([_squeezed(flat[_ragged(starts[p], sizes[p])]) for p in places], pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(run, "block string, numbers binary, sizes binary, ids binary")


def _assembled(block: pa.Table, parts: pa.Table) -> Iterator[pa.RecordBatch]:
    """The ids of each document of a block, from the answers of the buckets."""
    numbers, doc_sizes = _spread(block.column("numbers")[0].as_py()), np.array(block.column("sizes")[0].as_py(), dtype=np.int64)
    at = [np.cumsum(_spread(x)) for x in parts.column("numbers").to_pylist()]
    each = [_spread(x) for x in parts.column("sizes").to_pylist()]
    flat = np.concatenate([_spread(x) for x in parts.column("ids").to_pylist()])
    places, sizes = np.concatenate(at), np.concatenate(each)
    start, size = np.zeros(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
    start[places], size[places] = np.cumsum(sizes) - sizes, sizes
    doc_ids, ends = block.column("doc_ids")[0].as_py(), np.cumsum(doc_sizes)
    # cut where about BATCH_IDS ids are full
    totals = np.concatenate([[0], np.cumsum(size[numbers])])[np.concatenate([[0], ends])]
    first = 0
    while first < len(doc_ids):
        last = max(first + 1, int(np.searchsorted(totals, totals[first] + BATCH_IDS)) - 1)
        words = numbers[ends[first] - doc_sizes[first] : ends[last - 1]]
        data = flat[_ragged(start[words], size[words])].astype("<u4").tobytes()
        cuts = ((totals[first : last + 1] - totals[first]) * 4).tolist()
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids[first:last], pa.int64()), "ids": pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())})
        first = last


def encode(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (32-bit little-endian) of each whole text, as ``Tokenizer.from_file(path)`` gives them."""
    folder = fresh_folder(documents.sparkSession, "word-blocks")
    characters = documents.agg(F.sum(F.char_length("text"))).first()[0] or 0
    dealt = stored(word_blocks(documents, path, folder, characters // BUCKET_CHARACTERS + 1), "word-packs")

    def join(parts: pa.Table) -> pa.Table:
        from pyarrow import parquet

        system, place = file_system(folder)
        with system.open_input_file(f"{place}/{parts.column('block')[0].as_py()}") as file:
            block = parquet.read_table(file)
        return pa.Table.from_batches(_assembled(block, parts), schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))

    return _encoded(dealt, path).groupBy("block").applyInArrow(join, "doc_id bigint, ids binary")


def vocabulary(path: str) -> list[bytes | None]:
    """The bytes of each id's piece; added tokens stand for their own text."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    # the byte alphabet: printable bytes stand for themselves, the others follow from U+0100 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    shown = content["model"]["vocab"] | {t["content"]: t["id"] for t in content["added_tokens"]}
    pieces: list[bytes | None] = [None] * (max(shown.values()) + 1)
    for piece, number in shown.items():
        pieces[number] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return pieces


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` with ``decoded``, the text of its ``ids``, special tokens included, and ``id_text``, the ids in decimal, joined by commas."""
    pieces = coded.sparkSession.sparkContext.broadcast([p or b"" for p in vocabulary(path)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = dict(enumerate(pieces.value))
        shown = [str(i) for i in piece]
        for batch in batches:
            texts, decimals = [], []
            for data in batch.column(1).to_pylist():
                ids = np.frombuffer(data, dtype="<u4").tolist()
                texts.append(b"".join([piece.get(i, b"") for i in ids]).decode("utf-8", "replace"))
                decimals.append(",".join([shown[i] if i < len(shown) else str(i) for i in ids]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(decimals, pa.string())], names=["doc_id", "ids", "decoded", "id_text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, decoded string, id_text string")
