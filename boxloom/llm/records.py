"""Token ids in length-delimited binary records with masked checksums and a separate offset index.

Data file: for each record 8 bytes of length, 4 bytes of masked CRC-32C of the length, the payload, 4 bytes of its masked CRC-32C
(little-endian).  Payload: 8 bytes of document id, 1 byte that is 1 when there is an id, 1 byte of id width (2 or 4), then the
token ids.  Index file: for each record the offset and the number of ids, 8 bytes each, so a reader can visit records in
any order.

Documents are dealt to files by ranges of their id, so files in order hold ids in order; a file is written under a name
of its attempt and renamed, so a lost executor leaves no half file.  Ids are written in as few bytes as the vocabulary needs.

Defined cases: null text is empty and has the end id alone; a null id comes first; rows that share an id are ordered by text,
so repeated rows are repeated records; an empty table gives no file and an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.llm.byte_pairs import UNSAFE_BLANK
from boxloom.llm.common import file_system, fresh_folder, stored

# Fixed values of the record format: the CRC-32C polynomial (reflected) and the mask.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
LANE = 256
# units that a writing worker remembers (about 150 bytes each)
KNOWN_UNITS = 1_200_000
# one pre-token whatever the Unicode version: a word of Latin letters with at most one blank before it
PLAIN_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_TABLE = _byte_table()


def _tables_of(images: np.ndarray) -> np.ndarray:
    """Lookup tables (4 x 256) of a linear map from the images of the 32 unit registers."""
    tables = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for bit in range(8):
            tables[byte, 1 << bit : 2 << bit] = tables[byte, : 1 << bit] ^ images[8 * byte + bit]
    return tables


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0, x & 255] ^ tables[1, (x >> 8) & 255] ^ tables[2, (x >> 16) & 255] ^ tables[3, x >> 24]


def _shifts() -> list[np.ndarray]:
    """Maps of a register over LANE zero bytes, twice as many, and so on."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(LANE):
        images = _TABLE[images & 255] ^ (images >> 8)
    maps = []
    for _ in range(32):
        maps.append(_tables_of(images))
        images = _apply(maps[-1], images)
    return maps


_SHIFTS = _shifts()


def crc32c(buffers: list[bytes]) -> np.ndarray:
    """CRC-32C of each buffer, all of them at once.

    Buffers are padded with zeros in front to whole lanes, which leaves the register at zero; lanes run side by side
    and are then moved to their place and added up.
    """
    sizes = np.array([len(b) for b in buffers], dtype=np.int64)
    if not len(sizes):
        return np.zeros(0, dtype=np.uint32)
    # the initial register of ones is the same as ones added to the first four bytes; shorter buffers get four zero bytes' worth of room
    lanes = np.maximum(-(-sizes // LANE), 1)
    ends = np.cumsum(lanes) * LANE
    data = np.zeros(int(ends[-1]), dtype=np.uint8)
    joined = np.frombuffer(b"".join(buffers), dtype=np.uint8)
    begin = ends - sizes
    data[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(joined))] = joined
    for k in range(4):
        at = begin + k
        data[at[sizes > k]] ^= 255
    register = np.zeros(int(lanes.sum()), dtype=np.uint32)
    for column in data.reshape(-1, LANE).T:
        register = _TABLE[(register ^ column) & 255] ^ (register >> np.uint32(8))
    to_go = np.repeat(np.cumsum(lanes), lanes) - 1 - np.arange(len(register))
    for k, tables in enumerate(_SHIFTS):
        moved = (to_go >> k) & 1 == 1
        if not moved.any():
            if not (to_go >> k).any():
                break
            continue
        register[moved] = _apply(tables, register[moved])
    total = np.bitwise_xor.reduceat(register, np.cumsum(lanes) - lanes)
    for i in np.flatnonzero(sizes < 4):
        value = np.uint32(0xFFFFFFFF)
        for b in buffers[i]:
            value = _TABLE[(value ^ np.uint32(b)) & 255] ^ (value >> np.uint32(8))
        total[i] = value
    return total ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def framed(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Records of the payloads, and the offset of each."""
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    heads, bodies = masked(crc32c(lengths)), masked(crc32c(payloads))
    parts = [x for n, h, p, b in zip(lengths, heads.tolist(), payloads, bodies.tolist()) for x in (n, h.to_bytes(4, "little"), p, b.to_bytes(4, "little"))]
    return b"".join(parts), np.cumsum([0] + [len(p) + 16 for p in payloads])[:-1]


def payloads_of(block: bytes, offsets: np.ndarray) -> list[bytes]:
    """Payloads of records that lie in ``block``, after a check of their lengths and checksums."""
    payloads, lengths, heads, bodies = [], [], [], []
    for at in offsets.tolist():
        lengths.append(block[at : at + 8])
        n = int.from_bytes(lengths[-1], "little")
        heads.append(int.from_bytes(block[at + 8 : at + 12], "little"))
        payloads.append(block[at + 12 : at + 12 + n])
        bodies.append(int.from_bytes(block[at + 12 + n : at + 16 + n], "little"))
    if masked(crc32c(lengths)).tolist() != heads or masked(crc32c(payloads)).tolist() != bodies:
        raise ValueError("a record's checksum differs")
    return payloads


class TokenWriter:
    """Encodes texts with a tokenizers file; words seen first are remembered."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the library finds the strings of added tokens before it splits a text, so a text that holds one goes through it whole
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([UNSAFE_BLANK.pattern, *map(re.escape, sorted(added))]))
        self.width, self.code = (2, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (4, "I")
        self.known: dict[str, bytes] = {}
        # the byte alphabet of the vocabulary: printable bytes stand for themselves, the others follow from U+0100 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def unit(self, unit: str) -> bytes:
        """Ids of a unit that stands between safe blanks."""
        if unit in self.known:
            return self.known[unit]
        if PLAIN_WORD.fullmatch(unit):
            value = self.packed([t.id for t in self.tokenizer.model.tokenize(unit.encode().decode("latin-1").translate(self.shown))])
        elif unit[-1:] in (".", ",") and PLAIN_WORD.fullmatch(unit[:-1]):
            return self.unit(unit[:-1]) + self.unit(unit[-1])
        else:
            value = self.packed(self.tokenizer.encode(unit, add_special_tokens=False).ids)
        if len(self.known) < KNOWN_UNITS:
            self.known[unit] = value
        return value

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text, packed."""
        result = []
        for text in texts:
            if not text:
                result.append(b"")
            elif self.whole.search(text):
                result.append(self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids))
            else:
                first, *rest = text.split(" ")
                unit, known = self.unit, self.known
                result.append(unit(first) + b"".join([known.get(w) or unit(w) for w in [" " + r for r in rest]]))
        return result


_WRITERS: dict[str, TokenWriter] = {}


def _writer(path: str) -> TokenWriter:
    if path not in _WRITERS:
        _WRITERS[path] = TokenWriter(path)
    return _WRITERS[path]


def write_records(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, files: int | None = None) -> DataFrame:
    """Write the token ids of ``documents`` in ascending id order; returns the stored manifest.

    ``folder`` is a URI that every executor reaches; ``files`` is the number of data files (default: the session's shuffle
    partitions).  Manifest: ``file_no``, ``name``, ``n_records``, ``n_tokens``, ``first_token`` (ids in the files before).
    """
    spark = documents.sparkSession
    count = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(count, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number, attempt = context.partitionId(), context.taskAttemptId()
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        name = f"part-{number:06d}"
        draft = f"{path}/.{name}-{attempt}"
        writer = _writer(tokenizer_path)
        end = writer.packed([end_id])
        records = tokens = at = 0
        data = index = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if data is None:
                data, index = system.open_output_stream(f"{draft}.tokens"), system.open_output_stream(f"{draft}.index")
            coded = [ids + end for ids in writer.encode(batch.column(1).to_pylist())]
            ids = batch.column(0).to_pylist()
            block, offsets = framed([(d or 0).to_bytes(8, "little", signed=True) + bytes([d is not None, writer.width]) + x for d, x in zip(ids, coded)])
            sizes = np.array([len(x) // writer.width for x in coded], dtype="<u8")
            index.write(np.column_stack([(offsets + at).astype("<u8"), sizes]).tobytes())
            data.write(block)
            records, tokens, at = records + len(ids), tokens + int(sizes.sum()), at + len(block)
        if data is not None:
            data.close()
            index.close()
            for kind in ("tokens", "index"):
                system.move(f"{draft}.{kind}", f"{path}/{name}.{kind}")
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int32()), "name": [name], "n_records": pa.array([records], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    manifest = stored(rows.mapInArrow(run, "file_no int, name string, n_records bigint, n_tokens bigint"), "manifest")
    # one row for each file
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_records(manifest: DataFrame, folder: str, block_records: int = 2000) -> DataFrame:
    """Documents read back by offset index: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    A task reads ``block_records`` records at a time; lengths and checksums are verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{path}/{row['name']}.index") as index:
                    table = np.frombuffer(index.read(), dtype="<u8").reshape(-1, 2).astype(np.int64)
                start = row["first_token"]
                with system.open_input_file(f"{path}/{row['name']}.tokens") as data:
                    size = data.size()
                    for i in range(0, len(table), block_records):
                        part = table[i : i + block_records]
                        end = int(table[i + block_records, 0]) if i + block_records < len(table) else size
                        data.seek(int(part[0, 0]))
                        payloads = payloads_of(data.read(end - int(part[0, 0])), part[:, 0] - part[0, 0])
                        ids = [np.frombuffer(p, dtype=f"<u{p[9]}", offset=10) for p in payloads]
                        if [len(x) for x in ids] != part[:, 1].tolist():
                            raise ValueError("an index entry differs from its record")
                        sizes = part[:, 1]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([int.from_bytes(p[:8], "little", signed=True) if p[8] else None for p in payloads], pa.int64()),
                            "start": pa.array(start + np.cumsum(sizes) - sizes), "n_tokens": pa.array(sizes),
                            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())})
                        start += int(sizes.sum())

    # a fixed number of tasks: the few rows of a manifest would else be coalesced into one
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(tasks, "file_no").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(spark: SparkSession, documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write to a new folder of the shared storage and read back."""
    folder = fresh_folder(spark, "token-records")
    return read_records(write_records(documents, folder, tokenizer_path), folder)
