import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from boxloom.llm.common import file_system, fresh_folder
from boxloom.llm.records import TokenWriter, crc32c, framed, masked, payloads_of, read_records, write_records
from tests.llm.conftest import DOCS
from tests.llm.test_byte_pairs import texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_crc(data):
    value = 0xFFFFFFFF
    for b in data:
        value ^= b
        for _ in range(8):
            value = (value >> 1) ^ (0x82F63B78 if value & 1 else 0)
    return value ^ 0xFFFFFFFF


def test_checksums_and_frames():
    rnd = random.Random(3)
    data = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 3, 4, 5, 255, 256, 257, 1000, 5000)]
    assert crc32c(data).tolist() == [plain_crc(d) for d in data]
    assert crc32c([b"123456789"])[0] == 0xE3069283
    block, offsets = framed(data)
    assert payloads_of(block, offsets) == data
    assert int.from_bytes(block[8:12], "little") == int(masked(crc32c([(0).to_bytes(8, "little")]))[0])
    broken = bytearray(block)
    broken[-6] ^= 1
    with pytest.raises(ValueError):
        payloads_of(bytes(broken), offsets)


def test_writer_equals_library():
    writer = TokenWriter(PATH)
    assert [np.frombuffer(g, dtype="<u2").tolist() for g in writer.encode(texts())] == [writer.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts()]


def test_round_trip(spark, make):
    rows = [(i * 7 % 101, f"text number {i} " * (i % 9), "en", "s", 1) for i in range(101)] + [(None, None, None, None, None), (3, "again", None, None, None), (3, "again", None, None, None)]
    folder = fresh_folder(spark, "t")
    manifest = write_records(make(rows, DOCS), folder, PATH, files=3)
    got = sorted(read_records(manifest, folder, block_records=5).collect(), key=lambda r: r.start)
    writer, start = TokenWriter(PATH), 0
    for r, (d, t, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*writer.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    system, path = file_system(folder)
    assert len(system.get_file_info(__import__("pyarrow").fs.FileSelector(path))) == 2 * manifest.count()
    assert read_records(write_records(make([], DOCS), fresh_folder(spark, "t"), PATH), folder).count() == 0


def test_added_tokens_as_the_library_has_them():
    """A fresh tokenizer of the same file is the judge, also for texts that hold an added token's string."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    several = [*texts(), *(f for a in added for f in (a, f"a {a} b", f"x{a}y", f"{a}{a} end", f"a {a[:-1]} b"))]
    assert added and [np.frombuffer(g, dtype="<u2").tolist() for g in TokenWriter(PATH).encode(several)] == [library.encode(t or "", add_special_tokens=False).ids for t in several]
