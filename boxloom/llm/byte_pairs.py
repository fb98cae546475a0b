"""Byte-level BPE in DuckDB, one database in memory per Python worker, over partitions that Spark deals.

A text is split by the pattern of the vocabulary; every piece is encoded by itself.  Pieces become rows of (piece,
position, token); a recursive query joins neighbouring tokens with the merge table and contracts each piece's leftmost pair of
the least rank until nothing merges.  Decoding joins token ids with the vocabulary and concatenates by an ordered aggregate.

Only different pieces are encoded; the pieces a worker met first are remembered up to ``KNOWN_PIECES``, and the units between
blanks up to ``KNOWN_UNITS``.  ``round_trip`` encodes and decodes in one worker, which holds one database.  Long pieces use a
second form of the recursion that contracts all occurrences of the least pair at once where no later merge can come
in between, and that is restarted after a bounded number of levels, so its memory stays in proportion to the piece.

Defined cases: null text counts as empty and has no ids; repeated rows are encoded each; ids outside the vocabulary
fail; an empty table gives an empty result; columns besides the named ones are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import resident

# pieces that a worker remembers
KNOWN_PIECES = 600_000
# units behind a blank that a worker remembers with their ids
KNOWN_UNITS = 400_000
CHUNK_BYTES = 100_000
LONG_PIECE = 64
# ids that one aggregate decodes, unless a row has more
DECODED_IDS = 200_000
LEVEL_ROWS = 2_000_000
# A blank splits safely unless white space stands on both of its sides or it ends the text behind white space.
UNSAFE_BLANK = re.compile(r"\s (?:\s|$)")

# a row links to the place e of its following token, so that a level needs no order
SHORT_SQL = """
WITH RECURSIVE s(w, p, t, e, lvl) AS (
  SELECT w, p, t, coalesce(lead(p) OVER (PARTITION BY w ORDER BY p), -1), 0 FROM pieces
  UNION ALL
  (WITH ranked AS (SELECT a.*, b.e AS after, g.r FROM s a LEFT JOIN s b ON b.w = a.w AND b.p = a.e LEFT JOIN merges g ON g.k = a.t * 65536 + b.t),
        least AS (SELECT w, min(r * 65536 + p) AS best, arg_min(e, r * 65536 + p) AS gone FROM ranked GROUP BY w HAVING best IS NOT NULL)
   SELECT r.w, r.p, CASE WHEN r.p = best % 65536 THEN best // 65536 ELSE r.t END, CASE WHEN r.p = best % 65536 THEN r.after ELSE r.e END, r.lvl + 1
   FROM ranked r JOIN least USING (w) WHERE r.p <> gone))
SELECT s.w, s.p, s.t FROM s JOIN (SELECT w, max(lvl) AS lvl FROM s GROUP BY w) USING (w, lvl) ORDER BY s.w, s.p
"""

LONG_SQL = """
WITH RECURSIVE s(w, p, t, lvl) AS (
  SELECT w, p, t, 0 FROM pieces
  UNION ALL
  (WITH ranked AS (SELECT a.*, g.r, g.alone FROM (SELECT *, lead(t) OVER (PARTITION BY w ORDER BY p) AS n FROM s WHERE lvl < {levels}) a
                   LEFT JOIN merges g ON g.k = a.t * 65536 + a.n),
        hits AS (SELECT *, min(r) OVER (PARTITION BY w) AS m, row_number() OVER (PARTITION BY w ORDER BY p) AS i FROM ranked),
        chains AS (SELECT *, coalesce(r = m, false) AS hit, i - row_number() OVER (PARTITION BY w, coalesce(r = m, false) ORDER BY p) AS chain FROM hits WHERE m IS NOT NULL),
        taken AS (SELECT *, hit AND CASE WHEN alone THEN p = min(CASE WHEN hit THEN p END) OVER (PARTITION BY w)
                    ELSE row_number() OVER (PARTITION BY w, hit, chain ORDER BY p) % 2 = 1 END AS take FROM chains)
   SELECT w, p, t, lvl FROM (
     SELECT w, p, CASE WHEN take THEN r ELSE t END AS t, lvl + 1 AS lvl, coalesce(lag(take) OVER (PARTITION BY w ORDER BY p), false) AS gone FROM taken) WHERE NOT gone))
SELECT s.w, s.p, s.t FROM s JOIN (SELECT w, max(lvl) AS lvl FROM s GROUP BY w) USING (w, lvl) ORDER BY s.w, s.p
"""

DECODE_SQL = "SELECT string_agg(v.shown, '' ORDER BY c.p) FROM coded c JOIN vocabulary v USING (t)"
# pseudo token that ends a row when several rows are decoded at once, and how it shows
END_OF_ROW, ROW_SIGN = -1, chr(0x200)


class BytePairs:
    """Vocabulary and merge table in a DuckDB database."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.has_merges = self.has_vocabulary = False

    def _merges(self) -> None:
        """Table of token pairs and what they merge to, made by the first encoding."""
        if self.has_merges:
            return
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        a, b, r = (np.array(x, dtype=np.int64) for x in (left, right, rank))
        # a token that can merge on to a lower rank is contracted one occurrence at a time
        alone = np.isin(r, np.concatenate([a[a > r], b[b > r]]))
        self._table("merges", pa.table({"k": a * 65536 + b, "r": r, "alone": alone}))
        self.has_merges = True

    def _vocabulary(self) -> None:
        """Table of tokens, made by the first decoding; bytes show as U+0100 and on, so that no control character is in a SQL string."""
        if not self.has_vocabulary:
            shown = ["".join(chr(256 + x) for x in token) for token in self.ranks]
            self._table("vocabulary", pa.table({"t": pa.array([*self.ranks.values(), END_OF_ROW], pa.int64()), "shown": [*shown, ROW_SIGN]}))
            self.has_vocabulary = True

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _contracted(self, sql: str, rows: pa.Table) -> pa.Table:
        self.db.register("pieces", rows)
        result = self.db.sql(sql).to_arrow_table()
        self.db.unregister("pieces")
        return result

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece as little-endian 32-bit numbers."""
        self._merges()
        result, groups, size = {}, [[]], 0
        for piece in pieces:
            raw = piece.encode()
            if raw in self.ranks:
                result[piece] = self.ranks[raw].to_bytes(4, "little")
                continue
            if size + len(raw) > CHUNK_BYTES and groups[-1]:
                groups.append([])
                size = 0
            groups[-1].append((piece, raw))
            size += len(raw)
        for group in groups:
            for chosen, sql in (([g for g in group if len(g[1]) <= LONG_PIECE], SHORT_SQL), ([g for g in group if len(g[1]) > LONG_PIECE], LONG_SQL)):
                if not chosen:
                    continue
                lengths = np.array([len(raw) for _, raw in chosen])
                number = np.repeat(np.arange(len(chosen)), lengths)
                rows = pa.table({"w": number, "p": np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths), "t": self.first[np.frombuffer(b"".join(raw for _, raw in chosen), dtype=np.uint8)]})
                if sql is SHORT_SQL:
                    rows = self._contracted(sql, rows)
                else:
                    before = None
                    while before != rows.num_rows:
                        before = rows.num_rows
                        rows = self._contracted(sql.format(levels=max(8, LEVEL_ROWS // before)), rows)
                tokens = rows["t"].to_numpy().astype("<u4").tobytes()
                ends = np.cumsum(np.bincount(rows["w"].to_numpy(), minlength=len(chosen))) * 4
                begin = 0
                for (piece, _), end in zip(chosen, ends.tolist()):
                    result[piece] = tokens[begin:end]
                    begin = end
        return result

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        # between safe blanks a text falls into units whose pieces do not depend on their neighbours
        split = [([None] if not t else [t] if UNSAFE_BLANK.search(t) else t.split(" ")) for t in texts]
        heads = {s[0] for s in split if s[0] is not None}
        tails: set[str] = set()
        for s in split:
            tails.update(s[1:])
        held = tails & self.units.keys()
        tails -= held
        parts = {u: self.split(u) for u in heads} | {" " + u: self.split(" " + u) for u in tails}
        new = self.encode_pieces(list({p for found in parts.values() for p in found} - self.known.keys()))
        if len(self.known) + len(new) <= KNOWN_PIECES:
            self.known.update(new)
        value = lambda p: new[p] if p in new else self.known[p]
        head = {u: b"".join(map(value, parts[u])) for u in heads}
        tail = {u: b"".join(map(value, parts[" " + u])) for u in tails}
        if len(self.units) + len(tail) <= KNOWN_UNITS:
            self.units.update(tail)
            tail = self.units
        else:
            tail.update((u, self.units[u]) for u in held)
        return [b"" if s[0] is None else head[s[0]] + b"".join(map(tail.__getitem__, s[1:])) for s in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes that the ids of each row stand for."""
        result, group, size = [], [], 0
        for row in ids:
            if group and size + len(row) > 4 * DECODED_IDS:
                result += self._decoded(group)
                group, size = [], 0
            group.append(row)
            size += len(row)
        return result + self._decoded(group) if group else result

    def _decoded(self, ids: list[bytes]) -> list[bytes]:
        """Some rows by one ordered aggregate; a sign between rows parts them again."""
        self._vocabulary()
        values = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
        if len(values) and (values.max() > max(self.ranks.values()) or values.min() < 0):
            raise ValueError(f"token id {values.max()} is not in the vocabulary")
        ends = np.cumsum([len(x) // 4 for x in ids])
        self.db.register("coded", pa.table({"t": np.insert(values, ends, END_OF_ROW), "p": np.arange(len(values) + len(ids))}))
        shown = self.db.execute(DECODE_SQL).fetchall()[0][0] or ""
        self.db.unregister("coded")
        return [row.encode("utf-16-le")[::2] for row in shown.split(ROW_SIGN)[:-1]]


def coder(path: str, pattern: str) -> BytePairs:
    """The coder of this worker process, built once."""
    return resident(("byte_pairs", path, pattern), lambda: BytePairs(path, pattern))


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit token ids) of every whole text.

    ``path`` is the rank file, which every worker can read; ``pattern`` splits texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder(path, pattern).encode(batch.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids binary")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (binary) of rows that ``encode`` made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(coder(path, pattern).decode(ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of every whole text: ``decode`` of ``encode`` in one pass, so that a task has one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coder(path, pattern)
        for batch in batches:
            ids = both.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(both.decode(ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids binary, decoded binary")
