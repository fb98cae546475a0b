"""Stretches of words that repeat with a period, found online by catchers over dyadic blocks.

A text is a stream of word codes.  As soon as a block of ``m = 2^l`` words that starts at a multiple of ``m`` is complete, a
catcher waits for the block to come again ``q`` words later, ``2m - 1 <= q <= 4m - 2``; every window of ``q`` words holds such a
block, so the first half of every square is caught on its level.  Each appended word completes one window a level, and exactly
two catchers of the level wait for it.  A catch opens a chain of period ``q`` whose suffix comparison goes back as far as the
words agree and then forth with every further word; when it has agreed over ``q`` words a square is reported, and all squares
of a chain are one run.  Comparisons use 64-bit hashes of all windows of ``2^l`` words and are confirmed on the words.

The texts of an Arrow batch are one stream, with a separate sign behind each; a stream is appended in pieces of bounded size.
Work is in proportion to words times levels.  Memory is 8 bytes for every word and level of the texts of a batch.

Defined cases: a null or empty text has no words and no runs; ties, repeated rows and null ids are rows like any other; an empty
table gives an empty result; very long texts are appended piece by piece; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxloom.llm.common import mix

# words appended at a time
PIECE = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.zeros(0, dtype=np.int64)


class SquareCatcher:
    """Runs of a stream of codes (non-negative integers); ``END`` codes (negative, each used once) separate texts."""

    def __init__(self, longest: int, seed: int = 0):
        self.codes = _NONE
        self.windows = [np.zeros(0, dtype=np.uint64)]
        self.seed = np.uint64(seed * 2 + 1)
        # levels whose catchers can see a square inside a text of ``longest`` words
        self.levels = 1
        while 4 * (1 << self.levels) - 2 <= longest:
            self.levels += 1
        # levels for comparisons, which go over whole texts
        self.tall = max(self.levels, int(longest).bit_length())
        self.open = np.zeros((0, 3), dtype=np.int64)  # period, first agreeing word, first word not compared yet
        self.closed: list[np.ndarray] = []  # period, first word, end of agreement

    def append(self, codes: np.ndarray) -> None:
        before = len(self.codes)
        self.codes = np.concatenate([self.codes, codes])
        self._hash(before)
        self._advance()
        self._catch(before)

    def finish(self) -> np.ndarray:
        """All runs as rows (start, length, period), by start and period; the period is the smallest of the run."""
        chains = np.concatenate([*self.closed, self.open])
        period, left, right = chains[(chains[:, 2] - chains[:, 1]) >= chains[:, 0]].T
        for q, a, b in zip(period.tolist(), left.tolist(), right.tolist()):
            if not np.array_equal(self.codes[a:b], self.codes[a + q : b + q]):
                raise HashCollision
        runs = np.unique(np.column_stack([left, right + period - left, period]), axis=0)
        # a multiple of the smallest period gives the same stretch
        first = np.ones(len(runs), dtype=bool)
        first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
        return runs[first]

    def _hash(self, before: int) -> None:
        """Hashes of the windows that the new words complete."""
        size = len(self.codes)
        new = mix(self.codes[before:].astype(np.uint64) * _STEP + self.seed)
        self.windows[0] = np.concatenate([self.windows[0], new])
        for level in range(1, self.tall):
            half, count = 1 << (level - 1), size - (1 << level) + 1
            if len(self.windows) == level:
                self.windows.append(np.zeros(0, dtype=np.uint64))
            below, known = self.windows[level - 1], len(self.windows[level])
            if count > known:
                new = mix(below[known:count] * _STEP + below[known + half : count + half])
                self.windows[level] = np.concatenate([self.windows[level], new])

    def _forth(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from ``a`` and ``b`` (behind ``a``) on."""
        done = np.zeros_like(a)
        for level in range(self.tall - 1, -1, -1):
            hashes, m = self.windows[level], 1 << level
            if len(hashes):
                # a difference is at most one window of each size away, but for the largest, which may follow itself
                while True:
                    at = b + done
                    same = (at < len(hashes)) & (hashes[np.minimum(a + done, len(hashes) - 1)] == hashes[np.minimum(at, len(hashes) - 1)])
                    done[same] += m
                    if level < self.tall - 1 or not same.any():
                        break
        return done

    def _back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree before ``a`` and ``b`` (behind ``a``)."""
        done = np.zeros_like(a)
        for level in range(self.tall - 1, -1, -1):
            hashes, m = self.windows[level], 1 << level
            if len(hashes):
                while True:
                    at = a - done - m
                    same = (at >= 0) & (hashes[np.maximum(at, 0)] == hashes[np.maximum(b - done - m, 0)])
                    done[same] += m
                    if level < self.tall - 1 or not same.any():
                        break
        return done

    def _settle(self, chains: np.ndarray) -> None:
        """Chains that reach the end of the stream stay open."""
        at_end = chains[:, 0] + chains[:, 2] == len(self.codes)
        self.open = np.concatenate([self.open, chains[at_end]])
        ended = chains[~at_end]
        self.closed.append(ended[(ended[:, 2] - ended[:, 1]) >= ended[:, 0]])

    def _advance(self) -> None:
        """Compare the open chains with the new words."""
        chains, self.open = self.open, self.open[:0]
        if len(chains):
            chains[:, 2] += self._forth(chains[:, 2], chains[:, 2] + chains[:, 0])
            self._settle(chains)

    def _caught(self, level: int, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of the level and the later starts at which the new words complete the block again."""
        m, hashes = 1 << level, self.windows[level]
        # the catchers that still wait: their last window ends behind the old end
        first = max(0, -(-(before - 5 * m + 3) // m)) * m
        if level < 4:
            found = []
            for q in range(2 * m - 1, 4 * m - 1):
                later = hashes[first + q :: m]
                found.append(first + m * np.flatnonzero(hashes[first::m][: len(later)] == later))
            blocks = np.concatenate(found)
            starts = blocks + np.repeat(np.arange(2 * m - 1, 4 * m - 1), [len(f) for f in found])
        else:
            whole = max(0, (len(hashes) - first - 4 * m + 1) // m + 1) if len(hashes) >= first + 4 * m - 1 else 0
            later = np.lib.stride_tricks.as_strided(hashes[first + 2 * m - 1 :], (whole, 2 * m), (8 * m, 8)) if whole else np.zeros((0, 2 * m), dtype=np.uint64)
            row, shift = np.nonzero(hashes[first : first + whole * m : m][:, None] == later)
            rows, shifts = [row], [shift]
            for k in range(whole, -(-max(0, len(hashes) - first) // m)):  # the last catchers have not seen all their windows
                at = np.flatnonzero(hashes[first + k * m + 2 * m - 1 : first + k * m + 4 * m - 1] == hashes[first + k * m])
                rows.append(np.full(len(at), k))
                shifts.append(at)
            blocks = first + m * np.concatenate(rows)
            starts = blocks + 2 * m - 1 + np.concatenate(shifts)
        new = starts + m > before
        return blocks[new], starts[new]

    def _catch(self, before: int) -> None:
        size = len(self.codes)
        # period and end of a run that covers a place, for catches of multiples of its period
        period, end = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        known = {(q, a) for q, a, _ in np.concatenate([*self.closed, self.open]).tolist()}
        for q, a, b in np.concatenate([*self.closed, self.open]).tolist():
            if b - a >= q:
                period[a : b + q], end[a : b + q] = q, b + q
        for level in range(min(self.levels, len(self.windows))):
            m = 1 << level
            blocks, starts = self._caught(level, before)
            if not len(blocks):
                continue
            q = starts - blocks
            p = period[blocks]
            inside = (p > 0) & (starts + m <= end[blocks]) & (q % np.maximum(p, 1) == 0)
            blocks, q = blocks[~inside], q[~inside]
            order = np.lexsort((blocks, q))
            blocks, q = blocks[order], q[order]
            # neighbouring blocks with one period are one chain
            head = np.ones(len(blocks), dtype=bool)
            head[1:] = (q[1:] != q[:-1]) | (blocks[1:] - blocks[:-1] != m)
            blocks, q = blocks[head], q[head]
            left = blocks - self._back(blocks, blocks + q)
            right = blocks + self._forth(blocks, blocks + q)
            chains = np.unique(np.column_stack([q, left, right]), axis=0)
            fresh = np.array([(x, a) not in known for x, a, _ in chains.tolist()], dtype=bool)
            chains = chains[fresh]
            if len(chains):
                self._settle(chains)
                for x, a, b in chains.tolist():
                    known.add((x, a))
                    if b - a >= x:
                        period[a : b + x], end[a : b + x] = x, b + x


class HashCollision(Exception):
    """Different windows with one hash: the stream is read again with another seed."""


def runs_of(texts: list[np.ndarray], piece: int = PIECE) -> list[np.ndarray]:
    """Runs (start, length, period) of each text, given as word codes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    stream = np.concatenate([x for k, t in enumerate(texts) for x in (t, np.array([-k - 1]))]).astype(np.int64)
    seed = 0
    while True:
        catcher = SquareCatcher(int(sizes.max()), seed)
        try:
            for at in range(0, len(stream), piece):
                catcher.append(stream[at : at + piece])
            runs = catcher.finish()
            break
        except HashCollision:
            seed += 1
    begins = np.cumsum(sizes + 1) - sizes - 1
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    runs[:, 0] -= begins[owner]
    return [runs[cuts[k] : cuts[k + 1]] for k in range(len(texts))]


def periodic_runs(documents: DataFrame, least: int = 12, plant=None) -> DataFrame:
    """Runs of at least ``max(least, 2 * period)`` words of each document, and the text without their repeats.

    ``plant``, a function of (doc_id, words), may replace the words of a document.  Returns ``doc_id``, ``n_words``, ``runs``
    (start, length, period by start and period) and ``collapsed``: the words that no run holds behind its first period,
    joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            # white space of the contract is the ASCII white space of bytes.split
            words = [(text or "").encode().split() for text in batch.column(1).to_pylist()]
            if plant is not None:
                words = [plant(i, w) for i, w in zip(ids, words)]
            codes: dict[bytes, int] = {}
            texts = [np.fromiter((codes.setdefault(w, len(codes)) for w in ws), dtype=np.int64, count=len(ws)) for ws in words]
            found, collapsed = [], []
            for ws, runs in zip(words, runs_of(texts)):
                runs = runs[runs[:, 1] >= least]
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()])
                if len(runs):
                    step = np.zeros(len(ws) + 1, dtype=np.int64)
                    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
                    ws = [ws[k] for k in np.flatnonzero(np.cumsum(step)[:-1] == 0).tolist()]
                collapsed.append(b" ".join(ws))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([len(w) for w in words], pa.int64()),
                "runs": pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                "collapsed": pa.array([c.decode() for c in collapsed], pa.string())})

    rows = documents.select(documents["doc_id"].cast("long"), documents["text"])
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
