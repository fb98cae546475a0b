"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Test items are partitioned by their number of shingles: partition ``u`` holds items with more than ``u / RATIO`` and
at most ``u`` shingles.  For each partition a document is cut into blocks of ``u`` shingle positions; two blocks in a
row make a window, so an item lies whole in some window however long the document is.  A window that holds a share t
of an item has a Jaccard similarity of at least ``t * u / RATIO / (2 * u + (1 - t) * u / RATIO)`` to it, whatever the
document's length.  From this the number of MinHash functions of the search follows, so that a pair is missed with a
probability of at most ``MISS``; an item is a candidate when one value agrees.  Each candidate is verified by the exact
share of its shingles that the whole document holds.

The items are held by every task in blocks of at most ``block_shingles`` shingles; a larger benchmark takes more passes
over the documents, one for each block.

Defined cases: words are lower-case runs of letters and digits; an item of fewer than ``size`` words is one shingle; null
or wordless items and documents match nothing; equal items match each; repeated rows give repeated matches; empty tables give
an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import WordHashes, mix, plain_words, shingle_hashes

RATIO = math.sqrt(2)
MISS = 1e-6


def functions_needed(threshold: float) -> int:
    """MinHash functions so that no value agrees with a probability of at most ``MISS``."""
    jaccard = (threshold / RATIO) / (2 + (1 - threshold) / RATIO)
    return math.ceil(math.log(MISS) / math.log(1 - jaccard))


class ItemBlock:
    """MinHash tables by size partition and exact shingles of some items.

    Items shorter than ``size`` words have a shingle of their own length; documents are shingled by each such length.
    """

    def __init__(self, items: list[tuple[int, list[str]]], size: int, threshold: float):
        hashes = WordHashes()
        self.size, self.threshold = size, threshold
        seeds = mix(np.arange(1, functions_needed(threshold) + 1, dtype=np.uint64))
        self.seeds = seeds | np.uint64(1)
        self.items, self.shingles = [], []
        # shingle length -> partition bound -> function number -> value -> items
        self.tables: dict[int, dict[int, list[dict[int, list[int]]]]] = {}
        for item, words in items:
            if not words:
                continue
            length = min(size, len(words))
            shingles = np.unique(shingle_hashes(hashes.of(words), size))
            bound = math.ceil(RATIO ** math.ceil(math.log(len(shingles), RATIO) - 1e-9))
            tables = self.tables.setdefault(length, {}).setdefault(bound, [defaultdict(list) for _ in self.seeds])
            for table, value in zip(tables, self._minima(shingles)):
                table[int(value)].append(len(self.items))
            self.items.append(item)
            self.shingles.append(shingles)

    def _minima(self, shingles: np.ndarray) -> list[np.uint64]:
        return [self._permuted(shingles, seed).min() for seed in self.seeds]

    @staticmethod
    def _permuted(shingles: np.ndarray, seed: np.uint64) -> np.ndarray:
        x = shingles * seed
        return x ^ (x >> np.uint64(32))

    def candidates(self, hashed: np.ndarray, starts: np.ndarray, bounds: dict[int, list[dict[int, list[int]]]]) -> set[tuple[int, int]]:
        """(document number, item number) pairs with an agreeing value; ``starts`` are the documents' first positions in ``hashed``."""
        found: set[tuple[int, int]] = set()
        cuts = {}
        for bound in bounds:
            lengths = np.diff(np.append(starts, len(hashed)))
            blocks = -(-lengths // bound)
            document = np.repeat(np.arange(len(starts)), blocks)
            number = np.arange(len(document)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            cuts[bound] = (starts[document] + number * bound, document)
        for k, seed in enumerate(self.seeds):
            values = self._permuted(hashed, seed)
            for bound, tables in bounds.items():
                begin, document = cuts[bound]
                least = np.minimum.reduceat(values, begin)
                pair = np.where(document[1:] == document[:-1], np.minimum(least[:-1], least[1:]), least[:-1])
                least = np.append(pair, least[-1])
                wanted = np.fromiter(tables[k], dtype=np.uint64, count=len(tables[k]))
                wanted.sort()
                at = np.minimum(np.searchsorted(wanted, least), len(wanted) - 1)
                for w in np.flatnonzero(wanted[at] == least):
                    found.update((int(document[w]), item) for item in tables[k][int(least[w])])
        return found

    def search(self, texts: list[str | None], hashes: WordHashes) -> list[tuple[int, int, float]]:
        """(document number, item number, containment) of each verified match."""
        words = [hashes.of(plain_words(t)) for t in texts]
        results = []
        for length, bounds in self.tables.items():
            rows = [(i, shingle_hashes(w, length)) for i, w in enumerate(words) if len(w) >= length]
            if not rows:
                continue
            hashed = np.concatenate([s for _, s in rows])
            starts = np.cumsum([0] + [len(s) for _, s in rows[:-1]])
            held: dict[int, np.ndarray] = {}
            for row, item in sorted(self.candidates(hashed, starts, bounds)):
                if row not in held:
                    held = {row: np.unique(rows[row][1])}
                wanted = self.shingles[item]
                at = np.minimum(np.searchsorted(held[row], wanted), len(held[row]) - 1)
                share = float((held[row][at] == wanted).sum()) / len(wanted)
                if share >= self.threshold:
                    results.append((rows[row][0], item, share))
        return results


def item_blocks(benchmark: DataFrame, size: int, threshold: float, block_shingles: int) -> Iterator[ItemBlock]:
    """Blocks of items within the bound, read one partition after the other."""
    part: list[tuple[int, list[str]]] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).toLocalIterator():
        words = plain_words(row["text"])
        if part and held + len(words) > block_shingles:
            yield ItemBlock(part, size, threshold)
            part, held = [], 0
        part.append((row["item_id"], words))
        held += len(words)
    if part:
        yield ItemBlock(part, size, threshold)


def matches(documents: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, block_shingles: int = 500_000) -> DataFrame:
    """Pairs of a document and a test item whose shingles it holds to a share of ``threshold`` at least.

    Returns ``doc_id``, ``item_id``, ``containment`` (share), ``n_shingles`` (of the item).
    """
    schema = "doc_id bigint, item_id bigint, containment double, n_shingles int"
    spark = documents.sparkSession
    result = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark, size, threshold, block_shingles):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, hashes = shared.value, WordHashes()
            for batch in batches:
                found = items.search(batch.column(1).to_pylist(), hashes)
                ids = batch.column(0).take(pa.array([d for d, _, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([items.items[i] for _, i, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.float64()),
                     pa.array([len(items.shingles[i]) for _, i, _ in found], pa.int32())], ["doc_id", "item_id", "containment", "n_shingles"])

        result = result.unionByName(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema))
    return result
