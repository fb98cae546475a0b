"""Near duplicates by bottom-k sketches of one hash function, inverted lists and exact verification.

1. Each document becomes the set of its word shingles; equal sets form a class, represented by the smallest id.
2. A class keeps the ``SKETCH`` smallest hashes of its set.  The smallest ``LISTED`` of them (all, of a small set) are its
   retained values, and inverted lists by value generate candidates.  Sets with a Jaccard similarity of 0.8 share 0.8 of
   the values that are smallest in their union; that a similar pair shares less than ``SHARED`` of the retained values has a
   probability of 1e-5 at the very threshold and far less above it, and for small sets the bound is exact.  So a class needs
   listing only under its rarest values, up to one more than it may fail to share.
3. Lists of up to ``SHORT`` classes give all their pairs.  The classes of longer lists are listed anew, by the rarest shingles of
   their full sets (an exact bound), which parts those that have only a popular passage in common.  What is long even then,
   split by set size, holds large groups of near copies: each list gives the pairs with its leader.  Afterwards the
   classes that such lists connect are compared by blocks of full sets, pairs of blocks being dealt out; out come not the
   pairs of a group but the links that join components, so no link between components is lost.
4. The union sketch of a pair (the smallest hashes of both) estimates its similarity; pairs well below the threshold go.
5. The rest is verified on full shingle sets: first the best partner of each class, then only those pairs that still
   lie in different components.  Components are those of the verified links.

Defined cases: a document without words (or with null text) has an empty set and is linked with nothing; fewer words than the shingle size
make one shingle; rows without an id take no part in links: their component is null and they are kept; rows that repeat id and text are one
document; where rows share an id with different texts they are one component and one of the texts stands for it; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.llm.common import WordHashes, mix, only, release, shingle_hashes, stored
from boxloom.llm.components import components

SKETCH, LISTED = 64, 32
SHARED = 0.5
SHORT = 32
BLOCK = 512
# estimates have a standard deviation of 0.05 at the threshold
MARGIN = 0.2
NO_ID = 2**63 - 1
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def ascii_words(text: str | None) -> list[str]:
    """Words between ASCII white space, with A-Z in lower case."""
    return WORDS.findall(text.translate(_LOWER) if not text.isascii() else text.lower()) if text else []


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(hashes.of(ascii_words(text)), size))


def sketches(documents: DataFrame, size: int) -> DataFrame:
    """``rank`` (id), ``n`` (set size), a digest of the set (``d1``, ``d2``) and its smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, size, hashes) for t in batch.column(1).to_pylist()]
            d1 = [int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0 for s in sets]
            d2 = [int(np.add.reduce(mix(s + np.uint64(1)))) if len(s) else 0 for s in sets]
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), signed(d1), signed(d2),
                 pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64()))], ["rank", "n", "d1", "d2", "sketch"])

    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rank"), "text")
    return rows.mapInArrow(run, "rank bigint, n bigint, d1 bigint, d2 bigint, sketch array<bigint>")


def _rare_prefix(every: DataFrame) -> DataFrame:
    """Inverted lists of the rarest values of each class, in rows (``family``, ``v``, ``rep``, ``n``).

    ``every`` has a row for each of the ``m`` values that a class lists in a family, and ``share``, the part of them that it
    has in common with any similar class.  Whoever has that much in common shares one of the ``m - share * m + 1`` rarest.
    """
    often = every.groupBy(F.col("family").alias("wf"), F.col("v").alias("w")).agg(F.count("*").alias("df")).where(F.col("df") > 1)
    shared = every.join(often, (F.col("v") == F.col("w")) & (F.col("family") == F.col("wf")))
    own = W.partitionBy("family", "rep")
    # values of one class alone are the rarest and need no list, but take their places
    place = F.col("m") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "v"))
    # the share is rounded down a little first, so that no rounding error adds a value to it
    return shared.withColumn("place", place).where(F.col("place") <= F.col("m") - F.ceil(F.col("m") * F.col("share") - 1e-6) + 1).select("family", "v", "rep", "n")


def _sketch_lists(classes: DataFrame, percent: int) -> DataFrame:
    """Lists of retained values.

    Family 0 holds the sets that their sketch holds whole: similar ones have ``percent`` of the larger set in common, exactly.
    Family 1 holds the sets that have a similar one beyond the sketch, with ``LISTED`` retained values each.
    """
    whole = classes.where(F.col("n") <= SKETCH).select(F.lit(0).alias("family"), "rep", "n", "sketch", F.lit(percent / 100).alias("share"))
    part = classes.where(100 * F.col("n") > percent * SKETCH).select(F.lit(1).alias("family"), "rep", "n", F.slice("sketch", 1, LISTED).alias("sketch"), F.lit(SHARED).alias("share"))
    return _rare_prefix(whole.unionByName(part).select("family", "rep", "n", F.size("sketch").alias("m"), "share", F.explode("sketch").alias("v")))


def _full_sets(documents: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """Whole shingle sets of some classes: ``rep``, ``shingles``."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, size, hashes).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

    return stored(_texts(documents, reps).mapInArrow(to_sets, "rep bigint, shingles array<bigint>"), "full-sets")


def _full_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Lists of the rarest shingles of full sets: exact, and apart from what most of them share."""
    m = F.size("shingles")
    return _rare_prefix(sets.select(F.lit(2).alias("family"), "rep", m.cast("long").alias("n"), m.alias("m"), F.lit(percent / 100).alias("share"), F.explode("shingles").alias("v")))


def _spanning_links(one: tuple, two: tuple, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of sets that join components which nothing has joined before, at most one per join.

    A block is (ids, components, set sizes, shingles in one array).
    """
    values = np.unique(one[3])

    def incidence(block: tuple) -> np.ndarray:
        at = np.minimum(np.searchsorted(values, block[3]), len(values) - 1)
        known = values[at] == block[3]
        matrix = np.zeros((len(block[0]), len(values)), dtype=np.float32)
        matrix[np.repeat(np.arange(len(block[0])), block[2])[known], at[known]] = 1
        return matrix

    shared = (incidence(one) @ incidence(two).T).astype(np.int64)
    similar = 100 * shared >= percent * (one[2][:, None] + two[2][None, :] - shared)
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(similar & (one[1][:, None] != two[1][None, :]))):
        x, y = top(int(one[1][i])), top(int(two[1][j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((int(one[0][i]), int(two[0][j])))
    return links


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links that join components inside large lists, by exact comparison of blocks of full sets.

    ``members`` has ``cluster`` (classes that large lists connect), ``rep``, ``component`` and ``shingles``.  Pairs of blocks are dealt
    out; of the pairs of classes only those come out that join two components.
    """
    counts = members.groupBy(F.col("cluster").alias("c")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(counts, F.col("cluster") == F.col("c")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        shingles = table["shingles"].combine_chunks()
        sizes = np.diff(shingles.offsets.to_numpy()).astype(np.int64)
        return pa.table({
            "cluster": table["cluster"][:1], "block": table["block"][:1], "blocks": table["blocks"][:1].cast(pa.int32()), "ids": [table["rep"].to_numpy().tobytes()], "components": [table["component"].to_numpy().tobytes()],
            "sizes": [sizes.tobytes()], "shingles": [shingles.flatten().to_numpy().tobytes()]})

    packed = stored(dealt.groupBy("cluster", "block").applyInArrow(pack, "cluster bigint, block int, blocks int, ids binary, components binary, sizes binary, shingles binary"), "blocks")
    parts = ("ids", "components", "sizes", "shingles")
    left = packed.select("cluster", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), *parts)
    right = packed.select(F.col("cluster").alias("c"), F.explode(F.sequence(F.lit(0), "block")).alias("k"), F.col("block").alias("l"), *[F.col(p).alias(f"{p}_b") for p in parts])
    work = left.join(right, (F.col("cluster") == F.col("c")) & (F.col("i") == F.col("k")) & (F.col("j") == F.col("l"))).select(*parts, *[f"{p}_b" for p in parts])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for r in range(batch.num_rows):
                one, two = [tuple(np.frombuffer(batch[p + end][r].as_buffer(), dtype=np.int64) for p in parts) for end in ("", "_b")]
                links += _spanning_links(one, two, percent)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return work.mapInArrow(compare, "a bigint, b bigint")


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text of each wanted id (column ``need``)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), "text").where(F.col("text").isNotNull() & F.col("id").isNotNull())
    return rows.join(wanted, F.col("id") == F.col("need"), "left_semi").dropDuplicates(["id"])


def _by_length(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of lists of up to SHORT classes, and of longer ones."""
    keys = [c for c in lists.columns if c not in ("rep", "n")]
    lengths = lists.groupBy(*[F.col(k).alias(f"l_{k}") for k in keys]).agg(F.count("*").alias("length")).where(F.col("length") > 1)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"l_{k}"))
    counted = stored(lists.join(lengths, same).drop(*[f"l_{k}" for k in keys]), "lists")
    return counted.where(F.col("length") <= SHORT).drop("length"), counted.where(F.col("length") > SHORT).drop("length")


def _close(percent: int):
    """Set sizes that allow the similarity."""
    return 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")


def _pairs_within(lists: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """All pairs of each list."""
    other = lists.select(*[F.col(k).alias(f"{k}_b") for k in keys], F.col("rep").alias("b"), F.col("n").alias("n_b"))
    same = F.col("rep") < F.col("b")
    for k in keys:
        same = same & (F.col(k) == F.col(f"{k}_b"))
    return lists.join(other, same & _close(percent)).select(F.col("rep").alias("a"), "b")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch allows the similarity, with the estimate: ``a``, ``b``, ``estimate``."""
    left = classes.select(F.col("rep").alias("ra"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("rep").alias("rb"), F.col("sketch").alias("sb"))
    joined = pairs.distinct().join(left, F.col("a") == F.col("ra")).join(right, F.col("b") == F.col("rb"))
    # sketches ascend as unsigned numbers, so order by the flipped sign; both hold the union's smallest values
    flip = lambda x: x.bitwiseXOR(F.lit(-(2**63)))
    joined = joined.select("a", "b", F.transform("sa", flip).alias("sa"), F.transform("sb", flip).alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    joined = joined.select("a", "b", "sa", "sb", union.alias("u"))
    both = F.size(F.array_intersect("u", F.array_intersect("sa", "sb")))
    return joined.select("a", "b", (both / F.size("u")).alias("estimate")).where(F.col("estimate") >= percent / 100 - MARGIN)


def _verified(pairs: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingle_set(t, size, hashes).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["id", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = pairs.select(F.col("a").alias("need")).unionByName(pairs.select(F.col("b").alias("need"))).distinct()
    sets = _texts(documents, needed).mapInArrow(to_sets, "id bigint, shingles binary")
    left, right = sets.select(F.col("id").alias("ia"), F.col("shingles").alias("xa")), sets.select(F.col("id").alias("ib"), F.col("shingles").alias("xb"))
    joined = pairs.select("a", "b").join(left, F.col("a") == F.col("ia")).join(right, F.col("b") == F.col("ib"))
    return joined.select("a", "b", "xa", "xb").mapInArrow(compare, "a bigint, b bigint")


class _Graph:
    """Verified links and the components they make so far."""

    def __init__(self, documents: DataFrame, classes: DataFrame, size: int, percent: int):
        self.documents, self.classes, self.size, self.percent = documents, classes, size, percent
        self.links = self.labels = None

    def labelled(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """``rows`` with the component of a class column."""
        if self.labels is None:
            return rows.withColumn(name, F.col(column))
        labels = self.labels.select(F.col("node").alias(f"{name}_node"), F.col("component").alias(f"{name}_c"))
        return rows.join(labels, F.col(column) == F.col(f"{name}_node"), "left").withColumn(name, F.coalesce(f"{name}_c", column)).drop(f"{name}_node", f"{name}_c")

    def add(self, links: DataFrame) -> None:
        """Merge what verified links join."""
        found = stored(links, "verified")
        self.links = found if self.links is None else self.links.unionByName(found)
        self.labels = components(self.links)

    def crossing(self, pairs: DataFrame) -> DataFrame:
        rows = self.labelled(self.labelled(pairs, "a", "ca"), "b", "cb")
        return rows.where(F.col("ca") != F.col("cb")).drop("ca", "cb")

    def resolve(self, candidates: DataFrame) -> None:
        """Verify the best partner of each class, then the pairs that still cross components."""
        candidates = stored(candidates, "candidates")
        best = candidates.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a")).select("a", "b")
        self.add(_verified(best, self.documents, self.size, self.percent))
        rest = stored(self.crossing(candidates.select("a", "b")), "crossing")
        if not rest.isEmpty():
            self.add(_verified(rest, self.documents, self.size, self.percent))


@only
def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable over links), ``kept`` (it is that id)."""
    everything = stored(sketches(documents, size), "sketches")
    reps = everything.where(F.col("rank") != NO_ID).groupBy(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("en")).agg(F.min("rank").alias("rep"))
    members = everything.join(reps, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("en")), "left")
    # an empty set and a row without id are linked with nothing, so each is its own representative
    members = members.withColumn("rep", F.when((F.col("n") == 0) | (F.col("rank") == NO_ID), F.col("rank")).otherwise(F.col("rep")))
    classes = stored(members.where((F.col("rank") == F.col("rep")) & (F.col("n") > 0) & (F.col("rank") != NO_ID)).select("rep", "n", "sketch").dropDuplicates(["rep"]), "classes")
    graph = _Graph(documents, classes, size, percent)

    short, long = _by_length(_sketch_lists(classes, percent))
    # long lists: their classes are listed anew by full sets, where what many have in common comes last; sets of similar
    # size meet in the list of their common or neighbouring size bucket
    sets = _full_sets(documents, long.select(F.col("rep").alias("need")).distinct(), size)
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)))
    fair, hot = _by_length(_full_lists(sets, percent).select("family", "v", F.explode(F.array(bucket, bucket - 1)).alias("s"), "rep", "n"))
    leaders = hot.groupBy(F.col("v").alias("lv"), F.col("s").alias("ls")).agg(F.min(F.struct("rep", "n")).alias("lead"))
    led = hot.join(leaders, (F.col("v") == F.col("lv")) & (F.col("s") == F.col("ls"))).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"), "n", F.col("lead.n").alias("n_b")).distinct()
    led = stored(led, "led")
    within = _pairs_within(short, ["family", "v"], percent).unionByName(_pairs_within(fair, ["v", "s"], percent))
    within = within.unionByName(led.where((F.col("a") < F.col("b")) & _close(percent)).select("a", "b"))
    graph.resolve(_estimated(within, classes, percent))
    if not led.isEmpty():
        # classes that large lists connect, with the components found so far
        clusters = components(led)
        grouped = sets.join(led.select(F.col("b").alias("in_hot")).distinct(), F.col("rep") == F.col("in_hot"), "left_semi").join(clusters, F.col("rep") == F.col("node"), "left")
        grouped = graph.labelled(grouped.select("rep", "shingles", F.coalesce("component", "rep").alias("cluster")), "rep", "component")
        graph.add(_block_links(grouped, percent))

    labels = graph.labels.select(F.col("node"), F.col("component"))
    result = members.select("rank", "n", "rep").join(labels, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    return result.select(
        F.when(F.col("rank") != NO_ID, F.col("rank")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"),
        (F.col("rank") == F.col("component")).alias("kept"))
