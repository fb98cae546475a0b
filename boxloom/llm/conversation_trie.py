"""Prefix trie of conversations, built as a burst trie over shards.

A conversation is the sequence of its turns; equal (role, text) pairs have one turn id.  Equal conversations are one sequence
with a count.  A container holds the sequences below a trie head (a prefix); the root is burst first, and a container with
more than ``limit`` turns is burst by the next turn id: its head becomes a finished node and its sequences move below longer
heads.  What remains fits a task: containers are dealt by head, sorted, and swept once into nodes, with a stack along the
current sequence.  Values of subtrees then rise from the swept heads through the burst nodes, one level after another.

Rounds are as many as the longest prefix that more than ``limit`` turns of different sequences share.  A container in a task is
bounded by ``limit`` turns or by one sequence.  A hot prefix is summed before it is shuffled; the join that marks its sequences
is one that adaptive execution splits.

Defined cases: null role or text is empty; turns order by number, null first, then role, the first 64 signs of the text and the turn id, so ties and repeated rows have
an order; rows without ``conv_id`` take no part; a conversation named in ``ids`` without turns is a member of the root alone;
very long texts are read as digests; an empty table gives no node, not even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.llm.common import stored

# turns of a container that one task sweeps
CONTAINER_TURNS = 1000
# width of the ranges of conversation ids that are gathered together
ID_RANGE = 4096
ROOT = b""
NODE = "conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
SWEPT = NODE + ", head binary, above binary"


def keyed_turns(turns: DataFrame) -> DataFrame:
    """Turns in order: ``conv_id``, ``no`` (from 1), ``key`` (turn id, 16 bytes), ``words`` (words of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"), role.alias("role"), F.substring(text, 1, 64).alias("begin"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "begin", "key")
    return rows.withColumn("no", F.row_number().over(order)).select("conv_id", "no", "key", "words")


def _ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ``conv_id`` of each ``sequence``; ids are gathered by ranges and streamed."""
    ranges = members.groupBy("sequence", F.floor(F.col("conv_id") / ID_RANGE).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            names, found = [], []
            for sequence, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sequence != current:
                    if current is not None:
                        names.append(current)
                        found.append(digest.hexdigest())
                    current, digest = sequence, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"sequence": pa.array(names, pa.string()), "ends": pa.array(found, pa.string())})
        if current is not None:
            yield pa.RecordBatch.from_pydict({"sequence": [current], "ends": [digest.hexdigest()]})

    return ranges.repartition("sequence").sortWithinPartitions("sequence", "part").select("sequence", "ids").mapInArrow(run, "sequence string, ends string")


def _sequences(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct conversations: ``keys``, ``words`` (of each turn), ``n``, ``conv`` (smallest), ``ends``."""
    gathered = keyed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", "key", "words"))).alias("turns"))
    every = ids.select("conv_id").where(F.col("conv_id").isNotNull()).distinct().join(gathered, "conv_id", "left")
    rows = every.select("conv_id", F.coalesce("turns.key", F.array().cast("array<binary>")).alias("keys"), F.coalesce("turns.words", F.array().cast("array<bigint>")).alias("words"))
    rows = stored(rows.withColumn("sequence", F.sha2(F.array_join(F.transform("keys", F.hex), ""), 256)), "trie-conversations")
    distinct = rows.groupBy("sequence").agg(F.first("keys").alias("keys"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    return distinct.join(_ends(rows.select("sequence", "conv_id")), "sequence").drop("sequence")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose rows come sorted by head and keys."""
    fields = [f.split() for f in SWEPT.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}

    def table(nodes: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({name: pa.array([n.get(name) for n in nodes], kinds[kind]) for name, kind in fields})

    def closed(stack: list[dict], depth: int) -> None:
        """Finish the nodes below ``depth``; each adds itself to its parent."""
        while stack and stack[-1]["depth"] > depth:
            node = stack.pop()
            node["n_leaves"] = node["n_leaves"] or 1
            node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
            if stack:
                above = stack[-1]
                node["parent"] = above
                above["n_children"] += 1
                above["conv_id"] = min(above["conv_id"], node["conv_id"])
                for name in ("n_convs", "n_leaves", "saved_tokens"):
                    above[name] += node[name]

    head, keys, stack, nodes = None, [], [], []
    out: list[dict] = []

    def container() -> list[dict]:
        closed(stack, -1)
        for n in nodes:
            if "parent" in n:
                n["parent_conv_id"] = n["parent"]["conv_id"]
        for n in nodes:
            n.pop("parent", None)
        return nodes

    for batch in batches:
        for row in batch.to_pylist():
            depth = row["depth"]
            if row["head"] != head:
                out += container()
                if len(out) >= 5000:
                    yield table(out)
                    out = []
                head, keys, stack, nodes = row["head"], row["keys"][:depth], [], []
                same = depth - 1
            else:
                same = depth
                while same < min(len(keys), len(row["keys"])) and keys[same] == row["keys"][same]:
                    same += 1
            closed(stack, same)
            keys = row["keys"]
            for d in range(same + 1, len(keys) + 1):
                node = {"conv_id": row["conv"], "depth": d, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "ends_sha256": None, "words": row["words"][d - 1] if d else 0}
                if d == depth:
                    node |= {"head": head, "above": row["above"]}
                stack.append(node)
                nodes.append(node)
            end = stack[-1]
            end["n_convs"] += row["n"]
            end["conv_id"] = min(end["conv_id"], row["conv"])
            end["ends_sha256"] = row["ends"]
    out += container()
    if out:
        yield table(out)


def prefix_trie(keyed: DataFrame, ids: DataFrame, limit: int = CONTAINER_TURNS) -> DataFrame:
    """One row for each distinct prefix of the conversations in ``ids``, whose turns ``keyed`` holds (see ``keyed_turns``).

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the prefix without its last turn, ``n_convs`` the members,
    ``n_children`` and ``n_leaves`` the nodes below, ``saved_tokens`` the words that the subtree's members share with an earlier
    one, ``ends_sha256`` a digest of the members that end there.
    """
    # the root is burst whatever its size
    state = stored(_sequences(keyed, ids).select(F.lit(ROOT).alias("head"), F.lit(None).cast("binary").alias("above"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("step"), "keys", "words", "n", "conv", "ends"), "trie-sequences")
    upper, containers = [], []
    while True:
        upper.append(state.groupBy("head").agg(
            F.min("above").alias("above"), F.min("depth").alias("depth"), F.max("step").alias("step"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"),
            F.max(F.when(F.size("keys") == F.col("depth"), F.col("ends"))).alias("ends_sha256")))
        key = F.element_at("keys", F.col("depth") + 1)
        moved = state.where(F.size("keys") > F.col("depth")).select(
            F.substring(F.unhex(F.sha2(F.concat("head", key), 256)), 1, 16).alias("head"), F.col("head").alias("above"), (F.col("depth") + 1).alias("depth"),
            F.element_at("words", F.col("depth") + 1).alias("step"), "keys", "words", "n", "conv", "ends")
        load = moved.groupBy("head").agg(F.sum(F.size("keys") - F.col("depth") + 1).alias("load"), F.count("*").alias("rows"))
        large = load.where((F.col("load") > limit) & (F.col("rows") > 1)).select("head", F.lit(True).alias("large"))
        marked = stored(moved.join(large, "head", "left"), "trie-round")
        containers.append(marked.where(F.col("large").isNull()).drop("large"))
        state = marked.where("large").drop("large")
        if state.isEmpty():
            break
    remaining = containers[0]
    for more in containers[1:]:
        remaining = remaining.unionByName(more)
    swept = stored(remaining.repartition("head").sortWithinPartitions("head", "keys").mapInArrow(_sweep, SWEPT), "trie-swept")
    heads = swept.where(F.col("head").isNotNull())
    tops, below = [], None
    for depth in range(len(upper) - 1, -1, -1):
        children = heads.where(F.col("depth") == depth + 1).select("above", "n_leaves", "saved_tokens")
        if below is not None:
            children = children.unionByName(below.select("above", "n_leaves", "saved_tokens"))
        sums = children.groupBy(F.col("above").alias("head")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        below = stored(upper[depth].join(sums, "head", "left").select(
            "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("step")).alias("saved_tokens"), "ends_sha256", "head", "above"), "trie-top")
        tops.append(below)
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    # heads learn the smallest member of the node above them
    parents = top.select(F.col("head").alias("above"), F.col("conv_id").alias("found"))
    linked = heads.unionByName(top).join(parents, "above", "left").withColumn("parent_conv_id", F.col("found")).drop("found")
    nodes = swept.where(F.col("head").isNull()).unionByName(linked.select(*swept.columns))
    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
