"""Approximate nearest neighbours by cosine in sharded, robust-pruned directed graphs.

Equal vectors form one node, which carries its ``k + 1`` smallest ids: no answer needs more.  Nodes are dealt by hash to
shards of about ``shard_nodes``.  Inside a shard nodes enter in batches: a greedy beam search over the graph so far
proposes neighbours, relaxed distance pruning keeps diverse edges (a candidate goes when a kept one is closer to it by
the factor ``ALPHA``), and reverse edges are added and pruned alike.  Queries come in blocks; every block is beam-searched in every
shard, the nodes found are scored in double precision on the original vectors, and the best of all shards are
merged.  The work is (queries x shards) searches.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id, take no part;
vectors of other lengths are searched apart; ties in the score go to the smaller id; repeated ids with the same vector count
once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.llm.common import stored

DEGREE, BEAM, ALPHA = 24, 48, 1.2
SEARCH_BEAM, RESCORED = 80, 24
BATCH = 256


def _prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Robust pruning of the candidates (-1: none) of several nodes at once: up to DEGREE diverse neighbours each."""
    candidates = np.where(candidates == nodes[:, None], -1, candidates)
    d = np.maximum(2 - 2 * np.einsum("bd,bmd->bm", x[nodes], x[candidates]), 0)
    d[candidates < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    points = x[candidates]
    between = 2 - 2 * np.matmul(points, points.transpose(0, 2, 1))
    alive = np.isfinite(d)
    row = np.arange(len(nodes))
    kept = np.full((len(nodes), DEGREE), -1, dtype=np.int32)
    for k in range(DEGREE):
        first = np.argmax(alive, axis=1)
        some = alive[row, first]
        if not some.any():
            break
        kept[some, k] = candidates[row[some], first[some]]
        # equal candidates are at distance zero, so a repeated candidate goes with the kept one
        alive &= ~(some[:, None] & (ALPHA * ALPHA * np.maximum(between[row, first], 0) <= d))
        alive[row, first] = False
    return kept


def _beam(x: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """Nodes that a beam search finds for each query, nearest first (-1: none)."""
    n, q = len(x), len(queries)
    row = np.arange(q)
    found = np.full((q, beam), -1, dtype=np.int32)
    score = np.full((q, beam), -np.inf, dtype=np.float32)
    done = np.ones((q, beam), dtype=bool)
    seen = np.zeros((q, n + 1), dtype=bool)
    found[:, 0], score[:, 0], done[:, 0], seen[:, start] = start, queries @ x[start], False, True
    while True:
        open_score = np.where(done, -np.inf, score)
        best = np.argmax(open_score, axis=1)
        active = np.flatnonzero(np.isfinite(open_score[row, best]))
        if not len(active):
            return found
        at = best[active]
        done[active, at] = True
        near = edges[found[active, at]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        # -1 marks the spare last column
        seen[active[:, None], np.where(near >= 0, near, n)] = True
        s = np.where(fresh, np.einsum("bd,bmd->bm", queries[active], x[near]), -np.inf).astype(np.float32)
        all_found, all_score = np.concatenate([found[active], near], 1), np.concatenate([score[active], s], 1)
        all_done = np.concatenate([done[active], ~fresh], 1)
        order = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
        found[active] = np.where(np.isfinite(np.take_along_axis(all_score, order, 1)), np.take_along_axis(all_found, order, 1), -1)
        score[active], done[active] = np.take_along_axis(all_score, order, 1), np.take_along_axis(all_done, order, 1)


def build_graph(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Edges (-1: none) and start node of the graph over unit vectors."""
    n = len(x)
    edges = np.full((n, DEGREE), -1, dtype=np.int32)
    start = int(np.argmax(x @ x.mean(axis=0)))
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[start], order[order != start]]).astype(np.int32)
    done, size = 1, 1
    while done < n:
        batch = order[done : done + size]
        near = _beam(x, edges, start, x[batch], BEAM)
        edges[batch] = _prune(x, batch, near)
        source, target = np.repeat(batch, DEGREE), edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by_target = np.argsort(target, kind="stable")
        source, target = source[by_target], target[by_target]
        # a few reverse edges of each node at a time, so that a hub does not widen the arrays of the others
        place = np.arange(len(target)) - np.searchsorted(target, target)
        for lot in range(0, int(place.max(initial=-1)) + 1, 8):
            chosen = (place >= lot) & (place < lot + 8)
            nodes, inverse = np.unique(target[chosen], return_inverse=True)
            added = np.full((len(nodes), 8), -1, dtype=np.int32)
            added[inverse, place[chosen] - lot] = source[chosen]
            for i in range(0, len(nodes), 512):
                part = nodes[i : i + 512]
                edges[part] = _prune(x, part, np.concatenate([edges[part], added[i : i + 512]], 1))
        done, size = done + len(batch), min(BATCH, size * 2)
    return edges, start


def _clean(vectors: DataFrame) -> DataFrame:
    """Usable rows: ``vec_id`` and ``v`` (doubles)."""
    v = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    good = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(good)


def _unit(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision; scaled first, so that tiny and huge components neither vanish nor overflow."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)


def nodes_of(vectors: DataFrame, k: int) -> DataFrame:
    """Different vectors with their ``k + 1`` smallest ids: ``v``, ``ids``."""
    by_id = W.partitionBy("v").orderBy("vec_id")
    return _clean(vectors).distinct().withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def build_index(vectors: DataFrame, k: int, shard_nodes: int) -> DataFrame:
    """One row per shard: ``dim``, ``shard`` and the packed ``points``, ``ids``, ``edges`` and ``start``."""
    nodes = stored(nodes_of(vectors, k), "nodes")
    shards = max(1, -(-nodes.count() // shard_nodes))
    dealt = nodes.select(F.size("v").alias("dim"), F.pmod(F.hash(F.col("ids")[0]), F.lit(shards)).alias("shard"), "v", "ids")

    def build(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        raw = np.array(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
        ids = np.full((len(raw), k + 1), np.iinfo(np.int64).min, dtype=np.int64)
        for i, held in enumerate(table["ids"].to_pylist()):
            ids[i, : len(held)] = held
        first = np.argsort(ids[:, 0], kind="stable")
        raw, ids = raw[first], ids[first]
        edges, start = build_graph(_unit(raw))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "points": [raw.tobytes()], "ids": [ids.tobytes()], "edges": [edges.tobytes()], "start": pa.array([start], pa.int32())})

    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, points binary, ids binary, edges binary, start int")


def _query_blocks(queries: DataFrame, per_block: int) -> DataFrame:
    """Queries packed in blocks: ``dim``, ``block``, ``q_ids``, ``q_points``."""
    clean = _clean(queries).distinct()
    blocks = max(1, -(-clean.count() // per_block))
    dealt = clean.select(F.size("v").alias("dim"), F.pmod(F.hash("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "v")

    def pack(table: pa.Table) -> pa.Table:
        points = np.array(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False))
        return pa.table({"dim": table["dim"][:1], "block": table["block"][:1], "q_ids": [table["vec_id"].to_numpy().tobytes()], "q_points": [points.tobytes()]})

    return dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, q_ids binary, q_points binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_nodes: int = 4096, per_block: int = 1024) -> DataFrame:
    """The ``k`` nearest of ``vectors`` for each row of ``queries``: ``query_id``, ``rank``, ``vec_id``, ``score`` (cosine)."""
    index = stored(build_index(vectors, k, shard_nodes), "graph-index")
    places = index.select(F.col("dim").alias("i_dim"), F.col("shard").alias("i_shard"), "points", "ids", "edges", "start")
    # each block goes to every shard of its dimension; the list of shards is one small row per dimension
    shards = index.groupBy(F.col("dim").alias("s_dim")).agg(F.collect_list("shard").alias("shards"))
    blocks = stored(_query_blocks(queries, per_block), "query-blocks").join(shards, F.col("dim") == F.col("s_dim")).withColumn("shard", F.explode("shards"))
    work = blocks.join(places, (F.col("dim") == F.col("i_dim")) & (F.col("shard") == F.col("i_shard"))).select("dim", "q_ids", "q_points", "points", "ids", "edges", "start")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, start = batch["dim"][i].as_py(), batch["start"][i].as_py()
                view = lambda name, kind, width: np.frombuffer(batch[name][i].as_buffer(), dtype=kind).reshape(-1, width)
                raw, ids, edges = view("points", np.float64, dim), view("ids", np.int64, k + 1), view("edges", np.int32, DEGREE)
                q_ids, q_raw = view("q_ids", np.int64, 1)[:, 0], view("q_points", np.float64, dim)
                x, norms = _unit(raw), np.sqrt(np.einsum("nd,nd->n", raw, raw))
                for j in range(0, len(q_ids), BATCH):
                    asked, q = q_ids[j : j + BATCH], q_raw[j : j + BATCH]
                    found = _beam(x, edges, start, _unit(q), min(SEARCH_BEAM, max(len(x), 1)))[:, : max(RESCORED, 2 * k)]
                    cosines = np.einsum("bd,bmd->bm", q, raw[found]) / (np.sqrt(np.einsum("bd,bd->b", q, q))[:, None] * norms[found])
                    # every id of a node found has the node's score
                    many = np.where(found[:, :, None] >= 0, ids[found], np.iinfo(np.int64).min)
                    usable = (many != np.iinfo(np.int64).min) & (many != asked[:, None, None])
                    flat_ids, flat = many.reshape(len(asked), -1), np.where(usable, cosines[:, :, None], -np.inf).reshape(len(asked), -1)
                    order = np.lexsort((flat_ids, -flat), axis=1)[:, :k]
                    out_ids, out = np.take_along_axis(flat_ids, order, 1), np.take_along_axis(flat, order, 1)
                    good = np.isfinite(out)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(asked, good.sum(axis=1))), "vec_id": pa.array(out_ids[good]), "score": pa.array(out[good])})

    hits = work.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
