"""Trees held as adjacency rows (tree_id, node_id, parent_id, ord).

Links are followed by pointer doubling: a row knows an ancestor and what lies between, and joining it with that ancestor's row
doubles the distance, so the number of rounds is the logarithm of the depth.  Trees of at most ``WHOLE`` rows are not
followed that way: their rows are sent once and walked level by level, many trees of a task at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from boxloom.functions.geometry import hull
from boxloom.session import cut_lineage

C = F.col
LISTS = ("path", "ancestors", "preorder")
# rows of a tree that is walked in one piece, and rows that a task walks at a time
WHOLE, TOGETHER = 2048, 16_384


def _composed(state: DataFrame, key: str, combine: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Every row that points at an ancestor takes over what the ancestor's rows know, and points where they point.

    ``combine`` maps a column to a function of (the ancestor's value, the own value).
    """
    above = state.select(key, C("node_id").alias("jump"), C("jump").alias("_jump"), *[C(c).alias("_up_" + c) for c in combine])
    pointing, done = state.where("jump IS NOT NULL"), state.where("jump IS NULL")
    values = {c: f(C("_up_" + c), C(c)) for c, f in combine.items()}
    moved = pointing.join(above, [key, "jump"]).select(*[values[c].alias(c) if c in values else C("_jump").alias("jump") if c == "jump" else C(c) for c in state.columns])
    return done.unionByName(moved)


def followed(links: DataFrame, key: str = "tree_id") -> tuple[DataFrame, int]:
    """(key, node_id, jump, lost) of every node, and the rounds it took.

    ``jump`` is null where a root or a node with a missing parent is above (then ``lost`` names that node); it is not null for
    nodes on a cycle or below one.
    """
    slim = links.select(key, "node_id", "parent_id").distinct()
    there = slim.select(key, C("node_id").alias("parent_id"), F.lit(True).alias("_there")).distinct()
    marked = slim.join(there, [key, "parent_id"], "left")
    missing = C("parent_id").isNotNull() & C("_there").isNull()
    state = cut_lineage(marked.select(key, "node_id", F.when(~missing, C("parent_id")).alias("jump"), F.when(missing, C("node_id")).alias("lost")))
    rounds, reach, largest = 0, 1, None
    while not state.where("jump IS NOT NULL").isEmpty():
        if largest is None:
            largest = state.groupBy(key).count().agg(F.max("count")).first()[0]
        if reach > largest:
            break
        for _ in range(2):
            state = _composed(state, key, {"lost": lambda up, own: F.coalesce(own, up)}).distinct()
        state, rounds, reach = cut_lineage(state), rounds + 1, reach * 4
    return state, rounds


def walk(nodes: DataFrame, marked: Column | None = None, key: str = "tree_id", lists: bool | tuple[str, ...] = True) -> DataFrame:
    """Depth, root, summed offsets and number of children of every node that hangs on a root, and with ``lists`` its path, ancestor ids and preorder key.

    ``abs_x``/``abs_y`` read x and y as relative to the parent; ``marked_depth`` counts ancestors for which ``marked``
    holds; ``lists`` may also name those wanted.  Lists are as long as the depth.  Where an id is repeated in a tree, there is a row for every way to a root; nodes on
    or below a cycle or a missing parent have none (see ``unreached``).
    """
    named = LISTS if lists is True else tuple(lists or ())
    mark = F.coalesce((F.lit(False) if marked is None else marked).cast("int"), F.lit(0))
    large = nodes.groupBy(key).agg(F.count("*").alias("_n")).where(C("_n") > WHOLE).select(key)
    if large.isEmpty():
        return _walk_small(nodes, mark, key, named)
    followed_ = _walk_large(nodes.join(large, key, "left_semi").select(nodes.columns), mark, key, named)
    return followed_.unionByName(_walk_small(nodes.join(large, key, "left_anti").select(nodes.columns), mark, key, named))


def _walk_large(nodes: DataFrame, mark: Column, key: str, named: tuple[str, ...]) -> DataFrame:
    """Trees of any size, by pointer doubling."""
    state, rounds = followed(nodes, key)
    reached = state.where("jump IS NULL AND lost IS NULL").select(key, "node_id").distinct()
    root = C("parent_id").isNull()
    base = nodes.withColumn("_mark", mark).join(reached, [key, "node_id"], "left_semi").withColumns({
        "jump": C("parent_id"), "depth": F.when(root, 0).otherwise(1), "marked_depth": C("_mark"), "root_id": C("node_id"), "abs_x": C("x"), "abs_y": C("y")})

    def summed(up: Column, own: Column) -> Column:
        return up + own

    combine = {"depth": summed, "marked_depth": summed, "abs_x": summed, "abs_y": summed, "root_id": lambda up, own: up}
    none = F.array().cast("array<bigint>")
    starts = {
        "path": F.when(root, F.lit("root")).otherwise(F.concat(F.lit(".children["), C("ord").cast("string"), F.lit("]"))),
        "ancestors": F.array(C("node_id").cast("bigint")), "preorder": F.when(root, none).otherwise(F.array(C("ord").cast("bigint")))}
    base = base.withColumns({c: starts[c] for c in named})
    combine |= {c: F.concat for c in named}
    out = cut_lineage(base)
    for _ in range(rounds):
        out = cut_lineage(_composed(_composed(out, key, combine), key, combine))
    # a node is no ancestor of its own
    out = out.withColumn("marked_depth", C("marked_depth") - C("_mark"))
    if "ancestors" in named:
        out = out.withColumn("ancestors", F.slice("ancestors", F.lit(1), C("depth")))
    return with_children(out.drop("_mark", "jump"), key)


def _walk_small(nodes: DataFrame, mark: Column, key: str, named: tuple[str, ...]) -> DataFrame:
    """Trees that fit a task: their rows lie together, and a task walks the trees it holds."""
    types = {f.name: f.dataType for f in nodes.schema.fields}
    new = {"depth": IntegerType(), "marked_depth": IntegerType(), "root_id": types["node_id"], "abs_x": types["x"], "abs_y": types["y"]}
    new |= {c: StringType() if c == "path" else ArrayType(LongType()) for c in named} | {"children": LongType()}
    kept = nodes.columns
    schema = StructType([StructField(n, t) for n, t in ({c: types[c] for c in kept} | new).items()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_trees(batches, key):
            yield from _ways(table, kept, key, named).to_batches(max_chunksize=TOGETHER)

    whole = nodes.where(C(key).isNotNull() & C("node_id").isNotNull()).withColumn("_mark", mark)
    return whole.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _whole_trees(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by tree, cut between trees."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            table = pa.Table.from_batches(held)
            last = table[key][table.num_rows - 1]
            end = pc.index(table[key], last).as_py()
            held = table.slice(end).to_batches()
            if end:
                yield table.slice(0, end)
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _ways(table: pa.Table, kept: list[str], key: str, named: tuple[str, ...]) -> pa.Table:
    """A row for every way from a root down; each level finds the rows below it by their parent."""
    table = table.combine_chunks()
    col = {c: table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0) for c in {*kept, "_mark"}}
    n = table.num_rows
    tree = pc.dictionary_encode(col[key]).indices.to_numpy().astype(np.int64)
    ids = pc.dictionary_encode(pa.concat_arrays([col["node_id"], col["parent_id"].cast(col["node_id"].type)]))
    code = pc.fill_null(ids.indices, -1).to_numpy().astype(np.int64)
    node, root = tree * len(ids.dictionary) + code[:n], code[n:] < 0
    below = np.flatnonzero(~root)
    parent = (tree * len(ids.dictionary) + code[n:])[below]
    order = np.argsort(parent, kind="stable")
    below, parent = below[order], parent[order]
    size = np.bincount(tree)
    mark, piece = col["_mark"].to_numpy().astype(np.int32), None
    if "path" in named:
        piece = pc.binary_join_element_wise(".children[", col["ord"].cast(pa.string()), "]", "")

    chain = np.flatnonzero(root)[:, None]
    x, y, marks = col["x"].take(pa.array(chain[:, 0])), col["y"].take(pa.array(chain[:, 0])), np.zeros(len(chain), np.int32)
    path = pa.array(["root"] * len(chain), pa.string())
    levels: dict[str, list] = {c: [] for c in ("row", "depth", "marked_depth", "top", "abs_x", "abs_y", *named)}
    while len(chain):
        rows, depth = chain[:, -1], chain.shape[1] - 1
        for name, value in (("row", rows), ("depth", np.full(len(rows), depth, np.int32)), ("marked_depth", marks), ("top", chain[:, 0]), ("abs_x", x), ("abs_y", y)):
            levels[name].append(value)
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * depth)
        for name, value in (("path", path), ("ancestors", lambda: _lists(col["node_id"], chain[:, :-1], ends)), ("preorder", lambda: _lists(col["ord"], chain[:, 1:], ends))):
            if name in named:
                levels[name].append(value() if callable(value) else value)
        # ids repeated on a cycle would lead on for ever
        first, last = np.searchsorted(parent, node[rows]), np.searchsorted(parent, node[rows], "right")
        counts = np.where(depth + 1 < size[tree[rows]], last - first, 0)
        up = np.repeat(np.arange(len(rows)), counts)
        at = below[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(up))]
        above, own = pa.array(up), pa.array(at)
        marks = marks[up] + mark[rows[up]]
        x, y = (pc.add_checked(v.take(above), col[c].take(own)).cast(col[c].type) for v, c in ((x, "x"), (y, "y")))
        if piece is not None:
            path = pc.binary_join_element_wise(path.take(above), piece.take(own), "")
        chain = np.concatenate([chain[up], at[:, None]], axis=1)
    if not levels["row"]:
        rows, top = np.empty(0, np.int64), np.empty(0, np.int64)
    else:
        rows, top = np.concatenate(levels["row"]), np.concatenate(levels["top"])
    reached = np.sort((tree * len(ids.dictionary) + code[n:])[rows[~root[rows]]])
    children = np.searchsorted(reached, node[rows], "right") - np.searchsorted(reached, node[rows])
    out = {c: col[c].take(pa.array(rows)) for c in kept}
    out |= {c: pa.array(np.concatenate(levels[c]) if levels[c] else [], pa.int32()) for c in ("depth", "marked_depth")}
    out["root_id"] = col["node_id"].take(pa.array(top))
    out |= {c: pa.concat_arrays(levels[c]) if levels[c] else col[c[-1]].slice(0, 0) for c in ("abs_x", "abs_y")}
    out |= {c: pa.concat_arrays(levels[c]) if levels[c] else pa.array([], pa.string() if c == "path" else pa.list_(pa.int64())) for c in named}
    return pa.table(out | {"children": pa.array(children, pa.int64())})


def _lists(values: pa.Array, rows: np.ndarray, ends: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(ends, values.take(pa.array(rows.ravel())).cast(pa.int64()))


def unreached(nodes: DataFrame, key: str = "tree_id") -> DataFrame:
    """(key, node_id, reason) of nodes that hang on no root: their parent is missing, one above lacks its parent, or a cycle is above."""
    state, _ = followed(nodes, key)
    reason = F.when(C("jump").isNotNull(), "on_or_below_a_cycle").when(C("lost") == C("node_id"), "missing_parent").otherwise("below_a_missing_parent")
    return state.where("jump IS NOT NULL OR lost IS NOT NULL").select(key, "node_id", reason.alias("reason"))


def with_children(walked: DataFrame, key: str = "tree_id") -> DataFrame:
    """Add the number of direct children, where ``walk`` has not done so."""
    if "children" in walked.columns:
        return walked
    counts = walked.where(C("parent_id").isNotNull()).groupBy(key, C("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    return walked.join(counts, [key, "node_id"], "left").fillna(0, ["children"])


def closure(walked: DataFrame, key: str = "tree_id") -> DataFrame:
    """(ancestor, descendant row) pairs; no join, the ancestors are on the row."""
    return walked.withColumn("ancestor_id", F.explode("ancestors"))


def subtree_facts(walked: DataFrame, key: str = "tree_id") -> DataFrame:
    """Descendants, leaves, leaf hull and contained types of every node that has children."""
    below = closure(with_children(walked, key), key)
    leaf = C("children") == 0
    leaves = below.select(key, "ancestor_id", "type", "children", *[F.when(leaf, C(c)).alias(c) for c in "xywh"])
    return leaves.groupBy(key, C("ancestor_id").alias("node_id")).agg(
        F.count("*").alias("descendants"), F.count(F.when(leaf, 1)).alias("leaves"), *hull(),
        F.max((C("type") == "text").cast("int")).alias("has_text"), F.max((C("type") == "image").cast("int")).alias("has_image"))


def tree_metrics(walked: DataFrame, key: str = "tree_id") -> DataFrame:
    """Size, depth and fan-out of each tree."""
    n = with_children(walked, key)
    inner = C("children") > 0
    m = n.groupBy(key).agg(
        F.count("*").alias("total"), F.max("depth").alias("max_depth"), F.avg("depth").alias("_d"),
        F.max(F.when(C("depth") == 0, C("children"))).alias("top_children"), F.count(F.when(inner, 1)).alias("containers"),
        F.count(F.when(~inner, 1)).alias("leaves"), F.avg(F.when(inner, C("children"))).alias("_f"),
        *[F.count(F.when(C("type") == t, 1)).alias("n_" + t) for t in ("frame", "text", "image")])
    return m.withColumn("avg_depth", F.rint(C("_d") * 100) / 100).withColumn(
        "avg_fanout", F.coalesce(F.rint(C("_f") * 100) / 100, F.lit(0.0))).drop("_d", "_f")


def containers(walked: DataFrame, min_leaves: int = 2, key: str = "tree_id") -> DataFrame:
    """Nodes with at least ``min_leaves`` leaves below, boxed by those leaves."""
    return subtree_facts(walked, key).where(C("leaves") >= min_leaves)


def cycle_members(edges: DataFrame) -> DataFrame:
    """(page_id, id) of nodes on a cycle of child -> parent links.

    Nodes with a single parent only pass a way on.  Pointer doubling takes each of them to the first node with several
    parents; a way that never leaves them ends in a plain cycle, whose nodes are those still pointed at.  The nodes with several
    parents, linked by those ways, are a small graph whose strongly connected parts are found by colours.  A passing node
    is on a cycle when the way it lies on leads from a part to itself.
    """
    key = "page_id"
    links = cut_lineage(edges.select(key, C("child_id").alias("src"), C("parent_id").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    parents = links.groupBy(key, "src").agg(F.count("*").alias("n"), F.min("dst").alias("dst"))
    single = parents.where("n = 1").select(key, C("src").alias("node_id"), C("dst").alias("jump"))
    passing = cut_lineage(single)
    size = passing.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    # ways of 1, 2, 4, ... steps over passing nodes; a way stops at the first node that does not pass
    ways, reach = [passing], 1
    while reach < size:
        step = ways[-1].select(key, C("node_id").alias("jump"), C("jump").alias("_far"))
        ways.append(cut_lineage(ways[-1].join(step, [key, "jump"], "left").select(key, "node_id", F.coalesce("_far", "jump").alias("jump"))))
        reach *= 2
    ends = ways[-1].join(passing.select(key, C("node_id").alias("jump"), F.lit(True).alias("_circles")), [key, "jump"], "left")
    plain = ends.where("_circles").select(key, C("jump").alias("id")).distinct()
    # the first node with several parents behind each link of such a node
    branch = parents.where("n > 1").select(key, "src")
    out = links.join(branch, [key, "src"], "left_semi")
    heads = ends.where("_circles IS NULL").select(key, C("node_id").alias("dst"), C("jump").alias("_head"))
    joined = out.join(heads, [key, "dst"], "left").select(key, "src", "dst", F.coalesce("_head", "dst").alias("head"))
    joined = cut_lineage(joined.join(branch.withColumnRenamed("src", "head"), [key, "head"], "left_semi"))
    parts = strong_parts(joined.select(key, "src", C("head").alias("dst")).distinct())
    one, two = parts.withColumnsRenamed({"id": "src", "part": "_p"}), parts.withColumnsRenamed({"id": "head", "part": "_q"})
    inner = cut_lineage(joined.join(one, [key, "src"]).join(two, [key, "head"]).where(C("_p") == C("_q")))
    # every node of the ways that stay in a part: 1, 2, 4, ... steps on from those already known
    met = inner.select(key, C("dst").alias("node_id")).distinct()
    for way in ways:
        met = cut_lineage(met.unionByName(met.join(way, [key, "node_id"]).select(key, C("jump").alias("node_id"))).distinct())
    on = met.withColumnRenamed("node_id", "id").unionByName(inner.select(key, C("src").alias("id"))).unionByName(plain)
    return on.distinct()


def strong_parts(links: DataFrame) -> DataFrame:
    """(page_id, id, part) of nodes in a strongly connected part that holds a link; ``part`` is its highest id.

    Nodes without a link in or out are trimmed.  The rest take the highest id that reaches them as colour; the nodes that
    reach the owner of their colour inside the colour are its part.  Parts leave, and the rest is coloured again.
    """
    key = "page_id"
    live, found = cut_lineage(links.select(key, "src", "dst")), None
    while True:
        count = -1
        while count != (count := live.count()):
            heads, tails = live.select(key, C("dst").alias("src")).distinct(), live.select(key, C("src").alias("dst")).distinct()
            live = cut_lineage(live.join(heads, [key, "src"], "left_semi").join(tails, [key, "dst"], "left_semi"))
        if not count:
            break
        ids = live.select(key, C("src").alias("id")).unionByName(live.select(key, C("dst").alias("id"))).distinct()
        colour, total = cut_lineage(ids.withColumn("c", C("id"))), None
        while True:
            passed = live.join(colour.withColumnsRenamed({"id": "src"}), [key, "src"]).select(key, C("dst").alias("id"), "c")
            colour = cut_lineage(colour.unionByName(passed).groupBy(key, "id").agg(F.max("c").alias("c")))
            now = colour.agg(F.sum(C("c").cast("decimal(38,0)"))).first()[0]
            if now == total:
                break
            total = now
        part, size = cut_lineage(colour.where(C("id") == C("c"))), -1
        while size != (size := part.count()):
            back = live.join(part.withColumnsRenamed({"id": "dst"}), [key, "dst"]).select(key, C("src").alias("id"), "c").join(colour, [key, "id", "c"], "left_semi")
            part = cut_lineage(part.unionByName(back).distinct())
        # a node alone is a part only with a link to itself
        many = part.groupBy(key, "c").agg(F.count("*").alias("n"))
        loops = live.where(C("src") == C("dst")).select(key, C("src").alias("id"), F.lit(True).alias("_loop")).distinct()
        good = part.join(many, [key, "c"]).join(loops, [key, "id"], "left").where("n > 1 OR _loop").select(key, "id", C("c").alias("part"))
        found = good if found is None else found.unionByName(good)
        gone = part.select(key, C("id").alias("src"))
        live = cut_lineage(live.join(gone, [key, "src"], "left_anti").join(gone.withColumnRenamed("src", "dst"), [key, "dst"], "left_anti"))
    if found is None:
        return links.select(key, C("src").alias("id"), C("src").alias("part")).where(F.lit(False))
    return found
