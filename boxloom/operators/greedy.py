"""Order-dependent selection: greedy suppression, ordered claims and one-to-one matching.

A conflict join (grid based) first finds the pairs that matter; only those pairs are resolved.  The pairs of a cell pass
through a task once, in rank order, and what they decide is all that is remembered; a page larger than a cell is resolved by its
cells side by side, and decisions that cross a border go into the next round.  The work is linear in the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from boxloom.functions.geometry import Box, box
from boxloom.operators.spatial import near_pairs
from boxloom.session import cut_lineage

C = F.col

# side of a cell in pixels: ordinary pages are one cell
CELL_SPAN = 4096


def _cell(b: Box, span: int) -> Column:
    """Number of the cell that holds the box's top left corner."""
    return (F.floor(b.x / span) * 1_000_003 + F.floor(b.y / span)).cast("bigint")


def conflict_edges(items: DataFrame, order: list[Column], conflict: Callable[[Box, Box], Column], carry: tuple[str, ...] = (),
                   extra: Column | None = None, margin: int = 0, ident: str = "region_id", span: int = CELL_SPAN) -> DataFrame:
    """(page, rank, first, second, cells of both): ``first`` precedes ``second`` and, if kept, rules it out.

    ``conflict(kept, candidate)`` compares boxes; ``extra`` may use the carried columns as ``a_*`` (kept) and ``b_*``.
    """
    slim = items.select("page_id", ident, "x", "y", "w", "h", *carry, F.struct(*order, C(ident).alias("_id")).alias("rank"))
    on = (C("a_rank") < C("b_rank")) & conflict(box("a_"), box("b_"))
    pairs = near_pairs(slim, slim, on if extra is None else on & extra, margin)
    return pairs.select("page_id", C("a_rank").alias("rank"), C("a_" + ident).alias("first"), C("b_" + ident).alias("second"),
                        _cell(box("a_"), span).alias("cell"), _cell(box("b_"), span).alias("other_cell"))


# what a pass says of an edge: its second item goes, or its first item is not decided yet
GOES, WAITS = 1, 2


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one cell after another, in rank order: page_id, cell, first, second, inner, blocked come first."""
    at, gone, waiting = None, set(), set()
    for batch in batches:
        outcome = []
        for page, cell, first, second, inner, blocked in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if (page, cell) != at:
                at, gone, waiting = (page, cell), set(), set()
            if first in gone:
                outcome.append(0)
            elif blocked or first in waiting:
                outcome.append(WAITS)
                if inner and second not in gone:
                    waiting.add(second)
            else:
                outcome.append(GOES)
                if inner:
                    gone.add(second)
                    waiting.discard(second)
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(outcome, pa.int32())], names=[*batch.schema.names, "outcome"])
        yield out.filter(pa.array([o > 0 for o in outcome], pa.bool_()))


def suppressed(edges: DataFrame) -> DataFrame:
    """(page_id, id) of everything ruled out when items are taken in rank order.

    ``rank`` is that of ``first``, which precedes ``second``.  Edges without cells have one cell a page.  An item waits while an
    edge from another cell, whose first item is not decided, points at it; the lowest waiting item of a page never does for
    long, so every round decides some, and all of them where no edge crosses a border.
    """
    crossing = "cell" in edges.columns
    cells = [C("cell"), C("other_cell")] if crossing else [F.lit(0).cast("bigint").alias(c) for c in ("cell", "other_cell")]
    left, out = cut_lineage(edges.select("page_id", "rank", "first", "second", *cells)), None
    while True:
        inner = C("cell") == C("other_cell")
        if crossing:
            blocked = left.where(~inner).select("page_id", C("second").alias("first"), F.lit(True).alias("_blocked")).distinct()
            flagged = left.join(blocked, ["page_id", "first"], "left").withColumn("blocked", C("_blocked").isNotNull())
        else:
            flagged = left.withColumn("blocked", F.lit(False))
        rows = flagged.select("page_id", "cell", "first", "second", inner.alias("inner"), "blocked", "rank", "other_cell")
        ordered = rows.repartition("page_id", "cell").sortWithinPartitions("page_id", "cell", "rank", "first", "second")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", outcome int"
        done = cut_lineage(ordered.mapInArrow(_passed, schema))
        gone = done.where(C("outcome") == GOES).select("page_id", C("second").alias("id")).distinct()
        out = gone if out is None else out.unionByName(gone)
        if not crossing or done.where(C("outcome") == WAITS).isEmpty():
            return out.distinct()
        rest = done.where(C("outcome") == WAITS).select(*left.columns)
        rest = rest.join(gone.withColumnRenamed("id", "second"), ["page_id", "second"], "left_anti")
        left = cut_lineage(rest.join(gone.withColumnRenamed("id", "first"), ["page_id", "first"], "left_anti").select(*left.columns))


def keep_greedily(items: DataFrame, order: list[Column], conflict: Callable[[Box, Box], Column], carry: tuple[str, ...] = (),
                  extra: Column | None = None, ident: str = "region_id", span: int = CELL_SPAN) -> DataFrame:
    """Items that survive when each is kept unless an earlier kept one conflicts with it."""
    edges = conflict_edges(items, order, conflict, carry, extra, ident=ident, span=span)
    return items.join(suppressed(edges).withColumnRenamed("id", ident), ["page_id", ident], "left_anti")


def first_owner(kept: DataFrame, dropped: DataFrame, order: list[Column], conflict: Callable[[Box, Box], Column],
                carry: tuple[str, ...] = (), values: dict[str, Column] | None = None) -> DataFrame:
    """For each dropped item the first kept one, in rank order, that ruled it out."""
    def slim(df: DataFrame) -> DataFrame:
        return df.select("page_id", "region_id", "x", "y", "w", "h", *carry, F.struct(*order, C("region_id").alias("_id")).alias("rank"))

    pairs = near_pairs(slim(kept), slim(dropped), (C("a_rank") < C("b_rank")) & conflict(box("a_"), box("b_")))
    payload = F.struct(C("a_region_id").alias("owner_id"), *[v.alias(n) for n, v in (values or {}).items()])
    best = pairs.groupBy("page_id", C("b_region_id").alias("region_id")).agg(F.min_by(payload, C("a_rank")).alias("o"))
    return best.select("page_id", "region_id", "o.*")


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one page after another, in rank order, that find both sides free: page_id, left_id, right_id come first."""
    at, lefts, rights = None, set(), set()
    for batch in batches:
        free = []
        for page, left, right in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if page != at:
                at, lefts, rights = page, set(), set()
            free.append(left not in lefts and right not in rights)
            if free[-1]:
                lefts.add(left)
                rights.add(right)
        yield batch.filter(pa.array(free, pa.bool_()))


def match_one_to_one(pairs: DataFrame) -> DataFrame:
    """Each left item, in ``left_rank`` order, takes the best right item not taken before it.

    ``pairs`` holds page_id, left_rank, left_id, right_id, score; ties go to the lower right id.  The pairs of a page pass through
    a task once, which remembers the items taken.
    """
    rows = pairs.select("page_id", "left_id", "right_id", "score", "left_rank", (-C("score")).alias("neg"))
    ordered = rows.repartition("page_id").sortWithinPartitions("page_id", "left_rank", "neg", "right_id").select("page_id", "left_id", "right_id", "score")
    return ordered.mapInArrow(_matched, ordered.schema)
