"""Rectangle joins.

Every join hashes on ``(page, cell)`` rather than on the page alone, so the pairs examined are those
of neighbours, and one very large page is spread over as many tasks as it has cells.  A pair is kept
only in the cell that holds the top-left corner of what the two rectangles share, so no distinct is
needed.

With ``spread`` the join first counts the rows of both sides on every page.  A page of at most ``WHOLE``
rows a side needs no cells: its rows are sent once and compared there.  On larger pages the rows of every
cell are counted too.  Rectangles on more than ``LARGE`` cells then go to a coarse level instead of being
copied into every cell they cover, and both sides of a cell with more than ``DENSE`` rows are dealt to
salts, so that the rows that meet under one join key stay near ``DENSE`` a side however many rectangles
lie on one spot.  The counts reach the rows as tables of at most ``PAGE_SLOTS`` and ``SLOTS`` rows, keyed by
a hash of the page or cell: those that share a slot are split alike, which costs copies and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxloom.functions.geometry import Box, box
from boxloom.session import cut_lineage

CELL = 256
COARSE = 16
LARGE = 64
DENSE = 2048
SLOTS = 4096
WHOLE = 128
PAGE_SLOTS = 131_072

# what meets at a level: small with small on the fine grid, large left with any right, small left with large right, all of a small page
_SMALL, _LARGE_LEFT, _LARGE_RIGHT, _WHOLE = 0, 1, 2, 3
_CELL = ["_level", "_cx", "_cy"]


def _span(low: Column, high: Column, margin: int, size: Column | int) -> Column:
    return F.sequence(F.floor((low - margin) / size), F.floor((high + margin) / size))


def _cells(df: DataFrame, b: Box, margin: int, cell: int) -> DataFrame:
    return df.withColumn("_cx", F.explode(_span(b.x, b.x2, margin, cell))).withColumn("_cy", F.explode(_span(b.y, b.y2, margin, cell)))


def _size(cell: int) -> Column:
    return F.when(F.col("_level") == _SMALL, cell).otherwise(cell * COARSE)


def _leveled(df: DataFrame, b: Box, margin: int, cell: int, left: bool, meets_large: Column, big: Column | None = None) -> DataFrame:
    """Rows in the cells of every level they take part in; ``meets_large``: the other side may hold large ones on this page.

    Rows of pages that are not ``big`` stay in one piece.
    """
    def cells(low: Column, high: Column) -> Column:
        return F.floor((high + margin) / cell) - F.floor((low - margin) / cell) + 1

    large = cells(b.x, b.x2) * cells(b.y, b.y2) > LARGE
    own, other = (_LARGE_LEFT, _LARGE_RIGHT) if left else (_LARGE_RIGHT, _LARGE_LEFT)
    levels = F.when(large, F.array(F.lit(own)) if left else F.array(F.lit(own), F.lit(other))).when(
        meets_large, F.array(F.lit(_SMALL), F.lit(other))).otherwise(F.array(F.lit(_SMALL)))
    if big is not None:
        levels = F.when(big, levels).otherwise(F.array(F.lit(_WHOLE)))
    rows, one = df.withColumn("_level", F.explode(levels)), F.array(F.lit(0).cast("bigint"))
    for name, low, high in (("_cx", b.x, b.x2), ("_cy", b.y, b.y2)):
        rows = rows.withColumn(name, F.explode(F.when(F.col("_level") == _WHOLE, one).otherwise(_span(low, high, margin, _size(cell)))))
    return rows


def _slot(*key: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def page_slot(key: str) -> Column:
    return _slot(key, slots=PAGE_SLOTS).alias("_page_slot")


def large_pages(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Slots that hold a page with more than ``WHOLE`` rows of a side, where both sides have rows."""
    counts = left.groupBy(key).agg(F.count("*").alias("_l"))
    if left is right:
        counts = counts.withColumn("_r", F.col("_l"))
    else:
        sides = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        counts = sides.groupBy(key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    return cut_lineage(counts.where((F.least("_l", "_r") > 0) & (F.greatest("_l", "_r") > WHOLE)).select(page_slot(key)).distinct())


def spread_plan(left: DataFrame, right: DataFrame, a: Box, b: Box, margin: int, key: str, cell: int, big: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Salts of both sides by slot of the cell, and the slots of large pages with the sides that hold large rectangles there.

    Each table has one row for a slot that needs more than a plain join, ``SLOTS`` and ``PAGE_SLOTS`` at most.
    """
    big, always = large_pages(left, right, key) if big is None else big, F.lit(True)

    def side(df: DataFrame, r: Box, margin: int, first: bool) -> DataFrame:
        rows = df.select(key, *_sides(r)).withColumn("_page_slot", page_slot(key)).join(F.broadcast(big), "_page_slot", "left_semi")
        return _leveled(rows, r, margin, cell, first, always).select(key, *_CELL, F.lit(int(first)).alias("_l"), F.lit(int(not first)).alias("_r"))

    sides = side(left, a, margin, True).unionAll(side(right, b, 0, False))
    counts = sides.groupBy(key, *_CELL).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).where("_l > 0 AND _r > 0")
    salts = counts.where((F.col("_l") > DENSE) | (F.col("_r") > DENSE)).groupBy(_slot(key, *_CELL).alias("_cell_slot")).agg(
        F.max(F.ceil(F.col("_l") / DENSE)).alias("_left_salts"), F.max(F.ceil(F.col("_r") / DENSE)).alias("_right_salts"))
    held = counts.where(F.col("_level") != _SMALL).groupBy(page_slot(key)).agg(
        F.max(F.col("_level") == _LARGE_LEFT).alias("_left_large"), F.max(F.col("_level") == _LARGE_RIGHT).alias("_right_large"))
    return salts, big.join(held, "_page_slot", "left").withColumn("_big", F.lit(True))


def _sides(b: Box) -> list[Column]:
    return [b.x, b.y, b.w, b.h]


def _salted(df: DataFrame, b: Box, margin: int, key: str, cell: int, left: bool, plan: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Rows of one side under every (cell, salt) where they meet the other side."""
    salts, pages = plan
    # the hash of a whole row deals it out, the same way when a lost task is run again
    fields = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    mine, others = ("_left_salts", "_right_salts") if left else ("_right_salts", "_left_salts")
    rows = df.withColumn("_deal", F.xxhash64(*fields)).withColumn("_page_slot", page_slot(key)).join(F.broadcast(pages), "_page_slot", "left")
    rows = _leveled(rows, b, margin, cell, left, F.coalesce(F.col("_right_large" if left else "_left_large"), F.lit(False)), F.col("_big").isNotNull())
    rows = rows.withColumn("_cell_slot", _slot(key, *_CELL)).join(F.broadcast(salts), "_cell_slot", "left")
    own = F.pmod(F.col("_deal"), F.coalesce(F.col(mine), F.lit(1)))
    n = F.coalesce(F.col(others), F.lit(1))
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    pair = ("_own", "_other") if left else ("_other", "_own")
    return rows.select(*df.columns, *_CELL, F.col(pair[0]).alias("_sa"), F.col(pair[1]).alias("_sb"))


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename all columns but those in ``keep``."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def settled(pairs: DataFrame) -> DataFrame:
    """Rows as values of a generator: what is asked of them later is worked out from these values, and not inside the join for all that meet."""
    return pairs.select(F.explode(F.array(F.struct(*pairs.columns))).alias("_pair")).select("_pair.*")


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    on: Column | None = None,
    margin: int = 0,
    key: str = "page_id",
    left_prefix: str = "a_",
    right_prefix: str = "b_",
    cell: int = CELL,
    spread: bool = False,
    first: Column | None = None,
) -> DataFrame:
    """Pairs on one page whose larger axis gap is at most ``margin`` and that satisfy ``on``.

    Touching rectangles have gap 0.  Columns come back prefixed; ``on`` speaks in those names, as does ``first``, which is
    asked of all that meet and should be cheap.  ``spread`` reads
    both sides once more to count them, and again for the cells of large pages.
    """
    a, b = box(left_prefix), box(right_prefix)
    ls, rs = prefixed(left, left_prefix, (key,)), prefixed(right, right_prefix, (key,))
    touch = (
        (a.x - margin <= b.x2) & (b.x <= a.x2 + margin) & (a.y - margin <= b.y2) & (b.y <= a.y2 + margin)
    )
    condition = touch if first is None else first & touch

    def pairs(found: DataFrame) -> DataFrame:
        return settled(found) if on is None else settled(found).where(on)

    if spread:
        big = large_pages(left, right, key)
        if big.isEmpty():
            return pairs(ls.join(rs, key).where(condition))
        plan = spread_plan(ls, rs, a, b, margin, key, cell, big)
        ls, rs = _salted(ls, a, margin, key, cell, True, plan), _salted(rs, b, 0, key, cell, False, plan)
        size, at = _size(cell), [*_CELL, "_sa", "_sb"]
    else:
        ls, rs = _cells(ls, a, margin, cell), _cells(rs, b, 0, cell)
        size, at = F.lit(cell), ["_cx", "_cy"]
    corner_x = F.floor(F.greatest(a.x - margin, b.x) / size)
    corner_y = F.floor(F.greatest(a.y - margin, b.y) / size)
    own = (F.col("_cx") == corner_x) & (F.col("_cy") == corner_y)
    if spread:
        own = (F.col("_level") == _WHOLE) | own
    return pairs(ls.join(rs, [key, *at]).where(condition & own).drop(*at))


def self_pairs(df: DataFrame, on: Column | None = None, margin: int = 0, key: str = "page_id",
               ident: str = "region_id", cell: int = CELL, spread: bool = True) -> DataFrame:
    """Unordered neighbour pairs of one table, the smaller id on the left."""
    ordered = F.col("a_" + ident) < F.col("b_" + ident)
    return near_pairs(df, df, on, margin, key, cell=cell, spread=spread, first=ordered)


def keep_matching(left: DataFrame, right: DataFrame, on: Column | None = None, margin: int = 0,
                  key: str = "page_id", ident: str = "region_id", negate: bool = False) -> DataFrame:
    """Rows of ``left`` with (or, negated, without) a partner in ``right``."""
    hits = near_pairs(left, right, on, margin, key).select(key, F.col("a_" + ident).alias(ident)).distinct()
    return left.join(hits, [key, ident], "left_anti" if negate else "left_semi")


def best_partner(pairs: DataFrame, keys: list[str], order: Column, values: dict[str, Column]) -> DataFrame:
    """Per key the values of the pair with the smallest ``order``; partial aggregation, no sort."""
    payload = F.struct(*[c.alias(n) for n, c in values.items()])
    best = pairs.groupBy(*keys).agg(F.min_by(payload, order).alias("_best"))
    return best.select(*keys, *[F.col("_best")[n].alias(n) for n in values])
