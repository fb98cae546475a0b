"""Rows, bands, batches and runs inside a page.

The rules look at one coordinate after another.  Each first reduces a page to its distinct pixel coordinates, of which
there are no more than a page has pixels along an axis, and folds or windows over those.  Pages that a task takes whole
(``page_batches``, ``page_regular_rows``) are read item by item instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from boxloom.operators.ranking import following, row_numbers
from boxloom.operators.whole_pages import by_pages, in_tasks

C = F.col
# half pixels of a centre that share a slot
SLOT = 64


def rows_by_centre(items: DataFrame, key: list[str], factor: float = 0.42, least: int = 8) -> DataFrame:
    """First-fit rows on the centre line; the tolerance follows the row's first member.

    Items of equal centre and height land in the same row, so the work runs over those spots.  A fold finds the spots that
    open a row and looks only at open rows that a later centre can still reach: row heads lie more than ``least`` apart, so
    these are few.  Every spot then meets the heads in reach by an equi-join on slots of the centre and takes the lowest row.
    """
    spots = items.groupBy(*key, (C("y") * 2 + C("h")).cast("bigint").alias("_cy"), C("h").cast("bigint").alias("_h")).agg(F.min("x").alias("_x"))
    lists = spots.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_cy", "_x", "_h"))).alias("s"), F.max("_h").alias("_top"))
    row = "array<struct<cy:bigint,h:bigint>>"
    zero = F.struct(F.array().cast(row).alias("open"), F.array().cast(row).alias("heads"))

    def reach(h: Column) -> Column:
        return 2 * F.greatest(F.lit(float(least)), h * factor)

    def step(acc: Column, s: Column) -> Column:
        live = F.filter(acc["open"], lambda r: r["cy"] >= s["_cy"] - reach(C("_top")))
        fits = F.exists(live, lambda r: s["_cy"] - r["cy"] <= reach(F.least(r["h"], s["_h"])))
        head = F.array(F.struct(s["_cy"].alias("cy"), s["_h"].alias("h")))
        return F.when(fits, F.struct(live.alias("open"), acc["heads"].alias("heads"))).otherwise(
            F.struct(F.concat(live, head).alias("open"), F.concat(acc["heads"], head).alias("heads")))

    heads = lists.select(*key, F.posexplode(F.aggregate("s", zero, step)["heads"]).alias("_i", "_head")).select(
        *key, (C("_i") + 1).alias("_row"), C("_head.cy").alias("_head_cy"), C("_head.h").alias("_head_h"), F.floor(C("_head.cy") / SLOT).alias("_slot"))
    near = spots.withColumn("_slot", F.explode(F.sequence(F.floor((C("_cy") - reach(C("_h"))) / SLOT), F.floor(C("_cy") / SLOT)))).join(heads, [*key, "_slot"])
    # heads below a spot have higher numbers than the row it found, so the lowest fitting number is the first fit
    placed = near.where(F.abs(C("_cy") - C("_head_cy")) <= reach(F.least("_h", "_head_h"))).groupBy(*key, "_cy", "_h").agg(F.min("_row").alias("row_no"))
    return items.withColumn("_cy", C("y") * 2 + C("h")).withColumn("_h", C("h")).join(placed, [*key, "_cy", "_h"]).drop("_cy", "_h")


def vertical_bands(items: DataFrame, key: str = "page_id") -> DataFrame:
    """Band number of every item: a new band starts after a wide enough empty stretch.

    Only the first item of a y position can open a band, so the window runs over distinct y positions.
    """
    lines = items.groupBy(key, "y").agg(F.max(C("y") + C("h")).alias("_bottom"), F.min_by("h", F.struct("x", "region_id")).alias("_h"))
    order = Window.partitionBy(key).orderBy("y")
    above = F.max("_bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    breaks = C("y") - above >= F.greatest(F.lit(96), F.least(F.lit(180), C("_h") * 2))
    marked = lines.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("int"))
    banded = marked.withColumn("band", F.sum("_break").over(order) + 1)
    return items.join(banded.select(key, "y", "band"), [key, "y"])


def batches(items: DataFrame, page_height: int, cap: int = 25, window: int = 640, overlap: int = 80) -> DataFrame:
    """Batch number per page: bands cut into windows of limited height and size.

    The fold sees each y position once with its item count; the items of one position are dealt out by arithmetic.
    """
    banded = vertical_bands(items)
    ranked = row_numbers(banded, ["page_id", "y"], [C("x"), C("region_id")], "_j")
    lines = banded.groupBy("page_id", "band", "y").agg(F.count("*").alias("_k"))
    lists = lines.groupBy("page_id", "band").agg(F.array_sort(F.collect_list(F.struct("y", "_k"))).alias("s"))
    zero = F.struct(F.lit(None).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("b"),
                    F.array().cast("array<struct<y:bigint,b:bigint,n:bigint>>").alias("out"))

    def limit(start: Column) -> Column:
        return F.least(F.lit(page_height), start + window).cast("bigint")

    def step(acc: Column, s: Column) -> Column:
        outside = (acc["n"] > 0) & (s["y"] >= acc["end"])
        n0 = F.when(outside, F.lit(0)).otherwise(acc["n"]).cast("bigint")
        b0 = acc["b"] + outside.cast("bigint")
        total = n0 + s["_k"]
        more = F.floor((total - 1) / cap)
        # a first position that overfills its batch opens the next one with an overlap, like any other
        end = F.when(outside | (more > 0), limit(F.greatest(F.lit(0), s["y"] - overlap))).when(acc["end"].isNull(), limit(s["y"])).otherwise(acc["end"])
        entry = F.struct(s["y"].cast("bigint").alias("y"), b0.alias("b"), n0.alias("n"))
        return F.struct(end.alias("end"), ((total - 1) % cap + 1).alias("n"), (b0 + more).alias("b"), F.concat(acc["out"], F.array(entry)).alias("out"))

    folded = lists.select("page_id", "band", F.aggregate("s", zero, step).alias("f"))
    before = Window.partitionBy("page_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    # bands per page are at most the page height over the smallest gap
    starts = folded.withColumn("_start", F.coalesce(F.sum("f.b").over(before), F.lit(0)))
    placed = starts.select("page_id", "band", "_start", F.explode("f.out").alias("p")).select("page_id", "band", "_start", "p.*")
    joined = ranked.join(placed, ["page_id", "band", "y"])
    return joined.withColumn("batch", C("_start") + C("b") + F.floor((C("n") + C("_j") - 1) / cap)).drop("_start", "b", "n", "_j")


def page_batches(items: DataFrame, page_height: int, cap: int = 25, window: int = 640, overlap: int = 80) -> DataFrame:
    """(page_id, region_id, batch) of ``batches``: a task goes through the pages it takes whole, the others are folded by position."""
    def work(rows: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        y, h, found = rows["y"].tolist(), rows["h"].tolist(), []
        for low, high in pairwise([*starts.tolist(), len(y)]):
            batch = held = end = bottom = 0
            for i in range(low, high):
                top = y[i]
                if i == low or top - bottom >= max(96, min(180, h[i] * 2)):
                    batch, held, end = batch + 1, 1, min(page_height, top + window)
                elif held >= cap or top >= end:
                    batch, held, end = batch + 1, 1, min(page_height, max(0, top - overlap) + window)
                else:
                    held += 1
                bottom = top + h[i] if i == low else max(bottom, top + h[i])
                found.append(batch)
        yield pa.RecordBatch.from_pydict({"page_id": rows["page_id"], "region_id": rows["region_id"], "batch": pa.array(found, pa.int64())})

    return by_pages(items, [*"xywh"], lambda small: in_tasks(small.sortWithinPartitions("page_id", "y", "x", "region_id"), work, "page_id bigint, region_id bigint, batch bigint"),
                    lambda others: batches(others, page_height, cap, window, overlap))


def first_fit(cy: list[int], h: list[int], factor: float = 0.42, least: int = 8) -> list[int]:
    """Row of each item of a page, as ``rows_by_centre`` numbers them; items come in order of twice the centre, x and height."""
    heads, first, found = [], 0, []
    for c, size in zip(cy, h):
        # a head never reaches further than by its own height
        while first < len(heads) and c - heads[first][0] > 2 * max(least, heads[first][1] * factor):
            first += 1
        for k in range(first, len(heads)):
            if c - heads[k][0] <= 2 * max(least, min(heads[k][1], size) * factor):
                found.append(k + 1)
                break
        else:
            heads.append((c, size))
            found.append(len(heads))
    return found


def in_row_order(small: DataFrame) -> DataFrame:
    """Whole pages with ``cy``, in the order that ``first_fit`` reads."""
    return small.withColumn("cy", C("y") * 2 + C("h")).sortWithinPartitions("page_id", "cy", "x", "h", "region_id")


def _regular(rows: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    cy, h, page = rows["cy"].tolist(), rows["h"].tolist(), rows["page_id"].tolist()
    centres, found = (rows["x"] + rows["w"] / 2).tolist(), []
    for low, high in pairwise([*starts.tolist(), len(cy)]):
        members = {}
        for i, row in enumerate(first_fit(cy[low:high], h[low:high]), low):
            members.setdefault(row, []).append(centres[i])
        for row, cx in members.items():
            n = len(cx)
            if n >= 3:
                cx.sort()
                mean = (cx[-1] - cx[0]) / (n - 1)
                off = max(abs(b - a - mean) for a, b in pairwise(cx))
                found.append((page[low], row, n, mean > 0 and off <= max(18.0, mean * 0.35)))
    names = ("page_id", "row_no", "n", "regular")
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.bool_()))], names=names)


def page_regular_rows(items: DataFrame) -> DataFrame:
    """``regular_rows`` of the ``rows_by_centre`` of all pages: most are taken whole by a task."""
    return by_pages(items, [*"xywh"], lambda small: in_tasks(in_row_order(small), _regular, "page_id bigint, row_no int, n bigint, regular boolean"),
                    lambda others: regular_rows(rows_by_centre(others, ["page_id"]), ["page_id", "row_no"]))


def regular_rows(items: DataFrame, key: list[str]) -> DataFrame:
    """Rows of at least three items whose centre gaps all stay near their mean."""
    centred = items.withColumn("_cx", C("x") + C("w") / 2)
    nxt = following(centred, key, F.floor(C("_cx")), [C("_cx"), C("region_id")], ["_cx"]).where("next__cx IS NOT NULL")
    mean = centred.groupBy(*key).agg(F.count("*").alias("n"), ((F.max("_cx") - F.min("_cx")) / (F.count("*") - 1)).alias("_avg")).where("n >= 3")
    off = nxt.join(mean, key).groupBy(*key, "n", "_avg").agg(F.max(F.abs(C("next__cx") - C("_cx") - C("_avg"))).alias("_off"))
    return off.select(*key, "n", ((C("_avg") > 0) & (C("_off") <= F.greatest(F.lit(18.0), C("_avg") * 0.35))).alias("regular"))


def close_gaps(flags: DataFrame, max_gap: int) -> DataFrame:
    """Short runs of false become true, also at either end."""
    w = Window.partitionBy("page_id").orderBy("idx")
    runs = flags.withColumn("_new", F.coalesce((C("value") != F.lag("value").over(w)).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(w))
    size = runs.groupBy("page_id", "_run").agg(F.count("*").alias("_len"))
    return runs.join(size, ["page_id", "_run"]).select("page_id", "idx", (C("value") | (C("_len") <= max_gap)).alias("value"))


def spans(flags: DataFrame, min_length: int, max_gap: int) -> DataFrame:
    """Runs of true of at least ``min_length``, those closer than ``max_gap`` joined.

    ``flags`` has one row per pixel row or tile row of a page, so a page is bounded by its height.
    """
    w = Window.partitionBy("page_id").orderBy("idx")
    on = flags.where("value").withColumn("_run", C("idx") - F.row_number().over(w))
    runs = on.groupBy("page_id", "_run").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end")).where(C("end") - C("start") >= min_length)
    v = Window.partitionBy("page_id").orderBy("start")
    split = runs.withColumn("_cut", F.coalesce((C("start") - F.lag("end").over(v) > max_gap).cast("int"), F.lit(0)))
    return split.withColumn("_island", F.sum("_cut").over(v)).groupBy("page_id", "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
