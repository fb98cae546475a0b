"""Text layers: word merging, row harmonising and scale."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from boxloom.functions.geometry import half_up, hull
from boxloom.functions.text import has_cjk
from boxloom.operators.banding import first_fit, in_row_order, rows_by_centre
from boxloom.operators.whole_pages import by_pages, in_tasks

C = F.col
LINE = ["page_id", "block", "par", "line"]


def lines_from_words(words: DataFrame, min_conf: int = 25) -> DataFrame:
    """Words of one line joined, with spaces where the gap asks for one and none around CJK."""
    good = words.where((F.trim("text") != "") & (C("conf") >= min_conf) & (C("w") > 0) & (C("h") > 0))
    parts = good.withColumn("_w", F.struct("word", "x", "pos", "text", (C("x") + C("w")).alias("x2"), "h", has_cjk(C("text")).alias("cjk")))
    grouped = parts.groupBy(*LINE).agg(F.sort_array(F.collect_list("_w")).alias("ws"), *hull(), half_up(F.avg("conf")).alias("conf"), F.count("*").alias("n"))

    def piece(w: Column, i: Column) -> Column:
        before = F.get("ws", i - 1)
        spaced = ~before["cjk"] & ~w["cjk"] & (w["x"] - before["x2"] > F.greatest(F.lit(2.0), F.least(before["h"], w["h"]) * 0.2))
        return F.when((i > 0) & spaced, F.concat(F.lit(" "), w["text"])).otherwise(w["text"])

    return grouped.select(*LINE, F.trim(F.array_join(F.transform("ws", piece), "")).alias("text"), "x", "y", "w", "h", "conf", "n")


def harmonized_sizes(layers: DataFrame) -> DataFrame:
    """Font sizes that move to the row's mode: same row, family, script and tone, at least three, within the threshold."""
    rows = rows_by_centre(layers, ["page_id"]).withColumn("script", F.coalesce("script", F.lit("")))
    key = ["page_id", "row_no", "family", "script", "tone"]
    sizes = rows.groupBy(*key, "font_size").agg(F.count("*").alias("k"))
    per_row = sizes.groupBy("page_id", "row_no").agg(F.sum("k").alias("in_row"))
    per_key = sizes.groupBy(*key).agg(F.sum("k").alias("n"), F.max("k").alias("best"))
    modes = sizes.join(per_key, key).join(per_row, ["page_id", "row_no"]).where((C("k") == C("best")) & (C("n") >= 3) & (C("in_row") >= 3)).groupBy(*key).agg(
        half_up(F.median("font_size")).alias("mode"))
    near = F.abs(C("font_size") - C("mode")) <= F.greatest(F.lit(3), F.least(F.lit(6), half_up(C("mode") * 0.18)))
    eligible = sizes.join(modes, key).where(near).groupBy(*key, "mode").agg(F.sum("k").alias("e")).where("e >= 2")
    return rows.join(eligible, key).where(near & (C("font_size") != C("mode"))).select("page_id", "region_id", "font_size", C("mode").alias("new_size"))


# a size that is not known
MISSING = -1 << 62


def _moved(sizes: dict) -> tuple[int, set]:
    """Mode of a row's sizes with their counts, and the sizes that move to it."""
    best = max(sizes.values())
    modes = sorted(s for s, k in sizes.items() if k == best and s != MISSING)
    if not modes:
        return 0, set()
    mode = math.floor((modes[(len(modes) - 1) // 2] + modes[len(modes) // 2]) / 2 + 0.5)
    near = {s for s in sizes if abs(s - mode) <= max(3, min(6, math.floor(mode * 0.18 + 0.5)))}
    return mode, near - {mode} if sum(sizes[s] for s in near) >= 2 else set()


def _harmonized(rows: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    cy, h, page, ids, size = (rows[c].tolist() for c in ("cy", "h", "page_id", "region_id", "font_size"))
    kinds = list(zip(rows["family"].tolist(), rows["script"].tolist(), rows["tone"].tolist()))
    found = []
    for low, high in pairwise([*starts.tolist(), len(cy)]):
        members = {}
        for i, row in enumerate(first_fit(cy[low:high], h[low:high]), low):
            members.setdefault((row, *kinds[i]), []).append(i)
        for (_, family, _, tone), items in members.items():
            # three of a kind are three of their row as well; what is not known equals nothing
            if len(items) >= 3 and family is not None and tone is not None:
                sizes = {}
                for i in items:
                    sizes[size[i]] = sizes.get(size[i], 0) + 1
                mode, moved = _moved(sizes)
                found += [(page[low], ids[i], size[i], mode) for i in items if size[i] in moved]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(4)], names=["page_id", "region_id", "font_size", "new_size"])


def page_harmonized_sizes(layers: DataFrame) -> DataFrame:
    """``harmonized_sizes`` of all pages: most are taken whole by a task.  Sizes are whole numbers."""
    columns = [*"xywh", F.coalesce(C("font_size").cast("bigint"), F.lit(MISSING)).alias("font_size"), "family", F.coalesce("script", F.lit("")).alias("script"), "tone"]
    return by_pages(layers, columns, lambda small: in_tasks(in_row_order(small), _harmonized, "page_id bigint, region_id bigint, font_size bigint, new_size bigint"), harmonized_sizes)


def scale_profile(lines: DataFrame, fallback: Column) -> DataFrame:
    """Working unit of a page from the median height of regular text and a fallback."""
    regular = (C("conf") >= 50) & C("h").between(6, 96) & (C("w") > 0) & (C("w") / F.greatest(F.lit(1), C("h")) <= 18)
    # heights are whole pixels from 6 to 96, so the exact median keeps few distinct values
    p = lines.groupBy("page_id").agg(F.median(F.when(regular, C("h"))).alias("_m"), F.count(F.when(regular, 1)).alias("samples"))
    p = p.select("page_id", F.coalesce("_m", F.lit(0.0)).alias("text_unit"), "samples", fallback.alias("_f"))
    low, high = F.least("text_unit", "_f"), F.greatest("text_unit", "_f")
    basis = F.when(C("text_unit") <= 0, C("_f")).when(high / F.greatest(F.lit(1.0), low) > 2.2, C("text_unit") * 0.75 + C("_f") * 0.25).otherwise(
        (C("text_unit") + C("_f")) / 2)
    return p.select("page_id", "text_unit", "samples", F.greatest(F.lit(8.0), F.least(F.lit(64.0), basis)).alias("basis"))
