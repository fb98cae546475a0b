"""Overlapping tile grids and the way back from tile to page coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxloom.functions.geometry import Box, clamp, half_up


def grid_shape(w: Column, h: Column, count: int) -> tuple[Column, Column]:
    """Columns and rows of a grid that suits the page's aspect."""
    one = F.lit(1)
    if count == 6:
        tall = h / F.greatest(one, w) >= 1.25
        wide = w / F.greatest(one, h) >= 1.25
        return F.when(tall, 1).when(wide, 3).otherwise(2), F.when(tall, 6).when(wide, 2).otherwise(3)
    cols = F.greatest(one, half_up(F.sqrt(count * (w / F.greatest(one, h)))))
    return cols, F.ceil(F.lit(count) / cols)


def tile_grid(pages: DataFrame, count: int, overlap: int) -> DataFrame:
    """One row per tile of every page (width, height), at most ``count`` per page."""
    pad = overlap // 2
    cols, rows = grid_shape(F.col("width"), F.col("height"), count)
    cells = (
        pages.withColumn("_cols", cols.cast("bigint")).withColumn("_rows", rows.cast("bigint"))
        .withColumn("tile_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(count), F.col("_cols") * F.col("_rows")))))
        .withColumn("_c", (F.col("tile_no") - 1) % F.col("_cols"))
        .withColumn("_r", F.floor((F.col("tile_no") - 1) / F.col("_cols")))
    )

    def edges(pos: str, n: str, size: str) -> tuple[Column, Column]:
        p, k, s = F.col(pos), F.col(n), F.col(size)
        low = F.floor(p * s / k) - F.when(p > 0, pad).otherwise(0)
        high = F.ceil((p + 1) * s / k) + F.when(p < k - 1, pad).otherwise(0)
        start = clamp(low, 0, F.greatest(F.lit(0), s - 1))
        return start, clamp(high, start + 1, s)

    x, x2 = edges("_c", "_cols", "width")
    y, y2 = edges("_r", "_rows", "height")
    return cells.select(
        *pages.columns, "tile_no", F.format_string("tile_%04d", "tile_no").alias("tile_id"),
        x.alias("x"), y.alias("y"), (x2 - x).alias("w"), (y2 - y).alias("h"),
    )


def to_page(b: Box, tile: Box, sent_w: Column, sent_h: Column) -> Box:
    """A box found in a resized tile image, in page pixels."""
    sx, sy = tile.w / sent_w, tile.h / sent_h
    return Box(half_up(tile.x + b.x * sx), half_up(tile.y + b.y * sy), half_up(b.w * sx), half_up(b.h * sy))
