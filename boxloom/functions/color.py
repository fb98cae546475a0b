"""Colour helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boxloom.functions.ladders import ladder


def normal_hex(value: Column) -> Column:
    """#RRGGBB in upper case, null for anything else."""
    t = F.trim(value)
    return F.when(t.rlike("^#[0-9A-Fa-f]{6}$"), F.upper(t))


def channels(value: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(value, s, 2), 16, 10).cast("int") for s in (2, 4, 6))


def color_family(value: Column) -> Column:
    r, g, b = channels(value)
    spread = F.greatest(r, g, b) - F.least(r, g, b)
    return ladder(
        [
            (value.isNull() | ~value.rlike("^#[0-9A-Fa-f]{6}$"), "unknown"),
            (spread < 28, "neutral"),
            ((b >= r + 28) & (b >= g + 16), "blue"),
            ((g >= r + 18) & (g >= b + 18), "green"),
            ((r >= g + 18) & (r >= b + 18), "red_or_orange"),
        ],
        "chromatic",
    )


def color_distance(p: tuple[Column, Column, Column], q: tuple[Column, Column, Column]) -> Column:
    total = None
    for a, b in zip(p, q):
        term = (a - b) * (a - b)
        total = term if total is None else total + term
    return F.sqrt(total.cast("double"))


def luma(rgb: tuple[Column, Column, Column]) -> Column:
    return rgb[0] * 0.299 + rgb[1] * 0.587 + rgb[2] * 0.114
