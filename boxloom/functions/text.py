"""Text measures as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from boxloom.functions.geometry import Box, half_up
from boxloom.functions.ladders import ladder

# fixed values: script class and width units per character class
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
SPACE = r"[\s   -     　﻿]"
UNITS = ((SPACE, 0.32), (CJK, 1.0), ("[0-9]", 0.58), ("[A-Z]", 0.66), ("[a-z]", 0.56), ("[￥¥$%]", 0.62))
OTHER_UNITS = 0.42


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def script_class(text: Column) -> Column:
    """cjk, latin or mixed."""
    cjk, latin = has_cjk(text), text.rlike("[A-Za-z0-9]")
    return ladder([(cjk & latin, "mixed"), (cjk, "cjk")], "latin")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def visual_units(text: Column) -> Column:
    """Width of a text in ems: every character counts by its class; at least 1."""
    t = F.trim(text)
    # hundredths of an em above the width of an unclassified character, so the sum stays exact
    extra = None
    for pattern, unit in UNITS:
        n = _count(t, pattern) * round((unit - OTHER_UNITS) * 100)
        extra = n if extra is None else extra + n
    return F.greatest(F.lit(1.0), (extra + F.length(t) * round(OTHER_UNITS * 100)) / 100.0)


def rendered_width(units: Column, size: Column) -> Column:
    return F.greatest(size.cast("double"), units * size)


def measured_height(script: Column, size: Column) -> Column:
    return F.ceil(size * ladder([(script == "latin", 0.78), (script == "mixed", 0.86)], 0.84))


def no_wrap_width(units: Column, script: Column, size: Column) -> Column:
    """Width that keeps the text on one line."""
    safety = ladder([(script == "latin", 1.18), (script == "mixed", 1.26)], 1.22)
    pad = F.greatest(F.lit(6), half_up(size * 0.48))
    return F.ceil(rendered_width(units, size) * safety + pad)


def with_font_size(df: DataFrame, text: Column, b: Box, name: str) -> DataFrame:
    """Add the largest size from 8 up to the box limit whose estimated text fits; 8 when none does.

    Width and height grow linearly with the size, so the answer is a quotient; the neighbours are tried because a
    quotient of doubles may land just beside the true bound.
    """
    ratio = ladder([(script_class(text) == "latin", 0.78), (script_class(text) == "mixed", 0.86)], 0.84)
    measured = df.withColumns({
        "_units": visual_units(text), "_ratio": ratio,
        "_wide": F.greatest(F.lit(1), half_up(b.w * 0.98)), "_tall": F.greatest(F.lit(1), half_up(b.h * 0.98)),
        "_top": F.greatest(F.lit(8), F.least(half_up(b.h * 0.8), F.lit(55))),
        "_blank": (F.length(F.trim(text)) == 0) | (b.w <= 0) | (b.h <= 0),
    })
    units, ratio, wide, tall, top = (F.col(c) for c in ("_units", "_ratio", "_wide", "_tall", "_top"))
    guessed = measured.withColumn("_guess", F.least(top, F.floor(wide / units), F.floor(tall / ratio)))
    guess = F.col("_guess")

    def fits(s: Column) -> Column:
        return (units * s <= wide) & (s * ratio <= tall)

    best = F.when(fits(guess + 1) & (guess + 1 <= top), guess + 1).when(fits(guess), guess).otherwise(guess - 1)
    size = F.when(F.col("_blank"), F.lit(8)).otherwise(F.greatest(F.lit(8), best)).cast("bigint")
    return guessed.withColumn(name, size).drop("_units", "_ratio", "_wide", "_tall", "_top", "_blank", "_guess")


def looks_like_marker(text: Column) -> Column:
    """Generated labels such as img-12 or g_3."""
    compact = F.regexp_replace(F.trim(text), r"[()［］\[\]{}]", "")
    return compact.rlike("(?i)^(img|lmg|ing)[-_]?[0-9]{1,4}$") | compact.rlike("(?i)^[gm][-_]?[0-9]{1,4}$")


def looks_editable(text: Column, b: Box, page_width: Column) -> Column:
    """Geometry of a text line fits ordinary running text."""
    t = F.trim(text)
    n, share = F.length(t), b.w / F.greatest(F.lit(1), page_width)
    return ~(
        (n == 0) | ((share > 0.72) & (n < 12)) | (share > 0.92) | ((b.h > 90) & (n < 8))
        | (has_cjk(t) & (n <= 4) & (b.h > b.w * 1.25))
    )


def single_token_like(text: Column) -> Column:
    """One character, or only digits, punctuation and unit signs."""
    compact = F.regexp_replace(text, SPACE, "")
    marks = r"^[\p{Nd}!-/:-@\[-`{-~￥¥%元人课分秒时天月年]*$"
    return (F.length(compact) > 0) & ((F.length(compact) <= 1) | compact.rlike(marks))


def slug(text: Column) -> Column:
    """Letters, digits, _ and - kept, other runs become one -, at most 40 characters (ASCII path)."""
    dashed = F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}_-]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 40)


@F.pandas_udf(StringType())
def fold_compat(values: pd.Series) -> pd.Series:
    """Compatibility decomposition, which Spark has no built-in for."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


def slug_any(text: Column) -> Column:
    """``slug`` for any script; only text outside ASCII goes through Python."""
    trimmed = F.trim(text)
    return slug(F.when(trimmed.rlike(r"^\p{ASCII}*$"), trimmed).otherwise(fold_compat(trimmed)))


def safe_id(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9_-]+$")


def safe_slice_id(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9_-]+(__[A-Za-z0-9_-]+)*$")


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 32)


def normal_email(value: Column) -> Column:
    return F.lower(F.trim(value))
