"""Icons that stand in an even row gain score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxloom.functions.geometry import half_even
from boxloom.functions.ladders import ladder
from boxloom.operators.ranking import following

C = F.col
MEDIUM = ["page_id", "media_id"]

# fixed values: names of the roles and decisions, score of two icons, weight of the repetition, and thresholds
ACCEPTED, REJECTED, ICON = "accepted_report_candidate", "rejected_fragment", "internal_icon_candidate"
SCORE_OF_TWO, WEIGHT, REPEATED = 0.65, 0.12, 0.55


def anchored_confidence(score: Column, anchor: Column, decision: Column) -> Column:
    """Confidence of a candidate from its score and the score of its text anchor."""
    return ladder([(decision == REJECTED, "low"), ((score >= 0.68) & (anchor >= 0.45), "high"), ((score >= 0.45) | (anchor >= 0.35), "medium")], "low")


def row_repetition(icons: DataFrame) -> DataFrame:
    """(page_id, media_id, repetition) of media with two icons or more: how level they stand and how even their gaps are.

    A medium is summed up by extremes, the upper median of the heights (from counts per height) and the first two moments of
    the gaps between neighbouring centres, so no medium is gathered in one task.
    """
    placed = icons.select(*MEDIUM, "region_id", "h", (C("x") * 2 + C("w")).alias("cx"), (C("y") * 2 + C("h")).alias("cy"))
    base = placed.groupBy(*MEDIUM).agg(F.count("*").alias("n"), (F.max("cy") - F.min("cy")).alias("spread"), (F.max("cx") - F.min("cx")).alias("span")).where("n >= 2")
    heights = placed.groupBy(*MEDIUM, "h").agg(F.count("*").alias("_k"))
    # as many rows a medium as it has different heights
    upto = F.sum("_k").over(Window.partitionBy(*MEDIUM).orderBy("h"))
    median = heights.withColumn("_upto", upto).join(base.select(*MEDIUM, "n"), MEDIUM).where(C("_upto") > F.floor(C("n") / 2)).groupBy(*MEDIUM).agg(F.min("h").alias("middle"))
    gaps = following(placed, MEDIUM, F.floor(C("cx") / 128), [C("cx"), C("region_id")], ["cx"]).where("next_cx IS NOT NULL").withColumn("_g", C("next_cx") - C("cx"))
    moments = gaps.groupBy(*MEDIUM).agg(F.sum(C("_g") * C("_g")).alias("squares"))
    s = base.join(median, MEDIUM).join(moments, MEDIUM)
    # centres are in half pixels
    level = half_even(F.greatest(F.lit(0.0), 1 - C("spread") / 2 / F.greatest(F.lit(1.0), C("middle") * 1.5)), 3)
    uneven = F.sqrt(((C("n") - 1) * C("squares") - C("span") * C("span")).cast("double")) / C("span")
    even = F.when(C("n") == 2, SCORE_OF_TWO).when(C("span") <= 0, 0.0).otherwise(half_even(F.greatest(F.lit(0.0), 1 - uneven), 3))
    return s.select(*MEDIUM, half_even((level + even) / 2, 3).alias("repetition"))


def with_repetition(candidates: DataFrame) -> DataFrame:
    """Candidates with ``repetition``, the raised ``score``, ``confidence`` and ``supported``.

    Only accepted icons that belong to a text count and gain; the others keep what they have.
    """
    counts = F.coalesce((C("decision") == ACCEPTED) & (C("role") == ICON) & C("ocr_id").isNotNull(), F.lit(False))
    found = row_repetition(candidates.where(counts))
    joined = candidates.join(found, MEDIUM, "left").withColumn("repetition", F.when(counts, C("repetition")))
    gains = C("repetition").isNotNull()
    raised = F.when(gains, half_even(F.least(F.lit(1.0), C("score") + C("repetition") * WEIGHT), 3)).otherwise(C("score"))
    return joined.withColumn("supported", gains & (C("repetition") >= REPEATED) & C("confidence").isin("high", "medium")).withColumn("score", raised).withColumn(
        "confidence", F.when(gains, anchored_confidence(C("score"), C("anchor"), C("decision"))).otherwise(C("confidence")))
