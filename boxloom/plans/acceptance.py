"""Detection acceptance: from raw model boxes to the boxes offered for cutting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxloom.functions.geometry import box, iou, normalize, share_of
from boxloom.operators.greedy import keep_greedily
from boxloom.operators.ranking import first_per_group, row_numbers
from boxloom.operators.spatial import keep_matching
from boxloom.session import cut_lineage

C = F.col


def union_in_order(overview: DataFrame, tiles: DataFrame) -> DataFrame:
    """Overview boxes first, then tile boxes, each in input order."""
    both = overview.withColumn("_pass", F.lit(0)).unionByName(tiles.withColumn("_pass", F.lit(1)))
    return row_numbers(both, ["page_id"], [C("_pass"), C("region_id")], "position").drop("_pass")


def accept(detections: DataFrame, slices: DataFrame, width: int, height: int, max_boxes: int) -> DataFrame:
    """Boxes inside the page, size gates, overview preference, no repeats of slices or of accepted boxes, at most ``max_boxes`` per page.

    Boxes that are not finite or not positive go first; the others are clipped to the page before any rule reads them.
    """
    area = width * height
    raw = box("")
    finite = [c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")) for c in raw]
    usable = detections.where(finite[0] & finite[1] & finite[2] & finite[3] & (raw.w > 0) & (raw.h > 0))
    clipped = normalize(raw, F.lit(width), F.lit(height), 1)
    boxes = usable.withColumns({n: c.cast("bigint") for c, n in zip(clipped, "xywh")})
    sized = boxes.where((C("w") >= 8) & (C("h") >= 8) & (C("w") * C("h") / area <= 0.82))
    # dealt out and stored once: every rule below reads them, and a given table may be a single split
    sized = cut_lineage(sized.withColumn("_pass", F.when(C("source_kind") == "overview", 0).otherwise(1)).repartition("page_id", "region_id"))
    overview = sized.where((C("_pass") == 0) & (C("w") * C("h") / area >= 0.01)).select("page_id", *"xywh", F.lit(True).alias("preferred"))
    known = overview.unionByName(slices.select("page_id", *"xywh", F.lit(False).alias("preferred")))
    one, two = box("a_"), box("b_")
    repeats = F.when(C("b_preferred"), (C("a__pass") == 1) & (share_of(one, two) >= 0.72)).otherwise(iou(one, two) >= 0.6)
    fresh = cut_lineage(keep_matching(sized, known, repeats, negate=True))
    kept = keep_greedily(fresh, [C("_pass")], lambda k, c: iou(k, c) >= 0.72)
    # stopping at the cap equals taking the first so many of all kept boxes
    return first_per_group(kept, ["page_id"], [C("_pass"), C("region_id")], max_boxes, "position").drop("_pass")


def page_counts(detections: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted and rejected per page; whatever was not accepted counts as rejected."""
    raw = detections.groupBy("page_id").agg(F.count("*").alias("raw"))
    got = accepted.groupBy("page_id").agg(F.count("*").alias("accepted"))
    joined = raw.join(got, "page_id", "left").fillna(0, ["accepted"])
    return joined.select("page_id", "accepted", (C("raw") - C("accepted")).alias("rejected"))
