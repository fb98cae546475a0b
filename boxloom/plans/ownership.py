"""Ownership conservation: every pixel claimed once, every erased pixel authorised."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxloom.functions.ladders import VISIBLE_ACTIONS, is_visible, ladder
from boxloom.plans.replay import directed, lies_in_media

C = F.col


def visible_claims(plan: DataFrame) -> DataFrame:
    return plan.where(is_visible(C("action"))).select("page_id", "region_id", "action", "role", "pixel_owner", "confidence")


def cleanup_claims(plan: DataFrame, targets: DataFrame) -> DataFrame:
    """Claims on the fallback image by every visible row, and on media images by the listed targets."""
    fallback = plan.where(is_visible(C("action"))).select(
        "page_id", "region_id", F.lit("fallback").alias("target"), F.lit(None).cast("bigint").alias("target_id"),
        F.lit("replayed_visible_object").alias("reason"))
    copied = targets.select("page_id", "region_id", F.lit("copied_image_asset").alias("target"), "target_id", "reason")
    return fallback.unionByName(copied)


def overlap_conflicts(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Visible pairs sharing a fifth of the smaller one (or near equal) that no owner relation explains."""
    ratio = C("shared_area") / F.least(C("a_w") * C("a_h"), C("b_w") * C("b_h"))
    pairs = edges.where(is_visible(C("a_action")) & is_visible(C("b_action")) & ((ratio >= 0.20) | (C("primary_rel") == "near_equal")))
    has_shape = (C("a_action") == "shape_replay") != (C("b_action") == "shape_replay")
    text_left = (C("a_action") == "text_replay") & (C("b_action") == "image_replay")
    text_right = (C("b_action") == "text_replay") & (C("a_action") == "image_replay")
    held = (C("primary_rel") == "near_equal") | (text_left & ((C("primary_rel") == "contained_by") | (C("left_in_right") >= 0.20))) | (
        text_right & ((C("primary_rel") == "contains") | (C("right_in_left") >= 0.20)))
    owned = targets.select("page_id", C("region_id").alias("_text"), C("target_id").alias("_media"), F.lit(True).alias("_owned"))
    marked = pairs.where(~has_shape).withColumn("_text", F.when(text_left, C("left_id")).when(text_right, C("right_id"))).withColumn(
        "_media", F.when(text_left, C("right_id")).when(text_right, C("left_id"))).withColumn("_held", held)
    joined = marked.join(owned, ["page_id", "_text", "_media"], "left")
    explained = C("_held") & C("_owned").isNotNull() & C("_text").isNotNull()
    return joined.where(~explained).select("page_id", "left_id", "right_id", F.lit("visible_ownership_overlap").alias("type"))


def missing_cleanup(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Visible text held by visible media without a cleanup target for that media."""
    held = directed(edges).where(
        (C("own_action") == "text_replay") & (C("other_action") == "image_replay") & (C("other_pixel_owner") == "preserve_raster")
        & (C("other_replay_decision") == "image_replay") & lies_in_media(0.20)).select(
        "page_id", C("own_id").alias("region_id"), C("other_id").alias("target_id"))
    return held.join(targets.select("page_id", "region_id", "target_id"), ["page_id", "region_id", "target_id"], "left_anti")


def invalid_cleanup(claims: DataFrame, plan: DataFrame, objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Cleanup claims that nothing authorises, with the first reason that applies."""
    rows = plan.select("page_id", "region_id", C("action").alias("_action"), F.lit(True).alias("_planned"))
    targets = objects.select("page_id", C("region_id").alias("target_id"), F.lit(True).alias("_known"),
                             ((C("pixel_owner") == "preserve_raster") & (C("replay_decision") == "image_replay")).alias("_media"))
    held = directed(edges).select("page_id", C("own_id").alias("region_id"), C("other_id").alias("target_id"), lies_in_media(0.20).alias("_held"))
    joined = claims.join(rows, ["page_id", "region_id"], "left").join(targets, ["page_id", "target_id"], "left").join(
        held, ["page_id", "region_id", "target_id"], "left")
    fallback = C("target") == "fallback"
    text = C("_action") == "text_replay"
    shape = (C("_action") == "shape_replay") & C("reason").isin("shape_background_contained_by_media", "foreground_claim_removed_from_residual_media")
    problem = ladder([
        (fallback & F.coalesce(is_visible(C("_action")), F.lit(False)), ""), (fallback, "invalid_fallback_cleanup_claim"),
        (C("_planned").isNull(), "plan item is missing"), (C("_known").isNull(), "target source object is missing"),
        (~C("_media"), "target must be preserve_raster image_replay media"), ((text | shape) & F.coalesce("_held", F.lit(False)), ""),
    ], "not authorized")
    return joined.withColumn("problem", problem).where("problem <> ''").select("page_id", "region_id", "target_id", "reason", "problem")


def non_visible_claims(plan: DataFrame) -> DataFrame:
    """Rows that are not shown yet name a target role, or carry an unknown action."""
    known = ("preserve_in_parent_raster", "fallback_only", "diagnostic_only", "suppress_duplicate")
    return plan.where(~C("action").isin(*VISIBLE_ACTIONS) & (C("role").isNotNull() | ~C("action").isin(*known))).select("page_id", "region_id")


def conflict_report(plan: DataFrame, edges: DataFrame, targets: DataFrame, claims: DataFrame) -> DataFrame:
    """All four kinds of conflict in one table with severity."""
    none = F.lit(None).cast("bigint")

    def rows(df: DataFrame, kind: str, severity: str, left: str, right) -> DataFrame:
        return df.select("page_id", F.lit(severity).alias("severity"), F.lit(kind).alias("type"), C(left).alias("object_id"), right.alias("other_id"))

    return (
        rows(non_visible_claims(plan), "non_visible_action_has_visible_claim", "error", "region_id", none)
        .unionByName(rows(overlap_conflicts(edges, targets), "visible_ownership_overlap", "warning", "left_id", C("right_id")))
        .unionByName(rows(missing_cleanup(edges, targets), "missing_copied_image_asset_cleanup", "warning", "region_id", C("target_id")))
        .unionByName(rows(invalid_cleanup(claims, plan, plan, edges), "invalid_copied_image_asset_cleanup", "error", "region_id", C("target_id")))
    )
