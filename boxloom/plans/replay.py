"""Replay plan: which regions become visible nodes, and what has to be cleaned up behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxloom.functions.geometry import box, gap, half_even, overlap
from boxloom.functions.ladders import is_visible, ladder, replay_action, target_role
from boxloom.operators.greedy import suppressed
from boxloom.operators.ranking import has_large_groups, row_numbers
from boxloom.operators.relations import RelationOptions, near_threshold, primary_relation, region_relations
from boxloom.operators.spatial import near_pairs, settled
from boxloom.session import cut_lineage

C = F.col
PAIR = ["page_id", "region_id"]

# fixed values: ranks of owners, confidences and actions
OWNER_RANK = {"editable_text": 50, "preserve_raster": 40, "raster_icon": 35, "shape_geometry": 30, "fallback_only": 10}
CONFIDENCE_ORDER = {"high": 0, "medium": 1}
OVERLAP_ORDER = {"image_replay": 0, "text_replay": 1, "shape_replay": 2, "icon_replay": 3}
BUDGET_ORDER = {"shape_replay": 0, "image_replay": 1, "icon_replay": 2, "text_replay": 3}
# fixed values: sources of promoted objects, roles that need a replacement style
ICON_SOURCES = ("m29_6_internal_icon_candidate", "m29_6_foreground_claim")
SHAPE_SOURCES = ("m29_6_internal_shape_candidate", "m29_6_foreground_claim")
STYLED_ROLES = ("status_dot_candidate", "table_marker_candidate", "internal_overlay_badge", "internal_pill_button", "internal_circle_control")
# what is known of an object's origin; objects without these columns have no promoted icons
EVIDENCE = ("promotion", "parent_media", "has_asset", "row_crop", "text_share", "evidence_score", "label_blocked", "media_share", "readable_media")
PLAN_ORDER = {**BUDGET_ORDER, "preserve_in_parent_raster": 4, "fallback_only": 5, "diagnostic_only": 6}


def rank_of(value: Column, ranks: dict[str, int], default: int) -> Column:
    return ladder([(value == k, v) for k, v in ranks.items()], default)


def with_actions(objects: DataFrame) -> DataFrame:
    """Replay action and target role of every source object."""
    acted = objects.withColumn("action", replay_action(C("replay_decision"), C("pixel_owner"), C("confidence")))
    return acted.withColumn("role", target_role(C("action")))


def object_edges(objects: DataFrame) -> DataFrame:
    """Relation edges with the attributes the plan rules read."""
    known = tuple(c for c in EVIDENCE if c in objects.columns)
    return region_relations(objects, carry=("pixel_owner", "replay_decision", "confidence", "action", *known))


def promoted_icon(p: str = "") -> Column:
    """The object is an icon that was promoted out of a media object."""
    return F.coalesce((C(p + "pixel_owner") == "raster_icon") & (C(p + "replay_decision") == "icon_replay") & C(p + "promotion").isin(*ICON_SOURCES), F.lit(False))


def spared_icon(media: str, icon: str, media_id: Column) -> Column:
    """An icon that may lie on its media: promoted out of it with pixels of its own, or anchored to a label and blocked."""
    own = C(icon + "promotion").isin(*ICON_SOURCES) & (C(icon + "parent_media") == media_id) & (C(icon + "has_asset") | C(icon + "row_crop"))
    anchored = C(icon + "label_blocked") & (C(icon + "media_share") >= 0.80) & C(media + "readable_media")
    return F.coalesce(own, F.lit(False)) | F.coalesce(anchored, F.lit(False))


def spared_label(icon: str) -> Column:
    """A promoted icon with pixels of its own that hardly touches text may overlap its label."""
    return F.coalesce(C(icon + "promotion").isin(*ICON_SOURCES) & (C(icon + "has_asset") | C(icon + "row_crop")) & (F.coalesce(C(icon + "text_share"), F.lit(0.0)) <= 0.14), F.lit(False))


def directed(edges: DataFrame) -> DataFrame:
    """Each edge from both ends, in one read: how far ``own`` lies in ``other`` and whether the relation says so."""
    def side(own: str, other: str, own_id: str, other_id: str, ratio: str, inside: str) -> Column:
        named = [F.col(f"{p}_{c}").alias(f"{n}_{c}") for p, n in ((own, "own"), (other, "other"))
                 for c in ("pixel_owner", "replay_decision", "confidence", "action", "x", "y", "w", "h")]
        return F.struct(C(own_id).alias("own_id"), C(other_id).alias("other_id"), C(ratio).alias("own_in_other"),
                        (C("primary_rel") == inside).alias("contained"), *named)

    ends = F.array(side("a", "b", "left_id", "right_id", "left_in_right", "contained_by"), side("b", "a", "right_id", "left_id", "right_in_left", "contains"))
    return edges.select("page_id", "primary_rel", F.explode(ends).alias("e")).select("page_id", "e.own_id", "e.other_id", "primary_rel", "e.own_in_other", "e.contained", *[
        f"e.{n}_{c}" for n in ("own", "other") for c in ("pixel_owner", "replay_decision", "confidence", "action", "x", "y", "w", "h")])


def lies_in_media(threshold) -> Column:
    """The own object counts as held by the other one."""
    return (C("primary_rel") == "near_equal") | C("contained") | (C("own_in_other") >= threshold)


def _conflicts(edges: DataFrame) -> DataFrame:
    """Edges on which one end may be given up, and no more of them than the two rules read.

    ``near``: the ends are nearly equal, and ``wins`` if the earlier one ranks no lower.  ``loses``: of two visible ends ``second`` is
    given up for ``first``, which stands at ``rank``.
    """
    def priority(p: str) -> Column:
        weight = {"high": 3, "medium": 2, "low": 1}
        return rank_of(C(p + "pixel_owner"), OWNER_RANK, 0) * 10 + rank_of(C(p + "confidence"), weight, 0)

    def rank(p: str) -> Column:
        return F.struct(rank_of(C(p + "action"), OVERLAP_ORDER, 9).alias("a"), rank_of(C(p + "confidence"), CONFIDENCE_ORDER, 2).alias("c"),
                        (-C(p + "w") * C(p + "h")).alias("s"), C("left_id" if p == "a_" else "right_id").alias("i"))

    read = [f"{p}_{c}" for c in ("pixel_owner", "replay_decision", "confidence", "action", "w", "h", *EVIDENCE) for p in "ab"]
    # expressions of one step are not written out in the next
    edges = settled(edges.where("primary_rel <> 'disjoint'").select("page_id", "left_id", "right_id", "primary_rel", "shared_area", *[c for c in read if c in edges.columns]))
    edges = settled(edges.withColumns({"a_rank": rank("a_"), "b_rank": rank("b_")}).withColumn("swapped", C("b_rank") < C("a_rank")))
    wins, swapped = priority("a_") >= priority("b_"), C("swapped")
    over_media = over_label = F.lit(False)
    if "a_promotion" in edges.columns:
        score = lambda p: F.coalesce(C(p + "evidence_score"), F.lit(0.0))
        wins = F.when(promoted_icon("a_") & promoted_icon("b_"), score("a_") >= score("b_")).otherwise(wins)
        # of an image or text and an icon, the icon ranks second
        over_media = F.when(swapped, spared_icon("b_", "a_", C("right_id"))).otherwise(spared_icon("a_", "b_", C("left_id")))
        over_label = F.when(swapped, spared_label("a_")).otherwise(spared_label("b_"))
    near = C("primary_rel") == "near_equal"
    ranked = settled(edges.select(
        "page_id", "left_id", "right_id", "primary_rel", near.alias("near"), F.when(near, wins).alias("wins"), F.least("a_rank", "b_rank").alias("rank"),
        F.when(swapped, C("right_id")).otherwise(C("left_id")).alias("first"), F.when(swapped, C("left_id")).otherwise(C("right_id")).alias("second"),
        F.when(swapped, C("b_action")).otherwise(C("a_action")).alias("one"), F.when(swapped, C("a_action")).otherwise(C("b_action")).alias("two"),
        (C("a_pixel_owner") == C("b_pixel_owner")).alias("same_owner"), over_media.alias("over_media"), over_label.alias("over_label"),
        (C("shared_area") / F.least(C("a_w") * C("a_h"), C("b_w") * C("b_h"))).alias("ratio")))
    held = C("primary_rel").isin("contains", "contained_by")
    same = (C("one") == C("two")) & C("same_owner")
    loses = is_visible(C("one")) & is_visible(C("two")) & (C("near")
        | (same & (C("one") == "image_replay") & ((C("ratio") >= 0.35) | (held & (C("ratio") >= 0.20))))
        | (same & (C("one") != "image_replay") & (C("ratio") >= 0.20))
        | ((C("one") == "image_replay") & (C("two") == "icon_replay") & (C("ratio") >= 0.20) & ~C("over_media"))
        | ((C("one") == "text_replay") & (C("two") == "icon_replay") & (C("ratio") >= 0.25) & ~C("over_label")))
    return ranked.select("page_id", "left_id", "right_id", "near", "wins", F.coalesce(loses, F.lit(False)).alias("loses"), "rank", "first", "second").where("near OR loses")


def near_equal_duplicates(edges: DataFrame) -> DataFrame:
    """Objects given up because a near-equal one outranks them, taken in id order.

    An object not yet given up at its turn gives up every later near-equal one of no higher priority, or itself when a
    later one, not given up before that turn, is of higher priority.  Two promoted icons compare by evidence score.
    """
    return _near_equal(cut_lineage(_conflicts(edges).where("near").select("page_id", "left_id", "right_id", "wins")))


def _near_equal(conflicts: DataFrame) -> DataFrame:
    pairs = conflicts.select("page_id", C("left_id").alias("first"), C("right_id").alias("second"), "wins")
    by_earlier = suppressed(pairs.where("wins").select("page_id", F.struct(C("first").alias("r")).alias("rank"), "first", "second"))
    active = pairs.join(by_earlier.withColumnRenamed("id", "first"), ["page_id", "first"], "left_anti")
    since = active.where("wins").groupBy("page_id", "second").agg(F.min("first").alias("since"))
    yielding = active.where("NOT wins").join(since, ["page_id", "second"], "left").where(C("since").isNull() | (C("since") >= C("first")))
    return by_earlier.unionByName(yielding.select("page_id", C("first").alias("id"))).distinct()


def cleanup_targets(edges: DataFrame) -> DataFrame:
    """(object, media, reason): pixels to erase from a media object because a text or shape in it is replayed."""
    d = directed(edges).where((C("other_replay_decision") == "image_replay") & (C("other_pixel_owner") == "preserve_raster") & is_visible(C("own_action")))
    text = (C("own_action") == "text_replay") & lies_in_media(0.20)
    shape = (C("own_action") == "shape_replay") & lies_in_media(0.70)
    return d.where(text | shape).select(
        "page_id", C("own_id").alias("region_id"), C("other_id").alias("target_id"),
        F.when(text, "editable_text_contained_by_media").otherwise("shape_background_contained_by_media").alias("reason"))


def icon_risk() -> Column:
    """Why a promoted icon may not be erased from its media; null if it may."""
    def outside(name: str, low: float, high: float) -> Column:
        return F.coalesce((C(name) < low) | (C(name) > high), F.lit(False))

    return ladder([
        (~F.coalesce(C("has_asset"), F.lit(False)), "cleanup_rejected_missing_transparent_replacement"),
        (outside("text_share", 0.0, 0.18), "cleanup_rejected_text_overlap_risk"),
        (outside("alpha_coverage", 0.04, 0.88), "cleanup_rejected_alpha_coverage_risk"),
        (outside("edge_alpha_coverage", 0.0, 0.18) | outside("edge_alpha_mean", 0.0, 36.0), "cleanup_rejected_edge_alpha_risk"),
        (F.coalesce(C("largest_part") < 0.35, F.lit(False)), "cleanup_rejected_fragmented_replacement_risk")], None)


def shape_risk() -> Column:
    """Why a shape may not be erased from a media object; null if it may."""
    promoted = F.coalesce(C("promotion").isin(*SHAPE_SOURCES), F.lit(False))
    bare = F.coalesce(C("role_inside").isin(*STYLED_ROLES), F.lit(False)) & ~F.coalesce(C("has_style"), F.lit(False))
    return ladder([
        (C("parent_media").isNotNull() & (C("parent_media") != C("target_id")), "cleanup_rejected_parent_media_mismatch"),
        (F.coalesce(C("text_share") > 0.24, F.lit(False)), "cleanup_rejected_text_overlap_risk"),
        (promoted & (F.coalesce(C("evidence_score"), F.lit(0.0)) < 0.68), "cleanup_rejected_low_shape_evidence"),
        (promoted & bare, "cleanup_rejected_missing_shape_replacement_style")], None)


def media_holds(objects: DataFrame, options: RelationOptions = RelationOptions()) -> DataFrame:
    """(page_id, region_id, target_id, kind, shown, mostly, wholly): media objects on or near an object, and how far it lies in them.

    The rows are those of the directed edges whose other end is a media object; only these are sent to meet the objects.
    """
    a, b = box("a_"), box("b_")
    media = (C("replay_decision") == "image_replay") & (C("pixel_owner") == "preserve_raster")
    pairs = near_pairs(objects.select(*PAIR, "x", "y", "w", "h", C("replay_decision").alias("kind"), is_visible(C("action")).alias("shown")),
                       objects.where(media).select(*PAIR, "x", "y", "w", "h"),
                       (C("a_region_id") != C("b_region_id")) & (gap(a, b) <= near_threshold(a, b, options)), margin=options.near_max, spread=True)
    related = pairs.select("page_id", C("a_region_id").alias("region_id"), C("b_region_id").alias("target_id"), C("a_kind").alias("kind"), C("a_shown").alias("shown"),
                           primary_relation(a, b, options).alias("primary_rel"), half_even(overlap(a, b) / a.area, 6).alias("own_in_other"))
    related = related.withColumn("contained", C("primary_rel") == "contained_by")
    return related.select(*PAIR, "target_id", "kind", "shown", lies_in_media(0.20).alias("mostly"), lies_in_media(0.70).alias("wholly"))


def judged_targets(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """The targets that ``edges`` hold, judged (see ``judged_holds``)."""
    held = directed(edges).where((C("other_replay_decision") == "image_replay") & (C("other_pixel_owner") == "preserve_raster"))
    return judged_holds(held.select("page_id", C("own_id").alias("region_id"), C("other_id").alias("target_id"), C("own_replay_decision").alias("kind"),
                                    is_visible(C("own_action")).alias("shown"), lies_in_media(0.20).alias("mostly"), lies_in_media(0.70).alias("wholly")), evidence)


def judged_holds(holds: DataFrame, evidence: DataFrame) -> DataFrame:
    """Media objects that an object may be erased from (``reason``), or may not and why (``risk``).

    ``evidence`` has a row per object: the columns of ``EVIDENCE`` and of the risks, ``foreground_claim`` among them.  Texts and shapes
    are erased from every media object that holds them, a promoted icon from its parent, a label-anchored blocked icon from every holder.
    """
    d = holds.where("shown").join(evidence.select(*PAIR, *(c for c in evidence.columns if c not in (*PAIR, "kind", "target_id", "shown", "mostly", "wholly"))), PAIR)
    icon = (C("kind") == "icon_replay") & C("mostly")
    claim = F.coalesce((C("promotion") == "m29_6_foreground_claim") | C("foreground_claim"), F.lit(False))
    promoted = icon & F.coalesce(C("promotion").isin(*ICON_SOURCES) & (C("parent_media") == C("target_id")), F.lit(False))
    anchored = icon & F.coalesce(C("label_blocked"), F.lit(False))
    far = F.when(C("media_share") < 0.80, "cleanup_rejected_low_media_containment")

    def rule(when: Column, reason, risk) -> Column:
        return F.when(when, F.struct(F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"), risk.cast("string").alias("risk")))

    rules = F.array_compact(F.array(
        rule((C("kind") == "text_replay") & C("mostly"), "editable_text_contained_by_media", F.lit(None)),
        rule((C("kind") == "shape_replay") & C("wholly"), F.when(claim, "foreground_claim_removed_from_residual_media").otherwise("shape_background_contained_by_media"), shape_risk()),
        rule(promoted, F.when(claim, "foreground_claim_removed_from_residual_media").otherwise("promoted_internal_asset_contained_by_media"), icon_risk()),
        rule(anchored, "label_anchored_blocked_asset_contained_by_media", far)))
    return d.select("page_id", "region_id", "target_id", F.explode(rules).alias("r")).select("page_id", "region_id", "target_id", "r.reason", "r.risk")


def plan_targets(plan: DataFrame, judged: DataFrame) -> DataFrame:
    """Cleanup rows of the plan's visible rows: ``target``, ``target_id``, ``reason``, ``risk``.

    Every visible row erases its place in the fallback.  A target that lost its own place to a visible overlap is pruned, which is
    a risk of the row; a rejected target is a risk without a target.
    """
    shown = plan.where(is_visible(C("final_action"))).select(*PAIR)
    lost = plan.where("why = 'visible_overlap_duplicate_suppressed'").select("page_id", C("region_id").alias("target_id"), F.lit(True).alias("pruned"))
    fallback = shown.select(*PAIR, F.lit("fallback").alias("target"), F.lit(None).cast("bigint").alias("target_id"), F.lit("replayed_visible_object").alias("reason"), F.lit(None).cast("string").alias("risk"))
    copied = judged.join(shown, PAIR).join(lost, ["page_id", "target_id"], "left")
    kept = C("risk").isNull() & C("pruned").isNull()
    copied = copied.select(*PAIR, F.when(kept, "copied_image_asset").alias("target"), C("target_id"), F.when(kept, C("reason")).alias("reason"),
                           F.coalesce("risk", F.when(C("pruned"), "copied_image_cleanup_target_suppressed")).alias("risk"))
    return fallback.unionByName(copied)


def budget(visible: DataFrame, limit: int) -> DataFrame:
    """Rank of each visible object in the node budget and whether it falls outside."""
    order = [rank_of(C("action"), BUDGET_ORDER, 9), rank_of(C("confidence"), CONFIDENCE_ORDER, 2), C("region_id")]
    ranked = row_numbers(visible, ["page_id"], order, "budget_rank")
    return ranked.withColumn("over_budget", C("budget_rank") > limit)


def replay_plan(objects: DataFrame, max_visible: int = 260) -> DataFrame:
    """One plan row per object with its final action, and why it was given up if it was."""
    acted = with_actions(objects)
    large = has_large_groups(objects, ["page_id"])
    # read four times below
    conflicts = cut_lineage(_conflicts(object_edges(acted)))
    dup = cut_lineage(_near_equal(conflicts.where("near")))
    live = conflicts.where("loses").select("page_id", "rank", "first", "second")
    for end in ("first", "second"):
        live = live.join(dup.withColumnRenamed("id", end), ["page_id", end], "left_anti")
    lost = suppressed(live)
    reasons = [df.select("page_id", C("id").alias("region_id"), F.lit(why).alias("why")) for df, why in (
        (dup, "near_equal_duplicate_suppressed"), (lost, "visible_overlap_duplicate_suppressed"))]
    # objects and reasons meet where the pages are ranked, so the objects are sent once
    marks = reasons[0].unionByName(reasons[1]).withColumn("_object", F.lit(False))
    rows = acted.withColumns({"why": F.lit(None).cast("string"), "_object": F.lit(True)}).unionByName(marks, allowMissingColumns=True)
    rows = rows.repartition(*(PAIR if large else ["page_id"])).withColumn("why", F.max("why").over(Window.partitionBy(*PAIR))).where("_object").drop("_object")
    free = C("why").isNull() & is_visible(C("action"))
    order = [(~free).cast("int"), rank_of(C("action"), BUDGET_ORDER, 9), rank_of(C("confidence"), CONFIDENCE_ORDER, 2), C("region_id")]
    ranked = row_numbers(rows, ["page_id"], order, "_rank", large)
    over = free & (C("_rank") > max_visible)
    plan = ranked.withColumn("why", F.when(over, "node_budget_suppressed").otherwise(C("why"))).drop("_rank")
    final = F.when(C("why").isNotNull(), "suppress_duplicate").otherwise(C("action"))
    planned = plan.withColumn("final_action", final).withColumn("final_role", F.when(C("why").isNull(), C("role")))
    return row_numbers(planned, ["page_id"], [rank_of(C("final_action"), PLAN_ORDER, 7), C("region_id")], "position", large)


def plan_summary(plan: DataFrame) -> DataFrame:
    """Plan rows per final action and reason over the corpus."""
    return plan.groupBy("final_action", "why").agg(F.count("*").alias("n"))
