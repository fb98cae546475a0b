"""Replay plan over objects with evidence: promoted icons, judged cleanup targets, pruning."""

from pyspark.sql import functions as F

from boxloom.functions.ladders import is_visible
from boxloom.plans import replay as rp
from boxloom.queries.fixture_sql import FIXTURE_SQL, fixture
from boxloom.queries.ladders_q import acted
from boxloom.queries.registry import query, sql
from boxloom.session import cut_lineage

C = F.col
VIS = "('text_replay', 'image_replay', 'icon_replay', 'shape_replay')"
# what a detector would say of an object, in an order that both engines read alike
_EVIDENCE = {
    "promotion": "CASE WHEN pixel_owner = 'raster_icon' THEN CASE score_milli % 3 WHEN 0 THEN 'm29_6_internal_icon_candidate' WHEN 1 THEN 'm29_6_foreground_claim' END "
                 "WHEN pixel_owner = 'shape_geometry' AND score_milli % 2 = 0 THEN 'm29_6_internal_shape_candidate' END",
    "parent_media": "CASE WHEN score_milli % 5 <> 0 THEN holder END",
    "has_asset": "score_milli % 4 <> 0",
    "row_crop": "score_milli % 8 = 0",
    "text_share": "CASE WHEN score_milli % 9 <> 0 THEN CAST(score_milli % 29 AS DOUBLE) / 100 END",
    "evidence_score": "CASE WHEN score_milli % 13 <> 0 THEN CAST(score_milli % 100 AS DOUBLE) / 100 END",
    "label_blocked": "suppkey % 4 = 0",
    "media_share": "CASE WHEN suppkey % 7 <> 0 THEN CAST(60 + suppkey % 41 AS DOUBLE) / 100 END",
    "readable_media": "suppkey % 3 <> 0",
    "foreground_claim": "suppkey % 11 = 0",
    "alpha_coverage": "CASE WHEN score_milli % 7 <> 0 THEN CAST(score_milli % 97 AS DOUBLE) / 100 END",
    "edge_alpha_coverage": "CASE WHEN w % 5 <> 0 THEN CAST(w % 23 AS DOUBLE) / 100 END",
    "edge_alpha_mean": "CASE WHEN h % 5 <> 0 THEN CAST(h % 43 AS DOUBLE) END",
    "largest_part": "CASE WHEN suppkey % 5 <> 0 THEN CAST(30 + suppkey % 71 AS DOUBLE) / 100 END",
    "role_inside": "CASE suppkey % 3 WHEN 0 THEN 'internal_pill_button' WHEN 1 THEN 'plain' END",
    "has_style": "score_milli % 6 < 3",
}
_COLUMNS = ", ".join(f"{e} AS {n}" for n, e in _EVIDENCE.items())
fixture("evidence", f"""
    SELECT *, {_COLUMNS} FROM (SELECT a.*, m.holder FROM acted a LEFT JOIN (SELECT page_id, own_id, min(other_id) AS holder FROM dedges
      WHERE other_replay_decision = 'image_replay' AND other_pixel_owner = 'preserve_raster' GROUP BY 1, 2) m ON a.page_id = m.page_id AND a.region_id = m.own_id)""", "acted dedges")
_ICONS = "('m29_6_internal_icon_candidate', 'm29_6_foreground_claim')"
_SHAPES = "('m29_6_internal_shape_candidate', 'm29_6_foreground_claim')"
_BOTH = ["pixel_owner", "replay_decision", "confidence", "action", "x", "y", "w", "h", *rp.EVIDENCE]
fixture("vedges", "SELECT e.*, " + ", ".join(f"{p}.{c} AS {p}_{c}" for p in "ab" for c in _BOTH)
        + " FROM edges e JOIN evidence a ON e.page_id = a.page_id AND e.left_id = a.region_id JOIN evidence b ON e.page_id = b.page_id AND e.right_id = b.region_id", "edges evidence")


def _icon(p):
    return f"({p}_pixel_owner = 'raster_icon' AND {p}_replay_decision = 'icon_replay' AND coalesce({p}_promotion IN {_ICONS}, false))"


def _spared(media, icon, media_id):
    return (f"(coalesce({icon}_promotion IN {_ICONS} AND {icon}_parent_media = {media_id} AND ({icon}_has_asset OR {icon}_row_crop), false)"
            f" OR coalesce({icon}_label_blocked AND {icon}_media_share >= 0.8 AND {media}_readable_media, false))")


def _label(icon):
    return f"coalesce({icon}_promotion IN {_ICONS} AND ({icon}_has_asset OR {icon}_row_crop) AND coalesce({icon}_text_share, 0) <= 0.14, false)"


_PAIR = ("a_action = '{one}' AND b_action = 'icon_replay' AND {ab}", "b_action = '{one}' AND a_action = 'icon_replay' AND {ba}")
_SPARED = " OR ".join(f"({x})" for x in (
    *(x.format(one="image_replay", ab=_spared("a", "b", "left_id"), ba=_spared("b", "a", "right_id")) for x in _PAIR),
    *(x.format(one="text_replay", ab=_label("b"), ba=_label("a")) for x in _PAIR)))
# the plan of g11 over the edges with evidence
_NEAR = FIXTURE_SQL["ne_dup"].replace("oedges", "vedges").replace("SELECT page_id, left_id AS l, right_id AS r, CASE WHEN", (
    f"SELECT page_id, left_id AS l, right_id AS r, CASE WHEN {_icon('a')} AND {_icon('b')} THEN CASE WHEN coalesce(a_evidence_score, 0) >= coalesce(b_evidence_score, 0) THEN right_id ELSE left_id END WHEN"))
fixture("v_dup", _NEAR, "vedges")
fixture("v_losers", FIXTURE_SQL["losers"].replace("oedges", f"(SELECT *, {_SPARED} AS spared FROM vedges)").replace("ne_dup", "v_dup").replace(
    "two = 'icon_replay' AND ratio", "two = 'icon_replay' AND NOT spared AND ratio"), "vedges v_dup")
fixture("v_plan", FIXTURE_SQL["plan"].replace("acted a", "evidence a").replace("ne_dup", "v_dup").replace("losers", "v_losers"), "evidence v_dup v_losers")
fixture("v_judged", f"""
    SELECT page_id, region_id, target_id, r.reason AS reason, r.risk AS risk FROM (SELECT page_id, region_id, target_id, unnest(list_filter([
        CASE WHEN kind = 'text_replay' AND mostly THEN {{'reason': 'editable_text_contained_by_media', 'risk': NULL::VARCHAR}} END,
        CASE WHEN kind = 'shape_replay' AND wholly THEN {{'reason': CASE WHEN claim THEN 'foreground_claim_removed_from_residual_media' ELSE 'shape_background_contained_by_media' END, 'risk':
          CASE WHEN parent_media IS NOT NULL AND parent_media <> target_id THEN 'cleanup_rejected_parent_media_mismatch' WHEN text_share > 0.24 THEN 'cleanup_rejected_text_overlap_risk'
            WHEN promotion IN {_SHAPES} AND coalesce(evidence_score, 0) < 0.68 THEN 'cleanup_rejected_low_shape_evidence'
            WHEN promotion IN {_SHAPES} AND role_inside = 'internal_pill_button' AND NOT has_style THEN 'cleanup_rejected_missing_shape_replacement_style' END}} END,
        CASE WHEN kind = 'icon_replay' AND mostly AND promotion IN {_ICONS} AND parent_media = target_id THEN {{'reason': CASE WHEN claim THEN 'foreground_claim_removed_from_residual_media' ELSE 'promoted_internal_asset_contained_by_media' END, 'risk':
          CASE WHEN NOT has_asset THEN 'cleanup_rejected_missing_transparent_replacement' WHEN text_share > 0.18 THEN 'cleanup_rejected_text_overlap_risk'
            WHEN alpha_coverage < 0.04 OR alpha_coverage > 0.88 THEN 'cleanup_rejected_alpha_coverage_risk' WHEN edge_alpha_coverage > 0.18 OR edge_alpha_mean > 36 THEN 'cleanup_rejected_edge_alpha_risk'
            WHEN largest_part < 0.35 THEN 'cleanup_rejected_fragmented_replacement_risk' END}} END,
        CASE WHEN kind = 'icon_replay' AND mostly AND label_blocked THEN {{'reason': 'label_anchored_blocked_asset_contained_by_media', 'risk': CASE WHEN media_share < 0.8 THEN 'cleanup_rejected_low_media_containment' END}} END],
        lambda q: q IS NOT NULL)) AS r
      FROM (SELECT v.*, d.other_id AS target_id, d.own_replay_decision AS kind, coalesce(v.promotion = 'm29_6_foreground_claim' OR v.foreground_claim, false) AS claim,
          (primary_rel = 'near_equal' OR contained OR own_in_other >= 0.2) AS mostly, (primary_rel = 'near_equal' OR contained OR own_in_other >= 0.7) AS wholly
        FROM dedges d JOIN evidence v ON d.page_id = v.page_id AND d.own_id = v.region_id
        WHERE d.other_replay_decision = 'image_replay' AND d.other_pixel_owner = 'preserve_raster' AND d.own_action IN {VIS}))""", "dedges evidence")


def with_evidence(spark, sf_dir):
    """Regions with what a detector would know of their origin, and the media objects near them; the parent is the first of these."""
    objects = acted(spark, sf_dir)
    holds = cut_lineage(rp.media_holds(objects))
    holder = holds.groupBy(*rp.PAIR).agg(F.min("target_id").alias("holder"))
    return objects.join(holder, rp.PAIR, "left").selectExpr("*", *[f"{e} AS {n}" for n, e in _EVIDENCE.items()]), holds


@query("g11_evidence_plan", sql("v_plan", "SELECT page_id, region_id, final_action, why, position FROM v_plan"))
def g11_evidence(spark, sf_dir):
    return rp.replay_plan(with_evidence(spark, sf_dir)[0], 8).select("page_id", "region_id", "final_action", "why", "position")


@query("g11_judged_targets", sql("v_judged", "SELECT * FROM v_judged"))
def g11_judged(spark, sf_dir):
    objects, holds = with_evidence(spark, sf_dir)
    return rp.judged_holds(holds, objects)


@query("g11_plan_targets", sql("v_plan v_judged", f"""
    , shown AS (SELECT page_id, region_id FROM v_plan WHERE final_action IN {VIS}),
    lost AS (SELECT page_id, region_id FROM v_plan WHERE why = 'visible_overlap_duplicate_suppressed')
    SELECT page_id, region_id, 'fallback' AS target, NULL::BIGINT AS target_id, 'replayed_visible_object' AS reason, NULL::VARCHAR AS risk FROM shown
    UNION ALL SELECT j.page_id, j.region_id, CASE WHEN j.risk IS NULL AND l.region_id IS NULL THEN 'copied_image_asset' END, j.target_id, CASE WHEN j.risk IS NULL AND l.region_id IS NULL THEN j.reason END,
      coalesce(j.risk, CASE WHEN l.region_id IS NOT NULL THEN 'copied_image_cleanup_target_suppressed' END)
    FROM v_judged j JOIN shown s ON j.page_id = s.page_id AND j.region_id = s.region_id LEFT JOIN lost l ON j.page_id = l.page_id AND j.target_id = l.region_id"""))
def g11_targets(spark, sf_dir):
    objects, holds = with_evidence(spark, sf_dir)
    # the targets read the visible rows and those that lost their place
    plan = rp.replay_plan(objects, 8).where(is_visible(C("final_action")) | (C("why") == "visible_overlap_duplicate_suppressed"))
    return rp.plan_targets(cut_lineage(plan.select(*rp.PAIR, "final_action", "why")), rp.judged_holds(holds, objects))
