"""Promoted icons, judged cleanup targets and pruning on small pages."""

import pytest
from pyspark.sql import functions as F

from boxloom.plans import replay as rp

TEXT, MEDIA, ICON, SHAPE = (("editable_text", "text_replay"), ("preserve_raster", "image_replay"), ("raster_icon", "icon_replay"), ("shape_geometry", "shape_replay"))
SCHEMA = """page_id bigint, region_id bigint, x bigint, y bigint, w bigint, h bigint, pixel_owner string, replay_decision string, confidence string,
    promotion string, parent_media bigint, has_asset boolean, row_crop boolean, text_share double, evidence_score double, label_blocked boolean, media_share double, readable_media boolean,
    foreground_claim boolean, alpha_coverage double, edge_alpha_coverage double, edge_alpha_mean double, largest_part double, role_inside string, has_style boolean"""
NAMES = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]
CANDIDATE, CLAIM = "m29_6_internal_icon_candidate", "m29_6_foreground_claim"


def thing(page, ident, box, kind, **evidence):
    values = dict(zip(NAMES, (page, ident, *box, *kind, "high")), **evidence)
    return tuple(values.get(n) for n in NAMES)


ROWS = [
    # icons on a media object: promoted out of it, plain, promoted out of another one, anchored to a label
    thing(1, 1, (0, 0, 400, 400), MEDIA, readable_media=True),
    thing(1, 2, (10, 10, 40, 40), ICON, promotion=CANDIDATE, parent_media=1, has_asset=True),
    thing(1, 3, (100, 100, 40, 40), ICON),
    thing(1, 4, (200, 200, 40, 40), ICON, promotion=CANDIDATE, parent_media=99, has_asset=True),
    thing(1, 5, (300, 300, 40, 40), ICON, label_blocked=True, media_share=0.9),
    thing(1, 6, (300, 10, 40, 40), ICON, promotion=CLAIM, parent_media=1, row_crop=True),
    # near-equal icons: the promoted ones compare by score, the plain ones by priority and id
    thing(2, 1, (0, 0, 40, 40), ICON, promotion=CANDIDATE, evidence_score=0.3),
    thing(2, 2, (0, 0, 40, 41), ICON, promotion=CLAIM, evidence_score=0.9),
    thing(2, 3, (300, 0, 40, 40), ICON, evidence_score=0.3),
    thing(2, 4, (300, 0, 40, 41), ICON, evidence_score=0.9),
    # icons over a label
    thing(3, 1, (0, 0, 200, 40), TEXT),
    thing(3, 2, (10, 5, 30, 30), ICON, promotion=CANDIDATE, has_asset=True, text_share=0.1),
    thing(3, 3, (100, 5, 30, 30), ICON, promotion=CANDIDATE, has_asset=True, text_share=0.5),
    # a text inside two media objects, one of which gives way; shapes with and without a style
    thing(4, 1, (0, 0, 400, 400), MEDIA),
    thing(4, 2, (0, 0, 200, 200), MEDIA),
    thing(4, 3, (20, 20, 60, 20), TEXT),
    thing(4, 4, (220, 220, 50, 50), SHAPE, promotion=CLAIM, evidence_score=0.8, role_inside="internal_pill_button"),
    thing(4, 5, (300, 300, 50, 50), SHAPE, promotion=CLAIM, evidence_score=0.8, role_inside="internal_pill_button", has_style=True),
    thing(4, 6, (220, 20, 50, 50), SHAPE, parent_media=9),
]


@pytest.fixture(scope="module")
def objects(spark):
    return rp.with_actions(spark.createDataFrame(ROWS, SCHEMA))


def test_promoted_icons_are_spared(objects):
    lost = {(r.page_id, r.region_id): r.why for r in rp.replay_plan(objects).where("why IS NOT NULL").collect()}
    near, over = "near_equal_duplicate_suppressed", "visible_overlap_duplicate_suppressed"
    assert lost == {(1, 3): over, (1, 4): over, (2, 1): near, (2, 4): near, (3, 3): over, (4, 2): over}
    # without evidence the same icons give way
    plain = rp.replay_plan(objects.drop(*rp.EVIDENCE)).where("why IS NOT NULL")
    assert {(1, 2), (1, 5), (1, 6), (2, 2), (3, 2)} <= {(r.page_id, r.region_id) for r in plain.collect()}


def test_targets_are_judged_and_pruned(objects):
    judged = rp.judged_targets(rp.object_edges(objects), objects)
    rows = rp.plan_targets(rp.replay_plan(objects), judged)
    got = {(r.page_id, r.region_id, r.target_id): (r.reason, r.risk) for r in rows.where("target_id IS NOT NULL").collect()}
    assert got == {
        (1, 2, 1): ("promoted_internal_asset_contained_by_media", None),
        (1, 5, 1): ("label_anchored_blocked_asset_contained_by_media", None),
        (1, 6, 1): (None, "cleanup_rejected_missing_transparent_replacement"),
        (4, 3, 1): ("editable_text_contained_by_media", None),
        (4, 3, 2): (None, "copied_image_cleanup_target_suppressed"),
        (4, 4, 1): (None, "cleanup_rejected_missing_shape_replacement_style"),
        (4, 5, 1): ("foreground_claim_removed_from_residual_media", None),
        (4, 6, 1): (None, "cleanup_rejected_parent_media_mismatch")}
    fallback = rows.where("target = 'fallback'")
    assert fallback.count() == len(ROWS) - 6 and fallback.where(F.col("risk").isNotNull()).count() == 0


@pytest.mark.parametrize("values, risk", [
    ({"text_share": 0.19}, "cleanup_rejected_text_overlap_risk"), ({"alpha_coverage": 0.9}, "cleanup_rejected_alpha_coverage_risk"),
    ({"alpha_coverage": 0.03}, "cleanup_rejected_alpha_coverage_risk"), ({"edge_alpha_mean": 36.5}, "cleanup_rejected_edge_alpha_risk"),
    ({"largest_part": 0.34}, "cleanup_rejected_fragmented_replacement_risk"), ({"text_share": 0.18, "alpha_coverage": 0.88, "edge_alpha_mean": 36.0, "largest_part": 0.35}, None)])
def test_icon_risks(spark, values, risk):
    row = thing(1, 1, (0, 0, 9, 9), ICON, has_asset=True, **values)
    assert spark.createDataFrame([row], SCHEMA).select(rp.icon_risk().cast("string").alias("risk")).first().risk == risk
