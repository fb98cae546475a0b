"""Decision ladders over every region."""

from pyspark.sql import functions as F

from boxloom.functions import ladders as lad
from boxloom.functions import text as tx
from boxloom.functions.geometry import box
from boxloom.queries.fixture_sql import even, fixture
from boxloom.queries.fixtures import primitives, regions, slices
from boxloom.queries.registry import query, sql
from boxloom.queries.relations_q import primitive_case

KEYS = ("page_id", "region_id")
C = F.col


def _reason_sql(name):
    return "'" + ",".join(lad.PRIMITIVE_REASONS[name]) + "'"


@query("p13_primitive_ladder", sql("primitives", f"""
    SELECT page_id, region_id, {primitive_case({k: f"'{v}'" for k, v in lad.PRIMITIVE_TYPE.items()})} AS type,
      {primitive_case({'thin_line': '0.86::DOUBLE', 'rect': 'greatest(0::DOUBLE, least(0.95::DOUBLE, 0.72::DOUBLE + fill_ratio * 0.2::DOUBLE))',
                       'surface': '0.74::DOUBLE', 'image': 'greatest(0::DOUBLE, least(0.92::DOUBLE, 0.55::DOUBLE + least(texture_score, 0.4::DOUBLE)))',
                       'symbol': '0.62::DOUBLE', 'long_line': '0.7::DOUBLE', 'none': '0.35::DOUBLE'})} AS confidence,
      {primitive_case({k: _reason_sql(k) for k in lad.PRIMITIVE_TYPE})} AS reasons FROM primitives"""))
def p13(spark, sf_dir):
    classed = lad.with_primitive_class(primitives(spark, sf_dir), F.lit(1080 * 1920))
    return classed.select(*KEYS, "type", "confidence", F.array_join("reasons", ",").alias("reasons"))


ACTION_SQL = """CASE WHEN replay_decision = 'text_replay' AND pixel_owner = 'editable_text' AND confidence <> 'low' THEN 'text_replay'
  WHEN replay_decision = 'image_replay' AND pixel_owner = 'preserve_raster' AND confidence <> 'low' THEN 'image_replay'
  WHEN replay_decision = 'icon_replay' AND pixel_owner = 'raster_icon' AND confidence <> 'low' THEN 'icon_replay'
  WHEN replay_decision = 'shape_replay' AND pixel_owner = 'shape_geometry' AND confidence <> 'low' THEN 'shape_replay'
  WHEN replay_decision = 'preserve_in_parent_raster' THEN 'preserve_in_parent_raster'
  WHEN pixel_owner = 'fallback_only' THEN 'fallback_only' ELSE 'diagnostic_only' END"""
ROLE_SQL = """CASE action WHEN 'text_replay' THEN 'm29_text' WHEN 'image_replay' THEN 'm29_image' WHEN 'icon_replay' THEN 'm29_symbol'
  WHEN 'shape_replay' THEN 'm29_shape' END"""
fixture("acted", f"SELECT *, {ROLE_SQL} AS role FROM (SELECT *, {ACTION_SQL} AS action FROM regions)", "regions")


def acted(spark, sf_dir):
    """Regions with the replay action and role chosen."""
    df = regions(spark, sf_dir).withColumn(
        "action", lad.replay_action(C("replay_decision"), C("pixel_owner"), C("confidence")))
    return df.withColumn("role", lad.target_role(C("action")))


@query("p14_replay_action", sql("acted", "SELECT page_id, region_id, action, role FROM acted"))
def p14(spark, sf_dir):
    return acted(spark, sf_dir).select(*KEYS, "action", "role")


@query("p15_confidence_maps", sql("regions", """
    SELECT page_id, region_id, CASE WHEN score_milli / 1000.0 >= 0.74 THEN 'high' WHEN score_milli / 1000.0 >= 0.52 THEN 'medium'
      ELSE 'low' END AS label, CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 WHEN 'low' THEN 0.4 ELSE 0.5 END AS value
    FROM regions"""))
def p15(spark, sf_dir):
    return regions(spark, sf_dir).select(
        *KEYS, lad.confidence_label(C("score_milli") / 1000).alias("label"), lad.confidence_value(C("confidence")).alias("value"))


@query("p16_count_confidence", sql("regions", """
    SELECT page_id, visual_kind, count(*) AS n, CASE WHEN count(*) >= 4 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END
      AS confidence FROM regions GROUP BY page_id, visual_kind"""))
def p16(spark, sf_dir):
    counted = regions(spark, sf_dir).groupBy("page_id", "visual_kind").agg(F.count("*").alias("n"))
    return counted.withColumn("confidence", lad.confidence_for_count(C("n")))


@query("p17_bins", sql("regions", """
    SELECT page_id, region_id, CASE WHEN least(w, h) <= 8 THEN '000-008' WHEN least(w, h) <= 20 THEN '009-020'
        WHEN least(w, h) <= 40 THEN '021-040' WHEN least(w, h) <= 80 THEN '041-080' ELSE '081+' END AS side,
      CASE WHEN kind_no = 4 THEN 'missing' WHEN w * h / 2073600.0 <= 0.01 THEN '0.00-0.01' WHEN w * h / 2073600.0 <= 0.05 THEN '0.01-0.05'
        WHEN w * h / 2073600.0 <= 0.15 THEN '0.05-0.15' WHEN w * h / 2073600.0 <= 0.4 THEN '0.15-0.40' ELSE '0.40+' END AS share,
      concat((round_even(w / 8.0, 0) * 8)::BIGINT, 'x', (round_even(h / 8.0, 0) * 8)::BIGINT) AS signature FROM regions"""))
def p17(spark, sf_dir):
    share = F.when(C("kind_no") != 4, C("w") * C("h") / 2073600)
    return regions(spark, sf_dir).select(
        *KEYS, lad.short_side_bin(F.least("w", "h")).alias("side"), lad.area_ratio_bin(share).alias("share"),
        lad.size_signature(C("w"), C("h")).alias("signature"))


@query("p19_looks_editable", sql("regions", """
    , t AS (SELECT *, substr('Ab中文 label 12 of the page', 1, 1 + partkey % 24) AS text FROM regions)
    SELECT page_id, region_id, NOT (length(trim(text)) = 0 OR (w / 200.0 > 0.72 AND length(trim(text)) < 12) OR w / 200.0 > 0.92
      OR (h > 90 AND length(trim(text)) < 8) OR (regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AND length(trim(text)) <= 4
        AND h > w * 1.25)) AS editable FROM t"""))
def p19(spark, sf_dir):
    text = F.expr("substr('Ab中文 label 12 of the page', 1, CAST(1 + partkey % 24 AS INT))")
    return regions(spark, sf_dir).select(*KEYS, tx.looks_editable(text, box(), F.lit(200)).alias("editable"))


# evidence terms of a candidate, all in [0, 1]
_TERMS = ["source_candidate", "foreground_claim", "claim_score", "foreground_layer", "overlay_geometry", "size_compactness",
          "text_anchor", "same_media", "repetition", "relation_consistency", "transparent_asset", "control_row",
          "text_overlap_penalty", "hero_penalty", "cleanup_risk", "repair_cost", "shape_role", "text_containment"]


def _terms(real: str) -> str:
    return ", ".join(
        f"((score_milli * {3 + 2 * i} + partkey * {5 + i} + suppkey) % 101) / {real} AS {t}" for i, t in enumerate(_TERMS))


fixture("evidence", f"SELECT page_id, region_id, kind_no, score_milli, {_terms('100.0')} FROM regions", "regions")


def evidence(spark, sf_dir):
    return regions(spark, sf_dir).selectExpr(*KEYS, "kind_no", "score_milli", *_terms("100.0D").split(", "))


def _score_sql(weights):
    return even("greatest(0::DOUBLE, least(1::DOUBLE, " + " + ".join(f"{n} * ({w}::DOUBLE)" for n, w in weights) + "))", 4)


@query("p20_evidence_score", sql("evidence", f"""
    SELECT page_id, region_id, {_score_sql(lad.ICON_WEIGHTS)} AS icon_score, {_score_sql(lad.SHAPE_WEIGHTS)} AS shape_score FROM evidence"""))
def p20(spark, sf_dir):
    return evidence(spark, sf_dir).select(
        *KEYS, lad.evidence_score(lad.ICON_WEIGHTS).alias("icon_score"), lad.evidence_score(lad.SHAPE_WEIGHTS).alias("shape_score"))


fixture("judged", f"""
    SELECT *, CASE WHEN len(hard) > 0 THEN 'reject' WHEN score >= 0.68 AND (clear OR rowy) AND runs AND same_media >= 0.3
      AND overlap <= 0.2 AND hero <= 0.42 THEN CASE WHEN claim THEN 'allow_foreground_claim' ELSE 'allow_visible_replay' END
      WHEN score >= 0.42 THEN 'report_only' ELSE 'reject' END AS mode
    FROM (SELECT *, list_filter([CASE WHEN kind_no = 4 THEN 'not_internal_icon_candidate' END,
        CASE WHEN score_milli % 9 = 0 THEN 'internal_candidate_not_accepted' END,
        CASE WHEN score_milli % 31 = 0 THEN 'generic_foreground_not_visible_replay' END,
        CASE WHEN score_milli % 11 = 0 THEN 'missing_parent_media_source_object' END,
        CASE WHEN overlap > 0.3 THEN 'text_overlap_too_high' END,
        CASE WHEN hero > 0.62 THEN 'hero_or_texture_risk_too_high' END], lambda s: s IS NOT NULL) AS hard
      FROM (SELECT page_id, region_id, kind_no, score_milli, same_media, {_score_sql(lad.ICON_WEIGHTS)} AS score,
        text_overlap_penalty / 3 AS overlap, hero_penalty * 0.7::DOUBLE AS hero, transparent_asset > 0.5 AS clear,
        control_row > 0.5 AS rowy, score_milli % 4 <> 0 AS runs, foreground_claim > 0.6 AS claim FROM evidence))""", "evidence")


def judged(spark, sf_dir):
    e = evidence(spark, sf_dir).select(
        *KEYS, "kind_no", "score_milli", "same_media", lad.evidence_score(lad.ICON_WEIGHTS).alias("score"),
        (C("text_overlap_penalty") / 3).alias("overlap"), (C("hero_penalty") * 0.7).alias("hero"),
        (C("transparent_asset") > 0.5).alias("clear"), (C("control_row") > 0.5).alias("rowy"),
        (C("score_milli") % 4 != 0).alias("runs"), (C("foreground_claim") > 0.6).alias("claim"))
    hard = lad.hard_rejections(
        F.when(C("kind_no") == 4, "other").otherwise("internal_icon_candidate"),
        F.when(C("score_milli") % 9 == 0, "rejected").otherwise("accepted_report_candidate"),
        C("score_milli") % 11 != 0, C("overlap"), C("hero"), C("score_milli") % 31 == 0)
    e = e.withColumn("hard", hard)
    # containment scaled so that the 0.95 gate falls at 0.3 of the derived term
    contained = F.when(C("same_media") >= 0.3, 1.0).otherwise(0.0)
    return e.withColumn("mode", lad.decision_mode(
        C("score"), C("hard"), C("clear"), C("runs"), C("rowy"), C("claim"), contained, C("overlap"), C("hero")))


@query("p21_decision_mode", sql("judged", """
    SELECT page_id, region_id, score, array_to_string(hard, ',') AS hard, mode FROM judged"""))
def p21(spark, sf_dir):
    return judged(spark, sf_dir).select(*KEYS, "score", F.array_join("hard", ",").alias("hard"), "mode")


@query("p22_layout_permission", sql("regions", """
    , c AS (SELECT page_id, region_id, confidence, score_milli / 1500.0 AS energy, ['row', 'column', 'grid', 'absolute', 'overlay'][1 + kind_no] AS model,
      list_filter([CASE WHEN copy_no = 2 THEN 'two_member' END, CASE WHEN kind_no = 1 AND copy_no = 3 THEN 'absolute_layout_fallback' END,
        CASE WHEN score_milli > 570 THEN 'high_layout_energy' END, CASE WHEN copy_no = 2 THEN 'two_member' END], lambda s: s IS NOT NULL) AS risks FROM regions),
    d AS (SELECT *, CASE WHEN model = 'grid' THEN 0.28 ELSE 0.32 END AS threshold, model NOT IN ('row', 'column', 'grid') AS bad,
      list_contains(risks, 'absolute_layout_fallback') AS fallback,
      list_filter([CASE WHEN confidence NOT IN ('high', 'medium') THEN 'layout_energy_confidence_too_low' END,
        CASE WHEN energy > CASE WHEN model = 'grid' THEN 0.28 ELSE 0.32 END THEN 'layout_energy_above_permission_threshold' END,
        CASE WHEN list_contains(risks, 'high_layout_energy') THEN 'layout_energy_risk_present' END], lambda s: s IS NOT NULL) AS doubts FROM c)
    SELECT page_id, region_id, CASE WHEN bad OR fallback THEN 'reject' WHEN len(doubts) > 0 THEN 'defer' ELSE 'allow_candidate' END AS permission,
      CASE WHEN bad OR fallback THEN 'low' WHEN len(doubts) > 0 THEN CASE WHEN confidence = 'low' THEN 'low' ELSE 'medium' END
        ELSE confidence END AS confidence, threshold::DOUBLE AS threshold,
      CASE WHEN bad THEN 'unsupported_layout_model_for_auto_layout_permission' WHEN fallback THEN 'absolute_layout_fallback_rejected'
        WHEN len(doubts) > 0 THEN array_to_string(doubts, ',')
        ELSE 'supported_model_with_low_layout_energy,permission_only_not_materialization' END AS reasons,
      array_to_string(list_concat(CASE WHEN copy_no_two THEN ['two_member'] ELSE [] END, list_filter(risks, lambda r: r <> 'two_member'),
        CASE WHEN bad THEN ['unsupported_layout_model'] ELSE [] END), ',') AS risks
    FROM (SELECT *, list_contains(risks, 'two_member') AS copy_no_two FROM d)"""))
def p22(spark, sf_dir):
    model = F.element_at(F.array(*[F.lit(m) for m in ("row", "column", "grid", "absolute", "overlay")]), C("kind_no") + 1)
    risks = lad.reasons((C("copy_no") == 2, "two_member"), ((C("kind_no") == 1) & (C("copy_no") == 3), "absolute_layout_fallback"),
                        (C("score_milli") > 570, "high_layout_energy"), (C("copy_no") == 2, "two_member"))
    p = lad.layout_permission(model, C("score_milli") / 1500.0, C("confidence"), risks)
    return regions(spark, sf_dir).select(*KEYS, p.alias("p")).select(
        *KEYS, "p.permission", "p.confidence", "p.threshold", F.array_join("p.reasons", ",").alias("reasons"),
        F.array_join("p.risks", ",").alias("risks"))


@query("p24_normalize_cut_mode", sql("slices", """
    SELECT page_id, region_id, CASE WHEN cut_mode IN ('shape', 'subject') THEN 'subject' WHEN cut_mode = 'card' THEN 'card' ELSE 'rect' END
      AS cut_mode FROM slices"""))
def p24(spark, sf_dir):
    return slices(spark, sf_dir).select(*KEYS, lad.normalize_cut_mode(C("cut_mode")).alias("cut_mode"))


# classified candidates: role, kind and verdict from attributes of the region
_ROLES = ["icon", "avatar", "thumbnail", "photo", "logo", "illustration", "card_bg", "button_bg", "bar_bg", "divider",
          "noise", "text", "unknown"]
_CLASSIFIED = """page_id, region_id, w, CASE WHEN partkey % 13 = 9 THEN greatest(h // 24, 1) ELSE h END AS h,
  w * CASE WHEN partkey % 13 = 9 THEN greatest(h // 24, 1) ELSE h END AS area, [{roles}][1 + partkey % 13] AS role,
  CASE WHEN partkey % 13 = 12 AND suppkey % 4 <> 0 THEN 'suppress' WHEN partkey % 13 BETWEEN 6 AND 9 OR suppkey % 7 = 0 THEN 'shape' ELSE 'image' END AS kind,
  CASE WHEN score_milli % 6 = 0 THEN 'suppress' ELSE 'emit' END AS verdict, 0.6 + score_milli / 2500.0 AS confidence,
  (score_milli % 50) / 100.0 AS text_ratio, suppkey % 4 AS text_blocks, score_milli % 50 > 18 AND copy_no > 0 AS has_clip"""
fixture("classified", "SELECT " + _CLASSIFIED.format(roles=", ".join(f"'{r}'" for r in _ROLES)) + " FROM regions", "regions")


def classified(spark, sf_dir):
    text = (_CLASSIFIED.replace("//", "div").replace("[{roles}][1 + partkey % 13]",
            "element_at(array(" + ", ".join(f"'{r}'" for r in _ROLES) + "), CAST(1 + partkey % 13 AS INT))")
            .replace("0.6 +", "0.6D +").replace("2500.0", "2500.0D").replace("100.0", "100.0D"))
    table = regions(spark, sf_dir)
    return spark.sql(f"SELECT {text} FROM {{t}}", t=table)


@query("p25_promotion_ladder", sql("classified", """
    , f AS (SELECT *, area BETWEEN 400 AND 24000 AND w >= 10 AND h >= 10 AND w / h::DOUBLE BETWEEN 0.33 AND 3.0 AND text_blocks <= 2
        AND text_ratio <= 0.45 AS compact, role IN ('icon', 'avatar', 'thumbnail', 'photo', 'logo', 'illustration') AND kind IN ('image', 'shape') AS img,
        has_clip AND role IN ('icon', 'avatar', 'thumbnail', 'logo') AS clip, text_ratio > 0.12 OR text_blocks >= 2 AS wordy FROM classified),
    d AS (SELECT page_id, region_id, CASE
      WHEN confidence < 0.65 THEN 'suppress/suppress_low_confidence' WHEN role IN ('noise', 'text') THEN 'suppress/suppress_unknown_role'
      WHEN role = 'unknown' AND kind = 'suppress' THEN CASE WHEN compact AND has_clip THEN 'emit_image/emit_image_unknown_text_clipped'
        WHEN compact THEN 'emit_image/emit_image_compact_unknown' ELSE 'suppress/suppress_unknown_role' END
      WHEN img THEN CASE WHEN area < 120 OR w < 10 OR h < 10 THEN 'suppress/suppress_too_small'
        WHEN area > 2073600 * 0.4 THEN 'suppress/suppress_too_large'
        WHEN verdict <> 'emit' THEN CASE WHEN kind = 'image' AND clip THEN 'emit_image/emit_image_text_clipped' ELSE 'suppress/suppress_classifier' END
        WHEN wordy THEN CASE WHEN clip THEN 'emit_image/emit_image_text_clipped' WHEN role IN ('thumbnail', 'photo', 'illustration', 'logo')
          AND area >= 8000 AND text_ratio <= 0.2 THEN 'emit_image/emit_image_with_internal_text'
          WHEN text_blocks >= 2 THEN 'suppress/suppress_contains_text' ELSE 'suppress/suppress_text_overlap' END
        WHEN kind = 'shape' THEN 'emit_image/emit_image_kind_repaired' ELSE 'emit_image/emit_image' END
      WHEN verdict <> 'emit' OR kind = 'suppress' THEN 'suppress/suppress_classifier'
      WHEN role IN ('card_bg', 'button_bg', 'bar_bg') AND kind = 'shape' THEN CASE WHEN area < 160 OR w < 16 OR h < 8 THEN 'suppress/suppress_too_small'
        WHEN area > 2073600 * 0.6 THEN 'suppress/suppress_full_page_backing' ELSE 'emit_shape/emit_shape' END
      WHEN role = 'divider' AND kind = 'shape' THEN CASE WHEN least(w, h) <= 4 AND greatest(w, h) >= 24 THEN 'emit_shape/emit_divider'
        ELSE 'suppress/suppress_bad_divider_geometry' END
      ELSE 'suppress/suppress_unknown_role' END AS v FROM f)
    SELECT page_id, region_id, split_part(v, '/', 1) AS action, split_part(v, '/', 2) AS reason FROM d"""))
def p25(spark, sf_dir):
    return classified(spark, sf_dir).select(
        *KEYS, lad.promotion(F.lit(2073600), image_min_area=120, shape_min_area=160, text_ratio_max=0.12).alias("p")
    ).select(*KEYS, "p.action", "p.reason")


@query("p26_evidence_kind", sql("primitives", """
    , e AS (SELECT page_id, region_id, w, h, color_count, texture_score, fill_ratio / 2 AS text_overlap,
        ['m29_image', 'm29_unknown', 'm29_symbol', 'm29_blocked', 'm291_group'][1 + kind_no] AS source,
        CASE WHEN color_count % 7 = 0 THEN 'likely_text_noise' WHEN kind_no = 0 THEN 'keep_accepted_image' ELSE 'none' END AS suggested,
        color_count = 13 AS support, CASE WHEN edge_density > 0.3 THEN 'conflict' ELSE 'none' END AS lineage, color_count > 30 AS counter FROM primitives),
    f AS (SELECT *, text_overlap >= 0.35 OR suggested = 'likely_text_noise' AS noise,
        least(0.99, greatest(0.55, 0.55::DOUBLE + text_overlap * 0.4::DOUBLE)) AS base,
        source IN ('m29_symbol', 'm291_group') AS derived FROM e),
    k AS (SELECT *, CASE WHEN support THEN 'other_candidate' WHEN noise AND lineage = 'conflict' AND NOT counter THEN 'mixed_symbol_text_candidate'
        WHEN noise THEN 'text_noise' WHEN source = 'm29_image' AND suggested = 'keep_accepted_image' THEN 'accepted_image'
        WHEN (derived OR source IN ('m29_unknown', 'm29_blocked')) AND text_overlap <= 0.2 AND w * h >= 1200 AND w / greatest(1, h)::DOUBLE <= 4
          AND (NOT derived OR greatest(w, h) >= 72) AND (color_count >= 32 OR texture_score >= 0.18) THEN 'media_candidate'
        WHEN (derived OR source = 'm29_blocked') AND text_overlap <= 0.2 AND w * h BETWEEN 16 AND 12000 AND greatest(w, h) <= 128 THEN 'icon_candidate'
        ELSE 'other_candidate' END AS kind FROM f)
    SELECT page_id, region_id, kind, CASE kind WHEN 'mixed_symbol_text_candidate' THEN 'uncertain' WHEN 'text_noise' THEN 'noise'
        WHEN 'accepted_image' THEN 'accepted' ELSE 'candidate' END AS decision,
      CASE kind WHEN 'mixed_symbol_text_candidate' THEN greatest(0.55, least(0.72, base - 0.12::DOUBLE)) WHEN 'text_noise' THEN base
        WHEN 'accepted_image' THEN 0.92 WHEN 'media_candidate' THEN texture_score WHEN 'icon_candidate' THEN 0.68
        ELSE CASE WHEN support THEN 0.74 ELSE 0.45 END END AS confidence FROM k"""))
def p26(spark, sf_dir):
    sources = F.array(*[F.lit(s) for s in ("m29_image", "m29_unknown", "m29_symbol", "m29_blocked", "m291_group")])
    e = primitives(spark, sf_dir).select(
        *KEYS, "w", "h", "color_count", "texture_score", (C("fill_ratio") / 2).alias("text_overlap"),
        F.element_at(sources, C("kind_no") + 1).alias("source"),
        F.when(C("color_count") % 7 == 0, "likely_text_noise").when(C("kind_no") == 0, "keep_accepted_image").otherwise("none").alias("suggested"),
        (C("color_count") == 13).alias("support"), F.when(C("edge_density") > 0.3, "conflict").otherwise("none").alias("lineage"),
        (C("color_count") > 30).alias("counter"), C("texture_score").alias("media_confidence"))
    return e.select(*KEYS, lad.evidence_kind().alias("k")).select(*KEYS, "k.kind", "k.decision", "k.confidence")
