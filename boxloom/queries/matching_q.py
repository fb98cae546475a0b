"""Rectangle matching: containment, coverage and best partners."""

from pyspark.sql import functions as F

from boxloom.functions.geometry import box
from boxloom.functions.ladders import ladder
from boxloom.functions.text import looks_editable, looks_like_marker
from boxloom.operators import matching as m
from boxloom.queries import fixtures as fx
from boxloom.queries.fixture_sql import even, fixture, inside, inter, ioa, iou, up
from boxloom.queries.registry import query, sql
from boxloom.queries.relations_q import typed_primitives

C = F.col

fixture("parents", f"""
    SELECT s.page_id, s.region_id, arg_min(p.region_id, (p.w * p.h)::HUGEINT * 100000000000000000 + p.region_id) AS parent_id,
      any_value(s.x) AS x, any_value(s.y) AS y, any_value(s.w) AS w, any_value(s.h) AS h
    FROM slices s LEFT JOIN slices p ON s.page_id = p.page_id AND {inside('p', 's', 4)}
      AND (p.w * p.h > s.w * s.h OR (p.w * p.h = s.w * s.h AND p.region_id < s.region_id))
    GROUP BY s.page_id, s.region_id""", "slices")


@query("j8_smallest_parent", sql("parents", """
    SELECT c.page_id, c.region_id, c.parent_id, c.x - coalesce(p.x, 0) AS rel_x, c.y - coalesce(p.y, 0) AS rel_y, c.w, c.h
    FROM parents c LEFT JOIN parents p ON c.page_id = p.page_id AND c.parent_id = p.region_id"""))
def j8(spark, sf_dir):
    return m.smallest_parents(fx.slices(spark, sf_dir))


@query("j9_lines_in_slices", sql("text_lines slices", """
    , k AS (SELECT l.page_id, l.line_id, l.x, l.y, l.w, l.h, s.region_id, s.x AS sx, s.y AS sy,
      row_number() OVER (PARTITION BY l.page_id, l.line_id ORDER BY s.w * s.h, s.region_id) AS r
      FROM text_lines l JOIN slices s ON l.page_id = s.page_id AND l.x + l.w / 2.0 BETWEEN s.x AND s.x + s.w
        AND l.y + l.h / 2.0 BETWEEN s.y AND s.y + s.h WHERE l.conf >= 30)
    SELECT page_id, line_id, region_id AS slice_id, x - sx AS x, y - sy AS y, w, h, greatest(10, floor(h * 0.72::DOUBLE + 0.5)) AS font_size
    FROM k WHERE r = 1"""))
def j9(spark, sf_dir):
    return m.lines_in_slices(fx.text_lines(spark, sf_dir), fx.slices(spark, sf_dir))


_PHYS_EXTRA = "CASE WHEN kind_no = 0 THEN region_id END AS ocr_line_id, CASE WHEN color_count % 5 = 0 THEN 'foreground' ELSE 'ocr' END AS source_kind"
fixture("phys", f"SELECT *, {_PHYS_EXTRA} FROM typed_primitives", "typed_primitives")


def phys(spark, sf_dir):
    return typed_primitives(spark, sf_dir).selectExpr("*", *_PHYS_EXTRA.split(", "))


def _score(a, b):
    return (f"({iou(a, b)} * 0.52::DOUBLE + {inter(a, b)} / greatest(1, least({a}.h, {b}.h) * least({a}.w, {b}.w))::DOUBLE * 0.18::DOUBLE"
            f" + greatest(0::DOUBLE, 1 - sqrt(pow({a}.x + {a}.w / 2.0 - {b}.x - {b}.w / 2.0, 2) + pow({a}.y + {a}.h / 2.0 - {b}.y - {b}.h / 2.0, 2))"
            f" / greatest(1, {a}.w, {b}.w)) * 0.2::DOUBLE + least({a}.h, {b}.h) / greatest({a}.h, {b}.h, 1)::DOUBLE * 0.1::DOUBLE)")


_GROW = ("{{'x': l.x - {px}, 'y': l.y - {py}, 'w': l.w + 2 * {px}, 'h': l.h + 2 * {py}}}")
fixture("located", f"""
    SELECT page_id, line_id, x, y, w, h, CASE WHEN reason IS NULL AND claims > 1 THEN 'shared_m29_bbox_for_multiple_ocr_lines' ELSE reason END AS reason,
      score, p
    FROM (SELECT *, count(*) FILTER (reason IS NULL) OVER (PARTITION BY page_id, who) AS claims FROM (
      SELECT *, CASE WHEN score IS NULL OR score < 0.42 THEN CASE WHEN mask_only THEN 'm29_text_region_ocr_mask_only' ELSE 'no_matching_m29_text_bbox' END
        WHEN (hr >= 1.45 AND ar >= 1.55 AND over >= greatest(6, h * 0.45::DOUBLE)) OR (hr >= 1.32 AND ar >= 1.85) OR (wr >= 1.85 AND hr >= 1.12)
          OR wr >= 2.4 THEN 'm29_bbox_too_broad_for_ocr_line'
        WHEN ar < 0.18 OR (wr < 0.5 AND ar < 0.32) OR (hr < 0.36 AND ar < 0.32) THEN 'm29_bbox_too_small_for_ocr_line' END AS reason
      FROM (SELECT *, p.w / greatest(1, w)::DOUBLE AS wr, p.h / greatest(1, h)::DOUBLE AS hr, p.w * p.h / (w * h)::DOUBLE AS ar,
          greatest(y - p.y, p.y + p.h - y - h) AS over FROM (
        SELECT l.page_id, l.line_id, l.x, l.y, l.w, l.h, d.source_kind = 'ocr' AS mask_only,
          CASE WHEN d.source_kind = 'foreground' THEN 1.0 WHEN c.best.score >= coalesce(u.score, -1) THEN c.best.score ELSE u.score END AS score0,
          CASE WHEN d.source_kind = 'foreground' THEN 1.0::DOUBLE WHEN u.score >= c.best.score THEN u.score ELSE c.best.score END AS score,
          CASE WHEN d.source_kind = 'foreground' THEN {{'x': d.x, 'y': d.y, 'w': d.w, 'h': d.h}} WHEN u.score >= c.best.score THEN u.b ELSE c.best.b END AS p,
          CASE WHEN d.source_kind = 'foreground' THEN d.region_id::VARCHAR WHEN u.score >= c.best.score THEN u.ids ELSE c.best.id::VARCHAR END AS who
        FROM text_lines l
        LEFT JOIN phys d ON d.page_id = l.page_id AND d.ocr_line_id = l.line_id
        LEFT JOIN (SELECT page_id, line_id, arg_max({{'score': score, 'id': id, 'b': b}}, {{'s': score, 'n': -id}}) AS best FROM line_frags GROUP BY 1, 2) c
          ON c.page_id = l.page_id AND c.line_id = l.line_id
        LEFT JOIN (SELECT page_id, line_id, ids, u AS b, {_score('l', 'u')} AS score FROM (SELECT page_id, line_id, any_value(l) AS l,
            string_agg(id, '+' ORDER BY id) AS ids, {{'x': min(b.x), 'y': min(b.y), 'w': max(b.x + b.w) - min(b.x), 'h': max(b.y + b.h) - min(b.y)}} AS u
            FROM line_frags WHERE on_line > 0 AND on_line / greatest(1, b.w * b.h)::DOUBLE >= 0.18 GROUP BY 1, 2)) u
          ON u.page_id = l.page_id AND u.line_id = l.line_id))))""", "line_frags phys text_lines")
fixture("line_frags", f"""
    SELECT l.page_id, l.line_id, l, f.region_id AS id, {{'x': f.x, 'y': f.y, 'w': f.w, 'h': f.h}} AS b, {_score('l', 'f')} * 0.82::DOUBLE AS score,
      greatest(0, least(l.x + l.w + 2, f.x + f.w) - greatest(l.x - 2, f.x)) * greatest(0, least(l.y + l.h + 3, f.y + f.h) - greatest(l.y - 3, f.y)) AS on_line
    FROM (SELECT *, greatest(8, floor(h * 0.8::DOUBLE + 0.5)) AS px, greatest(6, floor(h * 0.45::DOUBLE + 0.5)) AS py FROM text_lines) l
    JOIN phys f ON l.page_id = f.page_id
    WHERE f.primitive_type NOT IN ('surface_region', 'image_region') AND f.w <= 260 AND f.h <= 96
      AND NOT (f.primitive_type = 'text_region' AND f.source_kind = 'ocr')
      AND least(l.x + l.w + px, f.x + f.w) > greatest(l.x - px, f.x) AND least(l.y + l.h + py, f.y + f.h) > greatest(l.y - py, f.y)
      AND abs(f.y + f.h / 2.0 - l.y - l.h / 2.0) <= greatest(l.h, f.h) * 0.95::DOUBLE
      AND NOT (f.h > l.h * 2.6::DOUBLE AND f.w > l.w * 0.35::DOUBLE)""", "phys text_lines")


@query("j10_locate_lines", sql("located", f"""
    SELECT page_id, line_id, CASE WHEN reason IS NULL THEN 'm29_foreground' ELSE 'ocr' END AS bbox_source, reason,
      CASE WHEN reason IS NULL THEN p.x ELSE x END AS x, CASE WHEN reason IS NULL THEN p.y ELSE y END AS y,
      CASE WHEN reason IS NULL THEN p.w ELSE w END AS w, CASE WHEN reason IS NULL THEN p.h ELSE h END AS h,
      CASE WHEN reason IS NULL THEN {up('score', 3)} END AS match_score FROM located"""))
def j10(spark, sf_dir):
    """Line to physical box; the last step is the demotion of shared matches (J12)."""
    return m.locate_lines(fx.text_lines(spark, sf_dir), phys(spark, sf_dir))


@query("j12_shared_matches", sql("located", """
    SELECT page_id, count(*) FILTER (reason = 'shared_m29_bbox_for_multiple_ocr_lines') AS shared, count(*) FILTER (reason IS NULL) AS kept
    FROM located GROUP BY page_id"""))
def j12(spark, sf_dir):
    found = m.locate_lines(fx.text_lines(spark, sf_dir), phys(spark, sf_dir))
    return found.groupBy("page_id").agg(
        F.count(F.when(C("reason") == "shared_m29_bbox_for_multiple_ocr_lines", 1)).alias("shared"),
        F.count(F.when(C("reason").isNull(), 1)).alias("kept"))


fixture("uncovered_plain", f"""
    SELECT l.page_id, l.line_id, any_value(l) AS l, greatest(0::DOUBLE, 1 - least(1::DOUBLE, coalesce(sum(CASE WHEN s.region_id IS NOT NULL AND {inter('l', 's')} / (l.w * l.h)::DOUBLE >= 0.25
      THEN {inter('l', 's')} END), 0) / any_value(l.w * l.h)::DOUBLE)) AS remaining
    FROM text_lines l LEFT JOIN slices s ON l.page_id = s.page_id AND s.cut_mode <> 'rect' GROUP BY l.page_id, l.line_id""", "text_lines slices")


@query("j11_remaining_share", sql("uncovered_plain", "SELECT page_id, line_id, remaining FROM uncovered_plain"))
def j11(spark, sf_dir):
    blockers = fx.slices(spark, sf_dir).where("cut_mode <> 'rect'")
    return m.remaining_share(fx.text_lines(spark, sf_dir), blockers).select("page_id", "line_id", "remaining")


_LABEL = "CASE WHEN conf % 7 = 0 THEN ' ' WHEN conf % 11 = 0 THEN 'img-7' ELSE text END"


@query("p23_text_ownership", sql("uncovered_plain", f"""
    SELECT page_id, line_id, CASE WHEN trim(t) = '' THEN 'skipped/empty_text' WHEN l.conf < 70 THEN 'skipped/low_confidence'
      WHEN l.w <= 0 OR l.h < 5 THEN 'skipped/invalid_or_too_small_bbox'
      WHEN t = 'img-7' THEN 'raster_preserve/generated_asset_marker_label'
      WHEN (l.w / 180.0 > 0.72 AND length(t) < 12) OR l.w / 180.0 > 0.92 OR (l.h > 90 AND length(t) < 8) THEN 'raster_preserve/geometry_not_editable'
      WHEN remaining < 0.55 THEN 'raster_preserve/ocr_text_inside_confirmed_slice' ELSE 'editable_text/normal_ocr_text' END AS ownership
    FROM (SELECT *, {_LABEL.replace('conf', 'l.conf').replace('ELSE text', 'ELSE l.text')} AS t FROM uncovered_plain)"""))
def p23(spark, sf_dir):
    blockers = fx.slices(spark, sf_dir).where("cut_mode <> 'rect'")
    lines = m.remaining_share(fx.text_lines(spark, sf_dir).selectExpr("*", f"{_LABEL} AS t"), blockers)
    t = C("t")
    ownership = ladder([
        (F.trim(t) == "", "skipped/empty_text"), (C("conf") < 70, "skipped/low_confidence"),
        ((C("w") <= 0) | (C("h") < 5), "skipped/invalid_or_too_small_bbox"),
        (looks_like_marker(t), "raster_preserve/generated_asset_marker_label"),
        (~looks_editable(t, box(), F.lit(180)), "raster_preserve/geometry_not_editable"),
        (C("remaining") < 0.55, "raster_preserve/ocr_text_inside_confirmed_slice"),
    ], "editable_text/normal_ocr_text")
    return lines.select("page_id", "line_id", ownership.alias("ownership"))


fixture("det_matches", f"""
    SELECT page_id, det AS detection_id, kind AS layer_kind, layer AS layer_id, class_name, score, i AS iou, dc AS det_cov, lc AS layer_cov,
      CASE WHEN class_name = 'TextButton' AND kind = 'shape' AND score >= 0.35 THEN 'control_semantic_tag'
        WHEN class_name = 'TextButton' AND kind = 'text' AND lc >= 0.65 THEN 'control_search_window_candidate'
        WHEN class_name IN ('Image', 'Icon') AND kind = 'raster' AND score >= 0.3 THEN 'media_semantic_tag'
        WHEN class_name IN ('Image', 'Icon') AND kind <> 'raster' AND dc < 0.5 THEN 'media_missing_physical_candidate'
        WHEN class_name = 'Card' AND score >= 0.3 THEN 'structure_semantic_tag'
        WHEN class_name IN ('Text', 'TextButton') AND kind = 'raster' AND dc >= 0.35 THEN 'ocr_overlap_risk'
        WHEN i >= 0.5 THEN 'bbox_aligned' ELSE 'weak_match' END AS decision
    FROM (SELECT *, row_number() OVER (PARTITION BY page_id, det, kind ORDER BY score DESC, layer) AS r FROM (
      SELECT *, greatest(i, dc * 0.85::DOUBLE, lc * 0.75::DOUBLE) AS score FROM (
        SELECT d.page_id, d.region_id AS det, d.class_name, l.region_id AS layer, l.kind, {iou('d', 'l')} AS i, {ioa('d', 'l')} AS dc, {ioa('l', 'd')} AS lc
        FROM detections d JOIN layers l ON d.page_id = l.page_id AND {inter('d', 'l')} > 0)))
    WHERE r = 1 AND score >= 0.2""", "detections layers")


@query("j13_detection_layer_match", sql("det_matches", "SELECT * FROM det_matches"))
def j13(spark, sf_dir):
    return m.detection_layer_matches(fx.detections(spark, sf_dir), fx.layers(spark, sf_dir))


@query("a17_detection_evidence", sql("det_matches", """
    SELECT class_name, decision, count(*) AS n, count(DISTINCT (page_id, detection_id)) AS n_detections, count(DISTINCT page_id) AS n_pages
    FROM det_matches GROUP BY class_name, decision"""))
def a17(spark, sf_dir):
    found = m.detection_layer_matches(fx.detections(spark, sf_dir), fx.layers(spark, sf_dir))
    per_page = found.groupBy("class_name", "decision", "page_id", "detection_id").agg(F.count("*").alias("n"))
    by_page = per_page.groupBy("class_name", "decision", "page_id").agg(F.sum("n").alias("n"), F.count("*").alias("d"))
    return by_page.groupBy("class_name", "decision").agg(
        F.sum("n").alias("n"), F.sum("d").alias("n_detections"), F.count("*").alias("n_pages"))


@query("a17_case_summary", sql("det_matches detections", """
    , d AS (SELECT page_id, count(*) AS detections, count(*) FILTER (class_name = 'TextButton') AS controls,
        count(*) FILTER (class_name IN ('Image', 'Icon')) AS media FROM detections GROUP BY page_id),
    m AS (SELECT page_id, count(DISTINCT detection_id) FILTER (decision <> 'weak_match') AS matched,
        count(*) FILTER (decision = 'ocr_overlap_risk') AS risks, count(*) FILTER (decision = 'control_semantic_tag') AS surfaces
        FROM det_matches GROUP BY page_id)
    SELECT d.page_id, detections, controls, media, coalesce(matched, 0) AS matched, coalesce(risks, 0) AS risks,
      controls > 0 AND coalesce(surfaces, 0) <= 1 AS low_control, coalesce(risks, 0) > 0 AS high_risk FROM d LEFT JOIN m USING (page_id)"""))
def a17_cases(spark, sf_dir):
    from boxloom.plans.evaluation import detection_case_summary

    dets = fx.detections(spark, sf_dir)
    return detection_case_summary(dets, m.detection_layer_matches(dets, fx.layers(spark, sf_dir)))


@query("j14_control_text_risks", sql("detections text_lines", f"""
    SELECT d.page_id, d.region_id AS detection_id, d.class_name, t.line_id, {even(ioa('t', 'd'), 4)} AS coverage
    FROM detections d JOIN text_lines t ON d.page_id = t.page_id AND {ioa('t', 'd')} >= 0.65 WHERE d.class_name = 'TextButton'"""))
def j14(spark, sf_dir):
    return m.control_text_risks(fx.detections(spark, sf_dir), fx.text_lines(spark, sf_dir))


@query("j15_text_owner_surface", sql("text_lines layers", f"""
    , k AS (SELECT t.page_id, t.line_id, l.region_id, {ioa('t', 'l')} AS c, l.w * l.h / greatest(1, t.w * t.h)::DOUBLE AS bulk,
        t.x + t.w / 2.0 BETWEEN l.x AND l.x + l.w AND t.y + t.h / 2.0 BETWEEN l.y AND l.y + l.h AS mid,
        CASE WHEN l.kind = 'raster' THEN 'media_surface' WHEN coalesce(l.group_id = 1, false) THEN 'control_surface' ELSE 'container_surface' END AS role
      FROM text_lines t JOIN layers l ON t.page_id = l.page_id WHERE l.kind IN ('raster', 'shape')),
    s AS (SELECT *, CASE WHEN role = 'media_surface' THEN c - least(0.4::DOUBLE, bulk / 5000) ELSE c * 4 + CASE WHEN mid THEN 1 ELSE 0 END
        - least(1.5::DOUBLE, bulk / 500) END AS score FROM k WHERE (role = 'media_surface' AND c >= 0.85) OR (role = 'control_surface' AND (c >= 0.45 OR mid))
        OR (role = 'container_surface' AND (c >= 0.7 OR mid))),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id, line_id, role ORDER BY score DESC, region_id) AS n FROM s)
    SELECT page_id, line_id, role AS owner_role, region_id AS owner_id, score FROM r WHERE n = 1"""))
def j15(spark, sf_dir):
    layers = fx.layers(spark, sf_dir).withColumn("is_control", F.coalesce(C("group_id") == 1, F.lit(False)))
    return m.text_owner_surfaces(fx.text_lines(spark, sf_dir), layers)


@query("j17_prefer_overview", sql("detections", f"""
    , o AS (SELECT * FROM detections WHERE source_kind = 'overview' AND w >= 8 AND h >= 8 AND w * h / 2073600.0 BETWEEN 0.01 AND 0.82)
    SELECT page_id, region_id, source_kind FROM detections d WHERE source_kind = 'overview'
      OR NOT EXISTS (SELECT 1 FROM o WHERE o.page_id = d.page_id AND {ioa('d', 'o')} >= 0.72)"""))
def j17(spark, sf_dir):
    return m.drop_covered_tiles(fx.detections(spark, sf_dir), fx.PAGE_W * fx.PAGE_H).select("page_id", "region_id", "source_kind")


@query("j18_reject_existing", sql("detections slices", f"""
    SELECT page_id, region_id FROM detections d WHERE NOT EXISTS (SELECT 1 FROM slices s WHERE s.page_id = d.page_id AND {iou('d', 's')} >= 0.6)"""))
def j18(spark, sf_dir):
    return m.not_overlapping(fx.detections(spark, sf_dir), fx.slices(spark, sf_dir)).select("page_id", "region_id")


def missing_lines(spark, sf_dir):
    """OCR blocks that no visible text layer carries."""
    emitted = fx.layers(spark, sf_dir).where("visible AND kind = 'text'").select("page_id", C("region_id").alias("line_id"))
    return fx.text_lines(spark, sf_dir).join(emitted, ["page_id", "line_id"], "left_anti")


fixture("missing_lines", """
    SELECT * FROM text_lines t WHERE NOT EXISTS (SELECT 1 FROM layers l WHERE l.page_id = t.page_id AND l.region_id = t.line_id AND visible AND kind = 'text')""",
        "text_lines layers")


@query("j19_missing_text", sql("missing_lines", "SELECT page_id, line_id FROM missing_lines"))
def j19(spark, sf_dir):
    return missing_lines(spark, sf_dir).select("page_id", "line_id")


@query("j20_container_audit", sql("missing_lines typed_primitives layers", f"""
    , c AS (SELECT * FROM typed_primitives WHERE area > 2073600 * 0.015 AND area < 2073600 * 0.9 AND w >= 48 AND h >= 40
        AND primitive_type IN ('image_region', 'surface_region', 'unknown_region')),
    k AS (SELECT c.page_id, c.region_id, (SELECT count(*) FROM missing_lines t WHERE t.page_id = c.page_id AND {ioa('t', 'c')} >= 0.7) AS missing_text,
        (SELECT count(*) FROM layers l WHERE l.page_id = c.page_id AND l.region_id <> c.region_id AND {ioa('l', 'c')} >= 0.72) AS held_layers FROM c)
    SELECT *, CASE WHEN missing_text > 0 THEN 'foreground_conflict' ELSE 'container_contains_layers' END AS decision FROM k
    WHERE missing_text > 0 OR held_layers >= 2"""))
def j20(spark, sf_dir):
    containers = typed_primitives(spark, sf_dir).where(
        "area > 2073600 * 0.015D AND area < 2073600 * 0.9D AND w >= 48 AND h >= 40 "
        "AND primitive_type IN ('image_region', 'surface_region', 'unknown_region')")
    return m.container_audit(containers, missing_lines(spark, sf_dir), fx.layers(spark, sf_dir))


@query("j21_supporting_sources", sql("regions", f"""
    SELECT a.page_id, a.region_id, count(b.region_id) AS n_support,
      coalesce(array_to_string(list_sort(list_distinct(list(b.visual_kind) FILTER (b.visual_kind IS NOT NULL))), ','), '') AS sources
    FROM regions a LEFT JOIN regions b ON a.page_id = b.page_id AND a.region_id <> b.region_id AND {iou('a', 'b')} >= 0.15 GROUP BY 1, 2"""))
def j21(spark, sf_dir):
    found = m.supporting_sources(fx.regions(spark, sf_dir), "visual_kind")
    return found.withColumn("sources", F.coalesce(F.array_join("sources", ","), F.lit("")))


fixture("text_on", f"""
    SELECT c.*, coalesce(sum({inter('c', 't')}) FILTER (t.line_id IS NOT NULL), 0)::BIGINT AS overlap_area, count(t.line_id) AS text_blocks, coalesce(sum(t.w * t.h), 0)::BIGINT AS touching_area,
      count(t.line_id) FILTER ({inter('c', 't')} / (t.w * t.h)::DOUBLE >= 0.25) AS covered_blocks, max(t.conf) AS best_conf
    FROM (SELECT page_id, region_id, x, y, w, h, visual_kind, partkey, kind_no FROM regions) c
    LEFT JOIN text_lines t ON c.page_id = t.page_id AND c.region_id <> t.line_id AND {inter('c', 't')} > 0 GROUP BY ALL""", "regions text_lines")


@query("j22_text_heavy", sql("text_on", "SELECT page_id, region_id, touching_area / (w * h)::DOUBLE > 0.22 AS text_heavy FROM text_on"))
def j22(spark, sf_dir):
    found = m.text_overlap(fx.regions(spark, sf_dir), fx.text_lines(spark, sf_dir))
    return found.select("page_id", "region_id", (C("touching_area") / (C("w") * C("h")) > 0.22).alias("text_heavy"))


@query("j23_text_overlap", sql("text_on", f"""
    SELECT page_id, region_id, overlap_area, text_blocks, {even('overlap_area / (w * h)::DOUBLE', 4)} AS ratio, covered_blocks,
      covered_blocks > 0 AS knockout FROM text_on"""))
def j23(spark, sf_dir):
    found = m.text_overlap(fx.regions(spark, sf_dir), fx.text_lines(spark, sf_dir))
    return found.select("page_id", "region_id", "overlap_area", "text_blocks",
                        (F.rint(C("overlap_area") / (C("w") * C("h")) * 10000.0) / 10000.0).alias("ratio"), "covered_blocks",
                        (C("covered_blocks") > 0).alias("knockout"))


_VIS = "['icon_candidate', 'text_noise', 'media_candidate', 'accepted_image', 'mixed_symbol_text_candidate', 'other_candidate'][1 + partkey % 6]"


@query("j24_visual_ownership", sql("text_on", f"""
    , v AS (SELECT *, {_VIS} AS k, least(1::DOUBLE, overlap_area / greatest(1, w * h)::DOUBLE) AS by_box,
        CASE WHEN text_blocks = 0 THEN 0 ELSE least(1::DOUBLE, overlap_area / greatest(1, touching_area)::DOUBLE) END AS by_text, text_blocks > 0 AS hit FROM text_on)
    SELECT page_id, region_id, by_box, by_text, split_part(v, '/', 1) AS ownership, split_part(v, '/', 2) AS decision, split_part(v, '/', 3) AS reason
    FROM (SELECT *, CASE WHEN k = 'mixed_symbol_text_candidate' THEN 'mixed_or_uncertain/uncertain/symbol_text_ownership_conflict'
      WHEN k = 'text_noise' AND hit AND by_box >= 0.55 AND by_text >= 0.45 THEN 'text_owned/accepted/high_ocr_overlap_text_noise'
      WHEN k = 'text_noise' AND hit THEN 'mixed_or_uncertain/uncertain/low_ocr_confidence' WHEN k = 'text_noise' THEN 'audit_only/uncertain/missing_text_match'
      WHEN k IN ('media_candidate', 'accepted_image') THEN concat('visual_owned/', CASE WHEN k = 'accepted_image' THEN 'accepted' ELSE 'candidate' END,
        CASE WHEN hit AND by_box > 0 THEN '/image_with_text_overlay' ELSE '/visual_candidate_kept' END)
      WHEN hit AND by_box >= 0.35 THEN 'mixed_or_uncertain/uncertain/conflicting_ownership'
      ELSE 'visual_owned/candidate/visual_candidate_kept' END AS v FROM v)"""))
def j24(spark, sf_dir):
    found = m.text_overlap(fx.regions(spark, sf_dir), fx.text_lines(spark, sf_dir))
    kinds = F.array(*[F.lit(k) for k in ("icon_candidate", "text_noise", "media_candidate", "accepted_image",
                                         "mixed_symbol_text_candidate", "other_candidate")])
    hit = C("text_blocks") > 0
    by_box = F.least(F.lit(1.0), C("overlap_area") / F.greatest(F.lit(1), C("w") * C("h")))
    by_text = F.when(hit, F.least(F.lit(1.0), C("overlap_area") / F.greatest(F.lit(1), C("touching_area")))).otherwise(0.0)
    kind = F.element_at(kinds, (C("partkey") % 6 + 1).cast("int"))
    found = found.withColumn("by_box", by_box).withColumn("by_text", by_text)
    return found.select("page_id", "region_id", "by_box", "by_text", m.visual_ownership(
        kind, C("by_box"), C("by_text"), F.lit(1.0), hit).alias("v")).select("page_id", "region_id", "by_box", "by_text", "v.*")


@query("j31_covered_text", sql("layers", f"""
    SELECT t.page_id, t.region_id AS text_id, c.region_id AS cover_id FROM layers t JOIN layers c ON t.page_id = c.page_id
    WHERE t.visible AND t.kind = 'text' AND c.visible AND c.kind <> 'text' AND c.z > t.z AND {ioa('t', 'c')} >= 0.8"""))
def j31(spark, sf_dir):
    return m.covered_texts(fx.layers(spark, sf_dir))


def near_dup(a, b):
    return (f"({iou(a, b)} >= 0.88 OR (greatest({ioa(a, b)}, {ioa(b, a)}) >= 0.96 AND abs({a}.w * {a}.h - {b}.w * {b}.h) * 100"
            f" <= greatest({a}.w * {a}.h, {b}.w * {b}.h) * 18))")


@query("j32_duplicate_owners", sql("layers", f"""
    SELECT a.page_id, a.region_id AS left_id, b.region_id AS right_id, a.kind FROM layers a JOIN layers b ON a.page_id = b.page_id AND a.region_id < b.region_id
    WHERE a.visible AND b.visible AND a.kind = b.kind AND a.kind <> 'text' AND NOT coalesce(a.group_id = b.group_id, false)
      AND least(a.w * a.h, b.w * b.h) >= 800 AND {near_dup('a', 'b')}"""))
def j32(spark, sf_dir):
    return m.duplicate_owners(fx.layers(spark, sf_dir))


fixture("untrusted", f"""
    SELECT * FROM layers l WHERE visible AND kind <> 'text' AND coalesce(decision, '') <> 'image_replay' AND EXISTS (SELECT 1 FROM layers v WHERE v.page_id = l.page_id
      AND v.visible AND v.decision = 'image_replay' AND v.kind = l.kind AND v.w * v.h <= l.w * l.h * 4 AND {ioa('l', 'v')} >= 0.7)""", "layers")


def _suppressed(spark, sf_dir):
    layers = fx.layers(spark, sf_dir)
    trusted = layers.where("decision = 'image_replay'")
    return m.covered_by_trusted(layers.where("coalesce(decision, '') <> 'image_replay'"), trusted)


@query("j33_covered_by_trusted", sql("untrusted", "SELECT page_id, region_id, asset_id FROM untrusted"))
def j33(spark, sf_dir):
    return _suppressed(spark, sf_dir).select("page_id", "region_id", "asset_id")


@query("j33_remaining_assets", sql("untrusted layers", """
    SELECT DISTINCT page_id, asset_id FROM layers WHERE asset_id IS NOT NULL
    EXCEPT SELECT page_id, asset_id FROM untrusted WHERE asset_id IS NOT NULL"""))
def j33_assets(spark, sf_dir):
    assets = fx.layers(spark, sf_dir).where("asset_id IS NOT NULL").select("page_id", "asset_id").distinct()
    return assets.join(_suppressed(spark, sf_dir).select("page_id", "asset_id"), ["page_id", "asset_id"], "left_anti")


@query("j34_shapes_under_raster", sql("layers", f"""
    SELECT s.page_id, s.region_id, min(r.region_id) AS owner_id FROM layers s JOIN layers r ON s.page_id = r.page_id
    WHERE s.visible AND s.kind = 'shape' AND r.visible AND r.kind = 'raster' AND r.z > s.z AND r.w * r.h >= s.w * s.h AND {ioa('s', 'r')} >= 0.98 GROUP BY 1, 2"""))
def j34(spark, sf_dir):
    shown = fx.layers(spark, sf_dir).where("visible")
    return m.shapes_under_raster(shown.where("kind = 'shape'"), shown.where("kind = 'raster'"))


@query("a28_layer_kind_counts", sql("layers", "SELECT page_id, kind, count(*) AS n FROM layers GROUP BY page_id, kind"))
def a28(spark, sf_dir):
    return fx.layers(spark, sf_dir).groupBy("page_id", "kind").agg(F.count("*").alias("n"))
