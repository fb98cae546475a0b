"""Regions in context: neighbours, anchors, clipping, owners."""

from pyspark.sql import functions as F

from boxloom.operators import context as cx
from boxloom.queries import fixtures as fx
from boxloom.queries.fixture_sql import even, fixture, gap, inside, inter
from boxloom.queries.registry import query, sql
from boxloom.queries.relations_q import typed_primitives

C = F.col
R = fx.regions


@query("j6_neighbour_pairs", sql("regions", f"""
    , p AS (SELECT a.page_id, a.region_id AS left_id, b.region_id AS right_id, {gap('a', 'b')} AS gap FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.region_id < b.region_id AND {gap('a', 'b')} <= 84),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id, left_id ORDER BY gap, right_id) AS position FROM p) SELECT * FROM r WHERE position <= 4"""))
def j6(spark, sf_dir):
    return cx.neighbour_pairs(R(spark, sf_dir), 84, 4)


_NODE = "CASE WHEN kind_no = 0 THEN 'text' ELSE 'visual' END AS side, score_milli % 7 = 0 AS risk_text, w >= h * 4 AS risk_wide"
_U = {"w": "(greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x))", "h": "(greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y))"}


@query("j7_object_edges", sql("regions", f"""
    , n AS (SELECT page_id, region_id, x, y, w, h, {_NODE} FROM regions),
    p AS (SELECT a.page_id, a.region_id AS left_id, b.region_id AS right_id, {gap('a', 'b')} AS distance,
        greatest(0::DOUBLE, 1 - {gap('a', 'b')} / 84.0::DOUBLE) AS near,
        greatest(greatest(0::DOUBLE, 1 - least(abs(a.x + a.w / 2.0 - b.x - b.w / 2.0), abs(a.y + a.h / 2.0 - b.y - b.h / 2.0)) / 64.0::DOUBLE), greatest(0::DOUBLE, 1 - abs(a.y + a.h - b.y - b.h) / 40.0::DOUBLE)) AS aligned,
        greatest(0::DOUBLE, 1 - ({_U['w']} * {_U['h']} / greatest(1, a.w * a.h + b.w * b.h)::DOUBLE - 1) / 3) AS compact,
        greatest(0::DOUBLE, 1 - (greatest(a.w * a.h, b.w * b.h) / greatest(1, least(a.w * a.h, b.w * b.h))::DOUBLE - 1) / 8) AS sized,
        CASE WHEN a.side = 'text' AND b.side = 'text' THEN 0.75 ELSE 0.9 END::DOUBLE AS fit, (a.risk_text OR b.risk_text)::INT AS texty, (a.risk_wide OR b.risk_wide)::INT AS wide,
        (greatest(a.x + a.w, b.x + b.w) > 1080 OR greatest(a.y + a.h, b.y + b.h) > 1920)::INT AS outside
      FROM n a JOIN n b ON a.page_id = b.page_id AND a.region_id < b.region_id AND {gap('a', 'b')} <= 84),
    s AS (SELECT *, near * 0.25::DOUBLE + aligned * 0.2::DOUBLE + compact * 0.15::DOUBLE + fit * 0.15::DOUBLE + sized * 0.15::DOUBLE - texty * 0.25::DOUBLE - outside * 0.35::DOUBLE - wide * 0.3::DOUBLE AS score FROM p)
    SELECT page_id, left_id, right_id, distance, {even('greatest(0::DOUBLE, least(1::DOUBLE, score))', 6)} AS score,
      CASE WHEN outside = 1 THEN 'rejected' WHEN score >= 0.68 THEN 'accepted' WHEN score >= 0.52 THEN 'weak' ELSE 'rejected' END AS decision FROM s"""))
def j7(spark, sf_dir):
    nodes = R(spark, sf_dir).selectExpr("page_id", "region_id", "x", "y", "w", "h", *_NODE.split(", "))
    return cx.object_edges(nodes, fx.PAGE_W, fx.PAGE_H)


@query("j7_fragment_edges", sql("regions", f"""
    , p AS (SELECT a.page_id, a.region_id AS left_id, b.region_id AS right_id, {gap('a', 'b')} AS gap, least(a.x, b.x) AS x, least(a.y, b.y) AS y, {_U['w']} AS w, {_U['h']} AS h
      FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.region_id < b.region_id AND {gap('a', 'b')} <= 24 WHERE a.kind_no = 2 AND b.kind_no = 2)
    SELECT page_id, left_id, right_id, gap, array_to_string(list_filter([CASE WHEN w * h > 12000 THEN 'merged_bbox_too_large' END, CASE WHEN greatest(w, h) > 96 THEN 'merged_edge_too_large' END,
      CASE WHEN EXISTS (SELECT 1 FROM regions t WHERE t.page_id = p.page_id AND t.kind_no = 0 AND {inter('p', 't')} > 0) THEN 'cross_text_node' END,
      CASE WHEN EXISTS (SELECT 1 FROM regions t WHERE t.page_id = p.page_id AND t.kind_no = 1 AND {inter('p', 't')} > 0) THEN 'cross_image_node' END], lambda s: s IS NOT NULL), ',') AS hard_reasons FROM p"""))
def j7_fragments(spark, sf_dir):
    r = R(spark, sf_dir)
    return cx.fragment_edges(r.where("kind_no = 2"), r.where("kind_no = 0"), r.where("kind_no = 1"))


def _dir(cross, space, own, text, extent):
    sc, sg = f"greatest(16::DOUBLE, {extent} * 0.85::DOUBLE)", f"greatest(12::DOUBLE, {text} * 0.9::DOUBLE)"
    off = f"({space} - greatest(4::DOUBLE, {text} * 0.45::DOUBLE))"
    return f"CASE WHEN {space} < {own} * -0.25::DOUBLE THEN 0 ELSE exp(-({cross} * {cross}) / ({sc} * {sc} * 2)) * exp(-({off} * {off}) / ({sg} * {sg} * 2)) END"


_DX, _DY = "abs(a.x + a.w / 2.0 - t.x - t.w / 2.0)", "abs(a.y + a.h / 2.0 - t.y - t.h / 2.0)"
_WIDE, _TALL = "greatest(a.w, t.w)", "greatest(a.h, t.h)"
_ANCHORS = ", ".join(f"{{'o': {i}, 'relation': '{n}', 'score': {v}}}" for i, (n, v) in enumerate((
    ("above_text", _dir(_DX, "(t.y - a.y - a.h)", "a.h", "t.h", _WIDE)), ("below_text", _dir(_DX, "(a.y - t.y - t.h)", "a.h", "t.h", _WIDE)),
    ("left_of_text", _dir(_DY, "(t.x - a.x - a.w)", "a.w", "t.w", _TALL)), ("right_of_text", _dir(_DY, "(a.x - t.x - t.w)", "a.w", "t.w", _TALL)),
    ("near_text", f"exp(-({_DX} * {_DX}) / (pow(greatest(24::DOUBLE, {_WIDE} * 1.15::DOUBLE), 2) * 2)) * exp(-({_DY} * {_DY}) / (pow(greatest(18::DOUBLE, {_TALL} * 1.15::DOUBLE), 2) * 2)) * CASE WHEN {inter('a', 't')} > 0 THEN 0.35 ELSE 1 END"))))
_IN = "m.x <= {p}.x AND m.y <= {p}.y AND m.x + m.w >= {p}.x + {p}.w AND m.y + m.h >= {p}.y + {p}.h"
fixture("anchors", f"""
    SELECT page_id, region_id, line_id, s.relation AS relation, {even('s.score', 3)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id, region_id ORDER BY s.score DESC, line_id, s.o) AS n FROM (
      SELECT a.page_id, a.region_id, t.line_id, unnest([{_ANCHORS}]) AS s FROM regions a JOIN text_lines t ON a.page_id = t.page_id AND a.region_id <> t.line_id WHERE a.kind_no = 2 AND EXISTS (SELECT 1 FROM regions m WHERE m.page_id = a.page_id AND m.kind_no = 1 AND {_IN.format(p='a')} AND {_IN.format(p='t')}))) WHERE n = 1""",
        "regions text_lines")


@query("j16_text_anchors", sql("anchors", "SELECT page_id, region_id, line_id, relation, score FROM anchors"))
def j16(spark, sf_dir):
    return cx.text_anchors(R(spark, sf_dir).where("kind_no = 2"), fx.text_lines(spark, sf_dir), R(spark, sf_dir).where("kind_no = 1"))


@query("t7_best_candidate_per_text", sql("anchors", "SELECT page_id, line_id, arg_min(region_id, (-score, region_id)) AS region_id, max(score) AS score FROM anchors GROUP BY page_id, line_id"))
def t7(spark, sf_dir):
    return cx.best_per_text(cx.text_anchors(R(spark, sf_dir).where("kind_no = 2"), fx.text_lines(spark, sf_dir), R(spark, sf_dir).where("kind_no = 1")))


@query("j38_clipped_boxes", sql("regions text_lines", f"""
    , c AS (SELECT * FROM regions WHERE kind_no IN (1, 3)),
    s AS (SELECT c.page_id, c.region_id, any_value(c) AS c, sum({inter('c', 't')}) AS cover, min(t.y) FILTER (t.y + t.h / 2.0 >= c.y + c.h / 2.0) AS b, max(t.y + t.h) FILTER (t.y + t.h / 2.0 <= c.y + c.h / 2.0) AS u,
        min(t.x) FILTER (t.x + t.w / 2.0 >= c.x + c.w / 2.0) AS r, max(t.x + t.w) FILTER (t.x + t.w / 2.0 <= c.x + c.w / 2.0) AS l
      FROM c JOIN text_lines t ON c.page_id = t.page_id AND {inter('c', 't')} > 0 GROUP BY 1, 2),
    p AS (SELECT page_id, region_id, c.w * c.h AS whole, unnest(list_filter([CASE WHEN b IS NOT NULL THEN {{'i': 1, 'x': c.x, 'y': c.y, 'w': c.w, 'h': greatest(0, b - c.y)}} END,
        CASE WHEN u IS NOT NULL THEN {{'i': 2, 'x': c.x, 'y': u, 'w': c.w, 'h': greatest(0, c.y + c.h - u)}} END, CASE WHEN r IS NOT NULL THEN {{'i': 3, 'x': c.x, 'y': c.y, 'w': greatest(0, r - c.x), 'h': c.h}} END,
        CASE WHEN l IS NOT NULL THEN {{'i': 4, 'x': l, 'y': c.y, 'w': greatest(0, c.x + c.w - l), 'h': c.h}} END], lambda q: q IS NOT NULL)) AS p
      FROM s WHERE cover / (c.w * c.h)::DOUBLE > 0.08 AND cover / (c.w * c.h)::DOUBLE <= 0.45),
    q AS (SELECT page_id, region_id, whole, p.i AS i, p.x AS x, p.y AS y, p.w AS w, p.h AS h FROM p WHERE p.w >= 10 AND p.h >= 10 AND p.w * p.h >= 400 AND p.w * p.h >= whole * 0.2::DOUBLE),
    v AS (SELECT q.*, coalesce((SELECT sum({inter('q', 't')}) FROM text_lines t WHERE t.page_id = q.page_id), 0) AS rest FROM q),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_id, region_id ORDER BY w * h DESC, i) AS n FROM v WHERE rest / (w * h)::DOUBLE <= 0.08)
    SELECT page_id, region_id, x, y, w, h FROM k WHERE n = 1"""))
def j38(spark, sf_dir):
    return cx.clipped_boxes(R(spark, sf_dir).where("kind_no IN (1, 3)"), fx.text_lines(spark, sf_dir))


_LINES = "page_id, line_id, x, y, w, h, CASE WHEN conf % 9 = 0 THEN ' ' ELSE text END AS text, conf / 100.0{d} AS conf, (conf * 7 % 100) / 100.0{d} AS local_conf"


@query("j39_text_classes", sql("text_lines regions", f"""
    , t AS (SELECT {_LINES.format(d='')} FROM text_lines), m AS (SELECT * FROM regions WHERE kind_no IN (1, 3)),
    b AS (SELECT t.page_id, t.line_id, {inter('t', 'm')} / (t.w * t.h)::DOUBLE AS share, m.w AS mw, m.h AS mh, row_number() OVER (PARTITION BY t.page_id, t.line_id ORDER BY {inter('t', 'm')} DESC, m.region_id) AS n
      FROM t JOIN m ON t.page_id = m.page_id AND {inter('t', 'm')} > 0),
    k AS (SELECT t.page_id, t.line_id, coalesce(share, 0) AS media_share, CASE WHEN trim(text) = '' OR conf < 0.6 THEN 'preserve_raster_text/low'
        WHEN share >= 0.82 AND h >= 40 AND (h >= round_even(mh * 0.08::DOUBLE, 0) OR (w >= round_even(mw * 0.22::DOUBLE, 0) AND h >= 30) OR (w >= 238 AND h >= round_even(mh * 0.06::DOUBLE, 0))) THEN 'preserve_raster_text/medium'
        WHEN local_conf >= 0.45 THEN 'editable_ui_text/high' ELSE 'editable_ui_text/medium' END AS v FROM t LEFT JOIN b ON t.page_id = b.page_id AND t.line_id = b.line_id AND n = 1)
    SELECT page_id, line_id, split_part(v, '/', 1) AS visual_kind, split_part(v, '/', 2) AS confidence, media_share FROM k"""))
def j39(spark, sf_dir):
    lines = fx.text_lines(spark, sf_dir).selectExpr(*[e.strip() for e in _LINES.format(d="D").split(", ")])
    return cx.text_classes(lines, R(spark, sf_dir).where("kind_no IN (1, 3)"), fx.PAGE_W)


@query("j40_label_anchors", sql("regions text_lines", f"""
    , h AS (SELECT i.page_id, i, m FROM regions i JOIN regions m ON i.page_id = m.page_id AND i.region_id <> m.region_id AND {inter('i', 'm')} / (i.w * i.h)::DOUBLE >= 0.8 WHERE i.kind_no = 2 AND m.kind_no IN (1, 3, 4))
    SELECT h.page_id, i.region_id AS icon_id, m.region_id AS media_id, min(t.line_id) AS line_id FROM h JOIN text_lines t ON t.page_id = h.page_id
    WHERE ({inter('t', 'm')} / (t.w * t.h)::DOUBLE >= 0.7 OR (t.x + t.w / 2.0 BETWEEN m.x AND m.x + m.w AND t.y + t.h / 2.0 BETWEEN m.y AND m.y + m.h)) AND {inter('i', 't')} = 0
      AND abs(i.x + i.w / 2.0 - t.x - t.w / 2.0) <= greatest(i.w * 0.85::DOUBLE, 36) AND ((t.y - i.y - i.h >= -greatest(4, t.h * 0.35::DOUBLE) AND t.y - i.y - i.h <= greatest(36, i.h * 1.25::DOUBLE))
        OR abs(i.y + i.h / 2.0 - t.y - t.h / 2.0) <= greatest(i.h, t.h) * 1.8::DOUBLE) GROUP BY 1, 2, 3"""))
def j40(spark, sf_dir):
    r = R(spark, sf_dir)
    return cx.label_anchors(r.where("kind_no = 2"), r.where("kind_no IN (1, 3, 4)"), fx.text_lines(spark, sf_dir))


@query("j41_contained_text", sql("regions text_lines", f"""
    SELECT c.page_id, c.region_id, count(*) AS texts, sum({inter('c', 't')}) AS text_area FROM regions c JOIN text_lines t ON c.page_id = t.page_id AND {inter('c', 't')} / (t.w * t.h)::DOUBLE >= 0.85
    WHERE c.kind_no IN (3, 4) AND t.conf >= 60 GROUP BY 1, 2, c.w, c.h HAVING sum({inter('c', 't')}) / (c.w * c.h)::DOUBLE BETWEEN 0.04 AND 0.45"""))
def j41(spark, sf_dir):
    return cx.contained_text(R(spark, sf_dir).where("kind_no IN (3, 4)"), fx.text_lines(spark, sf_dir))


@query("j42_fallback_candidates", sql("typed_primitives regions", f"""
    , p AS (SELECT *, least(1::DOUBLE, coalesce((SELECT sum({inter('q', 'v')}) FROM regions v WHERE v.page_id = q.page_id AND v.region_id <> q.region_id AND v.kind_no IN (1, 3)), 0) / (w * h)::DOUBLE) AS by_visual,
      least(1::DOUBLE, coalesce((SELECT sum({inter('q', 't')}) FROM regions t WHERE t.page_id = q.page_id AND t.region_id <> q.region_id AND t.kind_no = 0), 0) / (w * h)::DOUBLE) AS by_text FROM typed_primitives q
      WHERE primitive_type IN ('symbol_region', 'image_region', 'unknown_region', 'rect', 'line') AND w * h BETWEEN 80 AND 25000 AND w <= 540 AND h <= 1920 * 0.12)
    SELECT page_id, region_id, by_visual, by_text FROM p WHERE by_visual < 0.35 AND by_text < 0.72 AND (by_text < 0.45 OR (w / h::DOUBLE BETWEEN 1.5 AND 4.8 AND w * h BETWEEN 900 AND 8000))"""))
def j42(spark, sf_dir):
    r = R(spark, sf_dir)
    return cx.fallback_candidates(typed_primitives(spark, sf_dir), r.where("kind_no IN (1, 3)"), r.where("kind_no = 0"), fx.PAGE_W, fx.PAGE_H)


@query("j43_media_text_owners", sql("regions text_lines", f"""
    , p AS (SELECT m.page_id, m.region_id, t.line_id, m.w * m.h AS area, (m.score_milli % 100) / 100.0::DOUBLE AS cx, {inter('m', 't')} AS i, {inter('m', 't')} / (t.w * t.h)::DOUBLE AS c
      FROM regions m JOIN text_lines t ON m.page_id = t.page_id AND {inter('m', 't')} / (t.w * t.h)::DOUBLE >= 0.72 WHERE m.kind_no = 1),
    s AS (SELECT page_id, region_id, area, cx, count(*) AS n, sum(i) / greatest(1, area)::DOUBLE AS ratio FROM p GROUP BY page_id, region_id, area, cx),
    g AS (SELECT *, cx + least(0.25::DOUBLE, area / 2073600.0) + least(0.18::DOUBLE, n * 0.035::DOUBLE) - least(0.2::DOUBLE, ratio) AS s FROM s WHERE NOT (n = 1 AND area < 2073600 * 0.035 AND cx < 0.52) AND ratio <= 0.22),
    k AS (SELECT p.page_id, p.line_id, p.region_id, g.s + p.c * 0.1::DOUBLE AS score, row_number() OVER (PARTITION BY p.page_id, p.line_id ORDER BY g.s + p.c * 0.1::DOUBLE DESC, p.region_id) AS o
      FROM p JOIN g ON p.page_id = g.page_id AND p.region_id = g.region_id)
    SELECT page_id, line_id, region_id AS owner_id, {even('score', 4)} AS owner_score FROM k WHERE o = 1"""))
def j43(spark, sf_dir):
    rasters = R(spark, sf_dir).where("kind_no = 1").withColumn("complexity", F.expr("(score_milli % 100) / 100.0D"))
    return cx.media_text_owners(rasters, fx.text_lines(spark, sf_dir), fx.PAGE_W * fx.PAGE_H)


@query("j44_enclosing_shapes", sql("regions", f"""
    SELECT i.page_id, i.region_id, arg_min(s.region_id, (s.w * s.h, s.region_id)) AS container_id FROM regions i JOIN regions s ON i.page_id = s.page_id AND i.region_id <> s.region_id AND {inside('s', 'i', 0)}
    WHERE i.kind_no = 2 AND s.kind_no = 3 GROUP BY 1, 2"""))
def j44(spark, sf_dir):
    r = R(spark, sf_dir)
    return cx.enclosing_shapes(r.where("kind_no = 2"), r.where("kind_no = 3"), "container_id")


@query("j44_icon_buttons", sql("regions", f"""
    , g AS (SELECT s.page_id, s.region_id, min(i.region_id) AS content_id FROM regions s JOIN regions i ON i.page_id = s.page_id AND i.region_id <> s.region_id AND {inside('s', 'i', 0)} WHERE s.kind_no = 3 AND i.kind_no = 1 GROUP BY 1, 2),
    f AS (SELECT s.page_id, s.region_id, min(i.region_id) AS content_id FROM regions s JOIN regions i ON i.page_id = s.page_id AND i.region_id <> s.region_id AND {inside('s', 'i', 0)} WHERE s.kind_no = 3 AND i.kind_no = 2 GROUP BY 1, 2)
    SELECT *, 'group' AS content FROM g UNION ALL SELECT *, 'fragment' FROM f WHERE (page_id, region_id) NOT IN (SELECT page_id, region_id FROM g)"""))
def j44_buttons(spark, sf_dir):
    r = R(spark, sf_dir)
    return cx.icon_buttons(r.where("kind_no = 3"), r.where("kind_no = 1"), r.where("kind_no = 2"))


_ROLE = "CASE {h} WHEN 0 THEN 'text' WHEN 1 THEN 'visual' WHEN 2 THEN 'wide_source' WHEN 3 THEN 'weak_visual' WHEN 4 THEN 'visual' ELSE 'noise' END"


@query("j45_member_routes", sql("regions", f"""
    , m AS (SELECT *, {_ROLE.format(h='score_milli % 6')} AS role, CASE WHEN suppkey % 9 = 0 THEN 0 ELSE w END AS mw FROM regions)
    SELECT page_id, region_id AS node_id, split_part(v, '/', 1) AS route, split_part(v, '/', 2) AS reason FROM (SELECT *, CASE WHEN mw <= 0 OR x + mw > 1080 OR y + h > 1920 THEN 'unresolved/invalid_bbox'
      WHEN kind_no = 4 THEN 'unresolved/missing_lookup' WHEN role = 'text' THEN 'text/' WHEN role = 'wide_source' THEN 'unresolved/wide_source' WHEN role = 'noise' THEN 'unresolved/noise_member'
      WHEN role = 'weak_visual' THEN 'unresolved/weak_visual' WHEN kind_no = 3 THEN 'shape/' ELSE 'visual/' END AS v FROM m)"""))
def j45(spark, sf_dir):
    r = R(spark, sf_dir)
    members = r.selectExpr("page_id", "region_id AS node_id", f"{_ROLE.format(h='score_milli % 6')} AS member_role", "x", "y", "CASE WHEN suppkey % 9 = 0 THEN 0 ELSE w END AS w", "h")
    nodes = r.where("kind_no <> 4").selectExpr("page_id", "region_id AS node_id", "CASE WHEN kind_no = 3 THEN 'shape' ELSE 'visual' END AS node_kind")
    return cx.route_members(members, nodes, fx.PAGE_W, fx.PAGE_H)
