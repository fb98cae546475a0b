"""Ordered claims and their kin."""

from pyspark.sql import functions as F

from boxloom.plans import claims as cl
from boxloom.plans.clusters import accepted_groups
from boxloom.queries import fixtures as fx
from boxloom.queries.cluster_q import bundles_by_page
from boxloom.queries.fixture_sql import fixture, greedy, inside, inter, ioa, iou
from boxloom.queries.registry import query, sql
from boxloom.queries.relations_q import typed_primitives

C = F.col
X = "x[1]"
BOX = "region_id x y w h"


@query("g3_merge_new_slices", sql("detections slices", f"""
    , c AS (SELECT * FROM detections d WHERE NOT EXISTS (SELECT 1 FROM slices s WHERE s.page_id = d.page_id AND {iou('d', 's')} >= 0.6)),
    k AS ({greedy('c', BOX, 'region_id', iou('k', X) + ' >= 0.6')})
    SELECT page_id, r.region_id AS region_id FROM k"""))
def g3_merge(spark, sf_dir):
    return cl.merge_new_slices(fx.detections(spark, sf_dir), fx.slices(spark, sf_dir), []).select("page_id", "region_id")


@query("g14_controlled_groups", sql("bundles", """
    , k AS (SELECT page_id, unnest(list_reduce(list([{'g': group_id, 'ms': ms, 's': score, 'n': n}] ORDER BY -score, n, group_id), lambda acc, x:
      CASE WHEN len(list_filter(acc, lambda k: len(list_intersect(k.ms, x[1].ms)) > 0)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS r FROM bundles GROUP BY page_id),
    p AS (SELECT page_id, r.g AS group_id, row_number() OVER (PARTITION BY page_id ORDER BY -r.s, r.n, r.g) AS position FROM k)
    SELECT * FROM p WHERE position <= 4"""))
def g14(spark, sf_dir):
    order = [(-C("score")).alias("s"), C("n")]
    return bundles_by_page(spark, sf_dir, lambda groups: accepted_groups(groups, order, 0.0).where("kept AND position <= 4").select("page_id", "group_id", "position"),
                           lambda groups, members: cl.controlled_groups(groups, members, order, 4))


# claims folded owner by owner, smallest owner first
fixture("holdings", f"""
    SELECT o.page_id, o.region_id AS owner, o.w * o.h AS area, list(c.region_id ORDER BY c.region_id) FILTER (c.region_id IS NOT NULL) AS items,
      list(c.region_id) FILTER (c.kind IN ('text', 'raster')) AS rich
    FROM layers o LEFT JOIN layers c ON o.page_id = c.page_id AND c.visible AND c.region_id <> o.region_id AND c.w * c.h * 100 < o.w * o.h * 94 AND {ioa('c', 'o')} >= 0.92
    WHERE o.visible AND o.kind IN ('shape', 'raster') AND o.w * o.h >= 4147 GROUP BY 1, 2, 3""", "layers")


@query("a12_major_groups", sql("holdings layers", """
    , f AS (SELECT page_id, unnest(list_reduce(list([{'o': owner, 'it': coalesce(items, []), 'ri': coalesce(rich, []), 'got': CASE WHEN len(coalesce(items, [])) >= 2 AND len(coalesce(rich, [])) > 0 THEN list_append(items, owner) ELSE [] END}]
        ORDER BY area, owner), lambda acc, x: list_append(acc, {'o': x[1].o, 'it': x[1].it, 'ri': x[1].ri, 'got': CASE
          WHEN len(list_filter(acc, lambda k: list_contains(k.got, x[1].o))) = 0
            AND len(list_filter(x[1].it, lambda i: len(list_filter(acc, lambda k: list_contains(k.got, i))) = 0)) >= 2
            AND len(list_filter(x[1].ri, lambda i: len(list_filter(acc, lambda k: list_contains(k.got, i))) = 0)) > 0
          THEN list_append(list_filter(x[1].it, lambda i: len(list_filter(acc, lambda k: list_contains(k.got, i))) = 0), x[1].o) ELSE [] END}))) AS r FROM holdings GROUP BY page_id)
    SELECT u.page_id, u.owner_id, u.region_id, l.kind FROM (SELECT page_id, r.o AS owner_id, unnest(r.got) AS region_id FROM f) u JOIN layers l ON u.page_id = l.page_id AND u.region_id = l.region_id"""))
def a12(spark, sf_dir):
    return cl.major_groups(fx.layers(spark, sf_dir), 4147)


_PRIO = "CASE {p}.role WHEN 'image_region' THEN 60 WHEN 'surface_region' THEN 50 WHEN 'unknown_region' THEN 45 WHEN 'symbol_region' THEN 30 WHEN 'rect' THEN 10 ELSE 20 END"
fixture("crops", "SELECT page_id, region_id, x, y, w, h, primitive_type AS role, color_count AS z FROM typed_primitives", "typed_primitives")
_SC = "(" + _PRIO + ", {p}.w * {p}.h, {p}.z, {p}.region_id)"
_MARG = "((c.x - p.x >= 3)::INT + (c.y - p.y >= 3)::INT + (p.x + p.w - c.x - c.w >= 3)::INT + (p.y + p.h - c.y - c.h >= 3)::INT)"
fixture("crop_owner", f"""
    SELECT page_id, region_id, coalesce(arg_max(pid, sc) FILTER (same), arg_min(pid, around) FILTER (NOT same)) AS owner_id,
      CASE WHEN bool_or(same) THEN 'same_region_duplicate' ELSE 'internal_fragment_covered_by_component_crop' END AS reason
    FROM (SELECT c.page_id, c.region_id, p.region_id AS pid, {_SC.format(p='p')} AS sc, (p.w * p.h, -({_PRIO.format(p='p')}), p.region_id) AS around, {iou('p', 'c')} >= 0.92 AND {_SC.format(p='p')} > {_SC.format(p='c')} AS same,
        p.w * p.h > c.w * c.h AND p.role <> 'rect' AND p.w * p.h >= c.w * c.h * CASE WHEN p.role = 'image_region' THEN 1.03 ELSE 1.12 END::DOUBLE
          AND p.w * p.h <= 2073600 * CASE p.role WHEN 'image_region' THEN 0.55 WHEN 'surface_region' THEN 0.32 WHEN 'unknown_region' THEN 0.32 WHEN 'symbol_region' THEN 0.18 ELSE 0.12 END
          AND {ioa('c', 'p')} >= 0.9 AND (p.role = 'image_region' OR {_MARG} >= 2) AS parent
      FROM crops c JOIN crops p ON c.page_id = p.page_id AND c.region_id <> p.region_id AND {inter('p', 'c')} > 0) WHERE same OR parent GROUP BY 1, 2""", "crops")


@query("g15_crop_owners", sql("crop_owner", """
    , f AS (SELECT page_id, region_id, owner_id, reason, owner_id AS cur FROM crop_owner UNION ALL SELECT f.page_id, f.region_id, f.owner_id, f.reason, o.owner_id FROM f JOIN crop_owner o ON f.page_id = o.page_id AND f.cur = o.region_id)
    SELECT page_id, region_id, owner_id, reason, cur AS root_id FROM f WHERE (page_id, cur) NOT IN (SELECT page_id, region_id FROM crop_owner)""", recursive=True))
def g15(spark, sf_dir):
    crops = typed_primitives(spark, sf_dir).selectExpr("page_id", "region_id", "x", "y", "w", "h", "primitive_type AS role", "color_count AS z")
    return cl.crop_owners(crops, fx.PAGE_W, fx.PAGE_H)


@query("a31_replaced_parents", sql("regions", f"""
    , p AS (SELECT a.page_id, a.region_id, b.region_id AS id, b.y, b.h, b.score_milli % 2 = 0 AS rep FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.region_id <> b.region_id AND {inside('a', 'b', 3)}
        AND b.w * b.h * 100 < a.w * a.h * 80 WHERE a.copy_no = 3),
    l AS (SELECT page_id, region_id, count(*) AS crops, count(*) FILTER (rep) AS repeated, list_reduce(list([{{'y': y, 'h': h}}] ORDER BY y, id), lambda acc, x:
      CASE WHEN abs(x[1].y - acc[-1].y) >= least(x[1].h, greatest(1, acc[-1].h)) // 2 THEN list_concat(acc, x) ELSE acc END) AS rows FROM p GROUP BY 1, 2)
    SELECT page_id, region_id, crops, len(rows) AS rows, repeated, crops >= 4 AND len(rows) >= 3 AND repeated >= 3 AS replaced FROM l"""))
def a31(spark, sf_dir):
    r = fx.regions(spark, sf_dir)
    return cl.replaced_parents(r.where("copy_no = 3"), r.withColumn("repeated", C("score_milli") % 2 == 0))


_CLASH = (f"({inter('k', X)} > 0 AND ({iou('k', X)} >= 0.72 OR greatest({ioa('k', X)}, {ioa(X, 'k')}) >= 0.82 OR (greatest(abs(k.x + k.w / 2.0 - {X}.x - {X}.w / 2.0) / greatest(1, least(k.w, {X}.w)),"
          f" abs(k.y + k.h / 2.0 - {X}.y - {X}.h / 2.0) / greatest(1, least(k.h, {X}.h))) <= 0.25 AND greatest(abs(k.w - {X}.w) / greatest(k.w, {X}.w)::DOUBLE, abs(k.h - {X}.h) / greatest(k.h, {X}.h)::DOUBLE) <= 0.25"
          f" AND least({ioa('k', X)}, {ioa(X, 'k')}) >= 0.5)))")


@query("g2_promoted_duplicates", sql("regions", f"""
    , c AS (SELECT *, visual_kind AS role FROM regions WHERE kind_no IN (2, 3)),
    k AS ({greedy('c', BOX + ' role score_milli', '-score_milli, region_id', _CLASH)}),
    kept AS (SELECT page_id, r.* FROM k),
    d AS (SELECT l.page_id, l.region_id, o.region_id AS owner_id, o.role = l.role AS same, row_number() OVER (PARTITION BY l.page_id, l.region_id ORDER BY greatest({iou('o', 'l')}, {ioa('o', 'l')}, {ioa('l', 'o')}) DESC, -o.score_milli, o.region_id) AS n
      FROM c l JOIN (SELECT page_id, r.region_id AS region_id, r.x AS x, r.y AS y, r.w AS w, r.h AS h, r.role AS role, r.score_milli AS score_milli FROM k) o ON l.page_id = o.page_id
        AND (-o.score_milli, o.region_id) < (-l.score_milli, l.region_id) AND {_CLASH.replace(X, 'l').replace('k.', 'o.')}
      WHERE (l.page_id, l.region_id) NOT IN (SELECT page_id, r.region_id FROM k))
    SELECT page_id, region_id, owner_id, CASE WHEN same THEN 'duplicate' ELSE 'role_conflict' END AS reason FROM d WHERE n = 1""".replace("kept AS (SELECT page_id, r.* FROM k),", "")))
def g2_promoted(spark, sf_dir):
    items = fx.regions(spark, sf_dir).where("kind_no IN (2, 3)").withColumn("role", C("visual_kind"))
    return cl.promoted_duplicates(items, [(-C("score_milli")).alias("s")])


@query("g16_token_passes", sql("typed_primitives", f"""
    , r AS (SELECT * FROM typed_primitives WHERE primitive_type = 'image_region' AND w * h >= 1036), s AS (SELECT * FROM typed_primitives WHERE primitive_type = 'surface_region'),
    j AS (SELECT p.*, (SELECT arg_min(r.region_id, (-(r.w * r.h), r.region_id)) FROM r WHERE r.page_id = p.page_id AND r.region_id <> p.region_id AND {inside('r', 'p', 3)}) AS rid,
      EXISTS (SELECT 1 FROM s WHERE s.page_id = p.page_id AND s.region_id <> p.region_id AND {inside('s', 'p', 3)}) AS in_surface FROM typed_primitives p),
    t AS (SELECT *, CASE WHEN primitive_type = 'text_region' THEN 'text_token/main' WHEN primitive_type = 'surface_region' THEN 'surface_region_token/main'
      WHEN primitive_type = 'image_region' AND w * h >= 1036 THEN 'raster_region_token/main' WHEN NOT in_surface AND rid IS NOT NULL AND primitive_type NOT IN ('symbol_region', 'rect', 'line') THEN 'texture_fragment_token/suppressed'
      WHEN primitive_type = 'rect' THEN 'layer_background_token/main' WHEN primitive_type = 'line' THEN 'line_token/main' WHEN primitive_type = 'image_region' THEN 'raster_region_token/main'
      WHEN primitive_type = 'symbol_region' THEN 'symbol_cluster_token/main' ELSE 'unknown_token/review' END AS v FROM j)
    SELECT page_id, region_id, split_part(v, '/', 1) AS token, split_part(v, '/', 2) AS disposition, CASE WHEN v LIKE 'texture%' THEN rid END AS raster_id FROM t"""))
def g16(spark, sf_dir):
    return cl.token_passes(typed_primitives(spark, sf_dir), fx.PAGE_W * fx.PAGE_H)
