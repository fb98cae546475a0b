"""Suppression of layers that repeat what others show."""

from pyspark.sql import functions as F

from boxloom.plans import repetition as rp
from boxloom.plans import structural as st
from boxloom.queries import fixtures as fx
from boxloom.queries.fixture_sql import even, fixture, ioa
from boxloom.queries.matching_q import near_dup
from boxloom.queries.registry import query, sql

C = F.col

# boxes around others become large rasters, many of them nested; a part covers the page
_LARGE = {
    "w": "1000 + partkey % 81", "x": "(1080 - (1000 + partkey % 81)) div 2", "h": "740 + 20 * (suppkey * 7 % 60)", "y": "(1920 - (740 + 20 * (suppkey * 7 % 60))) div 2",
}
_COLUMNS = ["page_id", "region_id", *[f"CASE WHEN copy_no = 3 THEN {_LARGE[c]} ELSE {c} END AS {c}" for c in "xywh"], "score_milli AS z", "score_milli % 10 <> 0 AS visible",
            "CASE WHEN copy_no = 3 OR kind_no IN (1, 2) AND score_milli % 3 = 0 THEN 'raster' WHEN kind_no IN (1, 2, 3) THEN 'shape' ELSE 'text' END AS kind",
            "CASE WHEN score_milli % 17 = 0 THEN NULL ELSE concat('asset_', partkey) END AS asset_id"]
# of the small layers of two pages in three only one in seven stays, so that single rasters decide
_KEPT = "copy_no = 3 OR page_id % 3 = 0 OR partkey % 7 = 0"
fixture("stacked", f"SELECT {', '.join(_COLUMNS)} FROM regions WHERE {_KEPT}".replace(" div ", " // "), "regions")


def stacked(spark, sf_dir):
    return fx.regions(spark, sf_dir).where(_KEPT).selectExpr(*_COLUMNS)


_IN = f"b.w * b.h * 100 < a.w * a.h * 92 AND {ioa('b', 'a')} >= 0.92"
fixture("page_rasters", f"""
    SELECT a.page_id, a.region_id, a.x = 0 AND a.w * a.h >= 0.98 * 2073600 AS whole, count(b.region_id) AS n, count(b.region_id) FILTER (b.kind = 'raster') AS r,
      count(b.region_id) FILTER (b.kind = 'text') AS t, coalesce(list(b.region_id) FILTER (b.kind = 'raster' AND b.region_id < a.region_id), []) AS earlier
    FROM (SELECT * FROM stacked WHERE visible AND kind = 'raster' AND (w * h * 100 >= 2073600 * 72 OR (w * 100 >= 1080 * 92 AND h * 100 >= 1920 * 50))) a
    LEFT JOIN (SELECT * FROM stacked WHERE visible) b ON a.page_id = b.page_id AND {_IN} GROUP BY ALL""".replace("a.x = 0 AND a.w * a.h >= 0.98 * 2073600", "a.w * a.h / 2073600.0 >= 0.98"), "stacked")
fixture("structural", """
    SELECT page_id, unnest(list_reduce(list_prepend([]::BIGINT[], list([region_id] ORDER BY region_id)), lambda gone, x: CASE WHEN
      len(list_filter(rows, lambda q: q.region_id = x[1] AND (q.whole OR q.n - len(list_intersect(q.earlier, gone)) >= 3 OR q.r - len(list_intersect(q.earlier, gone)) >= 2
        OR (q.t >= 2 AND q.n - len(list_intersect(q.earlier, gone)) >= 2)))) > 0 THEN list_concat(gone, x) ELSE gone END)) AS region_id
    FROM (SELECT *, list({'region_id': region_id, 'whole': whole, 'n': n, 'r': r, 't': t, 'earlier': earlier}) OVER (PARTITION BY page_id) AS rows FROM page_rasters) GROUP BY page_id, rows""", "page_rasters")
fixture("stack_shown", "SELECT * FROM stacked WHERE visible AND (page_id, region_id) NOT IN (SELECT page_id, region_id FROM structural)", "stacked structural")
fixture("stack_covered", f"""
    SELECT s.page_id, s.region_id, min(r.region_id) AS owner_id FROM stack_shown s JOIN stack_shown r ON s.page_id = r.page_id
    WHERE s.kind = 'shape' AND r.kind = 'raster' AND r.z > s.z AND r.w * r.h >= s.w * s.h AND {ioa('s', 'r')} >= 0.98 GROUP BY 1, 2""", "stack_shown")
fixture("stack_rest", "SELECT * FROM stack_shown WHERE kind = 'shape' AND (page_id, region_id) NOT IN (SELECT page_id, region_id FROM stack_covered)", "stack_shown stack_covered")
fixture("stack_kept", f"""
    SELECT page_id, unnest(list_reduce(list([{{'region_id': region_id, 'x': x, 'y': y, 'w': w, 'h': h}}] ORDER BY region_id), lambda acc, x: CASE WHEN
      len(list_filter(acc, lambda k: {near_dup('k', 'x[1]')})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM stack_rest GROUP BY page_id""", "stack_rest")
fixture("stack_gone", f"""
    SELECT page_id, region_id, '{st.STRUCTURAL}' AS reason, NULL::BIGINT AS owner_id FROM structural
    UNION ALL SELECT page_id, region_id, '{st.COVERED}', owner_id FROM stack_covered
    UNION ALL SELECT r.page_id, r.region_id, '{st.REPEATED}', min(k.k.region_id) FROM stack_rest r JOIN stack_kept k ON r.page_id = k.page_id AND k.k.region_id < r.region_id AND {near_dup('k.k', 'r')}
      WHERE (r.page_id, r.region_id) NOT IN (SELECT page_id, k.region_id FROM stack_kept) GROUP BY 1, 2""", "structural stack_covered stack_rest stack_kept")


@query("g13_structural_rasters", sql("structural", "SELECT page_id, region_id FROM structural"))
def g13_rasters(spark, sf_dir):
    return st.structural_rasters(stacked(spark, sf_dir), fx.PAGE_W, fx.PAGE_H)


@query("g13_suppressed_layers", sql("stack_gone", "SELECT page_id, region_id, reason, owner_id FROM stack_gone"))
def g13_layers(spark, sf_dir):
    """Structural rasters, covered shapes and repeated shapes, one pass after another."""
    return st.page_suppressed_layers(stacked(spark, sf_dir), fx.PAGE_W, fx.PAGE_H)


@query("g13_remaining_assets", sql("stacked structural", """
    SELECT DISTINCT page_id, asset_id FROM stacked WHERE asset_id IS NOT NULL
    EXCEPT SELECT page_id, asset_id FROM stacked JOIN structural USING (page_id, region_id)"""))
def g13_assets(spark, sf_dir):
    layers = stacked(spark, sf_dir)
    gone = st.structural_rasters(layers, fx.PAGE_W, fx.PAGE_H).withColumn("reason", F.lit(st.STRUCTURAL))
    return st.assets_without(layers, gone)


# candidates inside media: three media a page, icons roughly in rows
_CONF = "CASE WHEN {d} = 'rejected_fragment' THEN 'low' WHEN {s} >= 0.68 AND anchor >= 0.45 THEN 'high' WHEN {s} >= 0.45 OR anchor >= 0.35 THEN 'medium' ELSE 'low' END"
_ICON = ["page_id", "region_id", "partkey % 3 AS media_id", "x", "100 + 90 * (partkey % 3) + score_milli % 9 AS y", "w", "h",
         "CASE WHEN kind_no = 4 THEN 'status_dot_candidate' ELSE 'internal_icon_candidate' END AS role", "CASE WHEN score_milli % 7 = 0 THEN 'rejected_fragment' ELSE 'accepted_report_candidate' END AS decision",
         "CASE WHEN suppkey % 5 = 0 THEN NULL ELSE suppkey END AS ocr_id", "score_milli / 1000.0D AS score", "(suppkey % 100) / 100.0D AS anchor"]
fixture("icons", f"SELECT *, {_CONF.format(d='decision', s='score')} AS confidence FROM (SELECT {', '.join(_ICON).replace('0D AS', '0::DOUBLE AS')} FROM regions)", "regions")
_COUNTS = "decision = 'accepted_report_candidate' AND role = 'internal_icon_candidate' AND ocr_id IS NOT NULL"
fixture("repetition", f"""
    SELECT page_id, media_id, {even('(level + evenness) / 2', 3)} AS repetition FROM (
      SELECT page_id, media_id, {even('greatest(0::DOUBLE, 1 - (max(y + h / 2.0) - min(y + h / 2.0)) / greatest(1::DOUBLE, list_sort(list(h))[count(*) // 2 + 1] * 1.5::DOUBLE))', 3)} AS level,
        CASE WHEN count(*) = 2 THEN 0.65::DOUBLE WHEN avg(g) <= 0 THEN 0 ELSE {even('greatest(0::DOUBLE, 1 - sqrt(((count(g) * sum(g * g) - sum(g) * sum(g)))::DOUBLE) / sum(g)::DOUBLE)', 3)} END AS evenness
      FROM (SELECT *, lead(2 * x + w) OVER (PARTITION BY page_id, media_id ORDER BY 2 * x + w, region_id) - 2 * x - w AS g FROM icons WHERE {_COUNTS}) GROUP BY 1, 2 HAVING count(*) >= 2)""", "icons")


@query("w10_repetition_boost", sql("icons repetition", f"""
    , r AS (SELECT i.*, CASE WHEN {_COUNTS} THEN p.repetition END AS repetition FROM icons i LEFT JOIN repetition p USING (page_id, media_id)),
    n AS (SELECT *, CASE WHEN repetition IS NULL THEN score ELSE {even('least(1::DOUBLE, score + repetition * 0.12::DOUBLE)', 3)} END AS raised FROM r)
    SELECT page_id, region_id, repetition, raised AS score, CASE WHEN repetition IS NULL THEN confidence ELSE {_CONF.format(d='decision', s='raised')} END AS confidence,
      coalesce(repetition >= 0.55 AND confidence IN ('high', 'medium'), false) AS supported FROM n"""))
def w10(spark, sf_dir):
    """Icons of a medium gain by how evenly they stand in a row."""
    icons = fx.regions(spark, sf_dir).selectExpr(*_ICON).withColumn("confidence", rp.anchored_confidence(C("score"), C("anchor"), C("decision")))
    return rp.with_repetition(icons).select("page_id", "region_id", "repetition", "score", "confidence", "supported")
