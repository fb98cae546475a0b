"""Greedy suppression, claims, one-to-one matching and components."""

from pyspark.sql import functions as F

from boxloom.functions import geometry as g
from boxloom.operators import greedy as gr
from boxloom.operators import matching as m
from boxloom.operators.ranking import first_per_group
from boxloom.operators.spatial import near_pairs
from boxloom.plans import acceptance
from boxloom.queries import fixtures as fx
from boxloom.queries.fixture_sql import even, fixture, greedy, inter, ioa, iou
from boxloom.queries.registry import query, sql

C = F.col
BOX = "region_id x y w h"
X = "x[1]"


def kept_sql(name, source, fields, order, pred, where="true"):
    """Statement giving the ids kept by a greedy pass."""
    return sql(source, f", src AS (SELECT * FROM {source} WHERE {where}), k AS ({greedy('src', fields, order, pred)}) "
                       "SELECT page_id, r.region_id AS region_id FROM k")


fixture("clipped", """
    SELECT * REPLACE (greatest(1, least(w, 1080 - x)) AS w, greatest(1, least(h, 1920 - y)) AS h) FROM (
      SELECT * REPLACE (greatest(0, least(x, 1079)) AS x, greatest(0, least(y, 1919)) AS y) FROM detections WHERE w > 0 AND h > 0)""", "detections")


@query("g1_detection_acceptance", sql("clipped slices", f"""
    , o AS (SELECT * FROM clipped WHERE source_kind = 'overview' AND w * h / 2073600.0 BETWEEN 0.01 AND 0.82),
    c AS (SELECT *, CASE source_kind WHEN 'overview' THEN 0 ELSE 1 END AS pass FROM clipped d WHERE w >= 8 AND h >= 8 AND w * h / 2073600.0 <= 0.82
      AND (coalesce(source_kind = 'overview', false) OR NOT EXISTS (SELECT 1 FROM o WHERE o.page_id = d.page_id AND {ioa('d', 'o')} >= 0.72))
      AND NOT EXISTS (SELECT 1 FROM slices s WHERE s.page_id = d.page_id AND {iou('d', 's')} >= 0.6)),
    k AS ({greedy('c', BOX + ' pass', 'pass, region_id', iou('k', X) + ' >= 0.72')}),
    n AS (SELECT page_id, r.region_id AS region_id, r.x AS x, r.y AS y, r.w AS w, r.h AS h, row_number() OVER (PARTITION BY page_id ORDER BY r.pass, r.region_id) AS position FROM k)
    SELECT page_id, region_id, x, y, w, h, position FROM n WHERE position <= 12"""))
def g1(spark, sf_dir):
    return acceptance.accept(fx.detections(spark, sf_dir), fx.slices(spark, sf_dir), fx.PAGE_W, fx.PAGE_H, 12).select(
        "page_id", "region_id", *"xywh", "position")


@query("g1_page_counts", sql("clipped slices", f"""
    , o AS (SELECT * FROM clipped WHERE source_kind = 'overview' AND w * h / 2073600.0 BETWEEN 0.01 AND 0.82),
    c AS (SELECT *, CASE source_kind WHEN 'overview' THEN 0 ELSE 1 END AS pass FROM clipped d WHERE w >= 8 AND h >= 8 AND w * h / 2073600.0 <= 0.82
      AND (coalesce(source_kind = 'overview', false) OR NOT EXISTS (SELECT 1 FROM o WHERE o.page_id = d.page_id AND {ioa('d', 'o')} >= 0.72))
      AND NOT EXISTS (SELECT 1 FROM slices s WHERE s.page_id = d.page_id AND {iou('d', 's')} >= 0.6)),
    k AS ({greedy('c', BOX + ' pass', 'pass, region_id', iou('k', X) + ' >= 0.72')}),
    a AS (SELECT page_id, least(12, count(*)) AS accepted FROM k GROUP BY page_id)
    SELECT d.page_id, coalesce(any_value(a.accepted), 0) AS accepted, count(*) - coalesce(any_value(a.accepted), 0) AS rejected
    FROM clipped d LEFT JOIN a USING (page_id) GROUP BY d.page_id"""))
def g1_counts(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    return acceptance.page_counts(dets, acceptance.accept(dets, fx.slices(spark, sf_dir), fx.PAGE_W, fx.PAGE_H, 12))


@query("g2_confidence_order", kept_sql("", "detections", BOX + " score", "-score, -(w * h), y, x, region_id", iou("k", X) + " > 0.75",
                                       "w >= 4 AND h >= 4 AND w * h >= 64"))
def g2_confidence(spark, sf_dir):
    d = fx.detections(spark, sf_dir).where("w >= 4 AND h >= 4 AND w * h >= 64")
    order = [(-C("score")).alias("s"), (-C("w") * C("h")).alias("a"), C("y"), C("x")]
    return gr.keep_greedily(d, order, lambda k, c: g.iou(k, c) > 0.75).select("page_id", "region_id")


@query("g2_role_scoped", kept_sql("", "detections", BOX + " class_name source_kind score", "class_name, source_kind, -score, region_id",
                                  f"k.class_name = {X}.class_name AND {iou('k', X)} >= 0.75"))
def g2_role(spark, sf_dir):
    d = fx.detections(spark, sf_dir)
    order = [C("class_name"), C("source_kind"), (-C("score")).alias("s")]
    return gr.keep_greedily(d, order, lambda k, c: g.iou(k, c) >= 0.75, ("class_name",),
                            C("a_class_name") == C("b_class_name")).select("page_id", "region_id")


# fixed values: replay priority of a source object
PRIORITY = {"text_replay": 5, "image_replay": 4, "icon_replay": 3, "shape_replay": 2, "preserve_in_parent_raster": 1, "skip": 0}
_PRIO_SQL = "CASE replay_decision " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " END"


@query("g2_action_priority", kept_sql("", "regions", BOX + " replay_decision", f"-({_PRIO_SQL}), y, x, -(w * h), region_id", iou("k", X) + " >= 0.82"))
def g2_priority(spark, sf_dir):
    prio = F.create_map(*[F.lit(v) for kv in PRIORITY.items() for v in kv])[C("replay_decision")]
    order = [(-prio).alias("p"), C("y"), C("x"), (-C("w") * C("h")).alias("a")]
    return gr.keep_greedily(fx.regions(spark, sf_dir), order, lambda k, c: g.iou(k, c) >= 0.82).select("page_id", "region_id")


@query("g2_evidence_fusion", kept_sql("", "detections", BOX + " score class_name", "CASE source_kind WHEN 'overview' THEN 0 ELSE 1 END, -score, region_id",
                                      f"NOT ({X}.w > 260 AND {X}.h > 150) AND {iou('k', X)} > 0.82", "class_name IN ('Image', 'Icon') AND w * h >= 64"))
def g2_fusion(spark, sf_dir):
    """Very large items are always kept (for review) but still rule out later ones."""
    d = fx.detections(spark, sf_dir).where("class_name IN ('Image', 'Icon') AND w * h >= 64")
    order = [F.when(C("source_kind") == "overview", 0).otherwise(1).alias("p"), (-C("score")).alias("s")]
    return gr.keep_greedily(d, order, lambda k, c: (g.iou(k, c) > 0.82) & ~((c.w > 260) & (c.h > 150))).select("page_id", "region_id")


@query("g2_score_order", kept_sql("", "regions", BOX + " score_milli", "-score_milli, -(w * h), region_id",
                                  f"({iou('k', X)} >= 0.6 OR {ioa(X, 'k')} >= 0.82)"))
def g2_score(spark, sf_dir):
    order = [(-C("score_milli")).alias("s"), (-C("w") * C("h")).alias("a")]
    return gr.keep_greedily(fx.regions(spark, sf_dir), order, lambda k, c: (g.iou(k, c) >= 0.6) | (g.share_of(c, k) >= 0.82)
                            ).select("page_id", "region_id")


@query("g2_area_order", kept_sql("", "regions", BOX + " score_milli", "-(w * h), -score_milli, region_id",
                                 f"({iou('k', X)} >= 0.78 OR {ioa(X, 'k')} >= 0.88)"))
def g2_area(spark, sf_dir):
    order = [(-C("w") * C("h")).alias("a"), (-C("score_milli")).alias("s")]
    return gr.keep_greedily(fx.regions(spark, sf_dir), order, lambda k, c: (g.iou(k, c) >= 0.78) | (g.share_of(c, k) >= 0.88)
                            ).select("page_id", "region_id")


def _crop_clash(k, c):
    inside = g.share_of(c, k)
    return (g.iou(k, c) >= 0.92) | (inside >= 0.88) | ((c.area <= k.area * 0.45) & (inside >= 0.72))


_CROP = f"({iou('k', X)} >= 0.92 OR {ioa(X, 'k')} >= 0.88 OR ({X}.w * {X}.h <= k.w * k.h * 0.45::DOUBLE AND {ioa(X, 'k')} >= 0.72))"


@query("g2_top_z_order", sql("layers", f"""
    , k AS ({greedy('layers', BOX + ' z', '-z, region_id', _CROP)}),
    kept AS (SELECT page_id, r.region_id AS region_id, r.x AS x, r.y AS y, r.w AS w, r.h AS h, r.z AS z FROM k),
    d AS (SELECT l.page_id, l.region_id, o.region_id AS owner_id, {iou('o', 'l')} AS i, {ioa('l', 'o')} AS c,
        row_number() OVER (PARTITION BY l.page_id, l.region_id ORDER BY -o.z, o.region_id) AS n
      FROM layers l JOIN kept o ON l.page_id = o.page_id AND (-o.z, o.region_id) < (-l.z, l.region_id) AND {_CROP.replace(X, 'l').replace('k.', 'o.')}
      WHERE (l.page_id, l.region_id) NOT IN (SELECT page_id, region_id FROM kept))
    SELECT page_id, region_id, owner_id, CASE WHEN i >= 0.92 THEN 'same_region_duplicate' WHEN c >= 0.88 THEN 'covered_by_upper_crop'
      ELSE 'nested_duplicate_crop' END AS reason FROM d WHERE n = 1"""))
def g2_top_z(spark, sf_dir):
    """What the topmost-first pass dropped, with the first owner and the reason."""
    layers = fx.layers(spark, sf_dir)
    order = [(-C("z")).alias("z")]
    kept = gr.keep_greedily(layers, order, _crop_clash)
    dropped = layers.join(kept.select("page_id", "region_id"), ["page_id", "region_id"], "left_anti")
    a, b = g.box("a_"), g.box("b_")
    reason = F.when(g.iou(a, b) >= 0.92, "same_region_duplicate").when(g.share_of(b, a) >= 0.88, "covered_by_upper_crop").otherwise(
        "nested_duplicate_crop")
    return gr.first_owner(kept, dropped, order, _crop_clash, values={"reason": reason})


@query("g2_merge_priority", kept_sql("", "regions", BOX + " kind_no", "kind_no, y, x, -(w * h), region_id", iou("k", X) + " >= 0.82"))
def g2_merge(spark, sf_dir):
    order = [C("kind_no"), C("y"), C("x"), (-C("w") * C("h")).alias("a")]
    return gr.keep_greedily(fx.regions(spark, sf_dir), order, lambda k, c: g.iou(k, c) >= 0.82).select("page_id", "region_id")


@query("g10_one_to_one_match", sql("slices layers", f"""
    , p AS (SELECT s.page_id, s.region_id AS left_id, l.region_id AS right_id, {iou('s', 'l')} AS score FROM slices s
      JOIN layers l ON s.page_id = l.page_id AND {iou('s', 'l')} >= 0.5),
    k AS ({greedy('p', 'left_id right_id score', 'left_id, -score, right_id', f'k.left_id = {X}.left_id OR k.right_id = {X}.right_id')})
    SELECT page_id, r.left_id AS left_id, r.right_id AS right_id, r.score AS score FROM k"""))
def g10(spark, sf_dir):
    a, b = g.box("a_"), g.box("b_")
    pairs = near_pairs(fx.slices(spark, sf_dir), fx.layers(spark, sf_dir), g.iou(a, b) >= 0.5)
    return gr.match_one_to_one(pairs.select("page_id", C("a_region_id").alias("left_rank"), C("a_region_id").alias("left_id"),
                                            C("b_region_id").alias("right_id"), g.iou(a, b).alias("score")))


@query("u6_tag_dedupe", sql("det_matches", """
    , t AS (SELECT page_id, detection_id, class_name AS tag, decision, layer_id, score, row_number() OVER (PARTITION BY page_id, class_name, detection_id, decision
      ORDER BY score DESC, layer_id) AS n FROM det_matches)
    SELECT page_id, detection_id, tag, decision, layer_id, score FROM t WHERE n = 1"""))
def u6(spark, sf_dir):
    found = m.detection_layer_matches(fx.detections(spark, sf_dir), fx.layers(spark, sf_dir))
    best = found.groupBy("page_id", "detection_id", C("class_name").alias("tag"), "decision").agg(
        F.max(F.struct("score", (-C("layer_id")).alias("neg"))).alias("m"))
    return best.select("page_id", "detection_id", "tag", "decision", (-C("m.neg")).alias("layer_id"), C("m.score").alias("score"))


@query("u1_overview_and_tiles", sql("detections", """
    SELECT page_id, region_id, source_kind, row_number() OVER (PARTITION BY page_id ORDER BY CASE source_kind WHEN 'overview' THEN 0 ELSE 1 END, region_id)
      AS position FROM detections"""))
def u1(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    both = acceptance.union_in_order(dets.where("source_kind = 'overview'"), dets.where("source_kind = 'tile'"))
    return both.select("page_id", "region_id", "source_kind", "position")
