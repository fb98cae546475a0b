"""Relation edges and their counts."""

from pyspark.sql import functions as F

from boxloom.functions.ladders import PRIMITIVE_TYPE, primitive_type
from boxloom.operators import all_pairs, relations as rel
from boxloom.queries.fixture_sql import even, fixture, gap, inside, inter, up
from boxloom.queries.fixtures import primitives, regions
from boxloom.queries.registry import query, sql
from boxloom.session import cut_lineage

_AREA_A, _AREA_B = "(a.w * a.h)::DOUBLE", "(b.w * b.h)::DOUBLE"
_NEAR = ("least(24, greatest(6, round_even(0.08::DOUBLE * least(greatest(least(a.w, a.h), 8), greatest(least(b.w, b.h), 8)), 0)::BIGINT))")
_ALIGN = "least(12, greatest(2, round_even(0.04::DOUBLE * least(greatest(a.w, a.h), greatest(b.w, b.h)), 0)::BIGINT))"


def _similar(p: str, q: str) -> str:
    return f"(abs({p} - {q}) <= 2 OR abs({p} - {q}) / greatest(1, {p}, {q})::DOUBLE <= 0.08)"


_LABELS = {
    "near": "gap <= near_px",
    "left_of": "a.x + a.w <= b.x", "right_of": "NOT a.x + a.w <= b.x AND b.x + b.w <= a.x",
    "above": "a.y + a.h <= b.y", "below": "NOT a.y + a.h <= b.y AND b.y + b.h <= a.y",
    "aligned_left": "abs(a.x - b.x) <= align_px",
    "aligned_center_x": "abs((a.x + a.w / 2.0) - (b.x + b.w / 2.0)) <= align_px",
    "aligned_right": "abs(a.x + a.w - b.x - b.w) <= align_px",
    "aligned_top": "abs(a.y - b.y) <= align_px",
    "aligned_center_y": "abs((a.y + a.h / 2.0) - (b.y + b.h / 2.0)) <= align_px",
    "aligned_bottom": "abs(a.y + a.h - b.y - b.h) <= align_px",
    "same_width": _similar("a.w", "b.w"), "same_height": _similar("a.h", "b.h"),
    "same_size": _similar("a.w", "b.w") + " AND " + _similar("a.h", "b.h"),
}
_SECONDARY = "list_filter([" + ", ".join(
    f"CASE WHEN {c} THEN '{n}' END" for n, c in _LABELS.items()) + "], lambda s: s IS NOT NULL)"

fixture("edges", f"""
    SELECT a.page_id, a.region_id AS left_id, b.region_id AS right_id,
      CASE WHEN {inter('a', 'b')} / {_AREA_A} >= 0.9 AND {inter('a', 'b')} / {_AREA_B} >= 0.9 THEN 'near_equal'
           WHEN {inter('a', 'b')} / {_AREA_B} >= 0.95 THEN 'contains'
           WHEN {inter('a', 'b')} / {_AREA_A} >= 0.95 THEN 'contained_by'
           WHEN {inter('a', 'b')} > 0 THEN 'overlaps' ELSE 'disjoint' END AS primary_rel,
      {_SECONDARY.replace('near_px', _NEAR).replace('gap <=', gap('a', 'b') + ' <=').replace('align_px', _ALIGN)} AS secondary_rels,
      {inter('a', 'b')} AS shared_area,
      {even(inter('a', 'b') + ' / ' + _AREA_A, 6)} AS left_in_right,
      {even(inter('a', 'b') + ' / ' + _AREA_B, 6)} AS right_in_left,
      {gap('a', 'b')} AS gap, {_NEAR} AS near_px, {_ALIGN} AS align_px
    FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.region_id < b.region_id
    WHERE {gap('a', 'b')} <= {_NEAR}""", "regions")


fixture("all_edges", f"""
    SELECT a.page_id, a.region_id AS left_id, b.region_id AS right_id,
      CASE WHEN {inter('a', 'b')} / {_AREA_A} >= 0.9 AND {inter('a', 'b')} / {_AREA_B} >= 0.9 THEN 'near_equal'
           WHEN {inter('a', 'b')} / {_AREA_B} >= 0.95 THEN 'contains'
           WHEN {inter('a', 'b')} / {_AREA_A} >= 0.95 THEN 'contained_by'
           WHEN {inter('a', 'b')} > 0 THEN 'overlaps' ELSE 'disjoint' END AS primary_rel,
      {_SECONDARY.replace('near_px', _NEAR).replace('gap <=', gap('a', 'b') + ' <=').replace('align_px', _ALIGN)} AS secondary_rels,
      {inter('a', 'b')} AS shared_area,
      {even(inter('a', 'b') + ' / ' + _AREA_A, 6)} AS left_in_right,
      {even(inter('a', 'b') + ' / ' + _AREA_B, 6)} AS right_in_left,
      {gap('a', 'b')} AS gap, {_NEAR} AS near_px, {_ALIGN} AS align_px
    FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.region_id < b.region_id""", "regions")


@query("j4_region_relations", sql("edges", """
    SELECT page_id, left_id, right_id, primary_rel, array_to_string(secondary_rels, ',') AS secondary, shared_area,
      left_in_right, right_in_left, gap, near_px, align_px FROM edges"""))
def j4_region_relations(spark, sf_dir):
    edges = rel.region_relations(regions(spark, sf_dir))
    return edges.select(
        "page_id", "left_id", "right_id", "primary_rel", F.array_join("secondary_rels", ",").alias("secondary"),
        "shared_area", "left_in_right", "right_in_left", "gap", "near_px", "align_px",
    )


@query("j4_page_relation_counts", sql("regions", f"""
    , pairs AS (SELECT a.page_id, {inter('a', 'b')} AS i, a.w * a.h AS aa, b.w * b.h AS ba
      FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.region_id < b.region_id),
    kinds AS (SELECT page_id, CASE WHEN i / aa::DOUBLE >= 0.9 AND i / ba::DOUBLE >= 0.9 THEN 'near_equal'
        WHEN i / ba::DOUBLE >= 0.95 THEN 'contains' WHEN i / aa::DOUBLE >= 0.95 THEN 'contained_by'
        WHEN i > 0 THEN 'overlaps' ELSE 'disjoint' END AS k FROM pairs),
    n AS (SELECT page_id, count(*) AS n_regions FROM regions GROUP BY page_id)
    SELECT n.page_id, n_regions, count(*) FILTER (k = 'near_equal') AS near_equal, count(*) FILTER (k = 'contains') AS contains,
      count(*) FILTER (k = 'contained_by') AS contained_by, count(*) FILTER (k = 'overlaps') AS overlaps,
      count(*) FILTER (k = 'disjoint') AS disjoint
    FROM n LEFT JOIN kinds USING (page_id) GROUP BY n.page_id, n_regions"""))
def j4_page_relation_counts(spark, sf_dir):
    table = regions(spark, sf_dir)
    return rel.page_relation_counts(table, rel.region_relations(table))


def dealt(spark, sf_dir):
    """Boxes dealt out and stored: the given table may be a single split."""
    return cut_lineage(regions(spark, sf_dir).select("page_id", "region_id", *"xywh").repartition("page_id", "region_id"))


@query("j4_page_label_counts", sql("all_edges", """
    SELECT page_id, label, count(*) AS n FROM (SELECT page_id, unnest(secondary_rels) AS label FROM all_edges) GROUP BY 1, 2"""))
def j4_page_label_counts(spark, sf_dir):
    """How many pairs of each page, near or far, each secondary label holds for."""
    table = dealt(spark, sf_dir)
    return all_pairs.secondary_counts(table, rel.region_relations(table))


@query("a3_relation_label_counts", sql("all_edges", """
    SELECT 'primary' AS family, primary_rel AS label, count(*) AS n FROM all_edges GROUP BY 2
    UNION ALL SELECT 'secondary', label, count(*) FROM (SELECT unnest(secondary_rels) AS label FROM all_edges) GROUP BY 2"""))
def a3_relation_label_counts(spark, sf_dir):
    return all_pairs.page_label_counts(regions(spark, sf_dir))


_SHARE = "(area / 2073600.0)"
PRIMITIVE_CASE = f"""CASE WHEN least(w, h) <= 2 AND greatest(w, h) >= 12 THEN {{thin_line}}
  WHEN fill_ratio >= 0.72 AND color_count <= 10 AND edge_density <= 0.18 THEN {{rect}}
  WHEN color_count <= 12 AND edge_density <= 0.22 AND {_SHARE} >= 0.0008 AND least(w, h) >= 18 AND greatest(w, h) <= 220
    THEN {{surface}}
  WHEN {_SHARE} >= 0.004 AND (color_count >= 24 OR edge_density >= 0.22 OR texture_score >= 0.45) THEN {{image}}
  WHEN {_SHARE} <= 0.01 AND greatest(w, h) <= 128 AND fill_ratio >= 0.05 THEN {{symbol}}
  WHEN greatest(w, h) / least(w, h)::DOUBLE >= 8 AND least(w, h) <= 6 THEN {{long_line}} ELSE {{none}} END"""


def primitive_case(values: dict[str, str]) -> str:
    return PRIMITIVE_CASE.format(**values)


fixture("typed_primitives", "SELECT *, CASE WHEN kind_no = 0 THEN 'text_region' ELSE "
        + primitive_case({k: f"'{v}'" for k, v in PRIMITIVE_TYPE.items()}) + " END AS primitive_type FROM primitives",
        "primitives")


def typed_primitives(spark, sf_dir):
    """Primitives with the type ladder applied; text regions stay text."""
    kind = F.when(F.col("kind_no") == 0, "text_region").otherwise(primitive_type(F.lit(1080 * 1920)))
    return primitives(spark, sf_dir).withColumn("primitive_type", kind)


@query("j5_containment_and_text_edges", sql("typed_primitives", f"""
    SELECT a.page_id, a.region_id AS from_id, b.region_id AS to_id,
      CASE WHEN {inside('a', 'b', 2)} AND a.w * a.h > b.w * b.h THEN 'contains_bbox' ELSE 'near_text' END AS kind,
      CASE WHEN {inside('a', 'b', 2)} AND a.w * a.h > b.w * b.h THEN {up(inter('a', 'b') + ' / ' + _AREA_B, 4)} END AS ratio,
      CASE WHEN NOT ({inside('a', 'b', 2)} AND a.w * a.h > b.w * b.h) THEN dist END AS distance
    FROM (SELECT a, b, floor(sqrt((pow(greatest(0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w)), 2)
      + pow(greatest(0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)), 2))::DOUBLE) * 100 + 0.5) / 100 AS dist
      FROM typed_primitives a JOIN typed_primitives b ON a.page_id = b.page_id AND a.region_id <> b.region_id)
    WHERE ({inside('a', 'b', 2)} AND a.w * a.h > b.w * b.h)
      OR (a.primitive_type <> 'text_region' AND b.primitive_type = 'text_region' AND dist <= 12)"""))
def j5_containment_and_text_edges(spark, sf_dir):
    return rel.containment_and_text_edges(typed_primitives(spark, sf_dir))
