"""Relation edges between the regions of a page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from boxloom.functions.geometry import Box, box, contains, distance, gap, half_even, half_up, overlap
from boxloom.operators.spatial import near_pairs, self_pairs, settled


@dataclass(frozen=True)
class RelationOptions:
    """Fixed default thresholds of the relation kernel."""

    near_equal: float = 0.90
    contained: float = 0.95
    near_base: int = 6
    near_max: int = 24
    near_scale: float = 0.08
    thin_side: int = 8
    align_base: int = 2
    align_max: int = 12
    align_scale: float = 0.04
    size_abs: int = 2
    size_ratio: float = 0.08


SECONDARY_LABELS = (
    "near", "left_of", "right_of", "above", "below", "aligned_left", "aligned_center_x", "aligned_right",
    "aligned_top", "aligned_center_y", "aligned_bottom", "same_width", "same_height", "same_size",
)


def primary_relation(a: Box, b: Box, o: RelationOptions = RelationOptions(), shared: Column | None = None) -> Column:
    """near_equal, contains, contained_by, overlaps or disjoint; the first that holds.  ``shared`` is the overlap where it is known."""
    shared = overlap(a, b) if shared is None else shared
    a_in_b, b_in_a = shared / a.area, shared / b.area
    return (
        F.when((a_in_b >= o.near_equal) & (b_in_a >= o.near_equal), "near_equal")
        .when(b_in_a >= o.contained, "contains")
        .when(a_in_b >= o.contained, "contained_by")
        .when(shared > 0, "overlaps")
        .otherwise("disjoint")
    )


def near_threshold(a: Box, b: Box, o: RelationOptions = RelationOptions()) -> Column:
    """Pixel distance under which two boxes count as near; follows the shorter sides."""
    def short(r: Box) -> Column:
        return F.greatest(F.least(r.w, r.h), F.lit(o.thin_side))

    scaled = F.rint(F.lit(o.near_scale) * F.least(short(a), short(b))).cast("bigint")
    return F.least(F.lit(o.near_max), F.greatest(F.lit(o.near_base), scaled))


def align_threshold(a: Box, b: Box, o: RelationOptions = RelationOptions()) -> Column:
    """Pixel slack for alignment; follows the longer sides."""
    longest = F.least(F.greatest(a.w, a.h), F.greatest(b.w, b.h))
    scaled = F.rint(F.lit(o.align_scale) * longest).cast("bigint")
    return F.least(F.lit(o.align_max), F.greatest(F.lit(o.align_base), scaled))


def _similar(p: Column, q: Column, o: RelationOptions) -> Column:
    diff = F.abs(p - q)
    return (diff <= o.size_abs) | (diff / F.greatest(F.lit(1), F.greatest(p, q)) <= o.size_ratio)


def secondary_conditions(a: Box, b: Box, o: RelationOptions = RelationOptions()) -> dict[str, Column]:
    """The condition of each geometric label, in the fixed label order."""
    slack = align_threshold(a, b, o)
    left, above = a.x2 <= b.x, a.y2 <= b.y
    same_w, same_h = _similar(a.w, b.w, o), _similar(a.h, b.h, o)
    holds = (
        gap(a, b) <= near_threshold(a, b, o),
        left, ~left & (b.x2 <= a.x), above, ~above & (b.y2 <= a.y),
        F.abs(a.x - b.x) <= slack, F.abs(a.cx - b.cx) <= slack, F.abs(a.x2 - b.x2) <= slack,
        F.abs(a.y - b.y) <= slack, F.abs(a.cy - b.cy) <= slack, F.abs(a.y2 - b.y2) <= slack,
        same_w, same_h, same_w & same_h,
    )
    return dict(zip(SECONDARY_LABELS, holds))


def secondary_relations(a: Box, b: Box, o: RelationOptions = RelationOptions()) -> Column:
    """All geometric labels that hold, in the fixed label order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in secondary_conditions(a, b, o).items()]))


def region_relations(regions: DataFrame, options: RelationOptions = RelationOptions(),
                     carry: tuple[str, ...] = ()) -> DataFrame:
    """Edges between regions of a page that touch or are near each other.

    Disjoint boxes further apart than the near threshold get no row: their number is the page's pair
    count less the edges here (``page_relation_counts``), and a page with n regions never yields n^2
    rows.  ``carry`` names region columns to bring along as ``a_*`` and ``b_*``.
    """
    slim = regions.select("page_id", "region_id", "x", "y", "w", "h", *carry)
    a, b = box("a_"), box("b_")
    pairs = self_pairs(slim, gap(a, b) <= near_threshold(a, b, options), margin=options.near_max)
    shared = F.col("_shared")
    # filters on the relation then read a value
    pairs = settled(settled(pairs.withColumn("_shared", overlap(a, b))).withColumn("_relation", primary_relation(a, b, options, shared)))
    return pairs.select(
        "page_id",
        F.col("a_region_id").alias("left_id"),
        F.col("b_region_id").alias("right_id"),
        F.col("_relation").alias("primary_rel"),
        secondary_relations(a, b, options).alias("secondary_rels"),
        shared.alias("shared_area"),
        half_even(shared / a.area, 6).alias("left_in_right"),
        half_even(shared / b.area, 6).alias("right_in_left"),
        gap(a, b).alias("gap"),
        near_threshold(a, b, options).alias("near_px"),
        align_threshold(a, b, options).alias("align_px"),
        *[F.col(p + c) for c in ("x", "y", "w", "h", *carry) for p in ("a_", "b_")],
    )


def page_relation_counts(regions: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of each primary kind per page; the disjoint count includes pairs that have no edge row."""
    kinds = ("near_equal", "contains", "contained_by", "overlaps")
    found = edges.groupBy("page_id").agg(
        *[F.count(F.when(F.col("primary_rel") == k, 1)).alias(k) for k in kinds]
    )
    sizes = regions.groupBy("page_id").agg(F.count("*").alias("n_regions"))
    met = sum((F.coalesce(F.col(k), F.lit(0)) for k in kinds[1:]), F.coalesce(F.col(kinds[0]), F.lit(0)))
    return sizes.join(found, "page_id", "left").select(
        "page_id", "n_regions",
        *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in kinds],
        (F.col("n_regions") * (F.col("n_regions") - 1) / 2 - met).cast("bigint").alias("disjoint"),
    )


def containment_and_text_edges(primitives: DataFrame, tolerance: int = 2, reach: int = 12) -> DataFrame:
    """Directed edges: a larger box around another, or a non-text box near a text box."""
    a, b = box("a_"), box("b_")
    slim = primitives.select("page_id", "region_id", "x", "y", "w", "h", "primitive_type")
    holds = contains(a, b, tolerance) & (a.area > b.area)
    text = (F.col("a_primitive_type") != "text_region") & (F.col("b_primitive_type") == "text_region")
    near = text & (distance(a, b) <= reach)
    pairs = near_pairs(slim, slim, (F.col("a_region_id") != F.col("b_region_id")) & (holds | near), margin=reach, spread=True)
    return pairs.select(
        "page_id",
        F.col("a_region_id").alias("from_id"),
        F.col("b_region_id").alias("to_id"),
        F.when(holds, "contains_bbox").otherwise("near_text").alias("kind"),
        F.when(holds, half_up(overlap(a, b) / b.area, 4)).alias("ratio"),
        F.when(~holds, distance(a, b)).alias("distance"),
    )
