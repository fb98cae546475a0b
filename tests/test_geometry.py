"""Box arithmetic and relation labels on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from boxloom.functions import geometry as g
from boxloom.operators import relations as rel


def lit_box(values):
    return g.Box(*[F.lit(v) for v in values])


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a, b, label, shared", [
    ([0, 0, 30, 30], [20, 0, 30, 30], "overlaps", 300),
    ([0, 0, 30, 30], [1, 0, 30, 30], "near_equal", 870),
    ([0, 0, 100, 100], [10, 10, 20, 20], "contains", 400),
    ([10, 10, 20, 20], [0, 0, 100, 100], "contained_by", 400),
    ([0, 0, 10, 10], [50, 0, 10, 10], "disjoint", 0),
    # equal boxes are near equal before they are contained
    ([0, 0, 10, 10], [0, 0, 10, 10], "near_equal", 100),
])
def test_primary_relation(spark, a, b, label, shared):
    assert one(spark, rel.primary_relation(lit_box(a), lit_box(b))) == label
    assert one(spark, g.overlap(lit_box(a), lit_box(b))) == shared


def test_secondary_relations_are_exclusive_per_axis(spark):
    labels = one(spark, rel.secondary_relations(lit_box([0, 0, 30, 30]), lit_box([34, 1, 30, 30])))
    assert labels[0] == "near" and "left_of" in labels and "right_of" not in labels
    assert {"aligned_top", "same_size"} <= set(labels)


def test_tighter_options_drop_labels(spark):
    a, b = lit_box([0, 0, 30, 30]), lit_box([34, 1, 30, 30])
    tight = rel.RelationOptions(near_base=1, near_max=1, align_base=0, align_max=0)
    labels = one(spark, rel.secondary_relations(a, b, tight))
    assert "near" not in labels and "aligned_top" not in labels


@pytest.mark.parametrize("value, up, even", [(2.5, 3, 2.0), (-2.5, -2, -2.0), (3.5, 4, 4.0), (0.49, 0, 0.0)])
def test_rounding_rules(spark, value, up, even):
    assert one(spark, g.half_up(F.lit(value))) == up
    assert one(spark, g.half_even(F.lit(value))) == even


def test_clamp_prefers_low_when_bounds_cross(spark):
    assert one(spark, g.clamp(F.lit(50), 10, 5)) == 10


def test_normalize_keeps_box_on_page(spark):
    b = g.normalize(lit_box([-5.4, 1918.2, 2000.0, 0.2]), 1080, 1920, 8)
    assert [one(spark, c) for c in b] == [0, 1912, 1080, 8]


def test_distance_and_gap(spark):
    a, b = lit_box([0, 0, 10, 10]), lit_box([13, 14, 5, 5])
    assert one(spark, g.gap(a, b)) == 4
    assert one(spark, g.distance(a, b)) == 5.0
