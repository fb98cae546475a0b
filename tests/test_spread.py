"""Rectangle joins on dense spots and under giant rectangles."""

import random

from pyspark.sql import functions as F

from boxloom.functions.geometry import box
from boxloom.operators import spatial

SCHEMA = "page_id bigint, region_id bigint, x bigint, y bigint, w bigint, h bigint"


def touching(one, two, margin):
    """Pairs of ids by brute force."""
    return {(a[1], b[1]) for a in one for b in two if a[0] == b[0] and a[2] - margin <= b[2] + b[4] and b[2] <= a[2] + a[4] + margin
            and a[3] - margin <= b[3] + b[5] and b[3] <= a[3] + a[5] + margin}


def boxes(rng, n, page, start):
    return [(page, start + i, rng.randrange(40000), rng.randrange(40000), rng.choice([5, 300, 3000, 30000]), rng.choice([5, 300, 3000, 30000])) for i in range(n)]


def test_levels_and_salts_give_all_pairs_once(spark, monkeypatch):
    monkeypatch.setattr(spatial, "DENSE", 10)
    rng = random.Random(5)
    one = boxes(rng, 150, 1, 0) + boxes(rng, 5, 2, 200) + [(3, 300 + i, 7, 7, 3, 3) for i in range(45)] + [(4, 400, 0, 0, 99999, 99999)]
    two = boxes(rng, 120, 1, 0) + boxes(rng, 30, 2, 200) + [(3, 300 + i, 9, 9, 3, 3) for i in range(64)] + [(4, 400 + i, 900 * i, 70, 5, 5) for i in range(50)]
    for margin in (0, 24):
        got = spatial.near_pairs(spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA), margin=margin, spread=True)
        rows = [tuple(r) for r in got.select("a_region_id", "b_region_id").collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == touching(one, two, margin)
    assert not any(c.startswith("_") for c in got.columns)


def test_work_of_a_key_is_bounded(spark, monkeypatch):
    """A spot with 3,000 boxes a side and a box over the whole of a giant page: rows a key, and copies of the box."""
    monkeypatch.setattr(spatial, "DENSE", 100)
    spot = spark.range(3000).select(F.lit(1).cast("bigint").alias("page_id"), F.col("id").alias("region_id"), *[F.lit(9).cast("bigint").alias(c) for c in "xywh"])
    page = spark.createDataFrame([(2, -1, 0, 0, 100000, 100000)], SCHEMA)
    df = spatial.prefixed(spot.unionAll(page), "a_", ("page_id",))
    a = box("a_")
    plan = spatial.spread_plan(df, spatial.prefixed(spot.unionAll(page), "b_", ("page_id",)), a, box("b_"), 0, "page_id", spatial.CELL)
    rows = spatial._salted(df, a, 0, "page_id", spatial.CELL, True, plan)
    per_key = rows.groupBy("page_id", *spatial._CELL, "_sa", "_sb").count()
    assert per_key.agg(F.max("count")).first()[0] <= 200
    assert rows.where("a_region_id = -1").count() <= (100000 // (spatial.CELL * spatial.COARSE) + 1) ** 2


def test_empty_sides(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 1, 0, 0, 5, 5)], SCHEMA)
    assert spatial.near_pairs(none, some, spread=True).count() == spatial.near_pairs(some, none, spread=True).count() == 0
