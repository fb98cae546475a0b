"""Member sets, overlaps of groups, and rows of many centres."""

import random
import time

from pyspark.sql import functions as F

from boxloom.operators import banding
from boxloom.plans import claims, clusters, text

MEMBERS = "page_id bigint, group_id bigint, member_id bigint"


def sets(spark, groups):
    rows = [(p, g, m) for (p, g), ms in groups.items() for m in ms]
    out = clusters.set_classes(spark.createDataFrame(rows, MEMBERS), ["page_id"], "group_id", "member_id")
    return {(r.page_id, r.group_id): (r.set_id, r.set_size) for r in out.collect()}


GROUPS = {(1, 1): [5, 6], (1, 2): [6, 5], (1, 3): [5, 7], (1, 4): [5, 6, 6], (1, 5): [7, 5], (2, 6): [5, 6], (1, 7): [5, 6, 7], (1, 8): [8]}
CLASSES = {(1, 1): (1, 2), (1, 2): (1, 2), (1, 3): (3, 2), (1, 4): (4, 3), (1, 5): (3, 2), (2, 6): (6, 2), (1, 7): (7, 3), (1, 8): (8, 1)}


def test_equal_sets(spark):
    assert sets(spark, GROUPS) == CLASSES
    assert sets(spark, {}) == {}


def test_forged_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(clusters, "set_digest", lambda: [F.count("*").alias("_k_n"), F.lit(0).alias("_k_mix"), F.lit(0).alias("_k_sum")])
    assert sets(spark, GROUPS) == CLASSES


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(3)
    groups = {g: {0} | {rng.randrange(1, 12) for _ in range(rng.randrange(0, 9))} for g in range(60)}
    rows = [(1, g, m) for g, ms in groups.items() for m in ms]
    for floor in (0.5, 0.8, 1.0):
        got = {(r.one, r.two): r.share for r in clusters.member_overlaps(spark.createDataFrame(rows, MEMBERS), floor).collect()}
        want = {(a, b): len(groups[a] & groups[b]) / min(len(groups[a]), len(groups[b])) for a in groups for b in groups if a != b}
        assert got == {k: v for k, v in want.items() if v >= floor}


def test_rows_of_ten_thousand_centres(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.randrange(900), i * 3, 10, rng.choice([1, 9, 40, 200])) for i in range(10000)]
    df = spark.createDataFrame(rows, "page_id bigint, region_id bigint, x bigint, y bigint, w bigint, h bigint")
    start = time.time()
    got = {r.region_id: r.row_no for r in banding.rows_by_centre(df, ["page_id"]).collect()}
    assert time.time() - start < 30
    heads = []
    for b in sorted(rows, key=lambda b: (2 * b[3] + b[5], b[2], b[5])):
        cy = b[3] + b[5] / 2
        at = next((i for i, (hy, hh) in enumerate(heads) if abs(cy - hy) <= max(8, min(hh, b[5]) * 0.42)), len(heads))
        if at == len(heads):
            heads.append((cy, b[5]))
        assert got[b[1]] == at + 1


def test_batch_after_a_full_first_position(spark):
    # seven at y 100: the second batch opens there and reaches from 60 to 360, so the item at 365 opens a third
    rows = [(1, i, i, 100, 10, 300) for i in range(7)] + [(1, 7, 0, 365, 10, 10)]
    df = spark.createDataFrame(rows, "page_id bigint, region_id bigint, x bigint, y bigint, w bigint, h bigint")
    got = {r.region_id: r.batch for r in banding.batches(df, 1920, 5, 300, 40).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 3}


def test_scripts_keep_their_own_size(spark):
    schema = "page_id bigint, region_id bigint, x bigint, y bigint, w bigint, h bigint, font_size int, family string, script string, tone string"
    rows = [(1, i, i * 50, 10, 40, 20, size, "F", script, "blue")
            for i, (size, script) in enumerate([(14, "latin"), (14, "latin"), (15, "latin"), (15, "cjk"), (16, "cjk"), (16, "cjk"), (14, None), (14, None), (13, None)])]
    moved = {r.region_id: r.new_size for r in text.harmonized_sizes(spark.createDataFrame(rows, schema)).collect()}
    assert moved == {2: 14, 3: 16, 8: 14}


def test_controlled_groups_share_no_member(spark):
    rng = random.Random(5)
    groups = {g: {rng.randrange(40) for _ in range(rng.randrange(2, 6))} for g in range(30)}
    rows = [(1, g, m) for g, ms in groups.items() for m in ms]
    info = spark.createDataFrame([(1, g, -len(ms)) for g, ms in groups.items()], "page_id bigint, group_id bigint, s bigint")
    got = [r.group_id for r in claims.controlled_groups(info, spark.createDataFrame(rows, MEMBERS), [F.col("s")], 3).orderBy("position").collect()]
    free, want = set(range(40)), []
    for g in sorted(groups, key=lambda g: (-len(groups[g]), g)):
        if groups[g] <= free:
            want.append(g)
            free -= groups[g]
    assert got == want[:3]
