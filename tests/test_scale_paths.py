"""The paths for very large pages must give what the ordinary ones give, however the input is partitioned."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window, functions as F

from boxloom.functions import geometry as g
from boxloom.functions.geometry import Box
from boxloom.operators import all_pairs, banding, greedy, ranking, spatial
from boxloom.operators.graph import components

C = F.col


def boxes(n, pages=2, seed=3, span=900):
    """A skewed set: nine of ten boxes are on page 0."""
    r = random.Random(seed)
    return [(0 if r.random() < 0.9 else 1 + r.randrange(pages), i, r.randrange(span), r.randrange(span), 4 + r.randrange(150), 4 + r.randrange(90), r.randrange(50))
            for i in range(n)]


SCHEMA = "page_id bigint, region_id bigint, x bigint, y bigint, w bigint, h bigint, score bigint"


def py_inter(a, b):
    return max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))


def py_iou(a, b):
    i = py_inter(a, b)
    return i / (a[4] * a[5] + b[4] * b[5] - i) if i else 0.0


def py_gap(a, b):
    return max(0, max(a[2], b[2]) - min(a[2] + a[4], b[2] + b[4]), max(a[3], b[3]) - min(a[3] + a[5], b[3] + b[5]))


@pytest.mark.parametrize("margin, cell", [(0, 256), (24, 256), (24, 32), (84, 512)])
def test_grid_join_equals_brute_force(spark, margin, cell):
    rows = boxes(160)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.page_id, r.a_region_id, r.b_region_id) for r in spatial.self_pairs(df, margin=margin, cell=cell).collect()}
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and py_gap(a, b) <= margin}
    assert got == want


def py_greedy(rows, limit):
    kept = []
    for row in sorted(rows, key=lambda b: (-b[6], b[1])):
        if not any(k[0] == row[0] and py_iou(k, row) > limit for k in kept):
            kept.append(row)
    return {k[1] for k in kept}


@pytest.mark.parametrize("span", [4096, 120, 25])
def test_cells_agree_with_sequential_greedy(spark, span):
    rows = boxes(220, span=300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = greedy.keep_greedily(df, [(-C("score")).alias("s")], lambda k, c: g.iou(k, c) > 0.2, span=span)
    assert {r.region_id for r in kept.collect()} == py_greedy(rows, 0.2)


def test_a_chain_of_ten_thousand_conflicts(spark, monkeypatch):
    cuts, original = [], greedy.cut_lineage
    monkeypatch.setattr(greedy, "cut_lineage", lambda df: cuts.append(1) or original(df))
    items = spark.range(10_000).select(F.lit(1).cast("bigint").alias("page_id"), C("id").alias("region_id"), (C("id") * 6).alias("x"), F.lit(0).cast("bigint").alias("y"),
                                       F.lit(10).cast("bigint").alias("w"), F.lit(10).cast("bigint").alias("h"))
    kept = greedy.keep_greedily(items, [C("region_id").alias("o")], lambda k, c: g.overlap(k, c) > 0)
    assert kept.count() == 5000 and kept.where("region_id % 2 = 1").isEmpty()
    # one round for each of the 15 cells that the chain runs through at most
    assert len(cuts) <= 2 * 16


def test_one_to_one_matching(spark):
    r = random.Random(5)
    pairs = [(0, a, a, b, round(r.random(), 3)) for a in range(12) for b in range(12) if r.random() < 0.4]
    df = spark.createDataFrame(pairs, "page_id bigint, left_rank bigint, left_id bigint, right_id bigint, score double")
    got = {(x.left_id, x.right_id) for x in greedy.match_one_to_one(df).collect()}
    used, want = set(), set()
    for a in range(12):
        free = sorted((-s, b) for _, _, l, b, s in pairs if l == a and b not in used)
        if free:
            used.add(free[0][1])
            want.add((a, free[0][1]))
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = [(0, i, i + 1) for i in range(300)] + [(1, 5, 6), (0, 900, 901)]
    out = components(spark.createDataFrame(edges, "page_id bigint, left_id bigint, right_id bigint").repartition(4)).collect()
    assert {r.component for r in out if r.page_id == 0 and r.id <= 300} == {0}
    assert {r.component for r in out if r.id in (900, 901)} == {900}
    assert {r.component for r in out if r.page_id == 1} == {5}


def test_row_numbers_match_a_plain_window(spark):
    rows = boxes(150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    order = [C("y"), C("x"), C("region_id")]
    got = {(r.page_id, r.region_id): r.n for r in ranking.row_numbers(df, ["page_id"], order, "n").collect()}
    for page in {r[0] for r in rows}:
        for i, row in enumerate(sorted((b for b in rows if b[0] == page), key=lambda b: (b[3], b[2], b[1])), 1):
            assert got[(page, row[1])] == i


def test_following_crosses_slots(spark):
    rows = boxes(90)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.page_id, r.region_id): r.next_region_id for r in ranking.following(
        df, ["page_id"], F.floor(C("x") / 40), [C("x"), C("region_id")], ["region_id"]).collect()}
    for page in {r[0] for r in rows}:
        line = [b[1] for b in sorted((b for b in rows if b[0] == page), key=lambda b: (b[2], b[1]))]
        assert [got[(page, i)] for i in line] == line[1:] + [None]


def test_rows_by_centre_equal_first_fit(spark):
    rows = boxes(120, span=400)
    got = {(r.page_id, r.region_id): r.row_no for r in banding.rows_by_centre(spark.createDataFrame(rows, SCHEMA).repartition(4), ["page_id"]).collect()}
    for page in {r[0] for r in rows}:
        heads = []
        for b in sorted((b for b in rows if b[0] == page), key=lambda b: (2 * b[3] + b[5], b[2], b[5], b[1])):
            cy = b[3] + b[5] / 2
            for i, (hy, hh) in enumerate(heads):
                if abs(cy - hy) <= max(8, min(hh, b[5]) * 0.42):
                    break
            else:
                heads.append((cy, b[5]))
                i = len(heads) - 1
            assert got[(page, b[1])] == i + 1


def test_batches_equal_a_sequential_pass(spark):
    rows = boxes(140, span=1200)
    got = {(r.page_id, r.region_id): r.batch for r in banding.batches(spark.createDataFrame(rows, SCHEMA), 1920, 7, 300, 40).collect()}
    for page in {r[0] for r in rows}:
        batch, count, end, bottom = 0, 0, None, None
        for b in sorted((b for b in rows if b[0] == page), key=lambda b: (b[3], b[2], b[1])):
            new_band = bottom is None or b[3] - bottom >= max(96, min(180, b[5] * 2))
            if new_band:
                batch, count, end = batch + 1, 0, min(1920, b[3] + 300)
            elif (b[3] >= end and count) or count >= 7:
                batch, count, end = batch + 1, 0, min(1920, max(0, b[3] - 40) + 300)
            count += 1
            bottom = b[3] + b[5] if bottom is None else max(bottom, b[3] + b[5])
            assert got[(page, b[1])] == batch


def plain_labels(a, b):
    """Labels of a pair by plain arithmetic; a has the lower id."""
    (_, _, ax, ay, aw, ah, _), (_, _, bx, by, bw, bh, _) = a, b
    slack = min(12, max(2, round(0.04 * min(max(aw, ah), max(bw, bh)))))

    def alike(p, q):
        return abs(p - q) <= 2 or abs(p - q) / max(1, p, q) <= 0.08

    out = set()
    if ax + aw <= bx or bx + bw <= ax:
        out.add("left_of" if ax + aw <= bx else "right_of")
    if ay + ah <= by or by + bh <= ay:
        out.add("above" if ay + ah <= by else "below")
    for name, p, q in (("aligned_left", ax, bx), ("aligned_center_x", ax + aw / 2, bx + bw / 2), ("aligned_right", ax + aw, bx + bw),
                       ("aligned_top", ay, by), ("aligned_center_y", ay + ah / 2, by + bh / 2), ("aligned_bottom", ay + ah, by + bh)):
        if abs(p - q) <= slack:
            out.add(name)
    out |= {n for n, ok in (("same_width", alike(aw, bw)), ("same_height", alike(ah, bh)), ("same_size", alike(aw, bw) and alike(ah, bh))) if ok}
    return out


def groups_of(links):
    lowest = {}
    for a, b in links:
        for k in (a, b):
            lowest.setdefault(k, k)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(lowest[a], lowest[b])
            changed |= lowest[a] != low or lowest[b] != low
            lowest[a] = lowest[b] = low
    return lowest


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_and_links_at_any_distance_equal_all_pairs(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(all_pairs, "BLOCK", 4)
    rows = boxes(170, span=1500, seed=seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pairs = [(a, b, plain_labels(a, b)) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]]
    want = Counter((a[0], label) for a, b, labels in pairs for label in labels)
    counted = all_pairs.alignment_counts(df).unionByName(all_pairs.size_counts(df)).unionByName(all_pairs.flow_counts(df))
    assert {(r.page_id, r.label): r.n for r in counted.collect()} == want
    every = all_pairs.secondary_counts(df, df.select("page_id").limit(0))
    assert {(r.page_id, r.label): r.n for r in every.collect()} == want
    flow, shape = {"left_of", "right_of", "above", "below"}, {"aligned_left", "aligned_center_x", "aligned_right", "aligned_top", "aligned_center_y", "aligned_bottom", "same_width", "same_height"}
    # fewer boxes that overlap much, so that the links matter
    for page in {r[0] for r in rows}:
        edges = [(a[1], b[1]) for a, b, labels in pairs if a[0] == page and labels & flow and labels & shape]
        links = [(r.left_id, r.right_id) for r in all_pairs.aligned_links(df.where(C("page_id") == page)).collect()]
        assert set(links) <= set(edges) and groups_of(links) == groups_of(edges)


def test_a_row_of_distant_boxes_is_one_group(spark):
    rows = [(1, i, 400 * i, 100, 40 + 30 * i, 20, 0) for i in range(8)] + [(1, 50, 9000, 5000, 7, 333, 0)]
    got = {(r.id, r.component) for r in components(all_pairs.aligned_links(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {(i, 0) for i in range(8)}


def test_overlapping_aligned_boxes_meet_through_others(spark):
    # boxes 0 and 1 lie on each other, 2 and 3 too, far below; every one is linked through the other side
    rows = [(1, 0, 10, 0, 50, 50, 0), (1, 1, 10, 10, 90, 77, 0), (1, 2, 10, 500, 60, 41, 0), (1, 3, 10, 520, 31, 99, 0)]
    got = {(r.id, r.component) for r in components(all_pairs.aligned_links(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {(i, 0) for i in range(4)}


def test_kinds_over_blocks_equal_all_pairs(spark):
    rows = boxes(200, span=1500, seed=5)
    numbered = all_pairs.in_blocks(spark.createDataFrame(rows, SCHEMA).repartition(3), ["page_id"])
    kind = F.when(F.abs(C("a_x") - C("b_x")) <= 9, "line").when(F.pmod(C("a_y") + C("b_y"), F.lit(97)) == 0, "odd").otherwise("rest")
    got = {(r.page_id, r.kind, r.id): r.component for r in all_pairs.kind_components(numbered, kind, "kind").collect()}
    want = {}
    for page in {r[0] for r in rows}:
        links = {}
        for a in rows:
            for b in rows:
                if a[0] == b[0] == page and a[1] < b[1]:
                    k = "line" if abs(a[2] - b[2]) <= 9 else "odd" if (a[3] + b[3]) % 97 == 0 else "rest"
                    links.setdefault(k, []).append((a[1], b[1]))
        want |= {(page, k, i): c for k, ls in links.items() for i, c in groups_of(ls).items()}
    assert got == want


def test_ranks_of_a_skewed_page_are_dealt_out(spark):
    df = spark.range(40_000).select(F.when(C("id") % 10 == 0, C("id")).otherwise(-1).alias("page_id"), F.pmod(C("id") * 7919, F.lit(40_009)).alias("v"))
    ranked = ranking.row_numbers(df, ["page_id"], [C("v")], "n")
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("v")))
    assert ranked.exceptAll(plain).isEmpty() and plain.exceptAll(ranked).isEmpty()
    # the range partitions cut the page that holds nine tenths of the rows
    per_task = [len(p) for p in df.repartitionByRange(8, "page_id", "v").rdd.glom().collect()]
    assert max(per_task) < 3 * sorted(per_task)[len(per_task) // 2]
