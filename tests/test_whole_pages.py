"""Pages that a task takes whole give what pages spread over tasks give, and their rows are sent once."""

import random

import numpy as np
import pytest

from boxloom.operators import whole_pages as wp
from boxloom.plans import clusters as cl
from boxloom.queries import QUERIES
from boxloom.queries.ladders_q import acted

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["a10_layout_energy", "a8_sibling_groups", "g7_motif_components", "g8_sibling_components", "u3_layout_subjects", "a9_cluster_scores", "g12_clusters"])
def test_rows_are_sent_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Aggregate" not in plan and "LogicalRDD" not in plan


@pytest.mark.parametrize("of_pages", [cl.page_motifs, cl.page_clusters, cl.page_siblings, cl.page_sibling_groups, cl.page_subjects, cl.page_energies])
def test_small_pages_agree_with_spread_ones(spark, monkeypatch, of_pages):
    objects = acted(spark, SF).where("page_id < 5").localCheckpoint()

    def rows():
        df = of_pages(objects)
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())

    whole = rows()
    monkeypatch.setattr(wp, "PAGE_ROWS", 25)
    assert whole and rows() == whole


def test_odd_pages_are_left_to_the_spread_operators(spark):
    rows = [(1, 1, 0, 0, 8, 8), (1, 2, 9, 0, 8, 8), (2, 3, 0, 0, 8, 8), (2, 4, 0, None, 8, 8), (3, 5, 0, 0, 0, 8), (None, 6, 0, 0, 8, 8)]
    df = spark.createDataFrame(rows, "page_id long, region_id long, x long, y long, w long, h long")
    small, others = wp.whole_pages(df, [*"xywh"])
    assert {r.page_id for r in small.collect()} == {1} and {r.page_id for r in others.collect()} == {2, 3}
    assert wp.whole_pages(df.where("page_id = 1"), [])[1] is None


def test_batches_are_cut_between_pages(spark, monkeypatch):
    monkeypatch.setattr(wp, "BATCH_ROWS", 10)
    monkeypatch.setattr(wp, "BATCH_PAIRS", 30)
    df = spark.range(500).selectExpr("id div 7 AS page_id", "id AS region_id", "1L AS x", "1L AS y", "1L AS w", "1L AS h")
    small, _ = wp.whole_pages(df, [*"xywh"])

    def sizes(rows, starts):
        import pyarrow as pa
        yield pa.RecordBatch.from_pydict({"page_id": rows["page_id"][starts], "n": np.diff(np.r_[starts, rows["page_id"].size])})

    got = [tuple(r) for r in wp.in_tasks(small, sizes, "page_id bigint, n bigint").collect()]
    assert sorted(got) == [(p, 7 if p < 71 else 3) for p in range(72)]


def test_lowest_reached():
    rng = random.Random(5)
    for n, k in ((1, 0), (10, 8), (200, 150), (200, 400)):
        links = [sorted(rng.sample(range(n), 2)) for _ in range(k)]
        want = list(range(n))
        while True:
            new = list(want)
            for a, b in links:
                new[a] = new[b] = min(new[a], new[b])
            if new == want:
                break
            want = new
        one, two = (np.array([p[i] for p in links], int) for i in (0, 1))
        assert wp.lowest_reached(n, one, two).tolist() == want


def test_tracks_pass_the_tolerance_of_the_last_start():
    from boxloom.plans.page_groups import _tracks

    value, group = np.array([5, 9, 10, 30, 0, 100, 7]), np.array([0, 0, 0, 0, 1, 1, 2])
    assert _tracks(value, group, np.array([0, 4, 6]), np.array([4.9, 100.0, 4.0])).tolist() == [3, 1, 1]


def test_words_are_grouped_where_their_document_is(spark):
    plan = QUERIES["src3_parse_ocr_arrays"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1


@pytest.mark.parametrize("name, rows", [("a3_relation_label_counts", 1), ("w8_bounded_batches", 0), ("w9_regular_spacing", 0), ("a27_harmonized_sizes", 0)])
def test_rows_of_counts_and_rows_are_sent_once(spark, name, rows):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and plan.count("Aggregate") == rows and "LogicalRDD" not in plan


@pytest.mark.parametrize("name", ["a3_relation_label_counts", "w8_bounded_batches", "w9_regular_spacing", "a27_harmonized_sizes"])
def test_queries_agree_where_all_pages_are_spread(spark, monkeypatch, name):
    whole = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(wp, "PAGE_ROWS", 20)
    assert sorted(map(tuple, QUERIES[name](spark, SF).collect())) == whole


def test_sizes_that_are_not_known(spark):
    from boxloom.plans import text

    rows = [(1, k, 10 * k, 0, 8, 8, size, "F", None, "neutral") for k, size in enumerate((12, 12, 13, None, 40))]
    rows += [(2, k, 10 * k, 0, 8, 8, size, "F", "latin", "neutral") for k, size in enumerate((None, None, 13, 14))]
    df = spark.createDataFrame(rows, "page_id long, region_id long, x long, y long, w long, h long, font_size long, family string, script string, tone string")
    assert [tuple(r) for r in text.page_harmonized_sizes(df).collect()] == [tuple(r) for r in text.harmonized_sizes(df).collect()] == [(1, 2, 13, 12)]


@pytest.mark.parametrize("name", ["g14_controlled_groups", "u5_uncertain_objects", "u4_duplicate_clusters"])
def test_groups_are_made_and_accepted_where_their_page_is(spark, monkeypatch, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1
    whole = sorted(map(tuple, df.collect()))
    monkeypatch.setattr(wp, "PAGE_ROWS", 25)
    assert sorted(map(tuple, QUERIES[name](spark, SF).collect())) == whole


def test_layers_are_suppressed_where_their_page_is(spark, monkeypatch):
    df = QUERIES["g13_suppressed_layers"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "LogicalRDD" not in plan
    whole = sorted(map(str, df.collect()))
    monkeypatch.setattr(wp, "PAGE_ROWS", 9)
    assert len({r.reason for r in df.collect()}) == 3 and sorted(map(str, QUERIES["g13_suppressed_layers"](spark, SF).collect())) == whole
