"""Registered queries against their SQL on the smallest scale."""

import os

import pytest

import __spark_entry__ as entry_module
from tests.check import compare, duck

SF = "/root/testdata/sf0.001"
QUICK = ["j4_region_relations", "j5_containment_and_text_edges", "p13_primitive_ladder", "g2_confidence_order", "g10_one_to_one_match", "j8_smallest_parent",
         "a1_project_counts", "w4_grid_positions", "src9_flatten_tree", "a20_grouping_quality", "g6_connected_components", "g11_replay_plan", "w8_bounded_batches", "st1_job_outcomes",
         "a12_major_groups", "r1_background", "src2_parse_model_answers", "g1_detection_acceptance", "a3_relation_label_counts", "u5_uncertain_objects", "snk3_case_summary", "x2_page_hook",
         "q4_ownership_report", "j26_overlap_conflicts", "g7_motif_components", "g8_sibling_components"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(entry_module.queries()) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_equals_sql(spark, con, name):
    text, _, _, ok = compare(spark, con, name, entry_module.queries()[name], entry_module.oracle_sql().get(name), SF)
    assert ok, text


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
