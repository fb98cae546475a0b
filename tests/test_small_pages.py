"""Small pages are joined and ranked in one piece, with the results of large ones."""

import random

from boxloom.operators import ranking, spatial
from boxloom.operators.tree import walk
from boxloom.plans import claims
from boxloom.plans import replay as rp
from tests.test_evidence_plan import ROWS, SCHEMA as EVIDENCE
from tests.test_spread import SCHEMA, boxes, touching


def test_rows_of_small_pages_are_sent_once(spark):
    rows = boxes(random.Random(3), 60, 1, 0) + boxes(random.Random(4), 60, 2, 100)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = spatial.self_pairs(df, margin=24)
    assert {(r.a_region_id, r.b_region_id) for r in pairs.collect()} == {p for p in touching(rows, rows, 24) if p[0] < p[1]}
    # no copies for cells
    assert "sequence(" not in pairs._jdf.queryExecution().toString()


def test_small_and_large_pages_together(spark, monkeypatch):
    monkeypatch.setattr(spatial, "WHOLE", 20)
    monkeypatch.setattr(spatial, "DENSE", 10)
    rng = random.Random(7)
    one = [b for page, n in enumerate((1, 15, 40, 30)) for b in boxes(rng, n, page, 100 * page)]
    two = [b for page, n in enumerate((50, 18, 10, 30)) for b in boxes(rng, n, page, 100 * page)]
    got = spatial.near_pairs(spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA), margin=24, spread=True)
    found = [tuple(r) for r in got.select("a_region_id", "b_region_id").collect()]
    assert len(found) == len(set(found)) and set(found) == touching(one, two, 24)


def test_plan_of_large_pages(spark, monkeypatch):
    objects = spark.createDataFrame(ROWS, EVIDENCE)
    plain = sorted(map(str, rp.replay_plan(objects, 2).collect()))
    monkeypatch.setattr(ranking, "GROUP", 3)
    assert sorted(map(str, rp.replay_plan(objects, 2).collect())) == plain


def test_holds_are_the_directed_edges_to_media(spark):
    objects = rp.with_actions(spark.createDataFrame(ROWS, EVIDENCE))
    edges = sorted(map(str, rp.judged_targets(rp.object_edges(objects), objects).collect()))
    assert sorted(map(str, rp.judged_holds(rp.media_holds(objects), objects).collect())) == edges and edges


def test_crops_that_stay_are_not_walked(spark, monkeypatch):
    rows = [(1, 1, 0, 0, 200, 200), (1, 2, 20, 20, 100, 100), (1, 3, 20, 20, 100, 101), (1, 4, 600, 600, 30, 30)]
    layers = spark.createDataFrame([(*r, "image_region", 0) for r in rows], SCHEMA + ", role string, z int")
    walked = []
    monkeypatch.setattr(claims, "walk", lambda nodes, **kw: walked.append(nodes.count()) or walk(nodes, **kw))
    got = {(r.region_id, r.owner_id, r.root_id) for r in claims.crop_owners(layers, 1080, 1920).collect()}
    assert got == {(2, 3, 1), (3, 1, 1)} and walked == [3]
