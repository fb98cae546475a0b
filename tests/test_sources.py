"""Parsers and writers on hand-made input."""

import pytest
from pyspark.sql import functions as F

from boxloom.functions.hooks import per_cell
from boxloom.functions.text import slug_any
from boxloom.sources import ingest, sinks

PAGES = "project_id bigint, page_index bigint, page_name string, width bigint, height bigint"
SLICES = "project_id bigint, page_index bigint, slice_id bigint, name string, cut_mode string, x bigint, y bigint, w bigint, h bigint"


def test_answers(spark):
    texts = [(1, '{"boxes":[{"x":1,"y":"2","width":3,"height":4,"label":" A "}]}'), (2, '```json\n{"boxes":[]}\n```'), (3, "sorry, no"), (4, '{"boxes":[{"x":1'), (5, '{"items":[]}')]
    rows = ingest.parse_answers(spark.createDataFrame(texts, "id bigint, answer string")).collect()
    by_id = {r.id: r for r in rows}
    assert (by_id[1].x, by_id[1].y, by_id[1].name, by_id[1].error) == (1.0, 2.0, "A", "")
    assert 2 not in by_id
    assert by_id[3].error == by_id[4].error == "json_parse_error"
    assert by_id[5].error == "boxes_missing"


def test_word_tsv_files(spark, tmp_path):
    head = "\t".join(ingest.TSV_COLUMNS)
    (tmp_path / "a.tsv").write_text(head + "\n5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t91\tHello\n4\t1\t1\t1\t1\t0\t10\t20\t30\t8\t-1\t\n5\t1\t1\t1\t1\t2\t50\t20\t0\t8\t91\tx\n")
    rows = ingest.read_word_tsv(spark, str(tmp_path)).collect()
    assert [(r.text, r.left, r.conf) for r in rows] == [("Hello", 10, 91)]


def test_snapshot_replaces_only_given_projects(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "a", 100, 100), (2, 1, "b", 100, 100)], PAGES)
    out = str(tmp_path / "slices")
    sinks.save_slices(spark.createDataFrame([(1, 1, 10, "n", "shape", 95, 5, 50, 2), (2, 1, 20, "n", "card", 0, 0, 10, 10)], SLICES), pages, out)
    sinks.save_slices(spark.createDataFrame([(1, 1, 11, "n", "card", 0, 0, 10, 10)], SLICES), pages, out)
    rows = {(r.project_id, r.slice_id, r.cut_mode) for r in sinks.read_version(spark, out, SLICES).collect()}
    assert rows == {(1, 11, "card"), (2, 20, "card")}
    with pytest.raises(ValueError):
        sinks.save_slices(spark.createDataFrame([(1, 7, 12, "n", "card", 0, 0, 10, 10)], SLICES), pages, out)


def stored(spark, out, version=None):
    return sorted((r.project_id, r.slice_id) for r in sinks.read_version(spark, out, SLICES, version=version).collect())


def some(spark, projects, first):
    return spark.createDataFrame([(p, 1, first + p, "n", "card", 0, 0, 10, 10) for p in projects], SLICES)


def test_versions_with_growing_buckets(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "v")
    assert stored(spark, out) == []
    monkeypatch.setattr(sinks, "ROWS_PER_BUCKET", 10)
    one, two = some(spark, range(15), 100), some(spark, range(3, 5), 500)
    first = sinks.save_version(one, out, given=one)
    assert {e.buckets for e in sinks._stored(spark, out)} == {2}
    sinks.save_version(two, out, given=two)
    want = sorted([(p, 100 + p) for p in range(15) if p not in (3, 4)] + [(3, 503), (4, 504)])
    assert stored(spark, out) == want
    # the old version can still be read, and more rows bring more buckets
    assert stored(spark, out, first) == [(p, 100 + p) for p in range(15)]
    three = some(spark, range(20, 50), 100)
    sinks.save_version(three, out, given=three)
    assert {e.buckets for e in sinks._stored(spark, out)} == {8}
    assert stored(spark, out) == want + [(p, 100 + p) for p in range(20, 50)]
    # only buckets of the given projects are written again
    before = {e.bucket: e.save for e in sinks._stored(spark, out)}
    four = some(spark, [20], 900)
    sinks.save_version(four, out, given=four)
    after = {e.bucket: e.save for e in sinks._stored(spark, out)}
    assert sum(before[b] != after[b] for b in before) == 1
    sinks.save_version(some(spark, [1], 0).limit(0), out, given=spark.range(50).withColumnRenamed("id", "project_id"))
    assert stored(spark, out) == []
    sinks.save_version(one, out, given=one)
    assert len(stored(spark, out)) == 15


def test_failed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "v")
    one = some(spark, range(6), 100)
    sinks.save_version(one, out, given=one)
    deal = sinks._bucketed
    # the rows fail while they are written, after some files are there
    monkeypatch.setattr(sinks, "_bucketed", lambda rows, n: deal(rows, 8).withColumn(
        "name", F.when(F.col("bucket") == F.lit(3), F.raise_error(F.lit("lost"))).otherwise(F.col("name"))))
    with pytest.raises(Exception, match="lost"):
        sinks.save_version(some(spark, range(40), 700), out, given=some(spark, range(40), 700))
    assert stored(spark, out) == [(p, 100 + p) for p in range(6)]
    monkeypatch.undo()
    sinks.write_manifest(one, str(tmp_path / "m"))
    assert sinks.read_version(spark, str(tmp_path / "m"), SLICES, "json").count() == 6


def test_summary_writers(spark, tmp_path):
    sinks.write_summary(spark.createDataFrame([(1, "ok")], "case_id bigint, status string"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "json")).first()["status"] == "ok"
    assert spark.read.option("header", True).csv(str(tmp_path / "s" / "csv")).first()["status"] == "ok"


def test_files_by_content(spark, tmp_path):
    for name, text in (("b", "x"), ("a", "x"), ("c", "y")):
        (tmp_path / name).write_text(text)
    files = ingest.read_files(spark, str(tmp_path))
    rows = {r.path[-1]: (r.canonical[-1], r.copies) for r in ingest.canonical_cases(files, F.col("path"), F.col("content")).collect()}
    assert rows == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1)}


def test_slug_decomposes_only_what_needs_it(spark):
    df = spark.createDataFrame([("  Mein Café #1 ",), ("plain name",)], "t string")
    # the accent becomes a separate mark, which is no letter and joins the run after it
    assert [r[0] for r in df.select(slug_any(F.col("t"))).collect()] == ["Mein-Cafe-1", "plain-name"]


def test_cell_hook_has_one_contract_at_every_size(spark):
    rows = [(1, 10, 10), (1, 4200, 10), (1, 4090, 10), (2, 5, 5)] + [(3, x % 9000, x % 50) for x in range(120_000)]
    df = spark.createDataFrame(rows, "page_id bigint, x bigint, y bigint")

    def sizes(p):
        return p.groupby("page_id", as_index=False).agg(own=("owned", "sum"), seen=("owned", "size"))

    parts = per_cell(df, sizes, "page_id bigint, own bigint, seen bigint", halo=20).groupBy("page_id").sum("own", "seen").collect()
    assert {r["page_id"]: r["sum(own)"] for r in parts} == {1: 3, 2: 1, 3: 120_000}
    assert all(r["sum(seen)"] > r["sum(own)"] for r in parts)



def test_cell_hook_gets_many_whole_cells_at_a_time(spark):
    rows = [(p, x, y) for p in range(200) for x in (1, 5000) for y in (1, 2, 3)]
    df = spark.createDataFrame(rows, "page_id bigint, x bigint, y bigint").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")

    def calls(p):
        sizes = p.groupby(["page_id", "cell_x", "cell_y"]).size()
        return p.iloc[:1].assign(cells=len(sizes), split=int((sizes != 3).sum()))[["cells", "split"]]

    try:
        got = per_cell(df, calls, "cells bigint, split bigint").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sum(r.cells for r in got) == 400 and not any(r.split for r in got) and len(got) < 100
