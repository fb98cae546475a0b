"""Region-shaped inputs derived from the given tables by integer arithmetic.

All of them are map-side projections (plus explode), so deriving them costs no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxloom.operators.spatial import settled

PAGE_W, PAGE_H = 1080, 1920


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its splits follow ``spark.sql.files.maxPartitionBytes``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KIND = {
    "visual_kind": "CASE kind_no WHEN 0 THEN 'editable_ui_text' WHEN 1 THEN 'media_region' WHEN 2 THEN 'raster_icon' "
    "WHEN 3 THEN 'control_background' ELSE CASE WHEN score_milli % 2 = 0 THEN 'preserve_raster_text' ELSE 'unknown' END END",
    "pixel_owner": "CASE kind_no WHEN 0 THEN 'editable_text' WHEN 1 THEN 'preserve_raster' WHEN 2 THEN 'raster_icon' "
    "WHEN 3 THEN 'shape_geometry' ELSE CASE WHEN score_milli % 2 = 0 THEN 'preserve_raster' ELSE 'fallback_only' END END",
    "replay_decision": "CASE kind_no WHEN 0 THEN 'text_replay' WHEN 1 THEN 'image_replay' WHEN 2 THEN 'icon_replay' "
    "WHEN 3 THEN 'shape_replay' ELSE CASE WHEN score_milli % 2 = 0 THEN 'preserve_in_parent_raster' ELSE 'skip' END END",
    "confidence": "CASE returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END",
}

REGION_BASE = [
    "l_orderkey div 5 AS page_id",
    "(((((l_orderkey % 5) * 8 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000) * 64"
    " + CAST(l_quantity AS BIGINT)) * 4 + copy_no AS region_id",
    "12 * ((l_partkey * 37 + l_linenumber * 101) % 75) AS x0",
    "24 * ((l_suppkey * 53 + l_orderkey * 29) % 70) AS y0",
    "8 * (1 + (l_partkey * 11) % 20) AS w0",
    "8 * (1 + (CAST(l_quantity AS BIGINT) * 7) % 12) AS h0",
    "CAST((l_linenumber + copy_no) % 5 AS INT) AS kind_no",
    "(l_partkey * 7 + l_suppkey * 3 + copy_no * 37) % 1000 AS score_milli",
    "l_partkey AS partkey",
    "l_suppkey AS suppkey",
    "l_returnflag AS returnflag",
    "copy_no",
]

# copy 1 nearly equals the source box, copy 2 lies inside it, copy 3 surrounds it
REGION_BOX = [
    "CASE copy_no WHEN 1 THEN x0 + 1 WHEN 2 THEN x0 + 2 WHEN 3 THEN greatest(x0 - 16, 0) ELSE x0 END AS x",
    "CASE copy_no WHEN 2 THEN y0 + 2 WHEN 3 THEN greatest(y0 - 16, 0) ELSE y0 END AS y",
    "CASE copy_no WHEN 2 THEN greatest(w0 - 4, 4) WHEN 3 THEN w0 + 160 ELSE w0 END AS w",
    "CASE copy_no WHEN 2 THEN greatest(h0 - 4, 4) WHEN 3 THEN h0 + 120 ELSE h0 END AS h",
]


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = (
        "explode(CASE (l_partkey + l_linenumber) % 10 WHEN 0 THEN array(0L, 1L) WHEN 5 THEN array(0L, 2L) "
        "WHEN 7 THEN array(0L, 3L) ELSE array(0L) END) AS copy_no"
    )
    # settled, as the joins ask of every box that it is not null, and would work all of it out again for that
    base = settled(table(spark, sf_dir, "lineitem").selectExpr("*", copies).selectExpr(*REGION_BASE))
    return base.selectExpr(
        "page_id", "region_id", *REGION_BOX, "score_milli", "kind_no",
        *[f"{expr} AS {name}" for name, expr in KIND.items()], "partkey", "suppkey", "copy_no",
    )


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).selectExpr(
        "page_id", "region_id", "x", "y", "w", "h", "score_milli AS z", "score_milli % 10 <> 0 AS visible",
        "CASE kind_no WHEN 0 THEN 'text' WHEN 3 THEN 'shape' ELSE 'raster' END AS kind",
        "CASE WHEN suppkey % 3 = 0 THEN NULL ELSE suppkey % 3 END AS group_id",
        "CASE WHEN score_milli % 17 = 0 THEN NULL ELSE concat('asset_', partkey) END AS asset_id",
        "CASE WHEN score_milli % 13 = 0 THEN NULL ELSE replay_decision END AS decision",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).selectExpr(
        "page_id", "region_id", "x + suppkey % 7 AS x", "y", "w", "h", "score_milli / 1000.0D AS score",
        "CASE WHEN copy_no = 3 OR kind_no = 3 THEN 'overview' ELSE 'tile' END AS source_kind",
        "CASE WHEN kind_no = 4 THEN NULL ELSE concat('item ', partkey) END AS name",
        "CASE kind_no WHEN 0 THEN 'Text' WHEN 1 THEN 'Image' WHEN 2 THEN 'Icon' WHEN 3 THEN 'TextButton' ELSE 'Card' END AS class_name",
    )


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes already cut on a page: the high-confidence regions."""
    return regions(spark, sf_dir).where("confidence = 'high'").selectExpr(
        "page_id", "region_id", "x", "y", "w", "h",
        "CASE kind_no WHEN 0 THEN 'rect' WHEN 1 THEN 'subject' WHEN 2 THEN 'shape' ELSE 'card' END AS cut_mode",
    )


def primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).selectExpr(
        "page_id", "region_id", "x", "y", "w", "h", "kind_no", "w * h AS area",
        "(score_milli % 100) / 100.0D AS fill_ratio", "score_milli % 40 AS color_count",
        "(suppkey % 50) / 100.0D AS edge_density",
        "least(1.0D, (suppkey % 50) / 100.0D + (score_milli % 40) / 96.0D) AS texture_score",
    )


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-like regions read as OCR lines."""
    return regions(spark, sf_dir).where("kind_no = 0").selectExpr(
        "page_id", "region_id AS line_id", "x", "y", "w", "h", "score_milli % 101 AS conf",
        "concat('Line ', partkey) AS text",
    )


# characters of documents that are dealt to a task
TASK_CHARS = 4_000_000


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of the documents dealt out by id, so that what is grouped by document later stays where it is."""
    docs = table(spark, sf_dir, "documents")
    chars = docs.agg(F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / TASK_CHARS))
    return docs.select("doc_id", "text").repartition(parts, "doc_id")


def ocr_words(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Every whitespace-separated token of every document, set on a 6-column grid."""
    tokens = (dealt_documents(spark, sf_dir) if dealt else table(spark, sf_dir, "documents")).selectExpr(
        "doc_id AS page_id",
        "posexplode(filter(split(regexp_replace(text, '[ \\\\n\\\\t\\\\r]+', ' '), ' '), t -> t <> '')) AS (pos, text)",
    )
    return tokens.selectExpr(
        "page_id", "CAST(pos AS BIGINT) AS pos", "text",
        "CAST(pos div 24 AS BIGINT) AS block", "0L AS par", "CAST((pos div 6) % 4 AS BIGINT) AS line",
        "CAST(pos % 6 AS BIGINT) AS word",
        "CAST(20 + 90 * (pos % 6) AS BIGINT) AS x", "CAST(30 + 28 * (pos div 6) AS BIGINT) AS y",
        "CAST(least(8 * length(text), 88) AS BIGINT) AS w", "20L AS h",
        "(page_id * 13 + pos * 7) % 100 AS conf",
    )


def trees(spark: SparkSession, sf_dir: str, arity: int = 3) -> DataFrame:
    """One layout tree per document, one node per sentence or line of its text; node 1 is the root."""
    parts = table(spark, sf_dir, "documents").selectExpr("doc_id AS tree_id", "filter(split(text, '[.\\n]+'), s -> trim(s) <> '') AS parts")
    nodes = parts.selectExpr("tree_id", "CAST(size(parts) AS BIGINT) AS n_nodes", "posexplode(parts) AS (pos, part)").selectExpr(
        "tree_id", "n_nodes", "pos + 1L AS node_id", "CAST(length(part) AS BIGINT) AS size"
    )
    return nodes.selectExpr(
        "tree_id", "node_id",
        f"CASE WHEN node_id = 1 THEN NULL ELSE (node_id - 2) div {arity} + 1 END AS parent_id",
        f"CASE WHEN node_id = 1 THEN 0L ELSE (node_id - 2) % {arity} END AS ord",
        f"CASE WHEN {arity} * (node_id - 1) + 2 <= n_nodes THEN 'frame' WHEN size % 2 = 0 "
        "THEN 'text' ELSE 'image' END AS type",
        "12 * ((size * 7 + node_id * 37) % 75) AS x", "24 * ((size * 5 + node_id * 29) % 70) AS y",
        "8 * (1 + (node_id * 11 + size) % 20) AS w", "8 * (1 + (node_id * 7 + size) % 12) AS h",
    )


def style_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees(spark, sf_dir).selectExpr(
        "*",
        "CASE WHEN (tree_id + node_id) % 11 = 0 THEN 'red' WHEN (tree_id + node_id) % 5 = 0 "
        "THEN concat(' #', lpad(lower(hex(((node_id * 7919) % 12) * 1381653)), 6, '0')) "
        "ELSE concat('#', lpad(hex(((node_id * 7919) % 12) * 1381653), 6, '0')) END AS fill",
        "CASE WHEN type = 'text' THEN concat('#', lpad(hex((tree_id % 7) * 2236962), 6, '0')) END AS color",
        "CASE WHEN type = 'text' AND node_id % 4 <> 0 THEN 10 + 2 * (tree_id % 5) END AS font_size",
        "CASE WHEN type = 'text' AND node_id % 3 = 0 THEN 700L WHEN type = 'text' THEN 400L END AS font_weight",
        "CASE WHEN type = 'text' THEN concat('Family', tree_id % 2) END AS font_family",
        "CASE WHEN node_id % 6 = 0 THEN NULL ELSE (node_id % 4) * 4.5D END AS radius",
        "CASE WHEN node_id % 6 = 0 THEN array((tree_id % 3) * 2.5D, 4.0D, -1.0D, (node_id % 2) * 8.0D) END AS corners",
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS project_id", "o_custkey AS user_id", "concat('Project ', o_orderkey) AS name",
        "o_orderdate AS updated_at",
    )


def catalog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per (order, line number)."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").count().selectExpr(
        "l_orderkey AS project_id", "CAST(l_linenumber AS BIGINT) AS page_index",
        "concat('page_', lpad(l_linenumber, 3, '0')) AS page_name",
        "400 + 16 * (l_orderkey % 9) + 8L * l_linenumber AS width",
        "600 + 20 * (l_orderkey % 7) + 10L * l_linenumber AS height", "count AS n_lines",
    )


def catalog_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS project_id", "CAST(l_linenumber AS BIGINT) AS page_index",
        "(l_partkey * 1000 + l_suppkey % 1000) * 64 + CAST(l_quantity AS BIGINT) AS slice_id",
        "CASE WHEN l_returnflag = 'R' THEN concat('Hero ', l_partkey) ELSE concat('slice_', lpad(CAST(l_partkey % 1000 AS STRING), greatest(2, length(CAST(l_partkey % 1000 AS STRING))), '0')) END AS name",
        "CASE l_returnflag WHEN 'A' THEN 'rect' WHEN 'N' THEN 'subject' ELSE 'card' END AS cut_mode",
        "12 * (l_partkey % 75) AS x", "24 * (l_suppkey % 70) AS y",
        "8 * (1 + l_partkey % 20) AS w", "8 * (1 + CAST(l_quantity AS BIGINT) % 12) AS h",
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id AS job_id", "ts", "value",
        "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' "
        "WHEN 'error' THEN 'failed' ELSE 'canceled' END AS status",
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation case per document, with its label where there is one."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").selectExpr(
        "doc_id AS case_id", "lang", "source",
        "CASE WHEN toxic = 1 THEN 'failed' WHEN n_chars % 23 = 0 THEN 'skipped' ELSE 'completed' END AS status",
        "n_chars % 97 AS visible", "n_chars % 13 AS conflicts", "doc_id % 5 AS missing", "n_chars % 41 AS nodes",
        "n_chars % 29 AS text_blocks", "doc_id % 19 AS fallbacks", "n_chars * 7 % 1000 AS elapsed_ms",
        "coalesce(quality, 0) AS quality",
    )
