"""Catalog scans, nesting, renumbering, retention and integrity."""

from pyspark.sql import functions as F

from boxloom.operators.ranking import first_per_group, row_numbers
from boxloom.plans import catalog as cat
from boxloom.queries import fixtures as fx
from boxloom.queries.fixture_sql import fixture
from boxloom.queries.fixtures import table
from boxloom.queries.registry import query, sql

C = F.col
PAGE = ["project_id", "page_index"]


@query("src1_catalog_scan", sql("projects", "SELECT * FROM projects WHERE updated_at >= TIMESTAMP '1997-01-01'"))
def src1(spark, sf_dir):
    from boxloom.sources.catalog import scan

    rows = scan(spark, f"{sf_dir}/orders.parquet", "o_orderdate >= TIMESTAMP '1997-01-01'",
                ["o_orderkey", "o_custkey", "o_orderdate"])
    return rows.selectExpr("o_orderkey AS project_id", "o_custkey AS user_id", "concat('Project ', o_orderkey) AS name",
                           "o_orderdate AS updated_at")


@query("j1_project_cards", sql("projects catalog_pages", """
    , f AS (SELECT project_id, arg_min(page_name, page_index) AS page_name, min(page_index) AS page_index FROM catalog_pages GROUP BY project_id)
    SELECT p.*, f.page_index AS first_page_index, f.page_name AS first_page_name FROM projects p LEFT JOIN f USING (project_id)"""))
def j1(spark, sf_dir):
    return cat.project_cards(fx.projects(spark, sf_dir), fx.catalog_pages(spark, sf_dir))


_POS = "row_number() OVER (PARTITION BY project_id, page_index ORDER BY slice_id, x, y, w, h, name)"
_DEFAULT = "CASE WHEN regexp_matches(trim(name), '^slice_[0-9]+$') THEN concat('slice_', lpad(position::VARCHAR, greatest(2, length(position::VARCHAR))::INT, '0')) ELSE name END"
fixture("named_slices", f"SELECT * REPLACE ({_DEFAULT} AS name) FROM (SELECT *, {_POS} AS position FROM catalog_slices)", "catalog_slices")


@query("j2_project_detail", sql("projects catalog_pages named_slices", """
    SELECT p.project_id, p.name AS project_name, g.page_index, g.page_name, s.position, s.slice_id, s.name
    FROM projects p LEFT JOIN catalog_pages g USING (project_id) LEFT JOIN named_slices s ON g.project_id = s.project_id AND g.page_index = s.page_index"""))
def j2(spark, sf_dir):
    projects = fx.projects(spark, sf_dir).withColumnRenamed("name", "project_name")
    detail = cat.project_detail(projects, fx.catalog_pages(spark, sf_dir), cat.default_names(cat.slice_positions(fx.catalog_slices(spark, sf_dir))))
    return detail.select("project_id", "project_name", "page_index", "page_name", "position", "slice_id", "name")


@query("j2_nested_pages", sql("named_slices", """
    SELECT project_id, page_index, (position - 1) // 2 AS part, count(*) AS n, string_agg(name, '|' ORDER BY position) AS names FROM named_slices GROUP BY 1, 2, 3"""))
def j2_nested(spark, sf_dir):
    named = cat.default_names(cat.slice_positions(fx.catalog_slices(spark, sf_dir))).withColumn("filename", F.lit(None).cast("string"))
    nested = cat.nested_pages(named, 2)
    return nested.select(*PAGE, "part", F.size("slices").cast("bigint").alias("n"), F.array_join("slices.name", "|").alias("names"))


@query("j3_active_sessions", sql("", """
    SELECT event_id AS session_id, user_id, c_mktsegment AS segment FROM events JOIN customer ON user_id = c_custkey
    WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20' AND c_acctbal > 0"""))
def j3(spark, sf_dir):
    sessions = table(spark, sf_dir, "events").selectExpr("event_id AS session_id", "user_id", "ts + INTERVAL 7 DAYS AS expires_at")
    users = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id", "c_mktsegment AS segment", "CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'disabled' END AS status")
    return cat.active_sessions(sessions, users, F.lit("2024-01-20").cast("timestamp")).select("session_id", "user_id", "segment")


@query("a1_project_counts", sql("projects catalog_pages catalog_slices", """
    SELECT project_id, coalesce(p.n, 0) AS page_count, coalesce(s.n, 0) AS slice_count FROM projects
    LEFT JOIN (SELECT project_id, count(*) AS n FROM catalog_pages GROUP BY 1) p USING (project_id)
    LEFT JOIN (SELECT project_id, count(*) AS n FROM catalog_slices GROUP BY 1) s USING (project_id)"""))
def a1(spark, sf_dir):
    return cat.counts_per_project(*[f(spark, sf_dir) for f in (fx.projects, fx.catalog_pages, fx.catalog_slices)])


@query("w1_reindex_pages", sql("catalog_pages", """
    SELECT project_id, page_index, row_number() OVER (PARTITION BY project_id ORDER BY page_index) AS new_index FROM catalog_pages WHERE n_lines = 1"""))
def w1(spark, sf_dir):
    return cat.reindexed_pages(fx.catalog_pages(spark, sf_dir).where("n_lines = 1")).select("project_id", "page_index", "new_index")


@query("w1_default_names", sql("named_slices", "SELECT project_id, page_index, slice_id, position, name FROM named_slices"))
def w1_names(spark, sf_dir):
    return cat.default_names(cat.slice_positions(fx.catalog_slices(spark, sf_dir))).select(*PAGE, "slice_id", "position", "name")


@query("w2_next_page_number", sql("catalog_pages", """
    SELECT project_id, coalesce(max(CASE WHEN regexp_matches(page_name, '^page_[0-9]+$') THEN regexp_extract(page_name, '([0-9]+)$', 1)::BIGINT END), 0) + 1
      AS next_number FROM catalog_pages GROUP BY project_id"""))
def w2(spark, sf_dir):
    return cat.next_page_number(fx.catalog_pages(spark, sf_dir))


@query("w3_frame_positions", sql("catalog_pages", """
    SELECT project_id, page_index, coalesce(sum(width + 160) OVER (PARTITION BY project_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS frame_x FROM catalog_pages"""))
def w3(spark, sf_dir):
    return cat.frame_positions(fx.catalog_pages(spark, sf_dir)).select("project_id", "page_index", "frame_x")


@query("w4_grid_positions", sql("catalog_pages", """
    , r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY page_index) - 1 AS i FROM catalog_pages),
    f AS (SELECT project_id, CASE WHEN width >= height OR width / height::DOUBLE >= 0.85 THEN 2 ELSE 5 END AS columns FROM r WHERE i = 0),
    c AS (SELECT r.*, f.columns, i % f.columns AS col, i // f.columns AS row FROM r JOIN f USING (project_id)),
    xs AS (SELECT project_id, col, coalesce(sum(max(width) + 200) OVER (PARTITION BY project_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gx
      FROM c GROUP BY project_id, col),
    ys AS (SELECT project_id, row, coalesce(sum(max(height) + 200) OVER (PARTITION BY project_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gy
      FROM c GROUP BY project_id, row)
    SELECT c.project_id, c.page_index, gx AS grid_x, gy AS grid_y FROM c JOIN xs USING (project_id, col) JOIN ys USING (project_id, row)"""))
def w4(spark, sf_dir):
    return cat.grid_positions(fx.catalog_pages(spark, sf_dir)).select("project_id", "page_index", "grid_x", "grid_y")


@query("w11_paint_order", sql("text_lines slices", """
    , u AS (SELECT DISTINCT page_id, 0 AS k, 'remainder' AS kind, 0 AS ref_id FROM (SELECT page_id FROM text_lines UNION ALL SELECT page_id FROM slices)
      UNION ALL SELECT page_id, 1, 'text', line_id FROM text_lines UNION ALL SELECT page_id, 2, 'slice', region_id FROM slices)
    SELECT page_id, kind, ref_id, row_number() OVER (PARTITION BY page_id ORDER BY k, ref_id) AS paint_order FROM u"""))
def w11(spark, sf_dir):
    return cat.paint_order(fx.PAGE_W, fx.PAGE_H, fx.text_lines(spark, sf_dir), fx.slices(spark, sf_dir)).select(
        "page_id", "kind", "ref_id", "paint_order")


@query("w12_latest_version", sql("job_events", """
    , r AS (SELECT *, row_number() OVER (PARTITION BY job_id, status ORDER BY ts DESC, event_id DESC) AS n FROM job_events)
    SELECT job_id, status, event_id, ts FROM r WHERE n = 1"""))
def w12(spark, sf_dir):
    return cat.latest(fx.job_events(spark, sf_dir), ["job_id", "status"], F.struct("ts", "event_id"), ["event_id", "ts"])


@query("t1_projects_by_recency", sql("projects", """
    SELECT user_id, project_id, updated_at, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, project_id) AS position FROM projects"""))
def t1(spark, sf_dir):
    ranked = row_numbers(fx.projects(spark, sf_dir), ["user_id"], [-F.unix_micros(C("updated_at").cast("timestamp")), C("project_id")], "position")
    return ranked.select("user_id", "project_id", "updated_at", "position")


@query("t2_reading_order", sql("regions", """
    SELECT page_id, region_id, row_number() OVER (PARTITION BY page_id ORDER BY y, x, region_id) AS position FROM regions"""))
def t2(spark, sf_dir):
    ranked = row_numbers(fx.regions(spark, sf_dir), ["page_id"], [C("y"), C("x"), C("region_id")], "position")
    return ranked.select("page_id", "region_id", "position")


@query("t4_capped_rejections", sql("layers", """
    , r AS (SELECT page_id, region_id, kind, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN kind = 'raster' THEN 0 ELSE 1 END, region_id) AS position
      FROM layers WHERE NOT visible OR decision IS NULL)
    SELECT * FROM r WHERE position <= 3"""))
def t4(spark, sf_dir):
    rejected = fx.layers(spark, sf_dir).where("NOT visible OR decision IS NULL")
    order = [F.when(C("kind") == "raster", 0).otherwise(1), C("region_id")]
    return first_per_group(rejected, ["page_id"], order, 3, "position").select("page_id", "region_id", "kind", "position")


def jobs(spark, sf_dir):
    """One row per export job: its last event."""
    last = cat.latest(fx.job_events(spark, sf_dir), ["job_id"], F.struct("ts", "event_id"), ["status", "ts"])
    return last.withColumnRenamed("ts", "updated_at")


fixture("jobs", "SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at FROM job_events GROUP BY job_id", "job_events")


@query("t5_job_retention", sql("jobs", """
    , r AS (SELECT *, row_number() OVER (ORDER BY updated_at, job_id) AS age_rank FROM jobs WHERE status IN ('succeeded', 'failed', 'canceled'))
    SELECT job_id, status, age_rank FROM r WHERE age_rank <= (SELECT greatest(0, count(*) - 100) FROM jobs)"""))
def t5(spark, sf_dir):
    return cat.expired_jobs(jobs(spark, sf_dir), 100).select("job_id", "status", "age_rank")


@query("u7_page_order_check", sql("catalog_pages", """
    , w AS (SELECT project_id, CASE WHEN n_lines > 2 THEN page_index + 1 ELSE page_index END AS page_index FROM catalog_pages WHERE height % 37 <> 0),
    b AS (SELECT project_id, page_index, coalesce(h, 0) AS have, coalesce(n, 0) AS want FROM (SELECT project_id, page_index, count(*) AS h FROM catalog_pages GROUP BY 1, 2)
      FULL JOIN (SELECT project_id, page_index, count(*) AS n FROM w GROUP BY 1, 2) USING (project_id, page_index))
    SELECT project_id, sum(greatest(have - want, 0)) AS missing, sum(greatest(want - have, 0)) AS unexpected FROM b WHERE have <> want GROUP BY project_id"""))
def u7(spark, sf_dir):
    pages = fx.catalog_pages(spark, sf_dir)
    wanted = pages.where("height % 37 <> 0").selectExpr("project_id", "CASE WHEN n_lines > 2 THEN page_index + 1 ELSE page_index END AS page_index")
    return cat.order_mismatches(pages.select(*PAGE), wanted)


@query("q1_slice_violations", sql("catalog_slices catalog_pages", """
    , s AS (SELECT *  REPLACE (CASE WHEN w = 80 THEN page_index + 20 ELSE page_index END AS page_index, CASE WHEN h = 8 THEN 'blob' ELSE cut_mode END AS cut_mode)
      FROM catalog_slices)
    SELECT project_id, NULL::BIGINT AS page_index, slice_id, 'duplicate_slice_id' AS rule FROM s GROUP BY project_id, slice_id HAVING count(*) > 1
    UNION ALL SELECT project_id, page_index, slice_id, 'unknown_page' FROM s WHERE NOT EXISTS (SELECT 1 FROM catalog_pages p WHERE p.project_id = s.project_id AND p.page_index = s.page_index)
    UNION ALL SELECT project_id, page_index, slice_id, 'bad_kind' FROM s WHERE cut_mode NOT IN ('rect', 'subject', 'card')"""))
def q1(spark, sf_dir):
    given = fx.catalog_slices(spark, sf_dir).withColumn("page_index", F.expr("CASE WHEN w = 80 THEN page_index + 20 ELSE page_index END")).withColumn(
        "cut_mode", F.expr("CASE WHEN h = 8 THEN 'blob' ELSE cut_mode END"))
    return cat.slice_violations(given, fx.catalog_pages(spark, sf_dir))


@query("q6_job_requests", sql("", """
    SELECT o_orderkey AS project_id, CASE WHEN o_orderstatus = 'O' AND page IS NULL THEN 'pageId is required for page_project export jobs'
      WHEN o_orderstatus <> 'O' AND page IS NOT NULL THEN 'pageId is only valid for page_project export jobs' END AS error
    FROM (SELECT *, CASE WHEN o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%LOW%' THEN NULL ELSE 'page_1' END AS page FROM orders)"""))
def q6(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS project_id", "CASE WHEN o_orderstatus = 'O' THEN 'page_project' ELSE 'full_project' END AS kind",
        "CASE WHEN o_orderpriority LIKE '%URGENT%' THEN ' ' WHEN o_orderpriority LIKE '%LOW%' THEN NULL ELSE 'page_1' END AS page_id")
    return cat.job_request_errors(requests).select("project_id", "error")


_MANIFEST = """
    , m AS (SELECT g.project_id, g.page_index, concat('P', g.page_index, '-', g.page_name) AS page_directory, s.position, s.slice_id, s.name, s.cut_mode,
      CASE WHEN s.slice_id IS NOT NULL THEN concat('slices/P', g.page_index, '-', g.page_name, '/slice_', lpad(s.position::VARCHAR, greatest(4, length(s.position::VARCHAR))::INT, '0'), '.png') END AS filename,
      s.x, s.y, s.w, s.h FROM catalog_pages g LEFT JOIN named_slices s ON g.project_id = s.project_id AND g.page_index = s.page_index)"""


@query("snk1_export_manifest", sql("catalog_pages named_slices", _MANIFEST + " SELECT * FROM m"))
def snk1(spark, sf_dir):
    return cat.manifest(fx.catalog_pages(spark, sf_dir), fx.catalog_slices(spark, sf_dir))


@query("snk2_extended_manifest", sql("catalog_pages named_slices", _MANIFEST + """
    SELECT m.*, CASE WHEN p.height % 3 = 0 THEN 'ok' ELSE 'skipped' END AS text_status, CASE WHEN p.height % 3 = 0 THEN NULL ELSE 'not_run' END AS text_reason,
      CASE WHEN p.height % 3 = 0 THEN p.n_lines ELSE 0 END AS text_layers, CASE WHEN m.cut_mode = 'subject' THEN m.x + 2 ELSE m.x END AS placed_x,
      CASE WHEN m.cut_mode = 'subject' THEN m.y + 2 ELSE m.y END AS placed_y, CASE WHEN m.cut_mode = 'subject' THEN m.w - 4 ELSE m.w END AS placed_w,
      CASE WHEN m.cut_mode = 'subject' THEN m.h - 4 ELSE m.h END AS placed_h
    FROM m JOIN catalog_pages p ON m.project_id = p.project_id AND m.page_index = p.page_index"""))
def snk2(spark, sf_dir):
    pages = fx.catalog_pages(spark, sf_dir)
    flat = cat.manifest(pages, fx.catalog_slices(spark, sf_dir))
    text = pages.where("height % 3 = 0").select(*PAGE, F.lit("ok").alias("text_status"), C("n_lines").alias("text_layers"))
    trimmed = flat.where("cut_mode = 'subject'").selectExpr(*PAGE, "slice_id", "position", "x + 2 AS placed_x", "y + 2 AS placed_y",
                                                            "w - 4 AS placed_w", "h - 4 AS placed_h")
    return cat.extended_manifest(flat, text, trimmed)


@query("u8_review_pages", sql("regions", """
    , c AS (SELECT page_id, region_id FROM regions WHERE kind_no <> 4),
    s AS (SELECT DISTINCT page_id, region_id, CASE WHEN confidence = 'low' THEN 'rejected' ELSE 'hidden' END AS mark FROM regions WHERE confidence <> 'high')
    SELECT c.page_id, count(*) AS candidates, count(*) FILTER (s.mark = 'rejected') AS rejected, count(*) FILTER (s.mark = 'hidden') AS hidden
    FROM c LEFT JOIN s ON c.page_id = s.page_id AND c.region_id = s.region_id GROUP BY c.page_id"""))
def u8(spark, sf_dir):
    regions = fx.regions(spark, sf_dir)
    return cat.review_pages(regions.where("kind_no <> 4"), _marks(regions))


def _marks(regions):
    return regions.where("confidence <> 'high'").selectExpr(
        "page_id", "region_id", "CASE WHEN confidence = 'low' THEN 'rejected' ELSE 'hidden' END AS mark")


@query("a25_review_totals", sql("regions", """
    , p AS (SELECT page_id, page_id // 10 AS project_id, count(*) AS candidates, count(*) FILTER (confidence = 'low') AS rejected,
        count(*) FILTER (confidence = 'high' AND visual_kind = 'media_region') AS selected FROM regions WHERE kind_no <> 4 GROUP BY page_id)
    SELECT project_id, count(*) AS pages, sum(candidates) AS candidates, sum(selected) AS selected, sum(rejected) AS rejected,
      count(*) FILTER (selected > 0) AS completed FROM p GROUP BY project_id"""))
def a25(spark, sf_dir):
    regions = fx.regions(spark, sf_dir)
    pages = regions.selectExpr("page_id", "page_id div 10 AS project_id").distinct()
    review = cat.review_pages(regions.where("kind_no <> 4"), _marks(regions))
    return cat.review_totals(pages, review, regions.where("confidence = 'high' AND visual_kind = 'media_region'"))


@query("f11_project_fingerprints")
def f11(spark, sf_dir):
    return cat.fingerprints(fx.catalog_pages(spark, sf_dir), fx.catalog_slices(spark, sf_dir))


@query("f12_export_cache_hits", sql("projects", """
    SELECT project_id AS zip_key, project_id % 5 <> 0 AND project_id % 3 <> 0 AND project_id % 7 <> 0 AS hit FROM projects"""))
def f12(spark, sf_dir):
    base = fx.projects(spark, sf_dir).selectExpr(
        "project_id AS zip_key", "'full_project' AS kind", "'v1' AS version", "sha2(name, 256) AS fingerprint", "project_id % 9 AS asset_count",
        "CASE WHEN project_id % 4 = 0 THEN NULL ELSE project_id % 4 END AS page_count")
    cached = base.where("zip_key % 5 <> 0").selectExpr(
        "zip_key", "kind", "version", "CASE WHEN zip_key % 3 = 0 THEN 'stale' ELSE fingerprint END AS fingerprint",
        "CASE WHEN zip_key % 7 = 0 THEN asset_count + 1 ELSE asset_count END AS asset_count", "page_count")
    return cat.cache_hits(base, cached)
