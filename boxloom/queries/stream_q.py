"""Batch twins of the streaming operators, and the user hooks."""

import pandas as pd
from pyspark.sql import functions as F

from boxloom.functions import hooks
from boxloom.queries import fixtures as fx
from boxloom.queries.fixture_sql import fixture
from boxloom.queries.registry import query, sql
from boxloom.streaming import jobs, windows

C = F.col

fixture("outcomes", """
    SELECT job_id, acc[-1].s AS status, acc[1].t AS queued_at, list_max(list_transform(list_filter(acc, lambda a: a.s = 'running'), lambda a: a.t)) AS running_at,
      CASE WHEN acc[-1].s IN ('succeeded', 'failed', 'canceled') THEN acc[-1].t END AS finished_at
    FROM (SELECT job_id, list_reduce(list([{'s': status, 't': ts}] ORDER BY ts, event_id), lambda acc, x: CASE
        WHEN (acc[-1].s = 'queued' AND x[1].s IN ('running', 'canceled')) OR (acc[-1].s = 'running' AND x[1].s IN ('succeeded', 'failed')) THEN list_concat(acc, x) ELSE acc END) AS acc
      FROM (SELECT *, min((ts, event_id)) FILTER (status = 'queued') OVER (PARTITION BY job_id) AS q FROM job_events) WHERE (ts, event_id) >= q GROUP BY job_id)""", "job_events")


@query("st1_job_outcomes", sql("outcomes", "SELECT * FROM outcomes"))
def st1(spark, sf_dir):
    return jobs.job_outcomes(fx.job_events(spark, sf_dir))


@query("st2_job_timeouts", sql("outcomes", """
    SELECT job_id, running_at, running_at + INTERVAL 21600 SECOND AS timed_out_at FROM outcomes
    WHERE running_at IS NOT NULL AND (finished_at IS NULL OR finished_at > running_at + INTERVAL 21600 SECOND)"""))
def st2(spark, sf_dir):
    return jobs.job_timeouts(jobs.job_outcomes(fx.job_events(spark, sf_dir)), 21600)


@query("st3_activity_sessions", sql("job_events", """
    , g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS cut FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS s FROM g)
    SELECT job_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS expires_at, count(*) AS events FROM i GROUP BY job_id, s"""))
def st3(spark, sf_dir):
    return windows.activity_sessions(fx.job_events(spark, sf_dir), "job_id", "4 hours")


@query("st4_stage_windows", sql("job_events", """
    SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", status, count(*) AS n, sum(round(value * 100))::BIGINT AS cents FROM job_events GROUP BY ALL"""))
def st4(spark, sf_dir):
    return windows.stage_windows(fx.job_events(spark, sf_dir), "1 hour")


@query("st4_sliding_windows", sql("job_events", """
    , w AS (SELECT *, unnest([0, 1]) AS back FROM job_events)
    SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * back AS start, date_trunc('hour', ts) - INTERVAL 1 HOUR * back + INTERVAL 2 HOUR AS "end", status, count(*) AS n,
      sum(round(value * 100))::BIGINT AS cents FROM w GROUP BY ALL"""))
def st4_sliding(spark, sf_dir):
    return windows.stage_windows(fx.job_events(spark, sf_dir), "2 hours", "1 hour")


@query("st4_stage_durations", sql("job_events", """
    , e AS (SELECT s.job_id, s.event_id, s.ts, arg_min(e.status, e.ts) AS status, min(e.ts) AS ended FROM job_events s JOIN job_events e ON s.job_id = e.job_id AND e.ts > s.ts
      AND e.ts <= s.ts + INTERVAL 6 HOUR AND e.status IN ('succeeded', 'failed') WHERE s.status = 'running' GROUP BY 1, 2, 3)
    SELECT job_id, event_id, status, (epoch_us(ended) - epoch_us(ts)) // 1000 AS elapsed_ms FROM e"""))
def st4_durations(spark, sf_dir):
    events = fx.job_events(spark, sf_dir)
    return windows.stage_durations(events.where("status = 'running'"), events.where("status IN ('succeeded', 'failed')"), 21600)


@query("st5_skip_unchanged", sql("", """
    WITH e AS (SELECT md5(user_id::VARCHAR || props) AS hash, event_type AS version, ts, event_id FROM events)
    SELECT hash, version, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM e GROUP BY hash, version"""))
def st5(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").selectExpr("md5(concat(user_id, props)) AS hash", "event_type AS version", "ts", "event_id")
    return windows.skip_unchanged(events, ["hash", "version"])


@query("x1_scalar_hook", sql("regions", "SELECT page_id, region_id, w / h::DOUBLE * (score_milli / 1000.0) AS score FROM regions"))
def x1(spark, sf_dir):
    score = hooks.scorer(lambda w, h, s: w / h * (s / 1000.0))
    return fx.regions(spark, sf_dir).select("page_id", "region_id", score(C("w"), C("h"), C("score_milli")).alias("score"))


@query("x2_page_hook", sql("regions", "SELECT page_id, count(*) AS regions, sum(w * h) AS area FROM regions GROUP BY page_id"))
def x2(spark, sf_dir):
    def page_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["owned"]]
        return own.assign(area=own["w"] * own["h"]).groupby("page_id", as_index=False).agg(regions=("area", "size"), area=("area", "sum"))

    cells = hooks.per_cell(fx.regions(spark, sf_dir).select("page_id", "x", "y", "w", "h"), page_sums, "page_id bigint, regions bigint, area bigint")
    return cells.groupBy("page_id").agg(F.sum("regions").alias("regions"), F.sum("area").alias("area"))


@query("x3_table_hook", sql("", """
    SELECT doc_id, unnest([1, 2, 3]) AS node_id, unnest([NULL, 1, 1]) AS parent_id, unnest([0, 1, 1]) AS depth, unnest(['frame', lang, 'text']) AS type FROM documents"""))
def x3(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat('{\"type\":\"frame\",\"children\":[{\"type\":\"', lang, '\"},{\"type\":\"text\"}]}') AS document")
    return docs.lateralJoin(hooks.TreeRows(C("document").outer())).select("doc_id", "node_id", "parent_id", "depth", "type")
