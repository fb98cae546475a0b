"""Sessions, stage windows, stage durations and repeat suppression; the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

C = F.col


def with_watermark(df: DataFrame, delay: str) -> DataFrame:
    return df.withWatermark("ts", delay) if df.isStreaming else df


def activity_sessions(events: DataFrame, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Activity sessions per key, closed after ``gap`` without an event."""
    grouped = with_watermark(events, delay).groupBy(key, F.session_window("ts", gap).alias("s"))
    return grouped.agg(F.count("*").alias("events")).select(key, C("s.start").alias("start"), C("s.end").alias("expires_at"), "events")


def stage_windows(events: DataFrame, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events, failures and summed value per stage and time window, tumbling or sliding."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = with_watermark(events, delay).groupBy(window.alias("w"), "status")
    return grouped.agg(F.count("*").alias("n"), F.sum(F.round(C("value") * 100).cast("bigint")).alias("cents")).select(
        C("w.start").alias("start"), C("w.end").alias("end"), "status", "n", "cents")


def stage_pairs_stream(starts: DataFrame, ends: DataFrame, bound: str, delay: str = "10 minutes") -> DataFrame:
    """Stream-stream join of starts and ends within a time bound; both states are cut by the watermark."""
    s = starts.withWatermark("ts", delay).select("job_id", C("ts").alias("started_at"))
    e = ends.withWatermark("ts", delay).select(C("job_id").alias("end_job"), C("ts").alias("ended_at"), "status")
    on = F.expr(f"job_id = end_job AND ended_at > started_at AND ended_at <= started_at + INTERVAL {bound}")
    return s.join(e, on).drop("end_job")


def stage_durations(starts: DataFrame, ends: DataFrame, bound_seconds: int) -> DataFrame:
    """Earliest end of each start within the bound (batch).

    Joined on the key and on time buckets as wide as the bound, so only events close in time meet.
    """
    bucket = F.floor(F.unix_timestamp(C("ts").cast("timestamp")) / bound_seconds)
    s = starts.select("job_id", "event_id", C("ts").alias("started_at"), F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    e = ends.select("job_id", C("ts").alias("ended_at"), "status", bucket.alias("_b"))
    near = (C("ended_at") > C("started_at")) & (C("ended_at") <= C("started_at") + F.make_dt_interval(secs=F.lit(bound_seconds)))
    first = s.join(e, ["job_id", "_b"]).where(near).groupBy("job_id", "event_id", "started_at").agg(F.min(F.struct("ended_at", "status")).alias("e"))
    elapsed = F.unix_micros(C("e.ended_at").cast("timestamp")) - F.unix_micros(C("started_at").cast("timestamp"))
    return first.select("job_id", "event_id", C("e.status").alias("status"), F.floor(elapsed / 1000).alias("elapsed_ms"))


def skip_unchanged(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First event of each content and version; a stream forgets keys once the watermark has passed them."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("ts", "event_id")).alias("v")).select(*keys, "v.*")
