"""Stream forms against their batch twins."""

from pyspark.sql import functions as F

from boxloom.queries import fixtures as fx
from boxloom.session import configure
from boxloom.streaming import jobs, windows

SF = "/root/testdata/sf0.001"


def stream_of(spark, tmp_path):
    """The event log as a file stream."""
    events = fx.job_events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "events")
    events.repartition(1).write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path), events


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def closed_stream(spark, events, tmp_path, name, last):
    """A file stream of ``events`` and then of one event years later, which moves the watermark past everything."""
    path = str(tmp_path / f"{name}-data")
    events.repartition(1).write.parquet(path)
    late = spark.createDataFrame([last], events.schema)
    late.repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def far_event(events):
    row = events.orderBy(F.desc("ts")).first().asDict()
    return {**row, "job_id": -1, "status": "queued", "ts": row["ts"].replace(year=row["ts"].year + 5)}


def test_sessions_stream_equals_batch(spark, tmp_path):
    configure(spark)
    batch = fx.job_events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = closed_stream(spark, batch, tmp_path, "closing", far_event(batch))
    got = {tuple(r) for r in run(windows.activity_sessions(stream, "job_id", "4 hours"), "sessions", "append", tmp_path).collect()}
    assert got == {tuple(r) for r in windows.activity_sessions(batch, "job_id", "4 hours").collect()}


def test_stage_windows_stream_equals_batch(spark, tmp_path):
    configure(spark)
    batch = fx.job_events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = closed_stream(spark, batch, tmp_path, "stages", far_event(batch))
    got = {tuple(r) for r in run(windows.stage_windows(stream, "1 hour"), "stage_windows", "append", tmp_path).collect()}
    assert got == {tuple(r) for r in windows.stage_windows(batch, "1 hour").collect()}


def test_time_outs_fire(spark, tmp_path):
    configure(spark)
    rows = [(1, 1, "queued", "2024-01-01 00:00:00"), (2, 1, "running", "2024-01-01 00:01:00"), (3, 2, "queued", "2024-01-01 00:00:00")]
    batch = spark.createDataFrame(rows, "event_id bigint, job_id bigint, status string, t string").select("event_id", "job_id", "status", F.to_timestamp("t").alias("ts"))
    stream = closed_stream(spark, batch, tmp_path, "outs", far_event(batch))
    out = run(jobs.job_states_stream(stream, "1 hour", queue_timeout="2 days"), "outs", "update", tmp_path)
    ends = {r.job_id: (r.status, str(r.finished_at)) for r in out.where("finished_at IS NOT NULL").collect()}
    assert ends == {1: ("failed", "2024-01-01 01:01:00"), 2: ("canceled", "2024-01-03 00:00:00")}


def test_job_states_stream_reaches_the_batch_outcome(spark, tmp_path):
    configure(spark)
    stream, batch = stream_of(spark, tmp_path)
    out = run(jobs.job_states_stream(stream, "100000 hours", queue_timeout="100000 hours"), "states", "update", tmp_path)
    last = {r.job_id: r.status for r in out.groupBy("job_id").agg(F.max_by("status", F.coalesce("finished_at", "running_at", "queued_at")).alias("status")).collect()}
    want = {r.job_id: r.status for r in jobs.job_outcomes(batch).collect()}
    assert last == want


def test_dedupe_stream_keeps_one_row_per_key(spark, tmp_path):
    configure(spark)
    stream, batch = stream_of(spark, tmp_path)
    out = run(windows.skip_unchanged(stream, ["job_id", "status"], "1000 hours"), "unchanged", "append", tmp_path)
    assert out.count() == batch.select("job_id", "status").distinct().count()


def test_a_long_log_of_one_job(spark, tmp_path):
    """Many events of one job in no order: the outcome is that of the batch."""
    configure(spark)
    names = F.array(*[F.lit(n) for n in ("running", "succeeded", "failed", "canceled", "queued")])
    at = F.pmod(F.col("id") * 7919, F.lit(100003))
    log = spark.range(100000).select(F.col("id").alias("event_id"), F.lit(1).cast("bigint").alias("job_id"),
                                      F.get(names, F.when(at < 300, 0).when(at < 600, 1).when(at == 700, 4).otherwise(F.pmod(at, F.lit(3)))).alias("status"),
                                      F.timestamp_seconds(at + 1700000000).alias("ts"))
    path = str(tmp_path / "long")
    log.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(log.schema).parquet(path)
    out = run(jobs.job_states_stream(stream, "100000 hours", queue_timeout="100000 hours"), "long_log", "update", tmp_path)
    got = [(r.status, r.queued_at, r.running_at, r.finished_at) for r in out.collect()]
    assert got == [(r.status, r.queued_at, r.running_at, r.finished_at) for r in jobs.job_outcomes(spark.read.parquet(path)).collect()]


def test_stage_pairs_stream_joins_within_the_bound(spark, tmp_path):
    configure(spark)
    rows = [(1, 1, "start", "2024-01-01 00:00:00"), (2, 1, "end", "2024-01-01 00:05:00"), (3, 2, "start", "2024-01-01 00:00:00"),
            (4, 2, "end", "2024-01-01 02:00:00"), (5, 3, "end", "2024-01-01 00:00:00"), (6, 3, "start", "2024-01-01 00:01:00"), (7, 1, "end", "2024-01-01 00:09:00")]
    batch = spark.createDataFrame(rows, "event_id bigint, job_id bigint, status string, t string").select("event_id", "job_id", "status", F.to_timestamp("t").alias("ts"))
    path = str(tmp_path / "pairs-data")
    batch.repartition(1).write.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet(path)
    out = run(windows.stage_pairs_stream(stream.where("status = 'start'"), stream.where("status = 'end'"), "1 HOUR"), "pairs", "append", tmp_path)
    assert sorted((r.job_id, str(r.started_at), str(r.ended_at)) for r in out.collect()) == [
        (1, "2024-01-01 00:00:00", "2024-01-01 00:05:00"), (1, "2024-01-01 00:00:00", "2024-01-01 00:09:00")]
