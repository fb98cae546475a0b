"""Writers for summaries, manifests and slice snapshots."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from boxloom.functions.geometry import box, normalize
from boxloom.functions.ladders import normalize_cut_mode
from boxloom.plans.catalog import slice_violations
from boxloom.session import cut_lineage

from pyspark.sql import functions as F


def write_summary(rows: DataFrame, out: str) -> None:
    """Case summary as JSON and as CSV with a header."""
    rows.write.mode("overwrite").json(out + "/json")
    rows.write.mode("overwrite").option("header", True).csv(out + "/csv")


# rows a bucket should hold; the number of buckets doubles until it does
ROWS_PER_BUCKET = 1_000_000
LOG = "version bigint, buckets int, bucket int, save string, n bigint"


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt by a hash of their project, so a folder holds many projects and one file per writing task."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("project_id"), F.lit(buckets)).cast("int")).repartition("bucket")


def _stored(spark: SparkSession, out: str, version: int | None = None) -> list:
    """Log entries of a version, the newest by default: one for each bucket that holds rows, or one without a bucket."""
    try:
        log = spark.read.schema(LOG).parquet(out + "/log")
        last = log.agg(F.max("version")).first()[0] if version is None else version
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return []
    return [] if last is None else log.where(F.col("version") == last).collect()


def _paths(entries: list, out: str) -> list[str]:
    return [f"{out}/data/save={e.save}/bucket={e.bucket}" for e in entries if e.bucket is not None]


def read_version(spark: SparkSession, out: str, schema, form: str = "parquet", version: int | None = None) -> DataFrame:
    """Rows of a stored version, the newest by default; nothing stored reads as empty."""
    paths = _paths(_stored(spark, out, version), out)
    return spark.read.schema(schema).format(form).load(paths) if paths else spark.createDataFrame([], schema)


def save_version(rows: DataFrame, out: str, form: str = "parquet", given: DataFrame | None = None) -> int:
    """Store ``rows`` as a new version and return its number; ``given`` names the projects they replace, all when missing.

    Files are written to a folder of their own and never replaced.  The version exists once one small file has been added to
    the log that names the folder of every bucket, so a job that fails before leaves the old version as it was.  Buckets
    without a project of ``given`` keep their folder.  The number of buckets is part of the log; when the rows outgrow it
    all of them are dealt anew.  One writer at a time; files that no wanted version names may be deleted.
    """
    spark = rows.sparkSession
    entries = _stored(spark, out)
    rows = cut_lineage(rows)
    fields = rows.schema
    before = entries if given is not None else []
    total = rows.count() + sum(e.n for e in before)
    buckets = max([e.buckets for e in entries], default=1)
    while total > buckets * ROWS_PER_BUCKET:
        buckets *= 2
    fresh, untouched = rows, []
    if before:
        gone = cut_lineage(given.select("project_id").distinct())
        number = F.pmod(F.xxhash64("project_id"), F.lit(buckets)).cast("int")
        hit = {r[0] for r in gone.select(number).distinct().collect()} if buckets == before[0].buckets else None
        touched = [e for e in before if hit is None or e.bucket in hit]
        untouched = [e for e in before if hit is not None and e.bucket is not None and e.bucket not in hit]
        paths = _paths(touched, out)
        if paths:
            kept = spark.read.schema(fields).format(form).load(paths).join(gone, "project_id", "left_anti")
            fresh = rows.unionByName(kept.select(*rows.columns))
    save = uuid.uuid4().hex
    folder = f"{out}/data/save={save}"
    _bucketed(fresh, buckets).write.partitionBy("bucket").format(form).save(folder)
    version = max([e.version for e in entries], default=0) + 1
    # the bucket is read from the folder names, so nothing but counts is left to compute; an empty version has no bucket to name
    written = spark.read.schema(f"{fields[0].name} {fields[0].dataType.simpleString()}, bucket int").format(form).load(folder).groupBy("bucket").agg(F.count("*").alias("n")).collect()
    lines = [(version, buckets, e.bucket, e.save, e.n) for e in untouched] + [(version, buckets, r.bucket, save, r.n) for r in written]
    # one file: it is there as a whole or not at all
    spark.createDataFrame(lines or [(version, buckets, None, save, 0)], LOG).coalesce(1).write.mode("append").parquet(out + "/log")
    return version


def write_manifest(rows: DataFrame, out: str) -> None:
    """Manifest lines as JSON, by bucket of projects, as a new version."""
    save_version(rows, out, "json")


def summary_round_trip(rows: DataFrame, out: str) -> DataFrame:
    """Write the summary and read both files back: the JSON columns, and whether the CSV line of the key says the same."""
    write_summary(rows, out)
    spark, key, *rest = rows.sparkSession, *rows.columns
    text = spark.read.option("header", True).csv(out + "/csv").select(*[F.col(c).alias("_" + c) for c in rows.columns])
    lines = spark.read.schema(rows.schema).json(out + "/json")
    same = F.lit(True)
    for c in rest:
        same = same & F.col(c).cast("string").eqNullSafe(F.col("_" + c))
    return lines.join(text, F.col(key).cast("string") == F.col("_" + key), "left").select(*rows.columns, F.coalesce(same, F.lit(False)).alias("csv_agrees"))


def snapshot(slices: DataFrame, pages: DataFrame, min_size: int = 8) -> DataFrame:
    """Slices ready to be stored: cut modes normalised and boxes pushed inside their page."""
    sized = slices.join(pages.select("project_id", "page_index", "width", "height"), ["project_id", "page_index"])
    b = normalize(box(""), F.col("width"), F.col("height"), min_size)
    return sized.select("project_id", "page_index", "slice_id", "name", normalize_cut_mode(F.col("cut_mode")).alias("cut_mode"),
                        *[c.cast("bigint").alias(n) for c, n in zip(b, "xywh")])


def save_slices(slices: DataFrame, pages: DataFrame, out: str) -> int:
    """Replace the slices of the given projects only, as a new version; nothing is written while a violation remains.

    An unknown cut mode is no violation here, it is normalised.
    """
    broken = slice_violations(slices, pages).where("rule <> 'bad_kind'").limit(1).collect()
    if broken:
        raise ValueError(f"slices not saved: {broken[0]['rule']} {broken[0]['slice_id']}")
    return save_version(snapshot(slices, pages), out, given=slices)
