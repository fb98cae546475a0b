"""WARC files of pages, and an audit of replicas by Merkle trees over ordered offset ranges.

Pages are written as gzip members, one WARC record each, in files that are dealt by ranges of (page_id, url) and closed
after ``FILE_RECORDS`` records.  The manifest lists every record's file, number, offset and length.

A replica is hashed by the ranges of the manifest.  A leaf is the SHA-256 of a record's bytes with its range; an inner node hashes
``FANOUT`` children in order, so a node stands for a range of offsets.  Nodes above the files join them to one root.  The audit
compares roots and descends only below nodes that differ, level by level, to the records that are missing or changed.

Defined cases: null html is an empty body, null url has no target header, null page ids come first; repeated pages are repeated records; a replica
without a file, or with a shorter one, has missing records; an empty table gives no file and an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.llm.common import file_system, fresh_folder, stored

FILE_RECORDS, FANOUT = 4096, 16
READ_BYTES = 8 << 20
RECORD = "file string, record_no bigint, page_id bigint, offset bigint, length bigint"
NAMESPACE = uuid.UUID(int=0)


def warc_record(page_id: int | None, url: str | None, html: str | None, date: str) -> bytes:
    """One compressed WARC record; the same input gives the same bytes."""
    body = (html or "").encode()
    target = "" if url is None else "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A") + "\r\n"
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()  # noqa: S324  the format names SHA-1
    head = (
        f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {url}')}>\r\nWARC-Date: {date}\r\n{target}"
        f"WARC-Block-Digest: sha1:{digest}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n")
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 1, mtime=0)


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_records: int = FILE_RECORDS, partitions: int | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``folder``; returns the stored manifest, one row per record."""
    count = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").repartitionByRange(count, F.col("page_id").asc_nulls_first(), "url").sortWithinPartitions(F.col("page_id").asc_nulls_first(), "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        files, out, name, at, number = 0, None, "", 0, 0

        def close() -> None:
            out.close()
            system.move(f"{path}/.{name}-{context.taskAttemptId()}", f"{path}/{name}")

        for batch in batches:
            listed = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or number == file_records:
                    if out is not None:
                        close()
                    name, at, number = f"part-{context.partitionId():06d}-{files:06d}.warc.gz", 0, 0
                    files += 1
                    out = system.open_output_stream(f"{path}/.{name}-{context.taskAttemptId()}", compression=None)
                record = warc_record(page_id, url, html, date)
                out.write(record)
                listed.append((name, number, page_id, at, len(record)))
                at, number = at + len(record), number + 1
            columns = list(zip(*listed)) if listed else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["file", "record_no", "page_id", "offset", "length"])
        if out is not None:
            close()

    return stored(rows.mapInArrow(run, RECORD), "warc-manifest")


def copy_replica(manifest: DataFrame, source: str, target: str, damage: DataFrame | None = None) -> int:
    """Copy the files of a manifest to another folder; returns their number.

    ``damage`` (file, offset) names bytes that the copy inverts: a way to rehearse the audit.
    """
    files = manifest.select("file").distinct()
    if damage is None:
        files = files.withColumn("bytes", F.expr("cast(null as array<bigint>)"))
    else:
        hurt = damage.groupBy(F.col("file").alias("hurt")).agg(F.array_sort(F.collect_list("offset")).alias("bytes"))
        files = files.join(hurt, F.col("file") == F.col("hurt"), "left").select("file", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        read, from_path = file_system(source)
        write, to_path = file_system(target)
        write.create_dir(to_path, recursive=True)
        for batch in batches:
            for name, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                draft = f"{to_path}/.{name}-{TaskContext.get().taskAttemptId()}"
                with read.open_input_file(f"{from_path}/{name}") as data, write.open_output_stream(draft, compression=None) as out:
                    at = 0
                    while block := data.read(READ_BYTES):
                        inside = [p - at for p in places or () if at <= p < at + len(block)]
                        if inside:
                            block = bytearray(block)
                            for p in inside:
                                block[p] ^= 255
                        out.write(bytes(block))
                        at += len(block)
                write.move(draft, f"{to_path}/{name}")
            yield batch.select(["file"])

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(files.repartition(tasks, "file").mapInArrow(run, "file string"), "replica").count()


def leaves(manifest: DataFrame, folder: str) -> DataFrame:
    """Manifest rows with the ``digest`` of the replica's bytes in that range (null: not there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = file_system(folder)
        for batch in batches:
            rows = batch.to_pylist()
            digests: list[bytes | None] = []
            i = 0
            while i < len(rows):
                # one read for neighbours in a file
                j = i + 1
                while j < len(rows) and rows[j]["file"] == rows[i]["file"] and rows[j]["offset"] == rows[j - 1]["offset"] + rows[j - 1]["length"] and rows[j]["offset"] + rows[j]["length"] - rows[i]["offset"] <= READ_BYTES:
                    j += 1
                block = b""
                place = f"{path}/{rows[i]['file']}"
                if system.get_file_info(place).type == fs.FileType.File:
                    with system.open_input_file(place) as data:
                        if rows[i]["offset"] < data.size():
                            data.seek(rows[i]["offset"])
                            block = data.read(rows[j - 1]["offset"] + rows[j - 1]["length"] - rows[i]["offset"])
                for r in rows[i:j]:
                    at = r["offset"] - rows[i]["offset"]
                    part = block[at : at + r["length"]]
                    digests.append(hashlib.sha256(r["offset"].to_bytes(8, "little") + r["length"].to_bytes(8, "little") + part).digest() if len(part) == r["length"] else None)
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, "digest"])

    # a task reads the records of whole files in their order
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = manifest.repartition(tasks, "file").sortWithinPartitions("file", "record_no")
    return stored(dealt.mapInArrow(run, f"{RECORD}, digest binary"), "leaves")


def _parents(nodes: DataFrame) -> DataFrame:
    """Next level: FANOUT children in order make a node."""
    kids = F.array_sort(F.collect_list(F.struct("no", F.coalesce(F.hex("digest"), F.lit("-")).alias("x"))))
    return nodes.groupBy("file", F.floor(F.col("no") / FANOUT).alias("no")).agg(F.unhex(F.sha2(F.concat_ws(",", F.transform(kids, lambda k: F.concat(k["no"].cast("string"), F.lit(":"), k["x"]))), 256)).alias("digest"))


def _tree(hashed: DataFrame, file_levels: int, files: DataFrame, top_levels: int) -> list[DataFrame]:
    """Levels from the records up to one root.  ``files`` numbers the files; above them ``file`` is empty."""
    levels = [hashed.select("file", F.col("record_no").alias("no"), "digest")]
    for _ in range(file_levels):
        levels.append(stored(_parents(levels[-1]), "tree"))
    top = levels[-1].join(files, F.col("file") == F.col("name")).select(F.lit("").alias("file"), F.col("file_no").alias("no"), "digest")
    for _ in range(top_levels):
        levels.append(stored(_parents(top), "tree"))
        top = levels[-1]
    return levels


def _levels(count: int) -> int:
    """Levels until one node is left."""
    levels = 0
    while count > 1:
        count, levels = -(-count // FANOUT), levels + 1
    return levels


def audit(manifest: DataFrame, first: str, second: str) -> DataFrame:
    """Records that differ between two replicas: manifest columns and ``kind``.

    ``changed``: both replicas have the range with other bytes; ``missing_first`` and ``missing_second``: one of them lacks it.
    """
    per_file = manifest.groupBy(F.col("file").alias("name")).agg((F.max("record_no") + 1).alias("records"))
    # files are numbered by name, in slots of the task that wrote them, so only one row per task meets in one place
    counted = stored(per_file.withColumn("slot", F.substring("name", 1, 11)), "files")
    offsets = counted.groupBy(F.col("slot").alias("o_slot")).agg(F.count("*").alias("files"))
    offsets = offsets.select("o_slot", F.coalesce(F.sum("files").over(W.orderBy("o_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    files = counted.join(offsets, F.col("slot") == F.col("o_slot")).select("name", (F.col("before") + F.row_number().over(W.partitionBy("slot").orderBy("name")) - 1).alias("file_no"))
    sizes = counted.agg(F.max("records").alias("most"), F.count("*").alias("files")).first()
    file_levels, top_levels = max(1, _levels(sizes["most"] or 0)), max(1, _levels(sizes["files"]))
    one, two = leaves(manifest, first), leaves(manifest, second)
    a, b = _tree(one, file_levels, files, top_levels), _tree(two, file_levels, files, top_levels)

    differing = None
    for level in range(file_levels + top_levels, -1, -1):
        left, right = a[level], b[level].select(F.col("file").alias("f"), F.col("no").alias("n"), F.col("digest").alias("d"))
        if differing is not None and level == file_levels:
            # from the nodes above the files to the roots of the files
            parents = differing.select(F.col("no").alias("p_no"))
            wanted = files.join(parents, F.floor(F.col("file_no") / FANOUT) == F.col("p_no"), "left_semi").select(F.col("name").alias("p_file"))
            left, right = left.join(wanted, F.col("file") == F.col("p_file"), "left_semi"), right.join(wanted, F.col("f") == F.col("p_file"), "left_semi")
        elif differing is not None:
            parents = differing.select(F.col("file").alias("p_file"), F.col("no").alias("p_no"))
            left = left.join(parents, (F.col("file") == F.col("p_file")) & (F.floor(F.col("no") / FANOUT) == F.col("p_no")), "left_semi")
            right = right.join(parents, (F.col("f") == F.col("p_file")) & (F.floor(F.col("n") / FANOUT) == F.col("p_no")), "left_semi")
        differing = left.join(right, (F.col("file") == F.col("f")) & (F.col("no") == F.col("n")))
        differing = stored(differing.where(~F.col("digest").eqNullSafe(F.col("d"))).select("file", "no", F.col("digest").isNull().alias("a_gone"), F.col("d").isNull().alias("b_gone")), "differing")
    kind = F.when(F.col("a_gone"), "missing_first").when(F.col("b_gone"), "missing_second").otherwise("changed")
    found = differing.select(F.col("file").alias("d_file"), F.col("no").alias("d_no"), kind.alias("kind"))
    return manifest.join(found, (F.col("file") == F.col("d_file")) & (F.col("record_no") == F.col("d_no"))).select(*manifest.columns, "kind")


def rehearsal(spark: SparkSession, pages: DataFrame, damaged) -> DataFrame:
    """Write two replicas, invert one byte in the second one's records where the column ``damaged`` holds, and audit them."""
    first, second = fresh_folder(spark, "warc-first"), fresh_folder(spark, "warc-second")
    manifest = write_warc(pages, first)
    # the byte inverted lies in the middle of the record
    hurt = manifest.where(damaged).select("file", (F.col("offset") + F.floor(F.col("length") / 2)).alias("offset"))
    copy_replica(manifest, first, second, hurt)
    return audit(manifest, first, second)
