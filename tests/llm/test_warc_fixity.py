import gzip

from pyspark.sql import functions as F

from boxloom.llm.common import file_system, fresh_folder
from boxloom.llm.warc_fixity import audit, copy_replica, write_warc

PAGES = "page_id bigint, url string, html string"


def test_audit_finds_damage(spark, make):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(300)] + [(None, None, None), (7, "http://h/7", "<p>7</p>" * 2), (400, "a\nb", "é" * 50000)]
    first, second = fresh_folder(spark, "w"), fresh_folder(spark, "w")
    manifest = write_warc(make(rows, PAGES), first, file_records=40, partitions=3)
    assert manifest.count() == len(rows)
    hurt = manifest.where("page_id in (5, 123, 400)").select("file", (F.col("offset") + 12).alias("offset"))
    assert copy_replica(manifest, first, second, hurt) == manifest.select("file").distinct().count()
    assert sorted((r.page_id, r.kind) for r in audit(manifest, first, second).collect()) == [(5, "changed"), (123, "changed"), (400, "changed")]
    assert audit(manifest, first, first).count() == 0
    # a shortened file and a lost one
    system, path = file_system(second)
    names = sorted(r.file for r in manifest.select("file").distinct().collect())
    with system.open_input_file(f"{path}/{names[1]}") as f:
        data = f.read()
    with system.open_output_stream(f"{path}/{names[1]}", compression=None) as f:
        f.write(data[:-1])
    system.delete_file(f"{path}/{names[0]}")
    got = audit(manifest, first, second)
    assert got.where(F.col("file") == names[0]).count() == manifest.where(F.col("file") == names[0]).count()
    last = manifest.where(F.col("file") == names[1]).orderBy(F.desc("record_no")).first()
    assert [(r.record_no, r.kind) for r in got.where((F.col("file") == names[1]) & (F.col("kind") == "missing_second")).collect()] == [(last.record_no, "missing_second")]
    # the records are gzip members that hold the page
    row = manifest.where("page_id = 123").first()
    system, path = file_system(first)
    with system.open_input_file(f"{path}/{row.file}") as f:
        f.seek(row.offset)
        assert b"<p>123</p>" in gzip.decompress(f.read(row.length))


def test_empty(spark, make):
    folder = fresh_folder(spark, "w")
    manifest = write_warc(make([], PAGES), folder)
    assert manifest.count() == 0 and audit(manifest, folder, folder).count() == 0
