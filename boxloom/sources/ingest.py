"""Parsing of model answers, OCR output, manifests, traces and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boxloom.functions.geometry import half_up
from boxloom.operators.ranking import row_numbers

C = F.col

ANSWER_SCHEMA = ("boxes array<struct<x:string,y:string,width:string,height:string,label:string,confidence:string,reason:string>>, _bad string")


def clean_answer(text: Column) -> Column:
    """Drop a code fence and, where the text does not open with a brace, cut to the outermost braces."""
    t = F.trim(text)
    body = F.regexp_replace(F.regexp_replace(t, "^```[^\n]*\n", ""), "\n[ \t]*```[ \t]*$", "")
    bare = F.trim(F.when(t.startswith("```"), body).otherwise(t))
    cut = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(bare.startswith("{") | (cut == ""), bare).otherwise(cut)


def parse_answers(answers: DataFrame, text: str = "answer") -> DataFrame:
    """One row per box of a model answer; an unreadable answer gives one row with an error and no box."""
    parsed = answers.withColumn("_j", F.from_json(clean_answer(C(text)), ANSWER_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    error = F.when(C("_j").isNull() | C("_j._bad").isNotNull(), "json_parse_error").when(C("_j.boxes").isNull(), "boxes_missing").otherwise("")
    marked = parsed.withColumn("error", error).withColumn("_boxes", F.when(error == "", C("_j.boxes")))
    rows = marked.select(*answers.columns, "error", F.posexplode_outer("_boxes").alias("ord", "b")).drop(text)

    def number(name: str) -> Column:
        return F.expr(f"try_cast(b.{name} AS DOUBLE)")

    return rows.where((C("error") != "") | C("b").isNotNull()).select(
        *[c for c in rows.columns if c != "b"], number("x").alias("x"), number("y").alias("y"), number("width").alias("w"), number("height").alias("h"),
        F.substring(F.trim("b.label"), 1, 80).alias("name"), number("confidence").alias("confidence"), F.substring(F.trim("b.reason"), 1, 240).alias("reason"))


OCR_SCHEMA = "rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<double>>, rec_polys array<array<array<double>>>"


def parse_ocr_arrays(docs: DataFrame, text: str = "payload", min_score: float = 0.7) -> DataFrame:
    """Parallel OCR arrays to one row per line; a missing box falls back to the hull of the polygon."""
    parsed = docs.withColumn("_j", F.from_json(text, OCR_SCHEMA))
    zipped = F.arrays_zip(C("_j.rec_texts").alias("t"), C("_j.rec_scores").alias("s"), C("_j.rec_boxes").alias("b"), C("_j.rec_polys").alias("p"))
    rows = parsed.select(*[c for c in docs.columns if c != text], F.posexplode(zipped).alias("ord", "z"))
    xs, ys = F.transform("z.p", lambda q: q[0]), F.transform("z.p", lambda q: q[1])
    has_box = C("z.b").isNotNull() & (F.size("z.b") == 4)
    edge = [F.when(has_box, C("z.b")[i]).otherwise(v) for i, v in enumerate((F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))]
    lines = rows.select(*[c for c in rows.columns if c != "z"], F.trim("z.t").alias("text"), C("z.s").alias("_s"),
                        *[half_up(e).alias(n) for e, n in zip(edge, ("x", "y", "_x2", "_y2"))])
    kept = lines.where((C("text") != "") & (C("_s") >= min_score) & (C("_x2") > C("x")) & (C("_y2") > C("y")))
    return kept.select(*[c for c in lines.columns if not c.startswith("_")], (C("_x2") - C("x")).alias("w"), (C("_y2") - C("y")).alias("h"),
                       half_up(C("_s") * 100).alias("conf"))


TSV_COLUMNS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


def parse_word_tsv(lines: DataFrame, value: str = "line", min_conf: int = 25) -> DataFrame:
    """Word rows (level 5) of OCR TSV text, with confidence and size gates."""
    parts = F.split(value, "\t")
    named = lines.select(*[c for c in lines.columns if c != value], *[parts[i].alias(n) for i, n in enumerate(TSV_COLUMNS)])
    numeric = named.select(*[c for c in lines.columns if c != value], *[F.expr(f"try_cast(`{n}` AS BIGINT)").alias(n) for n in TSV_COLUMNS[:-1]], F.trim("text").alias("text"))
    return numeric.where((C("level") == 5) & (C("text") != "") & (C("conf") >= min_conf) & (C("width") > 0) & (C("height") > 0))


def read_word_tsv(spark: SparkSession, path: str, min_conf: int = 25) -> DataFrame:
    """OCR TSV files with a header line."""
    text = spark.read.text(path).withColumnRenamed("value", "line").where(~C("line").startswith("level\t"))
    return parse_word_tsv(text, "line", min_conf)


def parse_case_manifest(lines: DataFrame, value: str = "line") -> DataFrame:
    """Pipe-separated cases; comments and blank lines are skipped, the label defaults to the file name."""
    trimmed = lines.withColumn("_t", F.trim(value)).where((C("_t") != "") & ~C("_t").startswith("#"))
    parts = F.transform(F.split("_t", r"\|"), lambda p: F.trim(p))
    label = F.when(F.size(parts) > 2, parts[2]).otherwise(F.regexp_extract(parts[1], r"([^/]*)$", 1))
    return trimmed.select(*[c for c in lines.columns if c != value], label.alias("label"), parts[1].alias("path"))


def parse_trace_lines(lines: DataFrame, schema: str, value: str = "line") -> DataFrame:
    """JSON lines; blank ones are skipped."""
    kept = lines.where(F.trim(value) != "").withColumn("_e", F.from_json(value, schema))
    return kept.select(*[c for c in lines.columns if c != value], "_e.*")


def canonical_cases(files: DataFrame, path: Column, content: Column) -> DataFrame:
    """Every file with the canonical file of its content (smallest path) and the case number of the hash order."""
    hashed = files.select(path.alias("path"), F.sha2(content, 256).alias("hash"))
    cases = hashed.groupBy("hash").agg(F.min("path").alias("canonical"), F.count("*").alias("copies"))
    numbered = row_numbers(cases.withColumn("_all", F.lit(1)), ["_all"], [C("hash")], "case_no").drop("_all")
    return hashed.join(numbered, "hash")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """File inventory with content, for ``canonical_cases``."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def input_support(files: DataFrame, max_file: int, max_batch: int) -> DataFrame:
    """Why each input of a batch is refused, if it is; the batch limit counts every file."""
    totals = files.groupBy("batch").agg(F.sum("size").alias("_total"))
    reason = F.when(~F.lower("extension").isin("png", "jpg", "jpeg", "webp"), "unsupported_extension").when(
        C("size") > max_file, "file_too_large").when(C("_total") > max_batch, "batch_too_large")
    return files.join(totals, "batch").withColumn("reason", reason).drop("_total")
