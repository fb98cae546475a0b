"""Parsing of derived text in the source formats, and raster statistics."""

from pyspark.sql import Column, functions as F

from boxloom.functions.geometry import half_even
from boxloom.operators import raster as ra
from boxloom.plans import text as tp
from boxloom.queries import fixtures as fx
from boxloom.queries.fixture_sql import even, fixture
from boxloom.queries.fixtures import table
from boxloom.queries.registry import query, sql
from boxloom.sources import ingest as ing

C = F.col

_BOX_JSON = "concat('{{\"x\":', {x}, ',\"y\":\"', y, '\",\"width\":', w, ',\"height\":', h, ',\"label\":\" ', visual_kind, ' ', repeat('n', CAST(score_milli % 100 AS INT)), '\",\"confidence\":', score_milli, 'e-3}}')"


def answers(spark, sf_dir):
    """One model answer per region: plain, fenced, wrapped in prose, cut short or without boxes."""
    one, two = _BOX_JSON.format(x="x"), _BOX_JSON.format(x="x + 3")
    body = f"concat('{{\"boxes\":[', {one}, CASE WHEN partkey % 2 = 0 THEN concat(',', {two}) ELSE '' END, ']}}')"
    return fx.regions(spark, sf_dir).selectExpr("page_id", "region_id", f"{body} AS body", "suppkey").selectExpr(
        "page_id", "region_id",
        "CASE suppkey % 5 WHEN 0 THEN concat('```json\\n', body, '\\n```') WHEN 1 THEN concat('Here you go: ', body, ' Done.') "
        "WHEN 2 THEN left(body, length(body) - 2) WHEN 3 THEN replace(body, 'boxes', 'items') ELSE body END AS answer")


@query("src2_parse_model_answers", sql("regions", """
    , a AS (SELECT page_id, region_id, suppkey % 5 AS form, CASE WHEN suppkey % 5 IN (2, 3) THEN 1 WHEN partkey % 2 = 0 THEN 2 ELSE 1 END AS n, x, y, w, h, visual_kind, score_milli FROM regions),
    b AS (SELECT *, unnest(range(n)) AS i FROM a)
    SELECT page_id, region_id, CASE form WHEN 2 THEN 'json_parse_error' WHEN 3 THEN 'boxes_missing' ELSE '' END AS error, CASE WHEN form NOT IN (2, 3) THEN i END AS ord,
      CASE WHEN form NOT IN (2, 3) THEN (x + 3 * i)::DOUBLE END AS x, CASE WHEN form NOT IN (2, 3) THEN y::DOUBLE END AS y, CASE WHEN form NOT IN (2, 3) THEN w::DOUBLE END AS w,
      CASE WHEN form NOT IN (2, 3) THEN h::DOUBLE END AS h, CASE WHEN form NOT IN (2, 3) THEN substr(trim(visual_kind || ' ' || repeat('n', score_milli % 100)), 1, 80) END AS name,
      CASE WHEN form NOT IN (2, 3) THEN score_milli / 1000.0 END AS confidence, NULL::VARCHAR AS reason FROM b"""))
def src2(spark, sf_dir):
    return ing.parse_answers(answers(spark, sf_dir))


@query("src3_parse_ocr_arrays", sql("ocr_words", """
    SELECT page_id, pos // 24 AS part, (pos % 24) AS ord, text, x, y, CASE WHEN pos % 5 = 0 THEN w + 2 ELSE w END AS w, h, conf
    FROM ocr_words WHERE conf >= 70"""))
def src3(spark, sf_dir):
    words = fx.ocr_words(spark, sf_dir, dealt=True)
    # payloads of 24 words, in the parallel-array form of the OCR service; the words of a page are in one task, so nothing is sent
    grouped = words.groupBy("page_id", F.expr("pos div 24").alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", "text", "conf", *"xywh"))).alias("r"))

    def numbers(*values) -> Column:
        return F.array(*[v.cast("double") for v in values])

    def box(r: Column) -> Column:
        return F.when(r["pos"] % 5 != 0, numbers(r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"]))

    def polygon(r: Column) -> Column:
        return F.array(numbers(r["x"], r["y"]), numbers(r["x"] + r["w"] + 2, r["y"]), numbers(r["x"], r["y"] + r["h"]))

    payload = F.to_json(F.struct(C("r.text").alias("rec_texts"), F.transform("r", lambda r: r["conf"] / 100).alias("rec_scores"), F.transform("r", box).alias("rec_boxes"),
                                 F.transform("r", polygon).alias("rec_polys")), {"ignoreNullFields": "false"})
    return ing.parse_ocr_arrays(grouped.select("page_id", "part", payload.alias("payload")))


@query("src4_parse_word_tsv", sql("ocr_words", """
    SELECT page_id, block AS block_num, line AS line_num, word AS word_num, x AS "left", y AS top, w AS width, h AS height, conf, text
    FROM ocr_words WHERE conf >= 25 AND pos % 9 <> 0"""))
def src4(spark, sf_dir):
    lines = fx.ocr_words(spark, sf_dir).select("page_id", F.concat_ws(
        "\t", F.when(C("pos") % 9 == 0, "4").otherwise("5"), F.lit("1"), *[C(c).cast("string") for c in ("block", "par", "line", "word", "x", "y", "w", "h", "conf")], "text").alias("line"))
    return ing.parse_word_tsv(lines).select("page_id", "block_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


@query("a2_words_to_lines", sql("ocr_words", r"""
    , g AS (SELECT *, regexp_matches(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]') AS cjk FROM ocr_words WHERE conf >= 25 AND trim(text, ' ') <> ''),
    l AS (SELECT *, CASE WHEN lag(pos) OVER w IS NOT NULL AND NOT lag(cjk) OVER w AND NOT cjk AND x - (lag(x) OVER w + lag(w) OVER w) > greatest(2, least(lag(h) OVER w, h) * 0.2)
      THEN ' ' ELSE '' END || text AS piece FROM g WINDOW w AS (PARTITION BY page_id, block, par, line ORDER BY word, x, pos))
    SELECT page_id, block, par, line, trim(string_agg(piece, '' ORDER BY word, x, pos), ' ') AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h,
      floor(avg(conf) + 0.5) AS conf, count(*) AS n FROM l GROUP BY page_id, block, par, line"""))
def a2(spark, sf_dir):
    return tp.lines_from_words(fx.ocr_words(spark, sf_dir))


@query("src5_case_manifest", sql("", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE concat(replace(p_name, ' ', '_'), '.json') END AS label, concat('trees/', replace(p_name, ' ', '_'), '.json') AS path
    FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0"""))
def src5(spark, sf_dir):
    lines = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 7 = 0 THEN '# note' WHEN p_partkey % 11 = 0 THEN '  ' ELSE concat(' ref | trees/', replace(p_name, ' ', '_'), '.json ', "
        "CASE WHEN p_partkey % 3 = 0 THEN concat('| ', p_type) ELSE '' END) END AS line")
    return ing.parse_case_manifest(lines)


@query("src6_trace_lines", sql("", """
    SELECT event_id AS id, event_type AS decision, (props->>'$.k')::BIGINT AS k FROM events WHERE event_id % 13 <> 0"""))
def src6(spark, sf_dir):
    lines = table(spark, sf_dir, "events").selectExpr(
        "CASE WHEN event_id % 13 = 0 THEN '   ' ELSE concat('{\"id\":', event_id, ',\"decision\":\"', event_type, '\",\"props\":', props, '}') END AS line")
    return ing.parse_trace_lines(lines, "id bigint, decision string, props struct<k:bigint>").select("id", "decision", "props.k")


@query("src7_canonical_cases", sql("", """
    WITH h AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents), c AS (SELECT hash, min(path) AS canonical, count(*) AS copies, row_number() OVER (ORDER BY hash) AS case_no FROM h GROUP BY hash)
    SELECT * FROM h JOIN c USING (hash)"""))
def src7(spark, sf_dir):
    return ing.canonical_cases(table(spark, sf_dir, "documents"), C("doc_id"), C("text"))


@query("src8_supported_inputs", sql("", """
    WITH f AS (SELECT doc_id, doc_id // 20 AS batch, CASE doc_id % 6 WHEN 0 THEN 'PNG' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' ELSE 'jpeg' END AS extension, n_chars AS size FROM documents)
    SELECT doc_id, batch, CASE WHEN lower(extension) NOT IN ('png', 'jpg', 'jpeg', 'webp') THEN 'unsupported_extension' WHEN size > 8000 THEN 'file_too_large'
      WHEN sum(size) OVER (PARTITION BY batch) > 40000 THEN 'batch_too_large' END AS reason FROM f"""))
def src8(spark, sf_dir):
    files = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "doc_id div 20 AS batch", "CASE doc_id % 6 WHEN 0 THEN 'PNG' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' ELSE 'jpeg' END AS extension", "n_chars AS size")
    return ing.input_support(files, 8000, 40000).select("doc_id", "batch", "reason")


@query("snk4_slice_snapshot", sql("catalog_slices catalog_pages", """
    , j AS (SELECT s.*, p.width, p.height FROM catalog_slices s JOIN catalog_pages p USING (project_id, page_index)),
    n AS (SELECT *, greatest(0, least(x, greatest(0, width - 8))) AS nx, greatest(0, least(y, greatest(0, height - 8))) AS ny FROM j)
    SELECT project_id, page_index, slice_id, name, CASE WHEN cut_mode IN ('shape', 'subject') THEN 'subject' WHEN cut_mode = 'card' THEN 'card' ELSE 'rect' END AS cut_mode, nx AS x, ny AS y,
      greatest(8, least(w, width - nx)) AS w, greatest(8, least(h, height - ny)) AS h FROM n"""))
def snk4(spark, sf_dir):
    """Rows of the per-project snapshot; ``save_slices`` stores them as a new version."""
    from boxloom.sources.sinks import snapshot

    return snapshot(fx.catalog_slices(spark, sf_dir), fx.catalog_pages(spark, sf_dir))


@query("snk3_case_summary", sql("cases", "SELECT case_id, lang, source, status, visible, conflicts, nodes, elapsed_ms, true AS csv_agrees FROM cases"))
def snk3(spark, sf_dir):
    """Case summary written as JSON and CSV and read back."""
    from boxloom.session import shared_folder
    from boxloom.sources.sinks import summary_round_trip

    rows = fx.cases(spark, sf_dir).select("case_id", "lang", "source", "status", "visible", "conflicts", "nodes", "elapsed_ms")
    return summary_round_trip(rows, shared_folder(spark, "summary"))


# 16 x 16 pixels per document, coloured from the document's own numbers
_PIX = ("(x * 7 + y * 13 + page_id * 29 + n_chars) % 256 AS r, (x * x + y * 5 + page_id) % 256 AS g, (x * y + n_chars * 3) % 256 AS b")
fixture("pixels", f"SELECT page_id, x, y, {_PIX} FROM (SELECT doc_id AS page_id, n_chars, x, unnest(range(16)) AS y FROM (SELECT *, unnest(range(16)) AS x FROM documents))")


def pixels(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS page_id", "n_chars", "explode(sequence(0L, 15L)) AS x").selectExpr(
        "*", "explode(sequence(0L, 15L)) AS y").selectExpr("page_id", "x", "y", *_PIX.split(", "))


@query("r1_background", sql("pixels", """
    , e AS (SELECT page_id, r, g, b FROM pixels WHERE y = 0 UNION ALL SELECT page_id, r, g, b FROM pixels WHERE y = 15 UNION ALL SELECT page_id, r, g, b FROM pixels WHERE x = 0
      UNION ALL SELECT page_id, r, g, b FROM pixels WHERE x = 15),
    m AS (SELECT page_id, list_sort(list(r))[1 + count(*) // 2] AS r, list_sort(list(g))[1 + count(*) // 2] AS g, list_sort(list(b))[1 + count(*) // 2] AS b FROM e GROUP BY page_id),
    d AS (SELECT e.page_id, list_sort(list((e.r - m.r) * (e.r - m.r) + (e.g - m.g) * (e.g - m.g) + (e.b - m.b) * (e.b - m.b)))[1 + floor((count(*) - 1) * 0.95 + 0.5)::INT] AS d2
      FROM e JOIN m USING (page_id) GROUP BY e.page_id)
    SELECT m.*, greatest(18::DOUBLE, least(52::DOUBLE, greatest(18::DOUBLE, sqrt(d2::DOUBLE) * 2.2::DOUBLE))) AS threshold FROM m JOIN d USING (page_id)"""))
def r1(spark, sf_dir):
    return ra.background(pixels(spark, sf_dir), 16, 16)


@query("r2_dominant_color", sql("pixels", """
    , k AS (SELECT *, floor(r / 20.0 + 0.5) AS kr, floor(g / 20.0 + 0.5) AS kg, floor(b / 20.0 + 0.5) AS kb FROM pixels),
    s AS (SELECT page_id, kr, kg, kb, count(*) AS n, min(y * 16 + x) AS seen FROM k GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, seen) AS o FROM s)
    SELECT k.page_id, list_sort(list(r))[1 + count(*) // 2] AS r, list_sort(list(g))[1 + count(*) // 2] AS g, list_sort(list(b))[1 + count(*) // 2] AS b, count(*) AS pixels
    FROM k JOIN t USING (page_id, kr, kg, kb) WHERE o = 1 GROUP BY k.page_id"""))
def r2(spark, sf_dir):
    return ra.dominant_color(pixels(spark, sf_dir))


fixture("tiles8", """
    SELECT *, texture * 0.32::DOUBLE + edge * 0.28::DOUBLE + entropy * 0.25::DOUBLE + variety * 0.15::DOUBLE AS raster FROM (
    SELECT b.page_id, b.tr, b.tc, greatest(0, least(1, (sqrt(v) - 6) / 44)) AS texture, greatest(0, least(1, (coalesce(gx, 0) + coalesce(gy, 0)) / 48000)) AS edge,
      greatest(0, least(1, ent / 4)) AS entropy, greatest(0, least(1, (u - 1) / 24.0)) AS variety, top / n::DOUBLE AS dominant
    FROM (SELECT page_id, tr, tc, count(*) AS n, avg(dx) AS gx, avg(dy) AS gy, (var_pop(r) + var_pop(g) + var_pop(b)) / 3 AS v FROM tp GROUP BY 1, 2, 3) b
    JOIN (SELECT page_id, tr, tc, -sum(k / 64.0::DOUBLE * log2(k / 64.0::DOUBLE)) AS ent FROM (SELECT page_id, tr, tc, gray // 16000 AS bin, count(*) AS k FROM tp GROUP BY ALL) GROUP BY 1, 2, 3) e USING (page_id, tr, tc)
    JOIN (SELECT page_id, tr, tc, count(*) AS u, max(k) AS top FROM (SELECT page_id, tr, tc, r // 32 AS a, g // 32 AS c, b // 32 AS d, count(*) AS k FROM tp GROUP BY ALL) GROUP BY 1, 2, 3) c USING (page_id, tr, tc))""", "tp")
fixture("tp", """
    SELECT *, abs(lead(gray) OVER (PARTITION BY page_id, tr, tc, y ORDER BY x) - gray) AS dx, abs(lead(gray) OVER (PARTITION BY page_id, tr, tc, x ORDER BY y) - gray) AS dy
    FROM (SELECT *, y // 8 AS tr, x // 8 AS tc, r * 299 + g * 587 + b * 114 AS gray FROM pixels)""", "pixels")
_SCORES = ("texture", "edge", "entropy", "variety", "dominant", "raster")


@query("r3_tile_maps", sql("tiles8", "SELECT page_id, tr, tc, " + ", ".join(f"{even(c, 6)} AS {c}" for c in _SCORES) + " FROM tiles8"))
def r3(spark, sf_dir):
    return ra.tile_maps(pixels(spark, sf_dir), 8).select("page_id", "tr", "tc", *[half_even(C(c), 6).alias(c) for c in _SCORES])


_SMALL = "tree_id AS page_id, node_id AS region_id, x * 16 {d} 1080 AS x, y * 16 {d} 1920 AS y, 1 + w {d} 16 AS w, 1 + h {d} 12 AS h"


@query("r4_region_scores", sql("tiles8 trees", f"""
    , k AS (SELECT {_SMALL.format(d='//')} FROM trees), s AS (SELECT *, least(2, y // 8) AS r1, least(2, x // 8) AS c1 FROM k),
    e AS (SELECT page_id, region_id, tr, unnest(range(c1, greatest(c1 + 1, least(2, ceil((x + w) / 8.0)::BIGINT)))) AS tc FROM
      (SELECT *, unnest(range(r1, greatest(r1 + 1, least(2, ceil((y + h) / 8.0)::BIGINT)))) AS tr FROM s))
    SELECT e.page_id, e.region_id, """ + ", ".join(f"{even(f'avg({c})', 5)} AS {c}" for c in _SCORES) + " FROM e JOIN tiles8 USING (page_id, tr, tc) GROUP BY 1, 2"))
def r4(spark, sf_dir):
    boxes = fx.trees(spark, sf_dir).selectExpr(*_SMALL.format(d="div").split(", "))
    scores = ra.region_scores(boxes, ra.tile_maps(pixels(spark, sf_dir), 8), 8, 2, 2)
    return scores.select("page_id", "region_id", *[half_even(C(c), 5).alias(c) for c in _SCORES])


@query("r5_pixel_difference", sql("pixels", f"""
    , d AS (SELECT page_id, y % 5 = 0 AS masked, CASE WHEN (x + y) % 9 = 0 THEN 3 + 12 * (x % 2) ELSE 0 END AS e FROM pixels)
    SELECT page_id, count(*) AS pixels, {even('sum(e) / (count(*) * 3)::DOUBLE', 4)} AS mean_error, {even('count(*) FILTER (e > 10) / count(*)::DOUBLE', 6)} AS changed,
      count(*) FILTER (NOT masked) AS free_pixels, {even('sum(e) FILTER (NOT masked) / (count(*) FILTER (NOT masked) * 3)::DOUBLE', 4)} AS free_mean_error,
      {even('count(*) FILTER (e > 10 AND NOT masked) / count(*) FILTER (NOT masked)::DOUBLE', 6)} AS free_changed, max(e) AS max_error FROM d GROUP BY page_id"""))
def r5(spark, sf_dir):
    source = pixels(spark, sf_dir)
    rendered = source.withColumn("r", F.expr("CASE WHEN (x + y) % 9 = 0 THEN r + 3 + 12 * (x % 2) ELSE r END"))
    return ra.pixel_difference(source, rendered, C("y") % 5 == 0)
