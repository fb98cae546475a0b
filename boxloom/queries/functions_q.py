"""Text, colour, id and hash functions over whole texts and tables."""

from pyspark.sql import functions as F

from boxloom.functions import color as col
from boxloom.functions import text as tx
from boxloom.functions.geometry import box
from boxloom.queries.fixture_sql import fixture
from boxloom.queries.fixtures import catalog_slices, style_elements, table
from boxloom.queries.registry import query, sql

C = F.col

# DuckDB spelling of the script class (the given texts use Han, kana and Hangul inside these blocks)
CJK_SQL = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"


def _n(pattern, text="t"):
    return f"(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')))"


_SCRIPT = f"CASE WHEN regexp_matches(text, '{CJK_SQL}') AND regexp_matches(text, '[A-Za-z0-9]') THEN 'mixed' WHEN regexp_matches(text, '{CJK_SQL}') THEN 'cjk' ELSE 'latin' END"
_WS = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_PARTS = [(_WS, 0.32), (CJK_SQL, 1.0), ("[0-9]", 0.58), ("[A-Z]", 0.66), ("[a-z]", 0.56), ("[￥¥$%]", 0.62)]
_UNITS = ("greatest(1.0::DOUBLE, (" + " + ".join(f"{_n(p)} * {round((u - 0.42) * 100)}" for p, u in _PARTS)
          + " + length(t) * 42) / 100.0::DOUBLE)")
fixture("measured", f"SELECT doc_id, n_chars, text, {_SCRIPT} AS script, {_UNITS} AS units FROM (SELECT *, trim(text, ' ') AS t FROM documents)")


def measured(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", "text", tx.script_class(C("text")).alias("script"), tx.visual_units(C("text")).alias("units"))


@query("f1_script_class", sql("measured", "SELECT doc_id, script FROM measured"))
def f1(spark, sf_dir):
    return measured(spark, sf_dir).select("doc_id", "script")


@query("f2_visual_units", sql("measured", "SELECT doc_id, round(units, 4) AS units FROM measured"))
def f2(spark, sf_dir):
    return measured(spark, sf_dir).select("doc_id", F.round("units", 4).alias("units"))


@query("f3_text_size", sql("measured", """
    , m AS (SELECT *, 10 + n_chars % 30 AS size FROM measured)
    SELECT doc_id, ceil(greatest(size::DOUBLE, units * size)) AS width,
      ceil(size * CASE script WHEN 'latin' THEN 0.78 WHEN 'mixed' THEN 0.86 ELSE 0.84 END::DOUBLE) AS height,
      ceil(greatest(size::DOUBLE, units * size) * CASE script WHEN 'latin' THEN 1.18 WHEN 'mixed' THEN 1.26 ELSE 1.22 END::DOUBLE
        + greatest(6, floor(size * 0.48::DOUBLE + 0.5))) AS no_wrap FROM m"""))
def f3(spark, sf_dir):
    size = 10 + C("n_chars") % 30
    return measured(spark, sf_dir).select(
        "doc_id", F.ceil(tx.rendered_width(C("units"), size)).alias("width"), tx.measured_height(C("script"), size).alias("height"),
        tx.no_wrap_width(C("units"), C("script"), size).alias("no_wrap"))


@query("f4_fit_font_size", sql("catalog_slices", """
    , m AS (SELECT *, greatest(1.0::DOUBLE, {units}) AS units,
        greatest(8, least(floor(h * 0.8::DOUBLE + 0.5), 55)) AS top, greatest(1, floor(w * 0.98::DOUBLE + 0.5)) AS wide,
        greatest(1, floor(h * 0.98::DOUBLE + 0.5)) AS tall FROM (SELECT *, trim(name) AS t FROM catalog_slices))
    SELECT project_id, slice_id, coalesce(list_max(list_filter(range(8, top::BIGINT + 1), lambda s:
      ceil(greatest(s::DOUBLE, units * s)) <= wide AND ceil(s * 0.78::DOUBLE) <= tall)), 8) AS size FROM m""".replace("{units}", _UNITS)))
def f4(spark, sf_dir):
    return tx.with_font_size(catalog_slices(spark, sf_dir), C("name"), box(), "size").select("project_id", "slice_id", "size")


@query("f5_marker_label", sql("", r"""
    SELECT p_partkey, regexp_matches(regexp_replace(trim(label), '[()［］\[\]{}]', '', 'g'), '(?i)^(img|lmg|ing)[-_]?[0-9]{1,4}$')
      OR regexp_matches(regexp_replace(trim(label), '[()［］\[\]{}]', '', 'g'), '(?i)^[gm][-_]?[0-9]{1,4}$') AS marker
    FROM (SELECT p_partkey, concat(['img-', 'LMG_', '(g)', 'M-', 'icon ', 'ing'][1 + p_partkey % 6], p_partkey * 7) AS label FROM part)"""))
def f5(spark, sf_dir):
    heads = F.array(*[F.lit(v) for v in ("img-", "LMG_", "(g)", "M-", "icon ", "ing")])
    label = F.concat(F.element_at(heads, (C("p_partkey") % 6 + 1).cast("int")), (C("p_partkey") * 7).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.looks_like_marker(label).alias("marker"))


_RGB = "('0x' || substr(fill, {s}, 2))::INT"
fixture("painted", """
    SELECT tree_id, node_id, fill, CASE WHEN ok THEN ('0x' || substr(fill, 2, 2))::INT END AS r,
      CASE WHEN ok THEN ('0x' || substr(fill, 4, 2))::INT END AS g, CASE WHEN ok THEN ('0x' || substr(fill, 6, 2))::INT END AS b
    FROM (SELECT tree_id, node_id, fill, regexp_matches(fill, '^#[0-9A-Fa-f]{6}$') AS ok FROM style_elements)""", "style_elements")


@query("f6_color_family", sql("painted", """
    SELECT tree_id, node_id, CASE WHEN r IS NULL THEN 'unknown' WHEN greatest(r, g, b) - least(r, g, b) < 28 THEN 'neutral'
      WHEN b >= r + 28 AND b >= g + 16 THEN 'blue' WHEN g >= r + 18 AND g >= b + 18 THEN 'green'
      WHEN r >= g + 18 AND r >= b + 18 THEN 'red_or_orange' ELSE 'chromatic' END AS family FROM painted"""))
def f6(spark, sf_dir):
    return style_elements(spark, sf_dir).select("tree_id", "node_id", col.color_family(C("fill")).alias("family"))


@query("f7_normal_hex", sql("style_elements", """
    SELECT tree_id, node_id, CASE WHEN regexp_matches(trim(fill), '^#[0-9A-Fa-f]{6}$') THEN upper(trim(fill)) END AS hex FROM style_elements"""))
def f7(spark, sf_dir):
    return style_elements(spark, sf_dir).select("tree_id", "node_id", col.normal_hex(C("fill")).alias("hex"))


@query("f8_slug", sql("", r"""
    SELECT doc_id, substr(regexp_replace(regexp_replace(trim(text, ' '), '[^\p{L}\p{N}_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug FROM documents"""))
def f8(spark, sf_dir):
    """Letters beyond ASCII are kept as they are here; ``slug_any`` also decomposes them."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.slug(C("text")).alias("slug"))


@query("f8_slug_decomposed")
def f8_any(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.slug_any(C("text")).alias("slug"))


@query("f9_safe_ids", sql("", """
    SELECT p_partkey, regexp_matches(id, '^[A-Za-z0-9_-]+$') AS safe, regexp_matches(id, '^[A-Za-z0-9_-]+(__[A-Za-z0-9_-]+)*$') AS safe_slice
    FROM (SELECT p_partkey, replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN '__' WHEN p_partkey % 3 = 1 THEN '/' ELSE '-' END) AS id FROM part)"""))
def f9(spark, sf_dir):
    ids = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN '__' WHEN p_partkey % 3 = 1 THEN '/' ELSE '-' END) AS id")
    return ids.select("p_partkey", tx.safe_id(C("id")).alias("safe"), tx.safe_slice_id(C("id")).alias("safe_slice"))


@query("f10_content_hash", sql("", "SELECT doc_id, substr(sha256(text), 1, 32) AS hash FROM documents"))
def f10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(C("text")).alias("hash"))


@query("f13_color_distance", sql("painted", """
    SELECT tree_id, node_id, sqrt(((r - 255) * (r - 255) + (g - 128) * (g - 128) + b * b)::DOUBLE) AS distance,
      r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE AS luma FROM painted WHERE r IS NOT NULL"""))
def f13(spark, sf_dir):
    rgb = col.channels(C("fill"))
    return style_elements(spark, sf_dir).where(C("fill").rlike("^#[0-9A-Fa-f]{6}$")).select(
        "tree_id", "node_id", col.color_distance(rgb, (F.lit(255), F.lit(128), F.lit(0))).alias("distance"), col.luma(rgb).alias("luma"))


@query("f14_single_token", sql("ocr_words", r"""
    SELECT page_id, pos, length(text) <= 1 OR regexp_matches(text, '^[\p{Nd}!-/:-@\[-`{-~￥¥%元人课分秒时天月年]*$') AS single FROM ocr_words"""))
def f14(spark, sf_dir):
    from boxloom.queries.fixtures import ocr_words

    return ocr_words(spark, sf_dir).select("page_id", "pos", tx.single_token_like(C("text")).alias("single"))


@query("f15_ordered_unique", sql("", """
    , u AS (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
      FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)) GROUP BY doc_id, w)
    SELECT doc_id, sha256(string_agg(w, ' ' ORDER BY i)) AS words, count(*) AS n FROM u GROUP BY doc_id""".replace(", u AS", "WITH u AS", 1)))
def f15(spark, sf_dir):
    unique = F.array_distinct(F.split("text", " "))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(F.array_join(unique, " "), 256).alias("words"), F.size(unique).cast("bigint").alias("n"))


@query("f16_normal_email", sql("", """
    SELECT c_custkey, lower(trim(concat(' ', replace(c_name, '#', '.'), '@Example.COM '))) AS email FROM customer"""))
def f16(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.COM "))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.normal_email(raw).alias("email"))
