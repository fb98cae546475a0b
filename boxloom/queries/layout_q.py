"""Design tokens, rows, bands, batches and runs."""

from pyspark.sql import Window, functions as F

from boxloom.functions.color import color_family
from boxloom.functions.geometry import box
from boxloom.operators import banding as bd
from boxloom.operators.tree import walk
from boxloom.plans import text as tp
from boxloom.plans import tokens as tk
from boxloom.queries import fixtures as fx
from boxloom.queries.fixture_sql import even, fixture, up
from boxloom.queries.registry import query, sql

C = F.col

fixture("styled", """
    SELECT s.*, w.path, w.pre FROM style_elements s JOIN pre_walk w USING (tree_id, node_id)""", "style_elements pre_walk")
fixture("pre_walk", """
    SELECT tree_id, node_id, 'root' AS path, []::BIGINT[] AS pre FROM trees WHERE parent_id IS NULL
    UNION ALL SELECT c.tree_id, c.node_id, p.path || '.children[' || c.ord || ']', list_append(p.pre, c.ord) FROM trees c JOIN pre_walk p ON c.tree_id = p.tree_id AND c.parent_id = p.node_id""", "trees")


def styled(spark, sf_dir):
    return walk(fx.style_elements(spark, sf_dir), lists=("path", "preorder"))


def _tokens(uses, key, order):
    cols = ", ".join(key)
    return f"""
        , uses AS ({uses}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY tree_id, {cols} ORDER BY pre, part, path) AS n FROM uses),
        t AS (SELECT tree_id, {cols}, count(*) AS count, string_agg(path, ';' ORDER BY n) FILTER (n <= 12) AS paths FROM ranked GROUP BY tree_id, {cols})
        SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY -count, {order}) AS rank, {cols}, count,
          CASE WHEN count >= 4 THEN 'high' WHEN count >= 2 THEN 'medium' ELSE 'low' END AS confidence, paths FROM t"""


def _flat(df):
    return df.withColumn("paths", F.array_join("paths", ";"))


_HEX = "CASE WHEN regexp_matches(trim({c}), '^#[0-9A-Fa-f]{{6}}$') THEN upper(trim({c})) END"


@query("a4_color_tokens", sql("styled", _tokens(f"""
    SELECT * FROM (SELECT tree_id, pre, 0 AS part, path || '.style.fill' AS path, {_HEX.format(c='fill')} AS value FROM styled
      UNION ALL SELECT tree_id, pre, 1, path || '.style.color', {_HEX.format(c='color')} FROM styled) WHERE value IS NOT NULL""", ["value"], "value"), recursive=True))
def a4(spark, sf_dir):
    return _flat(tk.color_tokens(styled(spark, sf_dir)))


@query("a5_radius_tokens", sql("styled", _tokens("""
    SELECT * FROM (SELECT tree_id, pre, part, path || '.style.radius' AS path, round_even(r, 0)::BIGINT AS value FROM (SELECT tree_id, pre, path, unnest(rs) AS r, unnest(range(len(rs))) AS part
      FROM (SELECT *, CASE WHEN radius IS NOT NULL THEN [radius] ELSE list_filter(corners, lambda c: round_even(c, 0) >= 0) END AS rs FROM styled)))""", ["value"], "value"), recursive=True))
def a5(spark, sf_dir):
    return _flat(tk.radius_tokens(styled(spark, sf_dir)))


_TS = ["font_family", "font_size", "font_weight", "line_height", "color"]


@query("a6_text_style_tokens", sql("styled", _tokens(f"""
    SELECT tree_id, pre, 0 AS part, path, font_family, font_size, font_weight, NULL::BIGINT AS line_height, {_HEX.format(c='color')} AS color FROM styled WHERE type = 'text'""",
    _TS, ", ".join(c + " NULLS FIRST" for c in _TS)), recursive=True))
def a6(spark, sf_dir):
    return _flat(tk.text_style_tokens(styled(spark, sf_dir)))


@query("a7_spacing_tokens", sql("styled", _tokens("""
    SELECT tree_id, pre, 0 AS part, path, axis, value FROM (
      SELECT *, 'horizontal' AS axis, lead(x) OVER (PARTITION BY tree_id, parent_id ORDER BY x, y, node_id) - x - w AS value FROM styled WHERE parent_id IS NOT NULL
      UNION ALL SELECT *, 'vertical', lead(y) OVER (PARTITION BY tree_id, parent_id ORDER BY y, x, node_id) - y - h FROM styled WHERE parent_id IS NOT NULL) WHERE value > 0""",
    ["axis", "value"], "axis, value"), recursive=True))
def a7(spark, sf_dir):
    return _flat(tk.spacing_tokens(styled(spark, sf_dir)))


# first-fit rows: fold over the items of a page in (centre, x, id) order
fixture("row_fold", """
    SELECT page_id, unnest(list_reduce(list([{'cy': 2 * y + h, 'h': h, 'id': region_id, 'row': 1, 'head': true}] ORDER BY 2 * y + h, x, h, region_id), lambda acc, x:
      list_append(acc, {'cy': x[1].cy, 'h': x[1].h, 'id': x[1].id,
        'row': coalesce(list_min(list_transform(list_filter(acc, lambda k: k.head AND abs(x[1].cy - k.cy) <= 2 * greatest(8, least(k.h, x[1].h) * 0.42::DOUBLE)), lambda k: k.row)),
          list_max(list_transform(acc, lambda k: k.row)) + 1),
        'head': len(list_filter(acc, lambda k: k.head AND abs(x[1].cy - k.cy) <= 2 * greatest(8, least(k.h, x[1].h) * 0.42::DOUBLE))) = 0}))) AS r
    FROM regions GROUP BY page_id""", "regions")
fixture("region_rows", "SELECT r.*, f.r.row AS row_no FROM row_fold f JOIN regions r ON f.page_id = r.page_id AND f.r.id = r.region_id", "row_fold regions")


@query("w5_rows_by_centre", sql("region_rows", "SELECT page_id, region_id, row_no FROM region_rows"))
def w5(spark, sf_dir):
    return bd.rows_by_centre(fx.regions(spark, sf_dir), ["page_id"]).select("page_id", "region_id", "row_no")


@query("w6_distinct_tracks", sql("regions", """
    , v AS (SELECT page_id, list_sort(list(DISTINCT 2 * x + w)) AS xs FROM regions GROUP BY page_id)
    SELECT page_id, len(list_reduce(list_transform(xs, lambda v: [v]), lambda acc, v: CASE WHEN v[1] - acc[-1] > 48 THEN list_concat(acc, v) ELSE acc END)) AS tracks FROM v"""))
def w6(spark, sf_dir):
    from boxloom.plans.clusters import track_count

    centres = fx.regions(spark, sf_dir).groupBy("page_id").agg(F.sort_array(F.collect_set(C("x") * 2 + C("w"))).alias("xs"))
    return centres.select("page_id", track_count("xs", F.lit(48)).alias("tracks"))


fixture("sparse", "SELECT page_id, region_id, x, y, w, h FROM regions WHERE kind_no = 1 AND confidence <> 'low'", "regions")
fixture("banded", """
    SELECT *, sum(CASE WHEN y - above >= greatest(96, least(180, 2 * h)) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y, x, region_id) + 1 AS band
    FROM (SELECT *, max(y + h) OVER (PARTITION BY page_id ORDER BY y, x, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM sparse)""", "sparse")


def sparse(spark, sf_dir):
    return fx.regions(spark, sf_dir).where("kind_no = 1 AND confidence <> 'low'").select("page_id", "region_id", "x", "y", "w", "h")


@query("w7_vertical_bands", sql("banded", "SELECT page_id, region_id, band FROM banded"))
def w7(spark, sf_dir):
    return bd.vertical_bands(sparse(spark, sf_dir)).select("page_id", "region_id", "band")


@query("w8_bounded_batches", sql("regions", """
    , b AS (SELECT *, sum(CASE WHEN y - above >= greatest(96, least(180, 2 * h)) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y, x, region_id) + 1 AS band
      FROM (SELECT *, max(y + h) OVER (PARTITION BY page_id ORDER BY y, x, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM regions)),
    f AS (SELECT page_id, band, unnest(list_reduce(list([{'id': region_id, 'y': y, 'b': 1, 'n': 1, 'e': least(1920, y + 300)}] ORDER BY y, x, region_id), lambda acc, x: list_append(acc,
        {'id': x[1].id, 'y': x[1].y, 'b': acc[-1].b + CASE WHEN x[1].y >= acc[-1].e OR acc[-1].n >= 5 THEN 1 ELSE 0 END,
         'n': CASE WHEN x[1].y >= acc[-1].e OR acc[-1].n >= 5 THEN 1 ELSE acc[-1].n + 1 END,
         'e': CASE WHEN x[1].y >= acc[-1].e OR acc[-1].n >= 5 THEN least(1920, greatest(0, x[1].y - 40) + 300) ELSE acc[-1].e END}))) AS r FROM b GROUP BY page_id, band),
    m AS (SELECT page_id, band, coalesce(sum(max(r.b)) OVER (PARTITION BY page_id ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f GROUP BY page_id, band)
    SELECT f.page_id, f.r.id AS region_id, m.start + f.r.b AS batch FROM f JOIN m USING (page_id, band)"""))
def w8(spark, sf_dir):
    return bd.page_batches(fx.regions(spark, sf_dir), fx.PAGE_H, 5, 300, 40)


@query("w9_regular_spacing", sql("region_rows", """
    , g AS (SELECT page_id, row_no, x + w / 2.0 AS cx, lead(x + w / 2.0) OVER (PARTITION BY page_id, row_no ORDER BY x + w / 2.0, region_id) - (x + w / 2.0) AS gap FROM region_rows),
    m AS (SELECT page_id, row_no, count(*) AS n, (max(cx) - min(cx)) / (count(*) - 1) AS a FROM g GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT m.page_id, m.row_no, m.n, a > 0 AND max(abs(gap - a)) <= greatest(18, a * 0.35::DOUBLE) AS regular FROM m JOIN g USING (page_id, row_no) WHERE gap IS NOT NULL GROUP BY m.page_id, m.row_no, m.n, a"""))
def w9(spark, sf_dir):
    return bd.page_regular_rows(fx.regions(spark, sf_dir))


# tile rows of a page that hold the top of some media region
fixture("row_flags", """
    SELECT p.page_id, p.idx, m.page_id IS NOT NULL AS value FROM (SELECT page_id, unnest(range(0, 80)) AS idx FROM (SELECT DISTINCT page_id FROM regions)) p
    LEFT JOIN (SELECT DISTINCT page_id, unnest(range(y // 24, (y + h) // 24 + 1)) AS idx FROM regions WHERE kind_no = 1) m ON p.page_id = m.page_id AND p.idx = m.idx""", "regions")


def row_flags(spark, sf_dir):
    regions = fx.regions(spark, sf_dir)
    rows = regions.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(79).cast("bigint"))).alias("idx"))
    hit = regions.where("kind_no = 1").select("page_id", F.explode(F.expr("sequence(y div 24, (y + h) div 24)")).alias("idx")).distinct().withColumn("value", F.lit(True))
    return rows.join(hit, ["page_id", "idx"], "left").fillna(False, ["value"])


@query("w13_media_spans", sql("row_flags", """
    , r AS (SELECT page_id, idx - row_number() OVER (PARTITION BY page_id ORDER BY idx) AS g, idx FROM row_flags WHERE value),
    s AS (SELECT page_id, min(idx) AS start, max(idx) + 1 AS "end" FROM r GROUP BY page_id, g HAVING count(*) >= 2),
    c AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY page_id ORDER BY start) > 3 THEN 1 ELSE 0 END AS cut FROM s),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY page_id ORDER BY start) AS island FROM c)
    SELECT page_id, min(start) AS start, max("end") AS "end" FROM i GROUP BY page_id, island"""))
def w13(spark, sf_dir):
    return bd.spans(row_flags(spark, sf_dir), 2, 3)


@query("w13_closed_runs", sql("row_flags", """
    , n AS (SELECT *, CASE WHEN value <> lag(value) OVER w THEN 1 ELSE 0 END AS new FROM row_flags WINDOW w AS (PARTITION BY page_id ORDER BY idx)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY idx) AS run FROM n)
    SELECT page_id, idx, value OR count(*) OVER (PARTITION BY page_id, run) <= 3 AS value FROM r"""))
def w13_closed(spark, sf_dir):
    return bd.close_gaps(row_flags(spark, sf_dir), 3)


# text layers with a font size, family, script and colour
_TEXT = ("page_id, region_id, x, y, w, h, 10 + (score_milli % 7) + (h {d} 16) AS font_size, concat('F', suppkey % 2) AS family, "
         "CASE suppkey % 5 WHEN 0 THEN 'cjk' WHEN 1 THEN NULL ELSE 'latin' END AS script, "
         "CASE WHEN partkey % 2 = 0 THEN '#101010' ELSE '#2040F0' END AS color")
fixture("text_layers", "SELECT " + _TEXT.format(d="//") + " FROM regions WHERE kind_no <= 2", "regions")


@query("a27_harmonized_sizes", sql("text_layers", f"""
    , f AS (SELECT page_id, unnest(list_reduce(list([{{'cy': 2 * y + h, 'h': h, 'id': region_id, 'row': 1, 'head': true}}] ORDER BY 2 * y + h, x, h, region_id), lambda acc, x:
      list_append(acc, {{'cy': x[1].cy, 'h': x[1].h, 'id': x[1].id,
        'row': coalesce(list_min(list_transform(list_filter(acc, lambda k: k.head AND abs(x[1].cy - k.cy) <= 2 * greatest(8, least(k.h, x[1].h) * 0.42::DOUBLE)), lambda k: k.row)),
          list_max(list_transform(acc, lambda k: k.row)) + 1),
        'head': len(list_filter(acc, lambda k: k.head AND abs(x[1].cy - k.cy) <= 2 * greatest(8, least(k.h, x[1].h) * 0.42::DOUBLE))) = 0}}))) AS r FROM text_layers GROUP BY page_id),
    t AS (SELECT l.*, f.r.row AS row_no, count(*) OVER (PARTITION BY l.page_id, f.r.row) AS in_row, CASE color WHEN '#101010' THEN 'neutral' ELSE 'blue' END AS tone, coalesce(script, '') AS sc
      FROM text_layers l JOIN f ON l.page_id = f.page_id AND l.region_id = f.r.id),
    c AS (SELECT *, count(*) OVER (PARTITION BY page_id, row_no, family, sc, tone) AS n FROM t WHERE in_row >= 3),
    s AS (SELECT page_id, row_no, family, sc, tone, font_size, count(*) AS k FROM c WHERE n >= 3 GROUP BY ALL),
    m AS (SELECT page_id, row_no, family, sc, tone, max(k) AS best FROM s GROUP BY ALL),
    mode AS (SELECT s.page_id, s.row_no, s.family, s.sc, s.tone, floor(median(s.font_size) + 0.5) AS mode FROM s JOIN m USING (page_id, row_no, family, sc, tone) WHERE s.k = m.best GROUP BY ALL),
    e AS (SELECT c.page_id, c.region_id, c.font_size, mode.mode, count(*) OVER (PARTITION BY c.page_id, c.row_no, c.family, c.sc, c.tone) AS eligible
      FROM c JOIN mode USING (page_id, row_no, family, sc, tone) WHERE c.n >= 3 AND abs(c.font_size - mode.mode) <= greatest(3, least(6, floor(mode.mode * 0.18::DOUBLE + 0.5))))
    SELECT page_id, region_id, font_size, mode AS new_size FROM e WHERE eligible >= 2 AND font_size <> mode"""))
def a27(spark, sf_dir):
    layers = spark.sql("SELECT " + _TEXT.format(d="div") + " FROM {t} WHERE kind_no <= 2", t=fx.regions(spark, sf_dir))
    return tp.page_harmonized_sizes(layers.withColumn("tone", color_family(C("color"))))


@query("a26_scale_profile", sql("text_lines", """
    , h AS (SELECT page_id, median(h) AS m, count(*) AS n FROM text_lines WHERE conf >= 50 AND h BETWEEN 6 AND 96 AND w / greatest(1, h)::DOUBLE <= 18 GROUP BY page_id),
    p AS (SELECT p.page_id, coalesce(h.m, 0)::DOUBLE AS text_unit, coalesce(h.n, 0) AS samples, 24.0::DOUBLE AS fallback FROM (SELECT DISTINCT page_id FROM text_lines) p LEFT JOIN h USING (page_id))
    SELECT page_id, text_unit, samples, greatest(8::DOUBLE, least(64::DOUBLE, CASE WHEN text_unit <= 0 THEN fallback WHEN greatest(text_unit, fallback) / greatest(1, least(text_unit, fallback)) > 2.2
      THEN text_unit * 0.75::DOUBLE + fallback * 0.25::DOUBLE ELSE (text_unit + fallback) / 2 END)) AS basis FROM p"""))
def a26(spark, sf_dir):
    return tp.scale_profile(fx.text_lines(spark, sf_dir), F.lit(24.0))
