"""Scalar geometry over every region."""

from pyspark.sql import functions as F

from boxloom.functions import geometry as g
from boxloom.functions import ladders as lad
from boxloom.operators.tiles import tile_grid, to_page
from boxloom.queries.fixture_sql import even, fixture, gap, gapx, gapy, inside, ioa, iou, up
from boxloom.queries.fixtures import catalog_pages, detections, regions
from boxloom.queries.registry import query, sql

KEYS = ("page_id", "region_id")

# a second box per region, moved and grown a little
fixture("twins", """
    SELECT page_id, region_id, partkey, suppkey, {'x': x, 'y': y, 'w': w, 'h': h} AS a,
      {'x': x + suppkey % 40 - 20, 'y': y + partkey % 30 - 15, 'w': w + (partkey % 3) * 8, 'h': h + (suppkey % 3) * 8} AS b
    FROM regions""", "regions")


def A():
    return g.box("")


def B():
    a, part, supp = A(), F.col("partkey"), F.col("suppkey")
    return g.Box(a.x + supp % 40 - 20, a.y + part % 30 - 15, a.w + (part % 3) * 8, a.h + (supp % 3) * 8)


def scalar(name, expr, text, source="twins", table=regions):
    """Register a one-value-per-region query."""
    query(name, sql(source, f"SELECT page_id, region_id, {text} AS value FROM {source}"))(
        lambda spark, sf_dir: table(spark, sf_dir).select(*KEYS, expr(A(), B()).alias("value"))
    )


scalar("p3_iou", lambda a, b: g.iou(a, b), iou("a", "b"))
scalar("p4_containment_ratio", lambda a, b: g.share_of(b, a), ioa("b", "a"))
scalar("p6_gap_distance", lambda a, b: g.gap(g.Box(a.x, a.y, F.lit(8), F.lit(8)), b),
       gap("a", "b").replace("a.w", "8").replace("a.h", "8"))
scalar("p7_euclidean_distance", lambda a, b: g.distance(g.Box(a.x, a.y, F.lit(8), F.lit(8)), g.Box(b.x + b.w, b.y + b.h, b.w, b.h)),
       up("sqrt((pow({}, 2) + pow({}, 2))::DOUBLE)".format(*[
           f("a", "b").replace("a.w", "8").replace("a.h", "8").replace("b.x", "(b.x + b.w)").replace("b.y", "(b.y + b.h)")
           for f in (gapx, gapy)]), 2))


@query("p5_contains_with_tolerance", sql("twins", f"""
    SELECT page_id, region_id, {inside('b', 'a', 0)} AS t0, {inside('b', 'a', 2)} AS t2, {inside('b', 'a', 4)} AS t4 FROM twins"""))
def p5(spark, sf_dir):
    return regions(spark, sf_dir).select(*KEYS, *[g.contains(B(), A(), t).alias(f"t{t}") for t in (0, 2, 4)])


@query("p1_normalize_box", sql("regions", """
    , r AS (SELECT page_id, region_id, greatest(0, least(floor(x * 1.25::DOUBLE - 40.5 + 0.5), 1072)) AS x,
      greatest(0, least(floor(y * 1.1::DOUBLE - 20.25 + 0.5), 1912)) AS y, floor(w * 1.5::DOUBLE + 0.5) AS w0,
      floor(h * 0.06::DOUBLE + 0.5) AS h0 FROM regions)
    SELECT page_id, region_id, x, y, greatest(8, least(w0, 1080 - x)) AS w, greatest(8, least(h0, 1920 - y)) AS h FROM r"""))
def p1(spark, sf_dir):
    raw = g.Box(A().x * 1.25 - 40.5, A().y * 1.1 - 20.25, A().w * 1.5, A().h * 0.06)
    return regions(spark, sf_dir).select(*KEYS, *g.box_columns(g.normalize(raw, 1080, 1920, 8)))


@query("p2_clip_to_page", sql("regions", """
    , r AS (SELECT page_id, region_id, greatest(0, least(x - 40, 900)) AS x, greatest(0, least(y - 60, 1600)) AS y,
      greatest(0, least(x - 40 + w, 900)) AS x2, greatest(0, least(y - 60 + h, 1600)) AS y2 FROM regions)
    SELECT page_id, region_id, x, y, x2 - x AS w, y2 - y AS h FROM r WHERE x2 > x AND y2 > y"""))
def p2(spark, sf_dir):
    clipped = g.clip_to_page(g.Box(A().x - 40, A().y - 60, A().w, A().h), 900, 1600)
    return regions(spark, sf_dir).select(*KEYS, *g.box_columns(clipped)).where("w > 0 AND h > 0")


@query("p8_expand_box", sql("regions", """
    SELECT page_id, region_id, x - 12 AS x, y - 6 AS y, w + 24 AS w, h + 12 AS h FROM regions"""))
def p8(spark, sf_dir):
    return regions(spark, sf_dir).select(*KEYS, *g.box_columns(g.expand(A(), 12, 6)))


@query("p9_oversize_and_padding", sql("twins", f"""
    SELECT page_id, region_id, (b.w * b.h) / (a.w * a.h)::DOUBLE AS oversize,
      least(1.0, {even("(abs((a.x - b.x) - (b.x + b.w - a.x - a.w)) / greatest(1, b.w)::DOUBLE + abs((a.y - b.y) - (b.y + b.h - a.y - a.h)) / greatest(1, b.h)::DOUBLE) / 2", 6)}) AS imbalance
    FROM twins"""))
def p9(spark, sf_dir):
    from boxloom.plans.hierarchy import oversize_ratio, padding_imbalance

    return regions(spark, sf_dir).select(*KEYS, oversize_ratio(B(), A()).alias("oversize"), padding_imbalance(B(), A()).alias("imbalance"))


_TILES = """
    , g AS (SELECT *, CASE WHEN height / greatest(1, width)::DOUBLE >= 1.25 THEN 1 WHEN width / greatest(1, height)::DOUBLE >= 1.25
        THEN 3 ELSE 2 END AS cols, CASE WHEN height / greatest(1, width)::DOUBLE >= 1.25 THEN 6
        WHEN width / greatest(1, height)::DOUBLE >= 1.25 THEN 2 ELSE 3 END AS rows FROM catalog_pages),
    t AS (SELECT *, (tile_no - 1) % cols AS c, (tile_no - 1) // cols AS r FROM (SELECT *, unnest(range(1, 7)) AS tile_no FROM g)),
    e AS (SELECT *, greatest(0, least(floor(c * width / cols::DOUBLE) - CASE WHEN c > 0 THEN 16 ELSE 0 END, greatest(0, width - 1))) AS x,
        greatest(0, least(floor(r * height / rows::DOUBLE) - CASE WHEN r > 0 THEN 16 ELSE 0 END, greatest(0, height - 1))) AS y FROM t),
    tiles AS (SELECT project_id, page_index, tile_no, format('tile_{:04d}', tile_no) AS tile_id, x, y,
        greatest(x + 1, least(ceil((c + 1) * width / cols::DOUBLE) + CASE WHEN c < cols - 1 THEN 16 ELSE 0 END, width)) - x AS w,
        greatest(y + 1, least(ceil((r + 1) * height / rows::DOUBLE) + CASE WHEN r < rows - 1 THEN 16 ELSE 0 END, height)) - y AS h FROM e)"""


@query("p10_tile_grid", sql("catalog_pages", _TILES + "SELECT * FROM tiles"))
def p10(spark, sf_dir):
    return tile_grid(catalog_pages(spark, sf_dir), 6, 32).select("project_id", "page_index", "tile_no", "tile_id", *"xywh")


@query("p11_tile_box_to_page", sql("catalog_pages catalog_slices", _TILES + """
    , sent AS (SELECT *, greatest(1, floor(w * least(1.0, 256.0 / greatest(w, h)) + 0.5)) AS sw,
        greatest(1, floor(h * least(1.0, 256.0 / greatest(w, h)) + 0.5)) AS sh FROM tiles)
    SELECT s.project_id, s.page_index, s.slice_id, t.tile_id, floor(t.x + s.x % 200 * (t.w / t.sw::DOUBLE) + 0.5) AS x,
      floor(t.y + s.y % 200 * (t.h / t.sh::DOUBLE) + 0.5) AS y, floor(s.w * (t.w / t.sw::DOUBLE) + 0.5) AS w,
      floor(s.h * (t.h / t.sh::DOUBLE) + 0.5) AS h
    FROM catalog_slices s JOIN sent t ON s.project_id = t.project_id AND s.page_index = t.page_index
      AND t.tile_no = 1 + s.slice_id % 6"""))
def p11(spark, sf_dir):
    from boxloom.queries.fixtures import catalog_slices

    tiles = tile_grid(catalog_pages(spark, sf_dir), 6, 32)
    ratio = F.least(F.lit(1.0), F.lit(256.0) / F.greatest("w", "h"))
    sent = tiles.select(
        "project_id", "page_index", "tile_no", "tile_id", *[F.col(c).alias("t_" + c) for c in "xywh"],
        F.greatest(F.lit(1), g.half_up(F.col("w") * ratio)).alias("sent_w"),
        F.greatest(F.lit(1), g.half_up(F.col("h") * ratio)).alias("sent_h"),
    )
    found = catalog_slices(spark, sf_dir).selectExpr(
        "project_id", "page_index", "slice_id", "1 + slice_id % 6 AS tile_no", "x % 200 AS x", "y % 200 AS y", "w", "h")
    mapped = to_page(A(), g.box("t_"), F.col("sent_w"), F.col("sent_h"))
    return found.join(sent, ["project_id", "page_index", "tile_no"]).select(
        "project_id", "page_index", "slice_id", "tile_id", *g.box_columns(mapped))


@query("p12_size_gates", sql("detections", """
    , ok AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY region_id) AS rank FROM detections
      WHERE w >= 8 AND h >= 8 AND w * h / 2073600.0 <= 0.82)
    SELECT page_id, region_id, rank FROM ok WHERE rank <= 12"""))
def p12(spark, sf_dir):
    from boxloom.operators.ranking import first_per_group

    sized = detections(spark, sf_dir).where("w >= 8 AND h >= 8 AND w * h / 2073600.0D <= 0.82D")
    return first_per_group(sized, ["page_id"], [F.col("region_id")], 12, "rank").select("page_id", "region_id", "rank")


@query("p18_line_box_fit", sql("twins", """
    , m AS (SELECT page_id, region_id, (b.w * b.h) / (a.w * a.h)::DOUBLE AS ar, b.w / greatest(1, a.w)::DOUBLE AS wr,
      b.h / greatest(1, a.h)::DOUBLE AS hr, greatest(a.y - b.y, b.y + b.h - a.y - a.h) AS over, a.h AS lh FROM twins)
    SELECT page_id, region_id, (hr >= 1.45 AND ar >= 1.55 AND over >= greatest(6, lh * 0.45::DOUBLE)) OR (hr >= 1.32 AND ar >= 1.85)
        OR (wr >= 1.85 AND hr >= 1.12) OR wr >= 2.4 AS broad,
      ar < 0.18 OR (wr < 0.5 AND ar < 0.32) OR (hr < 0.36 AND ar < 0.32) AS small FROM m"""))
def p18(spark, sf_dir):
    return regions(spark, sf_dir).select(*KEYS, lad.too_broad(A(), B()).alias("broad"), lad.too_small(A(), B()).alias("small"))


@query("p27_cut_around_box", sql("twins", f"""
    , i AS (SELECT *, greatest(a.x, b.x) AS ix, greatest(a.y, b.y) AS iy, least(a.x + a.w, b.x + b.w) AS ix2,
        least(a.y + a.h, b.y + b.h) AS iy2 FROM twins),
    p AS (SELECT page_id, region_id, unnest(CASE WHEN ix2 > ix AND iy2 > iy THEN list_filter([
        {{'piece': 1, 'x': a.x, 'y': a.y, 'w': a.w, 'h': iy - a.y}}, {{'piece': 2, 'x': a.x, 'y': iy2, 'w': a.w, 'h': a.y + a.h - iy2}},
        {{'piece': 3, 'x': a.x, 'y': iy, 'w': ix - a.x, 'h': iy2 - iy}},
        {{'piece': 4, 'x': ix2, 'y': iy, 'w': a.x + a.w - ix2, 'h': iy2 - iy}}], lambda q: q.w >= 4 AND q.h >= 4 AND q.w * q.h >= 96)
        ELSE [{{'piece': 0, 'x': a.x, 'y': a.y, 'w': a.w, 'h': a.h}}] END) AS s FROM i)
    SELECT page_id, region_id, s.piece, s.x, s.y, s.w, s.h FROM p"""))
def p27(spark, sf_dir):
    return regions(spark, sf_dir).select(*KEYS, F.explode(lad.cut_around(A(), B())).alias("s")).select(*KEYS, "s.*")


@query("x4_rectangle_hull", sql("regions", """
    SELECT page_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM regions GROUP BY page_id"""))
def x4(spark, sf_dir):
    return regions(spark, sf_dir).groupBy("page_id").agg(*g.hull())
