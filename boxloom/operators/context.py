"""Regions in context: neighbours, anchors, owners, clipping and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxloom.functions.geometry import Box, axis_gaps, box, contains, gap, half_even, overlap, share_of
from boxloom.functions.ladders import ladder, reasons
from boxloom.operators.matching import attach
from boxloom.operators.ranking import first_per_group
from boxloom.operators.spatial import near_pairs, self_pairs

C = F.col
A, B = (lambda: box("a_")), (lambda: box("b_"))
KEY = ["page_id", "region_id"]
SLIM = ("page_id", "region_id", "x", "y", "w", "h")


def own_key(df: DataFrame, ident: str = "region_id") -> DataFrame:
    return df.withColumnRenamed("a_" + ident, ident)


# ---- neighbours --------------------------------------------------------------------------------------

def neighbour_pairs(nodes: DataFrame, reach: int = 84, most: int = 32) -> DataFrame:
    """For each node its nearest later nodes within reach, at most ``most`` by gap (the size of the list asked for)."""
    pairs = self_pairs(nodes.select(*SLIM), margin=reach).withColumn("gap", gap(A(), B()))
    return first_per_group(pairs, ["page_id", "a_region_id"], [C("gap"), C("b_region_id")], most, "position").select(
        "page_id", C("a_region_id").alias("left_id"), C("b_region_id").alias("right_id"), "gap", "position")


def _union(a: Box, b: Box) -> Box:
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return Box(x, y, F.greatest(a.x2, b.x2) - x, F.greatest(a.y2, b.y2) - y)


def object_edges(nodes: DataFrame, page_w: int, page_h: int, reach: int = 84) -> DataFrame:
    """Scored edges between nearby evidence nodes (side: visual or text; risk_text, risk_wide)."""
    a, b = A(), B()
    pairs = self_pairs(nodes.select(*SLIM, "side", "risk_text", "risk_wide"), margin=reach).withColumn("distance", gap(a, b))
    u = _union(a, b)
    ratio = u.area / F.greatest(F.lit(1), a.area + b.area)
    sizes = F.greatest(a.area, b.area) / F.greatest(F.lit(1), F.least(a.area, b.area))

    def unit(v: Column) -> Column:
        return F.greatest(F.lit(0.0), v)

    center = unit(1 - F.least(F.abs(a.cx - b.cx), F.abs(a.cy - b.cy)) / 64)
    baseline = unit(1 - F.abs(a.y2 - b.y2) / 40)
    scored = pairs.withColumns({
        "near": unit(1 - C("distance") / 84), "aligned": F.greatest(center, baseline), "compact": unit(1 - (ratio - 1) / 3), "sized": unit(1 - (sizes - 1) / 8),
        "fit": F.when((C("a_side") == "text") & (C("b_side") == "text"), 0.75).otherwise(0.9),
        "texty": (C("a_risk_text") | C("b_risk_text")).cast("int"), "wide": (C("a_risk_wide") | C("b_risk_wide")).cast("int"),
        "outside": ((u.x < 0) | (u.y < 0) | (u.x2 > page_w) | (u.y2 > page_h)).cast("int")})
    score = (C("near") * 0.25 + C("aligned") * 0.20 + C("compact") * 0.15 + C("fit") * 0.15 + C("sized") * 0.15
             - C("texty") * 0.25 - C("outside") * 0.35 - C("wide") * 0.30)
    s = scored.withColumn("score", score)
    decision = ladder([(C("outside") == 1, "rejected"), (C("score") >= 0.68, "accepted"), (C("score") >= 0.52, "weak")], "rejected")
    return s.select("page_id", C("a_region_id").alias("left_id"), C("b_region_id").alias("right_id"), "distance",
                    half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), C("score"))), 6).alias("score"), decision.alias("decision"))


def fragment_edges(fragments: DataFrame, texts: DataFrame, images: DataFrame, reach: int = 24, max_edge: int = 96, max_area: int = 12000) -> DataFrame:
    """Pairs of nearby fragments with the hard reasons against merging them; merged boxes may not touch text or images."""
    a, b = A(), B()
    pairs = self_pairs(fragments.select(*SLIM), margin=reach).withColumn("gap", gap(a, b))
    u = _union(a, b)
    merged = pairs.select("page_id", C("a_region_id").alias("left_id"), C("b_region_id").alias("right_id"), "gap", *[c.alias(n) for c, n in zip(u, "xywh")])

    def crossed(others: DataFrame, name: str) -> DataFrame:
        hits = near_pairs(merged, others.select("page_id", *"xywh"), overlap(A(), B()) > 0)
        return hits.select("page_id", C("a_left_id").alias("left_id"), C("a_right_id").alias("right_id")).distinct().withColumn(name, F.lit(True))

    pair = ["page_id", "left_id", "right_id"]
    j = merged.join(crossed(texts, "_text"), pair, "left").join(crossed(images, "_image"), pair, "left")
    hard = reasons((C("w") * C("h") > max_area, "merged_bbox_too_large"), (F.greatest("w", "h") > max_edge, "merged_edge_too_large"),
                   (F.coalesce("_text", F.lit(False)), "cross_text_node"), (F.coalesce("_image", F.lit(False)), "cross_image_node"))
    return j.select(*pair, "gap", F.array_join(hard, ",").alias("hard_reasons"))


# ---- anchors -----------------------------------------------------------------------------------------

def _anchor_scores(a: Box, t: Box) -> list[tuple[str, Column]]:
    """Gaussian score of each relation between a candidate and a text."""
    dx, dy = F.abs(a.cx - t.cx), F.abs(a.cy - t.cy)

    def directional(cross: Column, space: Column, own: Column, text: Column, extent: Column) -> Column:
        sc, sg = F.greatest(F.lit(16.0), extent * 0.85), F.greatest(F.lit(12.0), text * 0.90)
        off = space - F.greatest(F.lit(4.0), text * 0.45)
        value = F.exp(-(cross * cross) / (sc * sc * 2)) * F.exp(-(off * off) / (sg * sg * 2))
        return F.when(space < own * -0.25, 0.0).otherwise(value)

    wide, tall = F.greatest(a.w, t.w), F.greatest(a.h, t.h)
    sx, sy = F.greatest(F.lit(24.0), wide * 1.15), F.greatest(F.lit(18.0), tall * 1.15)
    near = F.exp(-(dx * dx) / (sx * sx * 2)) * F.exp(-(dy * dy) / (sy * sy * 2)) * F.when(overlap(a, t) > 0, 0.35).otherwise(1.0)
    return [
        ("above_text", directional(dx, t.y - a.y2, a.h, t.h, wide)), ("below_text", directional(dx, a.y - t.y2, a.h, t.h, wide)),
        ("left_of_text", directional(dy, t.x - a.x2, a.w, t.w, tall)), ("right_of_text", directional(dy, a.x - t.x2, a.w, t.w, tall)),
        ("near_text", near),
    ]


def text_anchors(candidates: DataFrame, texts: DataFrame, media: DataFrame) -> DataFrame:
    """Best text anchor of each candidate among the texts of a media region that holds both, whatever its score."""
    def held(df: DataFrame, ident: str) -> DataFrame:
        inside = near_pairs(df.select("page_id", ident, *"xywh"), media.select("page_id", C("region_id").alias("media_id"), *"xywh"), contains(box("b_"), box("a_"), 0))
        return inside.select("page_id", "b_media_id", "a_" + ident, *["a_" + c for c in "xywh"])

    left = held(candidates, "region_id").where("b_media_id <> a_region_id")
    right = held(texts, "line_id").select("page_id", "b_media_id", *[C("a_" + c).alias("t_" + c) for c in ("line_id", *"xywh")])
    pairs = left.join(right, ["page_id", "b_media_id"]).where(C("a_region_id") != C("t_line_id"))
    scored = pairs.select("page_id", C("a_region_id").alias("region_id"), C("t_line_id").alias("line_id"),
                          F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(n).alias("relation"), v.alias("score"))
                                              for i, (n, v) in enumerate(_anchor_scores(box("a_"), box("t_")))])).alias("s"))
    best = scored.groupBy(*KEY).agg(F.max(F.struct(C("s.score").alias("score"), (-C("line_id")).alias("neg"), (-C("s.o")).alias("o"), C("s.relation").alias("relation"))).alias("m"))
    return best.select(*KEY, (-C("m.neg")).alias("line_id"), C("m.relation").alias("relation"), half_even(C("m.score"), 3).alias("score"))


def best_per_text(anchors: DataFrame) -> DataFrame:
    """Of the candidates anchored to one text the best scoring, the first on ties."""
    return anchors.groupBy("page_id", "line_id").agg(F.min_by("region_id", F.struct(-C("score"), C("region_id"))).alias("region_id"), F.max("score").alias("score"))


# ---- clipping and coverage ---------------------------------------------------------------------------

def clipped_boxes(candidates: DataFrame, texts: DataFrame, min_area: int = 400, keep: float = 0.20, low: float = 0.08, high: float = 0.45) -> DataFrame:
    """Candidates cut free of text at one edge: the largest of up to four valid proposals, the first on ties."""
    a, t = A(), B()
    pairs = near_pairs(candidates.select(*SLIM), texts.select("page_id", "line_id", *"xywh"), (overlap(a, t) > 0) & (C("a_region_id") != C("b_line_id")))
    stats = own_key(pairs).groupBy(*KEY).agg(
        F.sum(overlap(a, t)).alias("_cover"), F.min(F.when(t.cy >= a.cy, t.y)).alias("_bottom"), F.max(F.when(t.cy <= a.cy, t.y2)).alias("_top"),
        F.min(F.when(t.cx >= a.cx, t.x)).alias("_right"), F.max(F.when(t.cx <= a.cx, t.x2)).alias("_left"))
    b = box("")
    j = candidates.select(*SLIM).join(stats, KEY).where((C("_cover") / b.area > low) & (C("_cover") / b.area <= high))
    zero = F.lit(0)

    def option(i: int, edge: str, x, y, w, h) -> Column:
        return F.when(C(edge).isNotNull(), F.struct(F.lit(i).alias("i"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))

    options = F.array_compact(F.array(
        option(1, "_bottom", b.x, b.y, b.w, F.greatest(zero, C("_bottom") - b.y)), option(2, "_top", b.x, C("_top"), b.w, F.greatest(zero, b.y2 - C("_top"))),
        option(3, "_right", b.x, b.y, F.greatest(zero, C("_right") - b.x), b.h), option(4, "_left", C("_left"), b.y, F.greatest(zero, b.x2 - C("_left")), b.h)))
    p = j.select(*KEY, (C("w") * C("h")).alias("_whole"), F.explode(options).alias("p")).select(*KEY, "_whole", "p.*")
    p = p.where((C("w") >= 10) & (C("h") >= 10) & (C("w") * C("h") >= min_area) & (C("w") * C("h") >= C("_whole") * keep))
    left = near_pairs(p, texts.select("page_id", "line_id", *"xywh"), (overlap(a, t) > 0) & (C("a_region_id") != C("b_line_id"))).groupBy(
        "page_id", C("a_region_id").alias("region_id"), C("a_i").alias("i")).agg(F.sum(overlap(a, t)).alias("_rest"))
    ok = attach(p, left, [*KEY, "i"], {"_rest": 0}).where(C("_rest") / (C("w") * C("h")) <= low)
    return ok.groupBy(*KEY).agg(F.min_by(F.struct("x", "y", "w", "h"), F.struct(-(C("w") * C("h")), C("i"))).alias("b")).select(*KEY, "b.*")


def coverage(items: DataFrame, layers: DataFrame, name: str) -> DataFrame:
    """Summed share of each item covered by other layers, at most 1."""
    found = own_key(near_pairs(items.select(*SLIM), layers.select(*SLIM), (C("a_region_id") != C("b_region_id")) & (overlap(A(), B()) > 0))).groupBy(*KEY).agg(
        F.sum(overlap(A(), B())).alias("_c"))
    out = attach(items, found, KEY, {"_c": 0})
    return out.withColumn(name, F.least(F.lit(1.0), C("_c") / (C("w") * C("h")))).drop("_c")


def fallback_candidates(primitives: DataFrame, visuals: DataFrame, texts: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Small primitives that no visual layer covers and that are not mostly text."""
    area = C("w") * C("h")
    sized = primitives.where(C("primitive_type").isin("symbol_region", "image_region", "unknown_region", "rect", "line") & (area >= 80)
                             & (area <= min(25_000, page_w * page_h * 0.035)) & (C("w") <= page_w * 0.5) & (C("h") <= page_h * 0.12))
    both = coverage(coverage(sized, visuals, "by_visual"), texts, "by_text")
    pill = (C("w") / C("h")).between(1.5, 4.8) & area.between(900, 8000)
    return both.where((C("by_visual") < 0.35) & (C("by_text") < 0.72) & ((C("by_text") < 0.45) | pill)).select(*KEY, "by_visual", "by_text")


# ---- text and media ----------------------------------------------------------------------------------

def text_classes(lines: DataFrame, media: DataFrame, page_w: int, min_conf: float = 0.60, max_overlap: float = 0.82) -> DataFrame:
    """Class of each OCR line from its best media: editable, display text inside media, or too unsure.

    Lines carry conf in [0, 1] and local_conf, the measured background confidence.
    """
    a, b = A(), B()
    best = near_pairs(lines.select("page_id", "line_id", *"xywh"), media.select(*SLIM), overlap(a, b) > 0).groupBy("page_id", C("a_line_id").alias("line_id")).agg(
        F.max(F.struct((overlap(a, b) / a.area).alias("share"), (-C("b_region_id")).alias("neg"), b.w.alias("mw"), b.h.alias("mh"))).alias("m"))
    j = lines.join(best, ["page_id", "line_id"], "left")
    h, w, mh = C("h"), C("w"), F.greatest(F.lit(1), C("m.mh"))
    display = (h >= 40) & ((h >= F.rint(mh * 0.08)) | ((w >= F.rint(F.greatest(F.lit(1), C("m.mw")) * 0.22)) & (h >= 30))
                           | ((w >= round(page_w * 0.22)) & (h >= F.rint(mh * 0.06))))
    inside = F.coalesce((C("m.share") >= max_overlap) & display, F.lit(False))
    unsure = (F.trim("text") == "") | (C("conf") < min_conf)
    kind = ladder([(unsure, "preserve_raster_text/low"), (inside, "preserve_raster_text/medium"), (C("local_conf") >= 0.45, "editable_ui_text/high")], "editable_ui_text/medium")
    parts = F.split(kind, "/")
    return j.select("page_id", "line_id", parts[0].alias("visual_kind"), parts[1].alias("confidence"), F.coalesce("m.share", F.lit(0.0)).alias("media_share"))


def label_anchors(icons: DataFrame, media: DataFrame, labels: DataFrame) -> DataFrame:
    """For each icon inside a media region the first label that belongs to it: below it, or in the same cell."""
    a, b = A(), B()
    held = near_pairs(icons.select(*SLIM), media.select(*SLIM), (overlap(a, b) / a.area >= 0.80) & (C("a_region_id") != C("b_region_id")))
    inside = held.select("page_id", C("a_region_id").alias("icon_id"), C("b_region_id").alias("media_id"), *[C("a_" + c).alias(c) for c in "xywh"],
                         *[C("b_" + c).alias("m" + c) for c in "xywh"])
    m = box("a_m")
    dx, down = F.abs(a.cx - b.cx), b.y - a.y2
    context = (overlap(b, m) / b.area >= 0.70) | ((b.cx >= m.x) & (b.cx <= m.x2) & (b.cy >= m.y) & (b.cy <= m.y2))
    cell = F.abs(a.cy - b.cy) <= F.greatest(a.h, b.h) * 1.8
    above = (down >= -F.greatest(F.lit(4.0), b.h * 0.35)) & (down <= F.greatest(F.lit(36.0), a.h * 1.25))
    fits = context & (overlap(a, b) == 0) & (dx <= F.greatest(a.w * 0.85, F.lit(36.0))) & (above | cell)
    # the label lies within the icon's own reach, so both boxes are grown by their sides
    wide = inside.select("*").withColumns({"ox": C("x"), "oy": C("y"), "ow": C("w"), "oh": C("h")})
    wide = wide.withColumns({"x": C("ox") - C("ow") - 40, "y": C("oy") - C("oh") * 2 - 40, "w": C("ow") * 3 + 80, "h": C("oh") * 5 + 80})
    texts = labels.select("page_id", "line_id", *[C(c).alias("o" + c) for c in "xywh"], (C("x") - C("w")).alias("x"), (C("y") - C("h") * 2).alias("y"),
                          (C("w") * 3).alias("w"), (C("h") * 5).alias("h"))
    pairs = near_pairs(wide, texts)
    real = pairs.select("page_id", C("a_icon_id").alias("icon_id"), C("a_media_id").alias("media_id"), C("b_line_id").alias("line_id"),
                        *[C("a_o" + c).alias("a_" + c) for c in "xywh"], *[C("b_o" + c).alias("b_" + c) for c in "xywh"], *[C("a_m" + c) for c in "xywh"])
    return real.where(fits).groupBy("page_id", "icon_id", "media_id").agg(F.min("line_id").alias("line_id"))


def contained_text(controls: DataFrame, lines: DataFrame, min_conf: int = 60, inside: float = 0.85, low: float = 0.04, high: float = 0.45) -> DataFrame:
    """Controls whose contained text takes an accepted share of their area."""
    a, b = A(), B()
    good = lines.where((C("conf") >= min_conf) & (F.trim("text") != ""))
    pairs = near_pairs(controls.select(*SLIM), good.select("page_id", "line_id", *"xywh"), (overlap(a, b) / b.area >= inside) & (C("a_region_id") != C("b_line_id")))
    found = own_key(pairs).groupBy(*KEY).agg(F.count("*").alias("texts"), F.sum(overlap(a, b)).alias("text_area"), F.max(a.area).alias("_area"))
    return found.where((C("text_area") / C("_area")).between(low, high)).select(*KEY, "texts", "text_area")


def media_text_owners(rasters: DataFrame, lines: DataFrame, page_area: int) -> DataFrame:
    """Media owner of each text line; rasters carry complexity, a measurement."""
    a, b = A(), B()
    cover = overlap(a, b) / b.area
    pairs = near_pairs(rasters.select(*SLIM, "complexity"), lines.select("page_id", "line_id", *"xywh"), (cover >= 0.72) & (C("a_region_id") != C("b_line_id")))
    stats = own_key(pairs).groupBy(*KEY).agg(F.count("*").alias("_n"), F.sum(overlap(a, b)).alias("_text"), F.max(a.area).alias("_area"), F.max("a_complexity").alias("_cx"))
    ratio = C("_text") / F.greatest(F.lit(1), C("_area"))
    good = stats.where(~((C("_n") == 1) & (C("_area") < page_area * 0.035) & (C("_cx") < 0.52)) & (ratio <= 0.22))
    owner = good.select(*KEY, (C("_cx") + F.least(F.lit(0.25), C("_area") / page_area) + F.least(F.lit(0.18), C("_n") * 0.035) - F.least(F.lit(0.20), ratio)).alias("_s"))
    ranked = own_key(pairs).select(*KEY, C("b_line_id").alias("line_id"), cover.alias("_c")).join(owner, KEY)
    best = ranked.groupBy("page_id", "line_id").agg(F.max(F.struct((C("_s") + C("_c") * 0.10).alias("score"), (-C("region_id")).alias("neg"))).alias("m"))
    return best.select("page_id", "line_id", (-C("m.neg")).alias("owner_id"), half_even(C("m.score"), 4).alias("owner_score"))


def enclosing_shapes(items: DataFrame, shapes: DataFrame, name: str) -> DataFrame:
    """Smallest shape fully around each item."""
    a, b = A(), B()
    pairs = near_pairs(items.select(*SLIM), shapes.select(*SLIM), contains(b, a, 0) & (C("a_region_id") != C("b_region_id")))
    return own_key(pairs).groupBy(*KEY).agg(F.min_by("b_region_id", F.struct(b.area, C("b_region_id"))).alias(name))


def icon_buttons(shapes: DataFrame, groups: DataFrame, fragments: DataFrame) -> DataFrame:
    """Each interactive shape with its first contained group, or else its first contained fragment."""
    a, b = A(), B()

    def first(items: DataFrame, kind: str) -> DataFrame:
        pairs = near_pairs(shapes.select(*SLIM), items.select(*SLIM), contains(a, b, 0) & (C("a_region_id") != C("b_region_id")))
        return own_key(pairs).groupBy(*KEY).agg(F.min("b_region_id").alias("content_id")).withColumn("content", F.lit(kind))

    in_groups = first(groups, "group")
    return in_groups.unionByName(first(fragments, "fragment").join(in_groups.select(*KEY), KEY, "left_anti"))


def route_members(members: DataFrame, nodes: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Route of each object member: text, visual, shape, or unresolved with the reason."""
    j = members.join(nodes.select("page_id", "node_id", "node_kind", F.lit(True).alias("_found")), ["page_id", "node_id"], "left")
    bad = (C("w") <= 0) | (C("h") <= 0) | (C("x") < 0) | (C("y") < 0) | (C("x") + C("w") > page_w) | (C("y") + C("h") > page_h)
    route = ladder([
        (bad, "unresolved/invalid_bbox"), (C("_found").isNull(), "unresolved/missing_lookup"), (C("member_role").isin("text", "nearby_text"), "text/"),
        (C("member_role") == "wide_source", "unresolved/wide_source"), (C("member_role") == "noise", "unresolved/noise_member"),
        (C("member_role") == "weak_visual", "unresolved/weak_visual"), ((C("member_role") == "visual") & (C("node_kind") == "shape"), "shape/"),
        (C("member_role") == "visual", "visual/"),
    ], "unresolved/source_conflict")
    parts = F.split(route, "/")
    return j.select("page_id", "node_id", parts[0].alias("route"), parts[1].alias("reason"))
