"""Matching one set of rectangles with another: coverage sums, best partners and exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxloom.functions.geometry import Box, box, contains, expand, half_up, holds_point, iou, overlap, share_of
from boxloom.functions.ladders import ladder, too_broad, too_small
from boxloom.operators.spatial import best_partner, keep_matching, near_pairs

C = F.col
A, B = (lambda: box("a_")), (lambda: box("b_"))


def attach(base: DataFrame, found: DataFrame, keys: list[str], fill: dict[str, object] | None = None) -> DataFrame:
    """Left join of per-row findings, with defaults where nothing was found."""
    joined = base.join(found, keys, "left")
    for name, value in (fill or {}).items():
        joined = joined.withColumn(name, F.coalesce(C(name), F.lit(value)))
    return joined


# ---- containment -------------------------------------------------------------------------------------

def smallest_parents(slices: DataFrame, tolerance: int = 4) -> DataFrame:
    """For each slice the smallest other slice around it; equal areas go to the lower id."""
    a, b = A(), B()
    slim = slices.select("page_id", "region_id", "x", "y", "w", "h")
    earlier = (b.area > a.area) | ((b.area == a.area) & (C("b_region_id") < C("a_region_id")))
    pairs = near_pairs(slim, slim, contains(b, a, tolerance) & earlier, margin=tolerance, spread=True)
    best = best_partner(
        pairs.withColumnRenamed("a_region_id", "region_id"), ["page_id", "region_id"], F.struct(b.area, C("b_region_id")),
        {"parent_id": C("b_region_id"), "parent_x": b.x, "parent_y": b.y})
    return attach(slim, best, ["page_id", "region_id"]).select(
        "page_id", "region_id", "parent_id", (C("x") - F.coalesce("parent_x", F.lit(0))).alias("rel_x"),
        (C("y") - F.coalesce("parent_y", F.lit(0))).alias("rel_y"), "w", "h")


def lines_in_slices(lines: DataFrame, slices: DataFrame, min_confidence: int = 30) -> DataFrame:
    """Text lines placed in the smallest slice holding their centre, in slice coordinates."""
    confident = lines.where(C("conf") >= min_confidence)
    # doubling keeps the centre of an odd-sized box on the integer grid
    centres = confident.select(
        "page_id", "line_id", (C("x") * 2 + C("w")).alias("x"), (C("y") * 2 + C("h")).alias("y"),
        F.lit(0).cast("bigint").alias("w"), F.lit(0).cast("bigint").alias("h"),
        *[C(c).alias("line_" + c) for c in "xywh"])
    doubled = slices.select("page_id", "region_id", *[(C(c) * 2).alias(c) for c in "xywh"])
    a, b = A(), B()
    pairs = near_pairs(centres, doubled, holds_point(b, a.x, a.y), cell=512, spread=True)
    line = box("a_line_")
    placed = pairs.withColumnRenamed("a_line_id", "line_id").groupBy("page_id", "line_id").agg(
        F.min_by(F.struct(C("b_region_id"), b.x, b.y), F.struct(b.area, C("b_region_id"))).alias("s"),
        *[F.first(c).alias(n) for c, n in zip(line, "xywh")])
    return placed.select(
        "page_id", "line_id", C("s.b_region_id").alias("slice_id"), (C("x") - C("s.b_x") / 2).cast("bigint").alias("x"),
        (C("y") - C("s.b_y") / 2).cast("bigint").alias("y"), "w", "h",
        F.greatest(F.lit(10), half_up(C("h") * 0.72)).alias("font_size"))


# ---- text lines and physical boxes -------------------------------------------------------------------

def match_score(line: Box, phys: Box) -> Column:
    shared = overlap(line, phys)
    least_area = F.least(line.h, phys.h) * F.least(line.w, phys.w)
    apart = F.sqrt((line.cx - phys.cx) * (line.cx - phys.cx) + (line.cy - phys.cy) * (line.cy - phys.cy))
    near = F.greatest(F.lit(0.0), 1 - apart / F.greatest(F.lit(1), line.w, phys.w))
    heights = F.least(line.h, phys.h) / F.greatest(line.h, phys.h, F.lit(1))
    return iou(line, phys) * 0.52 + shared / F.greatest(F.lit(1), least_area) * 0.18 + near * 0.2 + heights * 0.1


def fragment_fits(line: Box, frag: Box) -> Column:
    """A fragment close enough to a line, and not far taller than it, to be part of it."""
    reach_x = F.greatest(F.lit(8), half_up(line.h * 0.8))
    reach_y = F.greatest(F.lit(6), half_up(line.h * 0.45))
    return (
        (overlap(expand(line, reach_x, reach_y), frag) > 0)
        & (F.abs(frag.cy - line.cy) <= F.greatest(line.h, frag.h) * 0.95)
        & ~((frag.h > line.h * 2.6) & (frag.w > line.w * 0.35))
    )


def locate_lines(lines: DataFrame, primitives: DataFrame, min_score: float = 0.42) -> DataFrame:
    """Physical box of each OCR line.

    Candidates are single fragments (score x 0.82) and the hull of all fragments lying on the line.
    ``primitives`` carries primitive_type, ocr_line_id and source_kind.  Lines that end up on the same
    physical box fall back to their OCR box.
    """
    keys = ["page_id", "line_id"]
    line, frag = A(), B()
    usable = primitives.where(
        ~C("primitive_type").isin("surface_region", "image_region") & (C("w") <= 260) & (C("h") <= 96)
        & ~((C("primitive_type") == "text_region") & (C("source_kind") == "ocr"))
    ).select("page_id", "region_id", "x", "y", "w", "h")
    # the search reach follows the line height, so the join box is the grown line
    grown = lines.select(
        *keys, *[C(c).alias("o" + c) for c in "xywh"],
        (C("x") - F.greatest(F.lit(8), F.ceil(C("h") * 0.8) + 1)).alias("x"), (C("y") - F.greatest(F.lit(6), C("h"))).alias("y"),
        (C("w") + F.greatest(F.lit(8), F.ceil(C("h") * 0.8) + 1) * 2).alias("w"), (C("h") + F.greatest(F.lit(6), C("h")) * 2).alias("h"))
    line = box("a_o")
    pairs = near_pairs(grown, usable, spread=True).where(fragment_fits(line, frag)).withColumnRenamed("a_line_id", "line_id")
    pairs = pairs.withColumns({"_score": match_score(line, frag) * 0.82, "_on": overlap(expand(line, 2, 3), frag)})
    pairs = pairs.withColumn("_up", (C("_on") > 0) & (C("_on") / F.greatest(F.lit(1), frag.area) >= 0.18))
    joined_up = C("_up")
    best = pairs.groupBy(*keys).agg(
        F.max(F.struct(C("_score").alias("score"), (-C("b_region_id")).alias("neg_id"), *[
            c.alias(n) for c, n in zip(frag, "xywh")])).alias("single"),
        F.count(F.when(joined_up, 1)).alias("n"),
        F.min(F.when(joined_up, C("b_region_id"))).alias("lo_id"), F.max(F.when(joined_up, C("b_region_id"))).alias("hi_id"),
        F.sum(F.when(joined_up, F.xxhash64("b_region_id") % 1000003)).alias("mix"),
        F.min(F.when(joined_up, frag.x)).alias("ux"), F.min(F.when(joined_up, frag.y)).alias("uy"),
        F.max(F.when(joined_up, frag.x2)).alias("ux2"), F.max(F.when(joined_up, frag.y2)).alias("uy2"),
    )
    direct = primitives.where((C("primitive_type") == "text_region") & C("ocr_line_id").isNotNull()).select(
        "page_id", C("ocr_line_id").alias("line_id"), (C("source_kind") == "ocr").alias("mask_only"), C("region_id").alias("direct_id"),
        *[C(c).alias("d" + c) for c in "xywh"])
    base = lines.select(*keys, "x", "y", "w", "h").join(best, keys, "left").join(direct, keys, "left")
    own = box("")
    union = Box(C("ux"), C("uy"), C("ux2") - C("ux"), C("uy2") - C("uy"))
    union_score = F.when(C("n") > 0, match_score(own, union))
    take_direct = C("direct_id").isNotNull() & ~C("mask_only")
    take_union = ~take_direct & union_score.isNotNull() & (union_score >= C("single.score"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def who(n: Column, low: Column, high: Column, mix: Column) -> Column:
        return F.struct(n.alias("n"), low.alias("low"), high.alias("high"), mix.cast("bigint").alias("mix"))

    chosen = base.withColumn("_d", take_direct).withColumn("_u", take_union).select(
        *keys, "x", "y", "w", "h", "mask_only", "_u",
        F.when(C("_d"), 1.0).when(C("_u"), union_score).otherwise(C("single.score")).alias("score"),
        *[F.when(C("_d"), C("d" + n)).when(C("_u"), u).otherwise(C("single." + n)).alias("m" + n)
          for n, u in zip("xywh", union)],
        # which fragments the match stands for
        F.when(C("_d"), who(one, C("direct_id"), C("direct_id"), zero))
        .when(C("_u"), who(C("n"), C("lo_id"), C("hi_id"), F.when(C("n") > 1, C("mix")).otherwise(zero)))
        .otherwise(who(one, -C("single.neg_id"), -C("single.neg_id"), zero)).alias("who"),
    )
    phys = box("m")
    reason = ladder([
        (C("score").isNull() | (C("score") < min_score),
         F.when(F.coalesce("mask_only", F.lit(False)), "m29_text_region_ocr_mask_only").otherwise("no_matching_m29_text_bbox")),
        (too_broad(own, phys), "m29_bbox_too_broad_for_ocr_line"),
        (too_small(own, phys), "m29_bbox_too_small_for_ocr_line"),
    ], None)
    located = chosen.withColumn("reason", reason)
    return demote_shared(located, keys, own, phys)


def demote_shared(located: DataFrame, keys: list[str], own: Box, phys: Box) -> DataFrame:
    """Matches claimed by several lines are given up by all of them."""
    # counted conditionally: a filter here would be pushed, fully expanded, below the projections above
    claims = located.groupBy("page_id", "who").agg(F.count(F.when(C("reason").isNull(), 1)).alias("claims"))
    joined = located.join(claims, ["page_id", "who"], "left")
    reason = F.coalesce("reason", F.when(C("claims") > 1, "shared_m29_bbox_for_multiple_ocr_lines"))
    kept = reason.isNull()
    return joined.select(
        *keys, F.when(kept, "m29_foreground").otherwise("ocr").alias("bbox_source"), reason.alias("reason"),
        *[F.when(kept, p).otherwise(o).alias(n) for n, p, o in zip("xywh", phys, own)],
        F.when(kept, half_up(C("score"), 3)).alias("match_score"))


def remaining_share(lines: DataFrame, blockers: DataFrame, ident: str = "line_id", floor: float = 0.25,
                    name: str = "remaining") -> DataFrame:
    """Part of each line left uncovered; a blocker counts when it covers at least ``floor`` of the line."""
    a, b = A(), B()
    slim = lines.select("page_id", ident, "x", "y", "w", "h")
    pairs = near_pairs(slim, blockers.select("page_id", "x", "y", "w", "h"), overlap(a, b) / a.area >= floor, spread=True)
    covered = pairs.groupBy("page_id", C("a_" + ident).alias(ident)).agg(F.sum(overlap(a, b)).alias("_covered"))
    out = attach(lines, covered, ["page_id", ident], {"_covered": 0})
    area = C("w") * C("h")
    share = F.when(area <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), C("_covered") / area)))
    return out.withColumn(name, share).drop("_covered")


# ---- detections --------------------------------------------------------------------------------------

# fixed values: class names by family
CONTROL_CLASSES = ("TextButton", "EditText", "Spinner", "CheckedTextView", "Switch", "CheckBox", "RadioButton")
MEDIA_CLASSES = ("Image", "Icon", "BackgroundImage", "Map")
STRUCTURE_CLASSES = ("Card", "Toolbar", "Modal", "Drawer", "UpperTaskBar", "Bottom_Navigation")
DANGEROUS_TEXT_CLASSES = ("Text", "TextButton", "EditText", "CheckedTextView")


def detection_layer_matches(detections: DataFrame, layers: DataFrame, floor: float = 0.20) -> DataFrame:
    """Best layer of each kind for each detection, with the decision the match supports."""
    a, b = A(), B()
    det = detections.select("page_id", "region_id", "class_name", "x", "y", "w", "h")
    lay = layers.select("page_id", "region_id", "kind", "x", "y", "w", "h")
    in_layer, in_det, joint = share_of(a, b), share_of(b, a), iou(a, b)
    score = F.greatest(joint, in_layer * 0.85, in_det * 0.75)
    pairs = near_pairs(det, lay, overlap(a, b) > 0, spread=True)
    best = pairs.groupBy("page_id", C("a_region_id").alias("detection_id"), C("b_kind").alias("layer_kind")).agg(
        F.max(F.struct(score.alias("score"), (-C("b_region_id")).alias("neg"), joint.alias("iou"), in_layer.alias("det_cov"),
                       in_det.alias("layer_cov"), C("a_class_name").alias("class_name"))).alias("m"))
    m = best.where(C("m.score") >= floor).select(
        "page_id", "detection_id", "layer_kind", (-C("m.neg")).alias("layer_id"), "m.class_name", "m.score", "m.iou",
        "m.det_cov", "m.layer_cov")
    cls, kind = C("class_name"), C("layer_kind")
    control, media = cls.isin(*CONTROL_CLASSES), cls.isin(*MEDIA_CLASSES)
    decision = ladder([
        (control & (kind == "shape") & (C("score") >= 0.35), "control_semantic_tag"),
        (control & (kind == "text") & (C("layer_cov") >= 0.65), "control_search_window_candidate"),
        (media & (kind == "raster") & (C("score") >= 0.30), "media_semantic_tag"),
        (media & (kind != "raster") & (C("det_cov") < 0.50), "media_missing_physical_candidate"),
        (cls.isin(*STRUCTURE_CLASSES) & (C("score") >= 0.30), "structure_semantic_tag"),
        (cls.isin(*DANGEROUS_TEXT_CLASSES) & (kind == "raster") & (C("det_cov") >= 0.35), "ocr_overlap_risk"),
        (C("iou") >= 0.50, "bbox_aligned"),
    ], "weak_match")
    return m.withColumn("decision", decision)


def control_text_risks(detections: DataFrame, blocks: DataFrame, floor: float = 0.65) -> DataFrame:
    """OCR blocks mostly covered by a control detection."""
    a, b = A(), B()
    controls = detections.where(C("class_name").isin(*CONTROL_CLASSES)).select("page_id", "region_id", "class_name", *"xywh")
    pairs = near_pairs(controls, blocks.select("page_id", "line_id", *"xywh"), share_of(b, a) >= floor, spread=True)
    return pairs.select("page_id", C("a_region_id").alias("detection_id"), C("a_class_name").alias("class_name"),
                        C("b_line_id").alias("line_id"), (F.rint(share_of(b, a) * 10000.0) / 10000.0).alias("coverage"))


def text_owner_surfaces(blocks: DataFrame, layers: DataFrame) -> DataFrame:
    """Best control surface, container surface and media surface under each text block."""
    a, b = A(), B()
    cover = share_of(a, b)
    centred = holds_point(b, a.cx, a.cy)
    kind, control = C("b_kind"), C("b_is_control")
    shape_ok = (kind == "shape") & ((cover >= F.when(control, 0.45).otherwise(0.70)) | centred)
    media_ok = (kind == "raster") & (cover >= 0.85)
    role = F.when(kind == "raster", "media_surface").when(control, "control_surface").otherwise("container_surface")
    bulk = b.area / F.greatest(F.lit(1), a.area)
    score = F.when(kind == "raster", cover - F.least(F.lit(0.4), bulk / 5000.0)).otherwise(
        cover * 4.0 + F.when(centred, 1.0).otherwise(0.0) - F.least(F.lit(1.5), bulk / 500.0))
    pairs = near_pairs(blocks.select("page_id", "line_id", *"xywh"),
                       layers.select("page_id", "region_id", "kind", "is_control", *"xywh"), shape_ok | media_ok, spread=True)
    best = pairs.groupBy("page_id", C("a_line_id").alias("line_id"), role.alias("owner_role")).agg(
        F.max(F.struct(score.alias("score"), (-C("b_region_id")).alias("neg"))).alias("m"))
    return best.select("page_id", "line_id", "owner_role", (-C("m.neg")).alias("owner_id"), C("m.score").alias("score"))


def drop_covered_tiles(detections: DataFrame, page_area: int, share: float = 0.72) -> DataFrame:
    """Detections of any other source than the overview, mostly inside a usable overview detection, are dropped."""
    usable = detections.where(
        (C("source_kind") == "overview") & (C("w") >= 8) & (C("h") >= 8)
        & (C("w") * C("h") / page_area).between(0.01, 0.82)).select("page_id", *"xywh")
    overview = F.coalesce(C("source_kind") == "overview", F.lit(False))
    kept = keep_matching(detections.where(~overview), usable, share_of(A(), B()) >= share, negate=True)
    return detections.where(overview).unionByName(kept.select(*detections.columns))


def not_overlapping(boxes: DataFrame, existing: DataFrame, limit: float = 0.6) -> DataFrame:
    """Boxes that do not repeat an existing one."""
    return keep_matching(boxes, existing.select("page_id", *"xywh"), iou(A(), B()) >= limit, negate=True)


def container_audit(containers: DataFrame, missing: DataFrame, layers: DataFrame) -> DataFrame:
    """Containers with unclaimed text inside, or with at least two layers inside."""
    a, b = A(), B()
    keys = ["page_id", C("a_region_id").alias("region_id")]
    slim = containers.select("page_id", "region_id", *"xywh")
    text = near_pairs(slim, missing.select("page_id", *"xywh"), share_of(b, a) >= 0.70).groupBy(*keys).agg(
        F.count("*").alias("missing_text"))
    held = near_pairs(slim, layers.select("page_id", "region_id", *"xywh"),
                      (C("a_region_id") != C("b_region_id")) & (share_of(b, a) >= 0.72)).groupBy(*keys).agg(
        F.count("*").alias("held_layers"))
    both = text.join(held, ["page_id", "region_id"], "full").fillna(0, ["missing_text", "held_layers"])
    return both.where((C("missing_text") > 0) | (C("held_layers") >= 2)).withColumn(
        "decision", F.when(C("missing_text") > 0, "foreground_conflict").otherwise("container_contains_layers"))


def supporting_sources(items: DataFrame, source: str, floor: float = 0.15) -> DataFrame:
    """Distinct sources of other items that agree with an item's box."""
    slim = items.select("page_id", "region_id", source, *"xywh")
    pairs = near_pairs(slim, slim, (C("a_region_id") != C("b_region_id")) & (iou(A(), B()) >= floor), spread=True)
    found = pairs.groupBy("page_id", C("a_region_id").alias("region_id")).agg(
        F.count("*").alias("n_support"), F.sort_array(F.collect_set("b_" + source)).alias("sources"))
    return attach(items.select("page_id", "region_id"), found, ["page_id", "region_id"], {"n_support": 0})


def text_overlap(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Text touching each candidate: summed overlap, blocks, touching area and blocks covered by a quarter."""
    a, b = A(), B()
    pairs = near_pairs(candidates.select("page_id", "region_id", *"xywh"), texts.select("page_id", "line_id", *"xywh"),
                       (overlap(a, b) > 0) & (C("a_region_id") != C("b_line_id")), spread=True)
    found = pairs.groupBy("page_id", C("a_region_id").alias("region_id")).agg(
        F.sum(overlap(a, b)).alias("overlap_area"), F.count("*").alias("text_blocks"), F.sum(b.area).alias("touching_area"),
        F.count(F.when(overlap(a, b) / b.area >= 0.25, 1)).alias("covered_blocks"))
    zero = {n: 0 for n in ("overlap_area", "text_blocks", "touching_area", "covered_blocks")}
    return attach(candidates, found, ["page_id", "region_id"], zero)


def visual_ownership(row_kind: Column, by_box: Column, by_text: Column, confidence: Column, matched: Column) -> Column:
    """Struct of ownership, decision and reason of a visual item against the text on it."""
    good = matched & (confidence >= 0.55) & (by_box >= 0.55) & (by_text >= 0.45)
    clash = matched & (by_box >= 0.35)
    media = row_kind.isin("media_candidate", "accepted_image")
    rules = [
        (row_kind == "mixed_symbol_text_candidate", "mixed_or_uncertain/uncertain/symbol_text_ownership_conflict"),
        ((row_kind == "text_noise") & good, "text_owned/accepted/high_ocr_overlap_text_noise"),
        ((row_kind == "text_noise") & matched, "mixed_or_uncertain/uncertain/low_ocr_confidence"),
        (row_kind == "text_noise", "audit_only/uncertain/missing_text_match"),
        (media & matched & (by_box > 0), F.concat(F.lit("visual_owned/"), F.when(
            row_kind == "accepted_image", "accepted").otherwise("candidate"), F.lit("/image_with_text_overlay"))),
        (media, F.concat(F.lit("visual_owned/"), F.when(row_kind == "accepted_image", "accepted").otherwise("candidate"),
                         F.lit("/visual_candidate_kept"))),
        (clash, "mixed_or_uncertain/uncertain/conflicting_ownership"),
    ]
    parts = F.split(ladder(rules, "visual_owned/candidate/visual_candidate_kept"), "/")
    return F.struct(parts[0].alias("ownership"), parts[1].alias("decision"), parts[2].alias("reason"))


# ---- layers ------------------------------------------------------------------------------------------

def covered_texts(layers: DataFrame, floor: float = 0.80) -> DataFrame:
    """Visible text under a higher visible raster or shape, one row per cover."""
    shown = layers.where("visible")
    slim = ("page_id", "region_id", "z", *"xywh")
    pairs = near_pairs(shown.where("kind = 'text'").select(*slim), shown.where("kind IN ('raster', 'shape')").select(*slim),
                       (C("b_z") > C("a_z")) & (share_of(A(), B()) >= floor), spread=True)
    return pairs.select("page_id", C("a_region_id").alias("text_id"), C("b_region_id").alias("cover_id"))


def near_duplicate(a: Box, b: Box) -> Column:
    """IoU of .88, or one inside the other (.96) with areas within 18 percent."""
    most = F.greatest(share_of(a, b), share_of(b, a))
    return (iou(a, b) >= 0.88) | (
        (most >= 0.96) & (F.abs(a.area - b.area) * 100 <= F.greatest(a.area, b.area) * 18))


def duplicate_owners(layers: DataFrame, min_area: int = 800) -> DataFrame:
    """Visible non-text layers of one kind that repeat each other outside a shared group."""
    a, b = A(), B()
    shown = layers.where("visible AND kind IN ('raster', 'shape')").select("page_id", "region_id", "kind", "group_id", *"xywh")
    shared = F.coalesce(C("a_group_id") == C("b_group_id"), F.lit(False))
    pairs = near_pairs(shown, shown, (C("a_region_id") < C("b_region_id")) & (C("a_kind") == C("b_kind")) & ~shared
                       & (F.least(a.area, b.area) >= min_area) & near_duplicate(a, b), spread=True)
    return pairs.select("page_id", C("a_region_id").alias("left_id"), C("b_region_id").alias("right_id"), C("a_kind").alias("kind"))


def covered_by_trusted(layers: DataFrame, trusted: DataFrame, floor: float = 0.70) -> DataFrame:
    """Visible layers that a trusted layer of their kind, at most 4 times as large, covers."""
    a, b = A(), B()
    shown = layers.where("visible AND kind IN ('raster', 'shape')")
    return keep_matching(shown, trusted.where("visible").select("page_id", "kind", *"xywh"),
                         (C("a_kind") == C("b_kind")) & (b.area <= a.area * 4) & (share_of(a, b) >= floor))


def shapes_under_raster(shapes: DataFrame, rasters: DataFrame, floor: float = 0.98) -> DataFrame:
    """Shapes hidden by a higher raster at least as large; the first such raster is the owner."""
    a, b = A(), B()
    slim = ("page_id", "region_id", "z", *"xywh")
    pairs = near_pairs(shapes.select(*slim), rasters.select(*slim),
                       (C("b_z") > C("a_z")) & (b.area >= a.area) & (share_of(a, b) >= floor), spread=True)
    return pairs.groupBy("page_id", C("a_region_id").alias("region_id")).agg(F.min("b_region_id").alias("owner_id"))
