"""Decision ladders: ordered rules over flat columns, each a single ``when`` chain."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boxloom.functions.geometry import Box, half_even, overlap

C = F.col


def ladder(rules: list[tuple[Column, object]], default) -> Column:
    """First rule that holds decides."""
    def value(v):
        return v if isinstance(v, Column) else F.lit(v)

    out = F.when(rules[0][0], value(rules[0][1]))
    for condition, v in rules[1:]:
        out = out.when(condition, value(v))
    return out.otherwise(value(default))


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def reasons(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


# ---- physical primitives -------------------------------------------------------------------------

def primitive_rules(image_area: Column) -> list[tuple[Column, str]]:
    """The primitive ladder as (condition, rule name); reads w, h, area and the measurements."""
    small, large = F.least(C("w"), C("h")), F.greatest(C("w"), C("h"))
    share = C("area") / F.greatest(F.lit(1), image_area)
    return [
        ((small <= 2) & (large >= 12), "thin_line"),
        ((C("fill_ratio") >= 0.72) & (C("color_count") <= 10) & (C("edge_density") <= 0.18), "rect"),
        ((C("color_count") <= 12) & (C("edge_density") <= 0.22) & (share >= 0.0008) & (small >= 18) & (large <= 220), "surface"),
        ((share >= 0.004) & ((C("color_count") >= 24) | (C("edge_density") >= 0.22) | (C("texture_score") >= 0.45)), "image"),
        ((share <= 0.01) & (large <= 128) & (C("fill_ratio") >= 0.05), "symbol"),
        ((large / F.greatest(F.lit(1), small) >= 8) & (small <= 6), "long_line"),
    ]


# fixed values: type and reasons per rule
PRIMITIVE_TYPE = {"thin_line": "line", "rect": "rect", "surface": "surface_region", "image": "image_region",
                  "symbol": "symbol_region", "long_line": "line", "none": "unknown_region"}
PRIMITIVE_REASONS = {
    "thin_line": ["thin_component", "long_axis"], "rect": ["stable_rect", "low_texture"],
    "surface": ["control_surface_component", "low_texture_control_surface"],
    "image": ["high_texture_or_color_variance"], "symbol": ["compact_foreground_component"],
    "long_line": ["line_like_aspect"], "none": ["unclassified_physical_component"],
}


def primitive_type(image_area: Column) -> Column:
    return ladder([(c, PRIMITIVE_TYPE[n]) for c, n in primitive_rules(image_area)], PRIMITIVE_TYPE["none"])


def with_primitive_class(df, image_area: Column):
    """Add type, confidence and reasons; the rule is decided once and the three values follow from its name."""
    ruled = df.withColumn("_rule", ladder([(c, n) for c, n in primitive_rules(image_area)], "none"))
    rule = C("_rule")
    measured = {
        "rect": F.greatest(F.lit(0.0), F.least(F.lit(0.95), 0.72 + C("fill_ratio") * 0.2)),
        "image": F.greatest(F.lit(0.0), F.least(F.lit(0.92), 0.55 + F.least(C("texture_score"), F.lit(0.4)))),
    }
    fixed = {"thin_line": 0.86, "surface": 0.74, "symbol": 0.62, "long_line": 0.7}
    return ruled.withColumns({
        "type": ladder([(rule == n, t) for n, t in PRIMITIVE_TYPE.items()], None),
        "confidence": ladder([(rule == n, v) for n, v in {**measured, **fixed}.items()], 0.35),
        "reasons": ladder([(rule == n, F.array(*[F.lit(r) for r in rs])) for n, rs in PRIMITIVE_REASONS.items()], None),
    }).drop("_rule")


# ---- replay actions ------------------------------------------------------------------------------

# fixed values: visible action per (decision, owner), and the role each action draws
VISIBLE_ACTIONS = {"text_replay": "editable_text", "image_replay": "preserve_raster", "icon_replay": "raster_icon",
                   "shape_replay": "shape_geometry"}
TARGET_ROLES = {"text_replay": "m29_text", "image_replay": "m29_image", "icon_replay": "m29_symbol",
                "shape_replay": "m29_shape"}


def replay_action(decision: Column, owner: Column, confidence: Column) -> Column:
    rules = [((decision == d) & (owner == o) & (confidence != "low"), d) for d, o in VISIBLE_ACTIONS.items()]
    rules.append((decision == "preserve_in_parent_raster", "preserve_in_parent_raster"))
    rules.append((owner == "fallback_only", "fallback_only"))
    return ladder(rules, "diagnostic_only")


def target_role(action: Column) -> Column:
    return ladder([(action == a, r) for a, r in TARGET_ROLES.items()], None)


def is_visible(action: Column) -> Column:
    return action.isin(*VISIBLE_ACTIONS)


# ---- confidence ----------------------------------------------------------------------------------

def confidence_label(score: Column) -> Column:
    return ladder([(score >= 0.74, "high"), (score >= 0.52, "medium")], "low")


def confidence_value(label: Column) -> Column:
    return ladder([(label == "high", 1.0), (label == "medium", 0.75), (label == "low", 0.4)], 0.5)


def confidence_for_count(n: Column) -> Column:
    return ladder([(n >= 4, "high"), (n >= 2, "medium")], "low")


# ---- bins ----------------------------------------------------------------------------------------

def short_side_bin(v: Column) -> Column:
    return ladder([(v.isNull(), "missing"), (v <= 8, "000-008"), (v <= 20, "009-020"), (v <= 40, "021-040"),
                   (v <= 80, "041-080")], "081+")


def area_ratio_bin(v: Column) -> Column:
    return ladder([(v.isNull(), "missing"), (v <= 0.01, "0.00-0.01"), (v <= 0.05, "0.01-0.05"),
                   (v <= 0.15, "0.05-0.15"), (v <= 0.40, "0.15-0.40")], "0.40+")


def size_signature(w: Column, h: Column) -> Column:
    """Width and height to the nearest 8 pixels."""
    return F.concat_ws("x", *[(F.rint(v / 8) * 8).cast("bigint").cast("string") for v in (w, h)])


# ---- text line versus physical box ---------------------------------------------------------------

def too_broad(line: Box, phys: Box) -> Column:
    """The physical box reaches well past its OCR line."""
    wr, hr = phys.w / F.greatest(F.lit(1), line.w), phys.h / F.greatest(F.lit(1), line.h)
    ar = phys.area / line.area
    over = F.greatest(line.y - phys.y, phys.y2 - line.y2)
    return (
        (line.area <= 0) | (phys.area <= 0)
        | ((hr >= 1.45) & (ar >= 1.55) & (over >= F.greatest(F.lit(6.0), line.h * 0.45)))
        | ((hr >= 1.32) & (ar >= 1.85)) | ((wr >= 1.85) & (hr >= 1.12)) | (wr >= 2.4)
    )


def too_small(line: Box, phys: Box) -> Column:
    """The physical box covers too little of its OCR line."""
    wr, hr = phys.w / F.greatest(F.lit(1), line.w), phys.h / F.greatest(F.lit(1), line.h)
    ar = phys.area / line.area
    return (
        (line.area <= 0) | (phys.area <= 0) | (ar < 0.18) | ((wr < 0.50) & (ar < 0.32)) | ((hr < 0.36) & (ar < 0.32))
    )


# ---- evidence ------------------------------------------------------------------------------------

# fixed values: weight of each evidence term for icons and for shapes, in order of addition
ICON_WEIGHTS = [
    ("source_candidate", 0.20), ("foreground_claim", 0.08), ("claim_score", 0.08), ("foreground_layer", 0.06),
    ("overlay_geometry", 0.04), ("size_compactness", 0.12), ("text_anchor", 0.16), ("same_media", 0.12),
    ("repetition", 0.10), ("relation_consistency", 0.10), ("transparent_asset", 0.20), ("control_row", 0.14),
    ("text_overlap_penalty", -0.20), ("hero_penalty", -0.16), ("cleanup_risk", -0.12), ("repair_cost", -0.08),
]
SHAPE_WEIGHTS = [
    ("source_candidate", 0.18), ("foreground_claim", 0.10), ("claim_score", 0.10), ("foreground_layer", 0.08),
    ("overlay_geometry", 0.08), ("size_compactness", 0.18), ("shape_role", 0.22), ("same_media", 0.16),
    ("repetition", 0.12), ("relation_consistency", 0.08), ("text_containment", 0.10),
    ("text_overlap_penalty", -0.18), ("hero_penalty", -0.18), ("repair_cost", -0.08),
]


def evidence_score(weights: list[tuple[str, float]], prefix: str = "") -> Column:
    """Weighted evidence clamped to [0, 1], 4 decimals; a missing term counts 0."""
    total = None
    for name, weight in weights:
        term = F.coalesce(C(prefix + name), F.lit(0.0)) * F.lit(weight)
        total = term if total is None else total + term
    return half_even(clamp01(total), 4)


def hard_rejections(role: Column, candidate_decision: Column, has_media: Column, text_overlap: Column,
                    hero: Column, generic: Column) -> Column:
    """Reasons that rule a candidate out whatever its score."""
    return reasons(
        (role != "internal_icon_candidate", "not_internal_icon_candidate"),
        (candidate_decision != "accepted_report_candidate", "internal_candidate_not_accepted"),
        (generic, "generic_foreground_not_visible_replay"),
        (~has_media, "missing_parent_media_source_object"),
        (text_overlap > 0.30, "text_overlap_too_high"),
        (hero > 0.62, "hero_or_texture_risk_too_high"),
    )


def decision_mode(score: Column, hard: Column, transparent: Column, executable: Column, control_row: Column,
                  claim: Column, containment: Column, text_overlap: Column, hero: Column) -> Column:
    """reject, report_only, allow_visible_replay or allow_foreground_claim."""
    allowed = (
        (score >= 0.68) & (transparent | control_row) & executable & (containment >= 0.95)
        & (text_overlap <= 0.20) & (hero <= 0.42)
    )
    return ladder([(F.size(hard) > 0, "reject"), (allowed & claim, "allow_foreground_claim"),
                   (allowed, "allow_visible_replay"), (score >= 0.42, "report_only")], "reject")


def layout_permission(model: Column, energy: Column, confidence: Column, risks: Column) -> Column:
    """Struct of permission, confidence, threshold, reasons, risks for an auto-layout candidate."""
    threshold = F.when(model == "grid", 0.28).otherwise(0.32)
    unsupported = ~model.isin("row", "column", "grid")
    fallback = F.array_contains(risks, "absolute_layout_fallback")
    doubts = reasons(
        (~confidence.isin("high", "medium"), "layout_energy_confidence_too_low"),
        (energy > threshold, "layout_energy_above_permission_threshold"),
        (F.array_contains(risks, "high_layout_energy"), "layout_energy_risk_present"),
    )
    deferred = F.size(doubts) > 0

    def texts(*names):
        return F.array(*[F.lit(n) for n in names])

    return F.struct(
        ladder([(unsupported | fallback, "reject"), (deferred, "defer")], "allow_candidate").alias("permission"),
        ladder([(unsupported | fallback, "low"), (deferred, F.when(confidence == "low", "low").otherwise("medium"))],
               confidence).alias("confidence"),
        threshold.alias("threshold"),
        ladder([(unsupported, texts("unsupported_layout_model_for_auto_layout_permission")),
                (fallback, texts("absolute_layout_fallback_rejected")), (deferred, doubts)],
               texts("supported_model_with_low_layout_energy", "permission_only_not_materialization")).alias("reasons"),
        F.filter(F.array_distinct(F.when(unsupported, F.concat(risks, texts("unsupported_layout_model"))).otherwise(risks)),
                 lambda r: r != "").alias("risks"),
    )


def promotion(page_area: Column, image_min_area: int = 400, shape_min_area: int = 1200,
              text_ratio_max: float = 0.12) -> Column:
    """Struct of action and reason for a classified candidate.

    Reads role, kind, verdict, confidence, w, h, area, text_ratio, text_blocks and has_clip.
    """
    role, kind = C("role"), C("kind")
    aspect = C("w") / C("h")
    compact = (
        (C("area") >= 400) & (C("area") <= 24000) & (C("w") >= 10) & (C("h") >= 10) & (aspect >= 0.33)
        & (aspect <= 3.0) & (C("text_blocks") <= 2) & (C("text_ratio") <= 0.45)
    )
    image_role = role.isin("icon", "avatar", "thumbnail", "photo", "logo", "illustration")
    clip = C("has_clip") & role.isin("icon", "avatar", "thumbnail", "logo")
    internal = role.isin("thumbnail", "photo", "illustration", "logo") & (C("area") >= 8000) & (C("text_ratio") <= 0.20)
    wordy = (C("text_ratio") > text_ratio_max) | (C("text_blocks") >= 2)
    as_image = image_role & kind.isin("image", "shape")
    unknown = (role == "unknown") & (kind == "suppress")
    shape = role.isin("card_bg", "button_bg", "bar_bg") & (kind == "shape")
    divider = (role == "divider") & (kind == "shape")
    thin = (F.least(C("w"), C("h")) <= 4) & (F.greatest(C("w"), C("h")) >= 24)
    rejected = C("verdict") != "emit"
    rules = [
        (C("confidence") < 0.65, "suppress/suppress_low_confidence"),
        (role.isin("noise", "text"), "suppress/suppress_unknown_role"),
        (unknown & C("has_clip") & compact, "emit_image/emit_image_unknown_text_clipped"),
        (unknown & compact, "emit_image/emit_image_compact_unknown"),
        (unknown, "suppress/suppress_unknown_role"),
        (as_image & ((C("area") < image_min_area) | (C("w") < 10) | (C("h") < 10)), "suppress/suppress_too_small"),
        (as_image & (page_area > 0) & (C("area") > page_area * 0.40), "suppress/suppress_too_large"),
        (as_image & rejected & (kind == "image") & clip, "emit_image/emit_image_text_clipped"),
        (as_image & rejected, "suppress/suppress_classifier"),
        (as_image & wordy & clip, "emit_image/emit_image_text_clipped"),
        (as_image & wordy & internal, "emit_image/emit_image_with_internal_text"),
        (as_image & wordy & (C("text_blocks") >= 2), "suppress/suppress_contains_text"),
        (as_image & wordy, "suppress/suppress_text_overlap"),
        (as_image & (kind == "shape"), "emit_image/emit_image_kind_repaired"),
        (as_image, "emit_image/emit_image"),
        (rejected | (kind == "suppress"), "suppress/suppress_classifier"),
        (shape & ((C("area") < shape_min_area) | (C("w") < 16) | (C("h") < 8)), "suppress/suppress_too_small"),
        (shape & (page_area > 0) & (C("area") > page_area * 0.60), "suppress/suppress_full_page_backing"),
        (shape, "emit_shape/emit_shape"),
        (divider & thin, "emit_shape/emit_divider"),
        (divider, "suppress/suppress_bad_divider_geometry"),
    ]
    both = F.split(ladder(rules, "suppress/suppress_unknown_role"), "/")
    return F.struct(both[0].alias("action"), both[1].alias("reason"))


def evidence_kind() -> Column:
    """Struct of kind, decision and confidence of a piece of visual evidence.

    Reads source, suggested, support, lineage, counter, text_overlap, w, h, color_count, texture_score and
    media_confidence (a measurement).
    """
    src, text = C("source"), C("text_overlap")
    area, edge = C("w") * C("h"), F.greatest(C("w"), C("h"))
    aspect = C("w") / F.greatest(F.lit(1), C("h"))
    noise = (text >= 0.35) | (C("suggested") == "likely_text_noise")
    from_overlap = F.least(F.lit(0.99), F.greatest(F.lit(0.55), 0.55 + text * 0.4))
    conflict = noise & (C("lineage") == "conflict") & ~C("counter")
    derived = src.isin("m29_symbol", "m291_group", "after_text_mask_candidate")
    media = (
        (derived | src.isin("m29_unknown", "m29_blocked")) & (text <= 0.20) & (area >= 1200) & (aspect <= 4.0)
        & (~derived | (edge >= 72)) & ((C("color_count") >= 32) | (C("texture_score") >= 0.18))
    )
    icon = (derived | (src == "m29_blocked")) & (text <= 0.20) & (area >= 16) & (area <= 12000) & (edge <= 128)
    rules = [
        (C("support"), "other_candidate", "candidate", F.lit(0.74)),
        (conflict, "mixed_symbol_text_candidate", "uncertain", F.greatest(F.lit(0.55), F.least(F.lit(0.72), from_overlap - 0.12))),
        (noise, "text_noise", "noise", from_overlap),
        ((src == "m29_image") & (C("suggested") == "keep_accepted_image"), "accepted_image", "accepted", F.lit(0.92)),
        (media, "media_candidate", "candidate", C("media_confidence")),
        (icon, "icon_candidate", "candidate", F.lit(0.68)),
    ]
    return F.struct(
        ladder([(r[0], r[1]) for r in rules], "other_candidate").alias("kind"),
        ladder([(r[0], r[2]) for r in rules], "candidate").alias("decision"),
        ladder([(r[0], r[3]) for r in rules], 0.45).alias("confidence"),
    )


def normalize_cut_mode(v: Column) -> Column:
    return ladder([(v.isin("shape", "subject"), "subject"), (v == "card", "card")], "rect")


def cut_around(a: Box, cut: Box, min_side: int = 4, min_area: int = 96) -> Column:
    """Pieces of ``a`` above, below, left and right of ``cut``; ``a`` itself when they do not meet."""
    ix, iy = F.greatest(a.x, cut.x), F.greatest(a.y, cut.y)
    ix2, iy2 = F.least(a.x2, cut.x2), F.least(a.y2, cut.y2)

    def piece(n, x, y, w, h):
        return F.struct(F.lit(n).alias("piece"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))

    pieces = F.array(
        piece(1, a.x, a.y, a.w, iy - a.y), piece(2, a.x, iy2, a.w, a.y2 - iy2),
        piece(3, a.x, iy, ix - a.x, iy2 - iy), piece(4, ix2, iy, a.x2 - ix2, iy2 - iy),
    )
    kept = F.filter(pieces, lambda p: (p["w"] >= min_side) & (p["h"] >= min_side) & (p["w"] * p["h"] >= min_area))
    return F.when(overlap(a, cut) > 0, kept).otherwise(F.array(piece(0, a.x, a.y, a.w, a.h)))
