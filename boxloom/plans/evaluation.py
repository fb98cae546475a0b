"""Case summaries and corpus metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxloom.session import cut_lineage

C = F.col


def detection_case_summary(detections: DataFrame, matches: DataFrame) -> DataFrame:
    """Per page: detections by family, matched detections and risk flags."""
    from boxloom.operators.matching import CONTROL_CLASSES, MEDIA_CLASSES

    sizes = detections.groupBy("page_id").agg(
        F.count("*").alias("detections"), F.count(F.when(C("class_name").isin(*CONTROL_CLASSES), 1)).alias("controls"),
        F.count(F.when(C("class_name").isin(*MEDIA_CLASSES), 1)).alias("media"))
    per_detection = matches.groupBy("page_id", "detection_id").agg(
        F.max((C("decision") != "weak_match").cast("int")).alias("hit"),
        F.count(F.when(C("decision") == "ocr_overlap_risk", 1)).alias("risks"),
        F.count(F.when(C("decision") == "control_semantic_tag", 1)).alias("surfaces"))
    found = per_detection.groupBy("page_id").agg(*[F.sum(c).alias(n) for c, n in (
        ("hit", "matched"), ("risks", "risks"), ("surfaces", "surfaces"))])
    joined = sizes.join(found, "page_id", "left").fillna(0, ["matched", "risks", "surfaces"])
    return joined.select(
        "page_id", "detections", "controls", "media", "matched", "risks",
        ((C("controls") > 0) & (C("surfaces") <= 1)).alias("low_control"), (C("risks") > 0).alias("high_risk"))


# ---- two trees ---------------------------------------------------------------------------------------

_SLIM = ("tree_id", "node_id", "x", "y", "w", "h")


def agreeing_containers(own: DataFrame, other: DataFrame, floor: float = 0.6) -> DataFrame:
    """(tree_id, a_node_id, b_node_id) of containers of two trees that agree; reads both sides several times."""
    from boxloom.functions.geometry import box, iou
    from boxloom.operators.spatial import near_pairs

    return near_pairs(own.select(*_SLIM), other.select(*_SLIM), iou(box("a_"), box("b_")) >= floor, key="tree_id", spread=True).select("tree_id", "a_node_id", "b_node_id")


def container_verdicts(own: DataFrame, other: DataFrame, floor: float = 0.6) -> DataFrame:
    """Containers of one tree marked matched when some container of the other agrees."""
    own, other = cut_lineage(own), cut_lineage(other.select(*_SLIM))
    hits = agreeing_containers(own, other, floor).select("tree_id", C("a_node_id").alias("node_id")).distinct().withColumn("_hit", F.lit(True))
    joined = own.join(hits, ["tree_id", "node_id"], "left")
    return joined.withColumn("verdict", F.when(C("_hit"), "matched").otherwise("extra")).drop("_hit")


def _third(v):
    return F.rint(v * 1000) / 1000


def grouping_quality(trees: DataFrame, reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Recall, precision and F1 of container grouping per tree."""
    reference, candidate = cut_lineage(reference.select(*_SLIM)), cut_lineage(candidate.select(*_SLIM))
    pairs = agreeing_containers(reference, candidate)
    # rows of both sides and the nodes that agree, each pair once for either side
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), C(c).alias("node_id")) for side, c in ((0, "a_node_id"), (1, "b_node_id"))]))
    hits = pairs.select("tree_id", sides.alias("s")).select("tree_id", "s.*", F.lit(0).alias("n"), F.lit(1).alias("hit"))
    rows = [df.select("tree_id", F.lit(side).alias("side"), "node_id", F.lit(1).alias("n"), F.lit(0).alias("hit")) for side, df in enumerate((reference, candidate))]
    nodes = rows[0].unionAll(rows[1]).unionAll(hits).groupBy("tree_id", "side", "node_id").agg(F.sum("n").alias("n"), F.max("hit").alias("hit"))
    counts = nodes.groupBy("tree_id").agg(*[
        F.sum(F.when(C("side") == side, value).otherwise(0)).alias(name) for side, names in enumerate((("reference_n", "matched"), ("candidate_n", "matched_candidate")))
        for name, value in zip(names, (C("n"), C("n") * C("hit")))])
    joined = trees.join(counts, "tree_id", "left").fillna(0)
    joined = joined.withColumn("_r", F.when(C("reference_n") > 0, C("matched") / C("reference_n")).otherwise(0.0)).withColumn(
        "_p", F.when(C("candidate_n") > 0, C("matched_candidate") / C("candidate_n")).otherwise(0.0))
    both = C("_r") + C("_p")
    return joined.select(
        "tree_id", "reference_n", "candidate_n", "matched", "matched_candidate", _third(C("_r")).alias("recall"), _third(C("_p")).alias("precision"),
        F.when(both > 0, _third(C("_r") * 2 * C("_p") / both)).otherwise(0.0).alias("f1"),
        F.when(C("reference_n") > 0, _third(C("candidate_n") / C("reference_n"))).otherwise(0.0).alias("container_ratio"))


def batch_score(quality: DataFrame, reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Mean and worst score over all trees: 0.7 recall + 0.3 depth agreement."""
    r = reference.groupBy("tree_id").agg(F.max("depth").alias("_rd"))
    c = candidate.groupBy("tree_id").agg(F.max("depth").alias("_cd"))
    depth = F.least("_cd", "_rd") / F.greatest(C("_rd"), F.lit(1))
    scored = quality.join(r, "tree_id").join(c, "tree_id").withColumn("score", _third(C("recall") * 0.7 + depth * 0.3))
    return scored.agg(F.count("*").alias("cases"), _third(F.avg("score")).alias("mean_score"), F.min("score").alias("worst_score"),
                      _third(F.avg("container_ratio")).alias("mean_ratio"))


def first_events(events: DataFrame) -> DataFrame:
    """Earliest event per node."""
    return events.groupBy("node_id").agg(F.min("event_id").alias("event_id"))


def feature_records(verdicts: DataFrame, walked: DataFrame, events: DataFrame) -> DataFrame:
    """Container verdicts with tree facts, parent area and the first create event."""
    from boxloom.operators.tree import with_children

    # containers and their parents have children
    inner = cut_lineage(with_children(walked).where("children > 0").select("tree_id", "node_id", "parent_id", "children", "depth", "w", "h"))
    nodes = inner.withColumnsRenamed({"w": "nw", "h": "nh"})
    parents = inner.select("tree_id", C("node_id").alias("parent_id"), (C("w") * C("h")).alias("parent_area"))
    facts = verdicts.select("tree_id", "node_id", "verdict", "leaves", (C("has_text") == 1).alias("has_text"), (C("has_image") == 1).alias("has_image"))
    joined = facts.join(nodes, ["tree_id", "node_id"]).join(parents, ["tree_id", "parent_id"], "left").join(first_events(events), "node_id", "left")
    ratio = F.when(C("parent_area") > 0, F.rint(C("nw") * C("nh") / C("parent_area") * 10000) / 10000)
    return joined.select("tree_id", "node_id", "verdict", "leaves", "has_text", "has_image", "children", "depth", F.least("nw", "nh").alias("short_side"),
                         ratio.alias("area_ratio"), "event_id", (C("node_id") % 2 == 0).alias("spatial"))


def _binned(records: DataFrame) -> DataFrame:
    from boxloom.functions.ladders import area_ratio_bin, short_side_bin

    return records.withColumn("side_bin", short_side_bin(C("short_side"))).withColumn("area_bin", area_ratio_bin(C("area_ratio")))


def feature_distribution(records: DataFrame) -> DataFrame:
    """Matched and extra counts per feature value, in one pass over the records."""
    names = ("has_text", "side_bin", "area_bin", "depth")
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), C(n).cast("string").alias("value")) for n in names])
    long = _binned(records).select("verdict", F.explode(pairs).alias("p")).select("verdict", "p.*")
    counts = long.groupBy("feature", "value").agg(F.count(F.when(C("verdict") == "matched", 1)).alias("matched"),
                                                  F.count(F.when(C("verdict") == "extra", 1)).alias("extra"))
    return counts.withColumn("precision", _third(C("matched") / (C("matched") + C("extra"))))


def top_extra_signatures(records: DataFrame, n: int) -> DataFrame:
    """Most frequent feature combinations among extras."""
    signature = F.concat_ws("|", C("has_text").cast("string"), "side_bin", "area_bin")
    counts = _binned(records).groupBy(signature.alias("signature")).agg(
        F.count(F.when(C("verdict") == "matched", 1)).alias("matched"), F.count(F.when(C("verdict") == "extra", 1)).alias("extra"))
    return counts.orderBy(C("extra").desc(), "matched", "signature").limit(n)


def rule_backtest(records: DataFrame) -> DataFrame:
    """What each collapse rule would have removed, and at what cost."""
    quiet = ~C("has_text")
    rules = {"spatial<=20": C("spatial") & quiet & (C("short_side") <= 20), "spatial<=32": C("spatial") & quiet & (C("short_side") <= 32),
             "layer<=8": ~C("spatial") & quiet & (C("short_side") <= 8), "any<=8": quiet & (C("short_side") <= 8)}
    hits = F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("hit")) for n, c in rules.items()])
    long = records.select("verdict", F.explode(hits).alias("r")).select("verdict", "r.*")
    matched, extra, hit = C("verdict") == "matched", C("verdict") == "extra", C("hit")
    sums = long.groupBy("rule").agg(
        F.count(F.when(hit, 1)).alias("collapsed"), F.count(F.when(hit & extra, 1)).alias("extra"),
        F.count(F.when(hit & matched, 1)).alias("matched_lost"), F.count(F.when(matched, 1)).alias("_all"))
    return sums.withColumn("precision", F.when(C("collapsed") > 0, _third(C("extra") / C("collapsed"))).otherwise(0.0)).withColumn(
        "recall_risk", F.when(C("_all") > 0, _third(C("matched_lost") / C("_all"))).otherwise(0.0)).drop("_all")


def tree_states(links: DataFrame) -> DataFrame:
    """Each child of a proposed grouping: on a cycle, an inferred root (its parent is unknown), or fine."""
    from boxloom.operators.tree import cycle_members

    known = links.select("page_id", C("child_id").alias("parent_id")).distinct().withColumn("_known", F.lit(True))
    cycles = cycle_members(links).withColumnRenamed("id", "child_id").withColumn("_cycle", F.lit(True))
    joined = links.join(known, ["page_id", "parent_id"], "left").join(cycles, ["page_id", "child_id"], "left")
    state = F.when(C("_cycle"), "cycle").when(C("_known").isNull(), "root").otherwise("ok")
    return joined.select("page_id", C("child_id").alias("id"), state.alias("state"))


def batch_states(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Batches sent without an answer and answers nobody asked for."""
    a, b = sent.distinct().withColumn("_sent", F.lit(True)), received.distinct().withColumn("_got", F.lit(True))
    return a.join(b, "batch", "full").select("batch", F.when(C("_sent").isNull(), "unknown_batch_id").when(
        C("_got").isNull(), "missing_model_result").otherwise("ok").alias("state"))


# ---- case tables -------------------------------------------------------------------------------------

# fixed values: repair weight of each kind of risk
REPAIR_WEIGHTS = {"ownership_errors": 8, "ownership_conflicts": 4, "materialization_warnings": 3, "materialization_skips": 2,
                  "deferred_auto_layout": 1, "rejected_auto_layout": 2, "token_gaps": 1}


def quality_summary(risks: DataFrame) -> DataFrame:
    """Repair cost, score and grade of each case from its risk counts."""
    cost = None
    for name, weight in REPAIR_WEIGHTS.items():
        term = C(name) * weight
        cost = term if cost is None else cost + term
    scored = risks.withColumn("repair_cost", cost).withColumn("score", _third(1.0 - F.least(F.lit(0.75), C("repair_cost") / 400.0)))
    grade = F.when(C("score") >= 0.90, "high").when(C("score") >= 0.72, "medium").otherwise("low")
    return scored.select("case_id", "repair_cost", "score", grade.alias("grade"))


def repair_cost_items(risks: DataFrame) -> DataFrame:
    """Corpus cost of each kind of risk that occurs."""
    items = F.array(*[F.struct(F.lit(n).alias("item"), C(n).alias("count"), (C(n) * w).alias("cost")) for n, w in REPAIR_WEIGHTS.items()])
    return risks.select(F.explode(items).alias("i")).select("i.*").where("count > 0").groupBy("item").agg(F.sum("count").alias("count"), F.sum("cost").alias("cost"))


def skip_split(skips: DataFrame, ignored: tuple[str, ...]) -> DataFrame:
    """Skips somebody has to act on, and those that are expected."""
    quiet = C("reason").isin(*ignored)
    return skips.groupBy("case_id").agg(F.sum(F.when(quiet, 0).otherwise(C("n"))).alias("actionable"), F.sum(F.when(quiet, C("n")).otherwise(0)).alias("expected"))


def batch_summary(cases: DataFrame) -> DataFrame:
    """Totals, averages and maxima over all cases in one aggregation."""
    done, ok = C("status") == "completed", C("supported")
    return cases.agg(
        F.count("*").alias("cases"), F.count(F.when(ok, 1)).alias("supported"), F.count(F.when(~ok, 1)).alias("unsupported"),
        F.count(F.when(~done, 1)).alias("failed"), F.count(F.when(~done & ok, 1)).alias("supported_failed"),
        F.sum("visible").alias("visible_claims"), F.sum("conflicts").alias("conflicts"), F.sum("missing").alias("missing_artifacts"),
        F.sum("nodes").alias("nodes"), F.sum("text_blocks").alias("text_blocks"), F.sum("fallbacks").alias("fallbacks"),
        F.max("elapsed_ms").alias("slowest_ms"), F.sum("elapsed_ms").alias("elapsed_ms"),
        F.max("conflicts").alias("most_conflicts"), (F.sum("visible") / F.count("*")).alias("mean_visible"))


def failure_types(rows: DataFrame, max_rasters: int, max_tiny: int) -> DataFrame:
    """Failure types of a case and the part suspected."""
    from boxloom.functions.ladders import ladder, reasons

    found = reasons((~C("ocr_present"), "OCR_MISSING"), (~C("dsl_valid"), "DSL_INVALID"), (C("full_page") > 0, "FULL_PAGE_BACKING"),
                    (C("missing") > 0, "MISSING_ASSET"), (C("shape_assets") > 0, "SHAPE_ASSET"), (C("text_overlap") > 0, "TEXT_DUPLICATED"),
                    (C("rasters") > max_rasters, "ASSET_EXPLOSION"), (C("tiny") > max_tiny, "TINY_FRAGMENT_EXPLOSION"))

    def any_of(*names):
        return F.arrays_overlap("failures", F.array(*[F.lit(n) for n in names]))

    owner = ladder([(any_of("OCR_MISSING"), "ocr/provider"), (any_of("PIPELINE_EXCEPTION", "IMAGE_LOAD_FAILURE"), "batch/input"),
                    (any_of("DSL_INVALID", "MISSING_ASSET"), "dsl/assets"), (any_of("FULL_PAGE_BACKING", "TEXT_DUPLICATED"), "ownership/planner"),
                    (any_of("ASSET_EXPLOSION", "TINY_FRAGMENT_EXPLOSION"), "candidate extraction")], "unknown")
    return rows.withColumn("failures", found).withColumn("owner", owner)


def metric_deltas(oracle: DataFrame, candidate: DataFrame) -> DataFrame:
    """Metric by metric difference of two runs of a case; a metric missing on one side counts 0."""
    joined = oracle.withColumnRenamed("value", "oracle").join(candidate.withColumnRenamed("value", "candidate"), ["case_id", "metric"], "full").fillna(0, ["oracle", "candidate"])
    return joined.withColumn("delta", C("candidate") - C("oracle"))


def hard_gate(deltas: DataFrame) -> DataFrame:
    """Cases whose candidate run breaks a hard rule."""
    gates = {"missingAssetCount": "MISSING_ASSET", "shapeAssetCount": "SHAPE_ASSET", "fullPageVisibleRaster": "FULL_PAGE_BACKING"}
    bad = F.coalesce(*[F.when((C("metric") == m) & (C("candidate") > 0), F.lit(n)) for m, n in gates.items()])
    return deltas.groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_set(bad)), ",").alias("failures")).withColumn("passed", C("failures") == "")


def funnel_trace(candidates: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """Each candidate through the later stages, and the first one that stopped it.

    ``stages`` maps transparent, contract, promoted, plan, replayed and skipped to tables keyed by candidate_id.
    """
    joined = candidates
    for name, table in stages.items():
        joined = joined.join(table, "candidate_id", "left")
    shape = C("role") == "internal_shape"
    shown = C("action").isin("text_replay", "image_replay", "icon_replay", "shape_replay")
    rules = [
        (C("candidate_decision") != "accepted_report_candidate", F.lit("decomposition"), C("candidate_decision")),
        (~shape & C("eligible").isNull(), F.lit("transparent_assets"), F.lit("missing_transparent_asset_item")),
        (~shape & ~C("eligible"), F.lit("transparent_assets"), F.lit("not_visible_replay_eligible")),
        (C("mode").isNull(), F.lit("evidence_contract"), F.lit("missing_evidence_contract")),
        (~C("mode").isin("allow_visible_replay", "allow_foreground_claim"), F.lit("evidence_contract"), F.lit("evidence_contract_not_allowing_foreground_claim")),
        (C("promoted_id").isNull(), F.lit("source_promotion"), F.lit("missing_promoted_source_object")),
        (C("action").isNull(), F.lit("replay_plan"), F.lit("missing_final_plan_item")),
        (~shown, F.lit("replay_plan"), C("action")),
        (C("node_id").isNotNull(), F.lit("none"), F.lit("visible_replay_materialized")),
    ]
    stage, reason = F.lit("materialization"), F.coalesce("skip_reason", F.lit("missing_materialized_node"))
    for condition, s, r in reversed(rules):
        hit = F.coalesce(condition, F.lit(False))
        stage, reason = F.when(hit, s).otherwise(stage), F.when(hit, r).otherwise(reason)
    return joined.select("candidate_id", "role", stage.alias("stage"), reason.alias("reason"))


def funnel_counts(trace: DataFrame) -> DataFrame:
    """Counts by stage, by reason and by role in one pass over the trace."""
    parts = F.array(*[F.struct(F.lit(k).alias("facet"), C(k).alias("value")) for k in ("stage", "reason", "role")])
    return trace.select(F.explode(parts).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def promotion_outcome(candidates: DataFrame, assets: DataFrame, contracts: DataFrame, objects: DataFrame) -> DataFrame:
    """Promoted or rejected with the first reason; reads role, decision, media_id and the joined tables."""
    from boxloom.functions.ladders import ladder

    known = objects.select(C("object_id").alias("media_id"), F.lit(True).alias("_media")).distinct()
    j = candidates.join(assets, "candidate_id", "left").join(contracts, "candidate_id", "left").join(known, "media_id", "left")
    icon = C("role") == "internal_icon_candidate"
    reason = ladder([
        (~C("role").isin("internal_icon_candidate", "internal_shape"), "not_promotable_internal_candidate"),
        (C("candidate_decision") != "accepted_report_candidate", "internal_candidate_not_accepted"),
        (C("_media").isNull(), "missing_parent_media_source_object"),
        (icon & C("eligible").isNull(), "missing_transparent_asset_item"), (icon & ~C("eligible"), "not_visible_replay_eligible"),
        (C("mode").isNull(), "missing_evidence_contract"),
        (~C("mode").isin("allow_visible_replay", "allow_foreground_claim"), "evidence_contract_not_allowing_foreground_claim"),
    ], "")
    return j.select("candidate_id", reason.alias("reason"), (reason == "").alias("promoted"))


def pipeline_summary(elements: DataFrame, text_ratio: float = 0.08) -> DataFrame:
    """Per page: emitted elements by kind, tiny images, images over text and suppressions."""
    image = C("action") == "emit_image"
    return elements.groupBy("page_id").agg(
        F.count("*").alias("candidates"), F.count(F.when(image, 1)).alias("images"), F.count(F.when(C("action") == "emit_shape", 1)).alias("shapes"),
        F.count(F.when(image & (C("area") < 400), 1)).alias("tiny_images"), F.count(F.when(image & (C("text_ratio") > text_ratio), 1)).alias("text_overlap_images"),
        F.count(F.when(C("action") == "suppress", 1)).alias("suppressed"))


def suppression_reasons(elements: DataFrame) -> DataFrame:
    return elements.where("action = 'suppress'").groupBy("reason").agg(F.count("*").alias("n"))


def layer_rule_violations(layers: DataFrame, assets: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Layer rules: reference shown, asset missing or unknown, full-page backing, decision missing."""
    known = assets.select("page_id", "asset_id").distinct().withColumn("_known", F.lit(True))
    j = layers.join(known, ["page_id", "asset_id"], "left")
    from boxloom.functions.ladders import reasons

    raster = C("visible") & (C("kind") == "raster")
    inside_w = F.greatest(F.lit(0), F.least(C("x") + C("w"), F.lit(page_w)) - F.greatest(C("x"), F.lit(0)))
    inside_h = F.greatest(F.lit(0), F.least(C("y") + C("h"), F.lit(page_h)) - F.greatest(C("y"), F.lit(0)))
    rules = reasons(
        (C("visible") & (C("kind") == "reference"), "DRAFT_REFERENCE_IMAGE_VISIBLE"), (raster & C("asset_id").isNull(), "DRAFT_ASSET_ID_MISSING"),
        (raster & C("asset_id").isNotNull() & C("_known").isNull(), "DRAFT_ASSET_NOT_FOUND"),
        (raster & (inside_w * inside_h / (page_w * page_h) >= 0.98), "DRAFT_VISIBLE_FULL_IMAGE_BACKING"), (C("decision").isNull(), "DRAFT_DECISION_MISSING"))
    return j.select("page_id", "region_id", F.explode(rules).alias("rule"))


def tree_rule_violations(nodes: DataFrame, walked: DataFrame) -> DataFrame:
    """Document rules on flattened nodes: repeated ids, bad types, empty boxes, missing text, unknown parents, leaf frames."""
    from boxloom.functions.ladders import reasons

    copies = nodes.groupBy("tree_id", "node_id").agg(F.count("*").alias("_copies"))
    paths = walked.select("tree_id", "node_id", "path").distinct()
    j = nodes.join(copies, ["tree_id", "node_id"]).join(paths, ["tree_id", "node_id"], "left")
    rules = reasons((C("_copies") > 1, "NODE_ID_DUPLICATE"), (~C("type").isin("frame", "text", "image", "shape"), "NODE_TYPE_INVALID"),
                    ((C("w") <= 0) | (C("h") <= 0), "NODE_BBOX_INVALID"), ((C("type") == "text") & (F.coalesce(F.trim("characters"), F.lit("")) == ""), "TEXT_REQUIRED"),
                    (C("path").isNull(), "NODE_UNREACHABLE"))
    return j.select("tree_id", "node_id", "path", F.explode(rules).alias("rule"))


def flow_metrics(members: DataFrame, keys: list[str], expected_gap: int) -> DataFrame:
    """Vertical flow of a group: hull, required size, fit, cross spread, median cross size, gaps."""
    from boxloom.functions.geometry import hull
    from boxloom.operators.ranking import following
    from boxloom.operators.raster import order_statistic

    gaps = following(members, keys, C("y"), [C("y"), C("x"), C("w"), C("h"), C("region_id")], ["y"]).withColumn("g", C("next_y") - C("y") - C("h")).where("g > 0")
    stats = gaps.groupBy(*keys).agg(F.max("g").alias("max_gap"), F.count("*").alias("_gn"), F.sum("g").alias("_g1"), F.sum(C("g") * C("g")).alias("_g2"))
    base = members.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("h").alias("_sum"), (F.max("x") - F.min("x")).alias("cross_spread"),
                                      F.median("w").alias("median_cross"), *hull())
    s = base.join(stats, keys, "left").fillna(0, ["max_gap", "_gn", "_g1", "_g2"])
    required = (C("n") - 1) * expected_gap + C("_sum")
    variance = F.when(C("_gn") > 0, (C("_gn") * C("_g2") - C("_g1") * C("_g1")) / (C("_gn") * C("_gn"))).otherwise(0.0)
    return s.select(*keys, "n", "x", "y", "w", "h", required.alias("required"), (required / C("h")).alias("fit_ratio"), "cross_spread", "median_cross", "max_gap",
                    variance.alias("gap_variance"))
