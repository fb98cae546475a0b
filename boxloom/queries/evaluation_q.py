"""Case tables, funnels, document rules and flow metrics."""

from pyspark.sql import functions as F

from boxloom.functions.ladders import promotion
from boxloom.operators.tree import walk
from boxloom.plans import evaluation as ev
from boxloom.queries import fixtures as fx
from boxloom.queries.fixture_sql import even, fixture
from boxloom.queries.ladders_q import ACTION_SQL, acted, classified, judged
from boxloom.queries.registry import ORACLES, query, sql

C = F.col

_RISKS = ("case_id, conflicts {d} 10 AS ownership_errors, conflicts AS ownership_conflicts, missing AS materialization_warnings, fallbacks AS materialization_skips, "
          "nodes AS deferred_auto_layout, text_blocks {d} 4 AS rejected_auto_layout, visible AS token_gaps")
fixture("risks", "SELECT " + _RISKS.format(d="//") + " FROM cases", "cases")
_COST = " + ".join(f"{n} * {w}" for n, w in ev.REPAIR_WEIGHTS.items())


def risks(spark, sf_dir):
    return fx.cases(spark, sf_dir).selectExpr(*_RISKS.format(d="div").split(", "))


@query("a13_quality_summary", sql("risks", f"""
    , s AS (SELECT case_id, {_COST} AS repair_cost, {even('1 - least(0.75::DOUBLE, (' + _COST + ') / 400.0::DOUBLE)', 3)} AS score FROM risks)
    SELECT *, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.72 THEN 'medium' ELSE 'low' END AS grade FROM s"""))
def a13(spark, sf_dir):
    return ev.quality_summary(risks(spark, sf_dir))


@query("a13_repair_cost_items", sql("risks", " UNION ALL ".join(
    f"SELECT '{n}' AS item, sum({n}) AS count, sum({n} * {w}) AS cost FROM risks WHERE {n} > 0 HAVING count(*) > 0" for n, w in ev.REPAIR_WEIGHTS.items())))
def a13_items(spark, sf_dir):
    return ev.repair_cost_items(risks(spark, sf_dir))


_REASONS = ("preserve_in_parent_raster", "skip")


@query("a14_actionable_skips", sql("regions", f"""
    SELECT page_id AS case_id, count(*) FILTER (replay_decision NOT IN {_REASONS}) AS actionable, count(*) FILTER (replay_decision IN {_REASONS}) AS expected
    FROM regions WHERE confidence = 'low' OR kind_no = 4 GROUP BY page_id"""))
def a14(spark, sf_dir):
    skips = fx.regions(spark, sf_dir).where("confidence = 'low' OR kind_no = 4").groupBy(C("page_id").alias("case_id"), C("replay_decision").alias("reason")).agg(F.count("*").alias("n"))
    return ev.skip_split(skips, _REASONS)


@query("a15_batch_summary", sql("cases", """
    SELECT count(*) AS cases, count(*) FILTER (source <> '') AS supported, count(*) FILTER (NOT source <> '') AS unsupported, count(*) FILTER (status <> 'completed') AS failed,
      count(*) FILTER (status <> 'completed' AND source <> '') AS supported_failed, sum(visible) AS visible_claims, sum(conflicts) AS conflicts, sum(missing) AS missing_artifacts,
      sum(nodes) AS nodes, sum(text_blocks) AS text_blocks, sum(fallbacks) AS fallbacks, max(elapsed_ms) AS slowest_ms, sum(elapsed_ms) AS elapsed_ms, max(conflicts) AS most_conflicts,
      sum(visible) / count(*)::DOUBLE AS mean_visible FROM cases"""))
def a15(spark, sf_dir):
    return ev.batch_summary(fx.cases(spark, sf_dir).withColumn("supported", C("source") != ""))


_FAIL = ("case_id, text_blocks % 9 <> 0 AS ocr_present, visible % 8 <> 0 AS dsl_valid, CASE WHEN nodes = 7 THEN 1 ELSE 0 END AS full_page, CASE WHEN missing = 4 THEN 2 ELSE 0 END AS missing, "
         "fallbacks % 2 AS shape_assets, CASE WHEN conflicts > 9 THEN 1 ELSE 0 END AS text_overlap, nodes AS rasters, fallbacks AS tiny")
fixture("failing", "SELECT *, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in (
    ("NOT ocr_present", "OCR_MISSING"), ("NOT dsl_valid", "DSL_INVALID"), ("full_page > 0", "FULL_PAGE_BACKING"), ("missing > 0", "MISSING_ASSET"), ("shape_assets > 0", "SHAPE_ASSET"),
    ("text_overlap > 0", "TEXT_DUPLICATED"), ("rasters > 34", "ASSET_EXPLOSION"), ("tiny > 16", "TINY_FRAGMENT_EXPLOSION"))) + f"], lambda s: s IS NOT NULL) AS failures FROM (SELECT {_FAIL} FROM cases)", "cases")


def failing(spark, sf_dir):
    rows = fx.cases(spark, sf_dir).selectExpr(*[e.strip() for e in _FAIL.split(", ")])
    return ev.failure_types(rows, 34, 16)


@query("a16_failure_classes", sql("failing", """
    SELECT case_id, array_to_string(failures, ',') AS failures, CASE WHEN list_contains(failures, 'OCR_MISSING') THEN 'ocr/provider'
      WHEN list_contains(failures, 'DSL_INVALID') OR list_contains(failures, 'MISSING_ASSET') THEN 'dsl/assets'
      WHEN list_contains(failures, 'FULL_PAGE_BACKING') OR list_contains(failures, 'TEXT_DUPLICATED') THEN 'ownership/planner'
      WHEN list_contains(failures, 'ASSET_EXPLOSION') OR list_contains(failures, 'TINY_FRAGMENT_EXPLOSION') THEN 'candidate extraction' ELSE 'unknown' END AS owner FROM failing"""))
def a16(spark, sf_dir):
    return failing(spark, sf_dir).select("case_id", F.array_join("failures", ",").alias("failures"), "owner")


@query("a16_failure_counts", sql("failing", "SELECT failure, count(*) AS n FROM (SELECT unnest(failures) AS failure FROM failing) GROUP BY failure"))
def a16_counts(spark, sf_dir):
    return failing(spark, sf_dir).select(F.explode("failures").alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))


_METRICS = {"missingAssetCount": "missing", "shapeAssetCount": "fallbacks", "fullPageVisibleRaster": "conflicts", "rasterLayerCount": "nodes"}
fixture("deltas", " UNION ALL ".join(f"SELECT case_id, '{m}' AS metric, CASE WHEN visible % 9 = 0 THEN 0 ELSE {c} END AS oracle, CASE WHEN visible % 7 = 0 THEN 0 ELSE {c} + visible % 3 - 1 END AS candidate FROM cases WHERE visible % 9 <> 0 OR visible % 7 <> 0"
                                     for m, c in _METRICS.items()), "cases")


def deltas(spark, sf_dir):
    cases = fx.cases(spark, sf_dir)
    long = cases.select("case_id", "visible", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), C(c).alias("value")) for m, c in _METRICS.items()])).alias("m")).select("case_id", "visible", "m.*")
    oracle = long.where("visible % 9 <> 0").select("case_id", "metric", "value")
    candidate = long.where("visible % 7 <> 0").selectExpr("case_id", "metric", "value + visible % 3 - 1 AS value")
    return ev.metric_deltas(oracle, candidate)


@query("a18_metric_deltas", sql("deltas", "SELECT *, candidate - oracle AS delta FROM deltas"))
def a18(spark, sf_dir):
    return deltas(spark, sf_dir)


@query("a18_hard_gate", sql("deltas", """
    , b AS (SELECT case_id, CASE WHEN candidate > 0 THEN CASE metric WHEN 'missingAssetCount' THEN 'MISSING_ASSET' WHEN 'shapeAssetCount' THEN 'SHAPE_ASSET' WHEN 'fullPageVisibleRaster' THEN 'FULL_PAGE_BACKING' END END AS f FROM deltas)
    SELECT case_id, coalesce(string_agg(DISTINCT f, ',' ORDER BY f), '') AS failures, count(f) = 0 AS passed FROM b GROUP BY case_id"""))
def a18_gate(spark, sf_dir):
    return ev.hard_gate(deltas(spark, sf_dir))


# funnel stages of internal candidates, by attributes of the region
fixture("funnel", f"""
    SELECT concat(r.page_id, '_', r.region_id) AS candidate_id, CASE r.kind_no WHEN 2 THEN 'internal_icon_candidate' WHEN 3 THEN 'internal_shape' ELSE 'other' END AS role,
      CASE WHEN r.score_milli % 9 = 0 THEN 'rejected_fragment' ELSE 'accepted_report_candidate' END AS candidate_decision,
      CASE WHEN r.partkey % 10 <> 3 THEN r.partkey % 10 <> 4 END AS eligible, CASE WHEN r.suppkey % 8 <> 2 THEN j.mode END AS mode,
      CASE WHEN r.partkey % 6 <> 1 THEN r.region_id END AS promoted_id, CASE WHEN r.suppkey % 7 <> 1 THEN r.action END AS action,
      CASE WHEN r.score_milli % 5 <> 0 THEN r.region_id END AS node_id, CASE WHEN r.score_milli % 10 = 0 THEN 'clipped' END AS skip_reason,
      CASE WHEN r.partkey % 12 = 5 THEN -1 ELSE r.page_id END AS media_id
    FROM acted r JOIN judged j ON r.page_id = j.page_id AND r.region_id = j.region_id""", "acted judged")
fixture("trace", """
    SELECT candidate_id, role, split_part(v, '/', 1) AS stage, split_part(v, '/', 2) AS reason FROM (SELECT *, CASE
      WHEN candidate_decision <> 'accepted_report_candidate' THEN 'decomposition/' || candidate_decision
      WHEN role <> 'internal_shape' AND eligible IS NULL THEN 'transparent_assets/missing_transparent_asset_item'
      WHEN role <> 'internal_shape' AND NOT eligible THEN 'transparent_assets/not_visible_replay_eligible'
      WHEN mode IS NULL THEN 'evidence_contract/missing_evidence_contract'
      WHEN mode NOT IN ('allow_visible_replay', 'allow_foreground_claim') THEN 'evidence_contract/evidence_contract_not_allowing_foreground_claim'
      WHEN promoted_id IS NULL THEN 'source_promotion/missing_promoted_source_object' WHEN action IS NULL THEN 'replay_plan/missing_final_plan_item'
      WHEN action NOT IN ('text_replay', 'image_replay', 'icon_replay', 'shape_replay') THEN 'replay_plan/' || action
      WHEN node_id IS NOT NULL THEN 'none/visible_replay_materialized' ELSE 'materialization/' || coalesce(skip_reason, 'missing_materialized_node') END AS v FROM funnel)""", "funnel")


def funnel_inputs(spark, sf_dir):
    ident = F.concat_ws("_", "page_id", "region_id")
    base = acted(spark, sf_dir).withColumn("candidate_id", ident)
    candidates = base.selectExpr(
        "candidate_id", "CASE kind_no WHEN 2 THEN 'internal_icon_candidate' WHEN 3 THEN 'internal_shape' ELSE 'other' END AS role",
        "CASE WHEN score_milli % 9 = 0 THEN 'rejected_fragment' ELSE 'accepted_report_candidate' END AS candidate_decision", "CASE WHEN partkey % 12 = 5 THEN -1L ELSE page_id END AS media_id")
    stages = {
        "transparent": base.where("partkey % 10 <> 3").selectExpr("candidate_id", "partkey % 10 <> 4 AS eligible"),
        "contract": judged(spark, sf_dir).select(ident.alias("candidate_id"), "mode").join(base.where("suppkey % 8 <> 2").select("candidate_id"), "candidate_id"),
        "promoted": base.where("partkey % 6 <> 1").selectExpr("candidate_id", "candidate_id AS promoted_id"),
        "plan": base.where("suppkey % 7 <> 1").select("candidate_id", "action"),
        "replayed": base.where("score_milli % 5 <> 0").selectExpr("candidate_id", "candidate_id AS node_id"),
        "skipped": base.where("score_milli % 10 = 0").selectExpr("candidate_id", "'clipped' AS skip_reason"),
    }
    return candidates, stages


@query("j29_funnel_trace", sql("trace", "SELECT * FROM trace"))
def j29(spark, sf_dir):
    return ev.funnel_trace(*funnel_inputs(spark, sf_dir))


@query("a29_funnel_counts", sql("trace", """
    SELECT 'stage' AS facet, stage AS value, count(*) AS n FROM trace GROUP BY stage UNION ALL SELECT 'reason', reason, count(*) FROM trace GROUP BY reason
    UNION ALL SELECT 'role', role, count(*) FROM trace GROUP BY role"""))
def a29(spark, sf_dir):
    return ev.funnel_counts(ev.funnel_trace(*funnel_inputs(spark, sf_dir)))


@query("j37_promotion_outcome", sql("funnel regions", """
    , o AS (SELECT candidate_id, CASE WHEN role = 'other' THEN 'not_promotable_internal_candidate' WHEN candidate_decision <> 'accepted_report_candidate' THEN 'internal_candidate_not_accepted'
      WHEN media_id = -1 THEN 'missing_parent_media_source_object' WHEN role = 'internal_icon_candidate' AND eligible IS NULL THEN 'missing_transparent_asset_item'
      WHEN role = 'internal_icon_candidate' AND NOT eligible THEN 'not_visible_replay_eligible' WHEN mode IS NULL THEN 'missing_evidence_contract'
      WHEN mode NOT IN ('allow_visible_replay', 'allow_foreground_claim') THEN 'evidence_contract_not_allowing_foreground_claim' ELSE '' END AS reason FROM funnel)
    SELECT *, reason = '' AS promoted FROM o"""))
def j37(spark, sf_dir):
    candidates, stages = funnel_inputs(spark, sf_dir)
    objects = fx.regions(spark, sf_dir).select(C("page_id").alias("object_id"))
    return ev.promotion_outcome(candidates, stages["transparent"], stages["contract"], objects)


def promoted(spark, sf_dir):
    return classified(spark, sf_dir).withColumn("p", promotion(F.lit(2073600), 120, 160, 0.12)).select("page_id", "area", "text_ratio", "p.action", "p.reason")


_P25 = ORACLES["p25_promotion_ladder"].rsplit("SELECT page_id, region_id, split_part", 1)[0]


@query("a24_pipeline_summary", _P25 + """
    SELECT page_id, count(*) AS candidates, count(*) FILTER (v LIKE 'emit_image%') AS images, count(*) FILTER (v LIKE 'emit_shape%') AS shapes,
      count(*) FILTER (v LIKE 'emit_image%' AND area < 400) AS tiny_images, count(*) FILTER (v LIKE 'emit_image%' AND text_ratio > 0.08) AS text_overlap_images,
      count(*) FILTER (v LIKE 'suppress%') AS suppressed FROM (SELECT d.*, c.area, c.text_ratio FROM d JOIN classified c USING (page_id, region_id)) GROUP BY page_id""")
def a24(spark, sf_dir):
    return ev.pipeline_summary(promoted(spark, sf_dir))


@query("a24_suppression_reasons", _P25 + "SELECT split_part(v, '/', 2) AS reason, count(*) AS n FROM d WHERE v LIKE 'suppress%' GROUP BY 1")
def a24_reasons(spark, sf_dir):
    return ev.suppression_reasons(promoted(spark, sf_dir))


@query("q2_layer_rules", sql("layers", """
    , v AS (SELECT page_id, region_id, unnest(list_filter([CASE WHEN visible AND kind = 'raster' AND asset_id IS NULL THEN 'DRAFT_ASSET_ID_MISSING' END,
      CASE WHEN visible AND kind = 'raster' AND asset_id IS NOT NULL AND asset_id LIKE '%7' THEN 'DRAFT_ASSET_NOT_FOUND' END,
      CASE WHEN decision IS NULL THEN 'DRAFT_DECISION_MISSING' END], lambda s: s IS NOT NULL)) AS rule FROM layers)
    SELECT * FROM v"""))
def q2(spark, sf_dir):
    layers = fx.layers(spark, sf_dir)
    assets = layers.where("asset_id IS NOT NULL AND asset_id NOT LIKE '%7'")
    return ev.layer_rule_violations(layers, assets, fx.PAGE_W, fx.PAGE_H)


_BROKEN = ("tree_id, CASE WHEN node_id = 9 AND tree_id % 4 = 0 THEN 8 ELSE node_id END AS node_id, CASE WHEN node_id = 6 AND tree_id % 3 = 0 THEN 999 ELSE parent_id END AS parent_id, ord, "
           "CASE WHEN node_id = 4 AND tree_id % 5 = 0 THEN 'blob' ELSE type END AS type, x, y, CASE WHEN node_id = 5 AND tree_id % 7 = 0 THEN 0 ELSE w END AS w, h, "
           "CASE WHEN type = 'text' AND node_id % 4 <> 0 THEN 'abc' WHEN type = 'text' THEN ' ' END AS characters")
fixture("broken", f"SELECT {_BROKEN} FROM trees", "trees")
fixture("broken_walk", """
    SELECT tree_id, node_id, 'root' AS path FROM broken WHERE parent_id IS NULL
    UNION SELECT c.tree_id, c.node_id, p.path || '.children[' || c.ord || ']' FROM broken c JOIN broken_walk p ON c.tree_id = p.tree_id AND c.parent_id = p.node_id""", "broken")


@query("q3_tree_rules", sql("broken broken_walk", """
    , n AS (SELECT b.*, count(*) OVER (PARTITION BY tree_id, node_id) AS copies FROM broken b)
    SELECT n.tree_id, n.node_id, w.path, unnest(list_filter([CASE WHEN copies > 1 THEN 'NODE_ID_DUPLICATE' END, CASE WHEN type NOT IN ('frame', 'text', 'image', 'shape') THEN 'NODE_TYPE_INVALID' END,
      CASE WHEN n.w <= 0 OR n.h <= 0 THEN 'NODE_BBOX_INVALID' END, CASE WHEN type = 'text' AND coalesce(trim(characters), '') = '' THEN 'TEXT_REQUIRED' END,
      CASE WHEN w.path IS NULL THEN 'NODE_UNREACHABLE' END], lambda s: s IS NOT NULL)) AS rule FROM n LEFT JOIN broken_walk w ON n.tree_id = w.tree_id AND n.node_id = w.node_id""", recursive=True))
def q3(spark, sf_dir):
    nodes = spark.sql(f"SELECT {_BROKEN} FROM {{t}}", t=fx.trees(spark, sf_dir))
    return ev.tree_rule_violations(nodes, walk(nodes))


@query("a30_flow_metrics", sql("regions", """
    , g AS (SELECT page_id, kind_no, region_id, x, y, w, h, lead(y) OVER (PARTITION BY page_id, kind_no ORDER BY y, x, w, h, region_id) - y - h AS g FROM regions),
    b AS (SELECT page_id, kind_no, count(*) AS n, min(x) AS hx, min(y) AS hy, max(x + w) - min(x) AS hw, max(y + h) - min(y) AS hh, sum(h) + (count(*) - 1) * 12 AS required,
      max(x) - min(x) AS cross_spread, median(w) AS median_cross, coalesce(max(g) FILTER (g > 0), 0) AS max_gap, count(g) FILTER (g > 0) AS gn, coalesce(sum(g) FILTER (g > 0), 0) AS g1,
      coalesce(sum(g * g) FILTER (g > 0), 0) AS g2 FROM g GROUP BY page_id, kind_no)
    SELECT page_id, kind_no, n, hx AS x, hy AS y, hw AS w, hh AS h, required, required / hh::DOUBLE AS fit_ratio, cross_spread, median_cross, max_gap,
      CASE WHEN gn > 0 THEN (gn * g2 - g1 * g1) / (gn * gn)::DOUBLE ELSE 0 END AS gap_variance FROM b"""))
def a30(spark, sf_dir):
    return ev.flow_metrics(fx.regions(spark, sf_dir).select("page_id", "kind_no", "region_id", "x", "y", "w", "h"), ["page_id", "kind_no"], 12)
