"""Replay plan, ownership conservation and hierarchy."""

from pyspark.sql import functions as F

from boxloom.functions.ladders import is_visible
from boxloom.plans import hierarchy as hi
from boxloom.plans import ownership as own
from boxloom.plans import replay as rp
from boxloom.queries import fixtures as fx
from boxloom.queries.fixture_sql import even, fixture
from boxloom.queries.ladders_q import acted
from boxloom.queries.registry import query, sql
from boxloom.session import cut_lineage

C = F.col
VIS = "('text_replay', 'image_replay', 'icon_replay', 'shape_replay')"
_CARRY = ", ".join(f"{p}.{c} AS {p}_{c}" for p in "ab" for c in ("pixel_owner", "replay_decision", "confidence", "action", "x", "y", "w", "h"))
fixture("oedges", f"SELECT e.*, {_CARRY} FROM edges e JOIN acted a ON e.page_id = a.page_id AND e.left_id = a.region_id JOIN acted b ON e.page_id = b.page_id AND e.right_id = b.region_id",
        "edges acted")
_SIDE = ("SELECT page_id, {i} AS own_id, {j} AS other_id, primary_rel, {r} AS own_in_other, primary_rel = '{k}' AS contained, "
         + ", ".join(f"{{{p}}}_{c} AS {n}_{c}" for p, n in (("p", "own"), ("q", "other")) for c in ("pixel_owner", "replay_decision", "confidence", "action", "x", "y", "w", "h"))
         + " FROM oedges")
fixture("dedges", _SIDE.format(i="left_id", j="right_id", r="left_in_right", k="contained_by", p="a", q="b") + " UNION ALL "
        + _SIDE.format(i="right_id", j="left_id", r="right_in_left", k="contains", p="b", q="a"), "oedges")
_HELD = "(primary_rel = 'near_equal' OR contained OR own_in_other >= {t})"

_OWNER = "CASE {p}_pixel_owner WHEN 'editable_text' THEN 50 WHEN 'preserve_raster' THEN 40 WHEN 'raster_icon' THEN 35 WHEN 'shape_geometry' THEN 30 WHEN 'fallback_only' THEN 10 ELSE 0 END"
_PRIO = _OWNER + " * 10 + CASE {p}_confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
fixture("ne_dup", f"""
    SELECT DISTINCT page_id, r.s AS region_id FROM (SELECT page_id, unnest(list_reduce(list([{{'l': l, 'r': r, 's': s}}] ORDER BY l, r), lambda acc, x:
      CASE WHEN len(list_filter(acc, lambda k: (k.s = x[1].l OR k.s = x[1].r) AND k.l < x[1].l)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS r
      FROM (SELECT page_id, left_id AS l, right_id AS r, CASE WHEN {_PRIO.format(p='a')} >= {_PRIO.format(p='b')} THEN right_id ELSE left_id END AS s
        FROM oedges WHERE primary_rel = 'near_equal') GROUP BY page_id)""", "oedges")
_ACT = "CASE {p}_action WHEN 'image_replay' THEN 0 WHEN 'text_replay' THEN 1 WHEN 'shape_replay' THEN 2 WHEN 'icon_replay' THEN 3 ELSE 9 END"
_CONF = "CASE {p}_confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
_RANK = "({a}, {c}, -{p}_w * {p}_h, {i})"
_RA = _RANK.format(a=_ACT.format(p="a"), c=_CONF.format(p="a"), p="a", i="left_id")
_RB = _RANK.format(a=_ACT.format(p="b"), c=_CONF.format(p="b"), p="b", i="right_id")
fixture("losers", f"""
    SELECT DISTINCT page_id, r.s AS region_id FROM (SELECT page_id, unnest(list_reduce(list([{{'f': f, 's': s}}] ORDER BY rank, s), lambda acc, x:
      CASE WHEN len(list_filter(acc, lambda k: k.s = x[1].f OR k.s = x[1].s)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS r
      FROM (SELECT *, shared_area / least(a_w * a_h, b_w * b_h)::DOUBLE AS ratio, CASE WHEN {_RB} < {_RA} THEN {_RB} ELSE {_RA} END AS rank,
          CASE WHEN {_RB} < {_RA} THEN right_id ELSE left_id END AS f, CASE WHEN {_RB} < {_RA} THEN left_id ELSE right_id END AS s,
          CASE WHEN {_RB} < {_RA} THEN b_action ELSE a_action END AS one, CASE WHEN {_RB} < {_RA} THEN a_action ELSE b_action END AS two
        FROM oedges e WHERE a_action IN {VIS} AND b_action IN {VIS} AND (page_id, left_id) NOT IN (SELECT page_id, region_id FROM ne_dup)
          AND (page_id, right_id) NOT IN (SELECT page_id, region_id FROM ne_dup))
      WHERE primary_rel = 'near_equal' OR (primary_rel <> 'disjoint' AND (
        (one = two AND a_pixel_owner = b_pixel_owner AND (CASE WHEN one = 'image_replay' THEN ratio >= 0.35 OR (primary_rel LIKE 'contain%' AND ratio >= 0.2) ELSE ratio >= 0.2 END))
        OR (one = 'image_replay' AND two = 'icon_replay' AND ratio >= 0.2) OR (one = 'text_replay' AND two = 'icon_replay' AND ratio >= 0.25)))
      GROUP BY page_id)""", "oedges ne_dup")
fixture("plan", f"""
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE final_action WHEN 'shape_replay' THEN 0 WHEN 'image_replay' THEN 1 WHEN 'icon_replay' THEN 2
        WHEN 'text_replay' THEN 3 WHEN 'preserve_in_parent_raster' THEN 4 WHEN 'fallback_only' THEN 5 WHEN 'diagnostic_only' THEN 6 ELSE 7 END, region_id) AS position
    FROM (SELECT *, CASE WHEN why IS NULL THEN action ELSE 'suppress_duplicate' END AS final_action FROM (
      SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN action IN {VIS} AND row_number() OVER (PARTITION BY page_id, early IS NULL AND action IN {VIS}
          ORDER BY CASE action WHEN 'shape_replay' THEN 0 WHEN 'image_replay' THEN 1 WHEN 'icon_replay' THEN 2 ELSE 3 END,
          CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, region_id) > 8 THEN 'node_budget_suppressed' END AS why
      FROM (SELECT a.*, CASE WHEN n.region_id IS NOT NULL THEN 'near_equal_duplicate_suppressed' WHEN l.region_id IS NOT NULL THEN 'visible_overlap_duplicate_suppressed' END AS early
        FROM acted a LEFT JOIN ne_dup n ON a.page_id = n.page_id AND a.region_id = n.region_id LEFT JOIN losers l ON a.page_id = l.page_id AND a.region_id = l.region_id)))""",
        "acted ne_dup losers")


def edges_of(spark, sf_dir):
    return rp.object_edges(acted(spark, sf_dir))


@query("g3_near_equal_claim", sql("ne_dup", "SELECT page_id, region_id AS id FROM ne_dup"))
def g3(spark, sf_dir):
    return rp.near_equal_duplicates(edges_of(spark, sf_dir))


@query("g11_replay_plan", sql("plan", "SELECT page_id, region_id, final_action, why, position FROM plan"))
def g11(spark, sf_dir):
    return rp.replay_plan(fx.regions(spark, sf_dir), 8).select("page_id", "region_id", "final_action", "why", "position")


@query("g11_plan_summary", sql("plan", "SELECT final_action, why, count(*) AS n FROM plan GROUP BY 1, 2"))
def g11_summary(spark, sf_dir):
    return rp.plan_summary(rp.replay_plan(fx.regions(spark, sf_dir), 8))


@query("t3_node_budget", sql("acted", f"""
    SELECT page_id, region_id, row_number() OVER (PARTITION BY page_id ORDER BY CASE action WHEN 'shape_replay' THEN 0 WHEN 'image_replay' THEN 1 WHEN 'icon_replay' THEN 2 ELSE 3 END,
      CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, region_id) AS budget_rank, budget_rank > 10 AS over_budget FROM acted WHERE action IN {VIS}"""))
def t3(spark, sf_dir):
    shown = acted(spark, sf_dir).where(is_visible(C("action")))
    return rp.budget(shown, 10).select("page_id", "region_id", "budget_rank", "over_budget")


fixture("targets", f"""
    SELECT page_id, own_id AS region_id, other_id AS target_id, CASE WHEN own_action = 'text_replay' THEN 'editable_text_contained_by_media'
      ELSE 'shape_background_contained_by_media' END AS reason
    FROM dedges WHERE other_replay_decision = 'image_replay' AND other_pixel_owner = 'preserve_raster'
      AND ((own_action = 'text_replay' AND {_HELD.format(t=0.2)}) OR (own_action = 'shape_replay' AND {_HELD.format(t=0.7)}))""", "dedges")


@query("j36_cleanup_targets", sql("targets", "SELECT * FROM targets"))
def j36(spark, sf_dir):
    return rp.cleanup_targets(edges_of(spark, sf_dir))


# a plan whose targets lost the rows of some media objects
fixture("kept_targets", "SELECT * FROM targets WHERE target_id % 3 <> 0", "targets")
fixture("wild_claims", f"""
    SELECT page_id, region_id, 'fallback' AS target, NULL::BIGINT AS target_id, 'replayed_visible_object' AS reason FROM acted
    UNION ALL SELECT page_id, own_id, 'copied_image_asset', CASE WHEN own_id % 11 = 0 THEN -other_id ELSE other_id END, 'shape_background_contained_by_media' FROM dedges
      WHERE own_action IN {VIS}""", "acted dedges")


def wild_claims(spark, sf_dir, plan, edges):
    """Claims as an untrusted producer might send them."""
    fallback = plan.selectExpr("page_id", "region_id", "'fallback' AS target", "CAST(NULL AS BIGINT) AS target_id", "'replayed_visible_object' AS reason")
    copied = rp.directed(edges).where(is_visible(C("own_action"))).selectExpr(
        "page_id", "own_id AS region_id", "'copied_image_asset' AS target", "CASE WHEN own_id % 11 = 0 THEN -other_id ELSE other_id END AS target_id",
        "'shape_background_contained_by_media' AS reason")
    return fallback.unionByName(copied)


fixture("j26", f"""
    SELECT page_id, left_id, right_id FROM (SELECT e.*, CASE WHEN a_action = 'text_replay' AND b_action = 'image_replay' THEN left_id WHEN b_action = 'text_replay' AND a_action = 'image_replay' THEN right_id END AS t,
        CASE WHEN a_action = 'text_replay' AND b_action = 'image_replay' THEN right_id WHEN b_action = 'text_replay' AND a_action = 'image_replay' THEN left_id END AS m,
        primary_rel = 'near_equal' OR (a_action = 'text_replay' AND (primary_rel = 'contained_by' OR left_in_right >= 0.2)) OR (b_action = 'text_replay' AND (primary_rel = 'contains' OR right_in_left >= 0.2)) AS held
      FROM oedges e WHERE a_action IN {VIS} AND b_action IN {VIS} AND (shared_area / least(a_w * a_h, b_w * b_h)::DOUBLE >= 0.2 OR primary_rel = 'near_equal')
        AND (a_action = 'shape_replay') = (b_action = 'shape_replay'))
    WHERE NOT (t IS NOT NULL AND held AND (page_id, t, m) IN (SELECT page_id, region_id, target_id FROM kept_targets))""", "oedges kept_targets")
fixture("j27", f"""
    SELECT page_id, own_id AS region_id, other_id AS target_id FROM dedges WHERE own_action = 'text_replay' AND other_action = 'image_replay'
      AND {_HELD.format(t=0.2)} AND (page_id, own_id, other_id) NOT IN (SELECT page_id, region_id, target_id FROM kept_targets)""", "dedges kept_targets")
fixture("j28", f"""
    SELECT page_id, region_id, target_id, reason, problem FROM (SELECT c.*, CASE WHEN c.target = 'fallback' THEN CASE WHEN p.action IN {VIS} THEN '' ELSE 'invalid_fallback_cleanup_claim' END
        WHEN t.region_id IS NULL THEN 'target source object is missing'
        WHEN NOT (t.pixel_owner = 'preserve_raster' AND t.replay_decision = 'image_replay') THEN 'target must be preserve_raster image_replay media'
        WHEN p.action IN ('text_replay', 'shape_replay') AND coalesce(h.held, false) THEN '' ELSE 'not authorized' END AS problem
      FROM wild_claims c LEFT JOIN acted p ON c.page_id = p.page_id AND c.region_id = p.region_id LEFT JOIN acted t ON c.page_id = t.page_id AND c.target_id = t.region_id
      LEFT JOIN (SELECT page_id, own_id, other_id, {_HELD.format(t=0.2)} AS held FROM dedges) h ON h.page_id = c.page_id AND h.own_id = c.region_id AND h.other_id = c.target_id)
    WHERE problem <> ''""", "wild_claims acted dedges")


@query("j26_overlap_conflicts", sql("j26", "SELECT * FROM j26"))
def j26(spark, sf_dir):
    edges = cut_lineage(edges_of(spark, sf_dir))
    return own.overlap_conflicts(edges, rp.cleanup_targets(edges).where("target_id % 3 <> 0")).drop("type")


@query("j27_missing_cleanup", sql("j27", "SELECT * FROM j27"))
def j27(spark, sf_dir):
    edges = cut_lineage(edges_of(spark, sf_dir))
    return own.missing_cleanup(edges, rp.cleanup_targets(edges).where("target_id % 3 <> 0"))


@query("j28_invalid_cleanup", sql("j28", "SELECT * FROM j28"))
def j28(spark, sf_dir):
    plan = acted(spark, sf_dir)
    edges = cut_lineage(rp.object_edges(plan))
    return own.invalid_cleanup(wild_claims(spark, sf_dir, plan, edges), plan, plan, edges)


@query("q5_claims", sql("acted targets", f"""
    SELECT page_id, region_id, 'visible' AS claim, role AS detail, NULL::BIGINT AS target_id FROM acted WHERE action IN {VIS}
    UNION ALL SELECT page_id, region_id, 'fallback', 'replayed_visible_object', NULL FROM acted WHERE action IN {VIS}
    UNION ALL SELECT page_id, region_id, 'copied_image_asset', reason, target_id FROM targets"""))
def q5(spark, sf_dir):
    plan = acted(spark, sf_dir)
    shown = own.visible_claims(plan).select("page_id", "region_id", F.lit("visible").alias("claim"), C("role").alias("detail"), F.lit(None).cast("bigint").alias("target_id"))
    cleaned = own.cleanup_claims(plan, rp.cleanup_targets(rp.object_edges(plan))).select(
        "page_id", "region_id", C("target").alias("claim"), C("reason").alias("detail"), "target_id")
    return shown.unionByName(cleaned)


@query("q4_ownership_report", sql("j26 j27 j28 acted", f"""
    SELECT page_id, 'warning' AS severity, 'visible_ownership_overlap' AS type, left_id AS object_id, right_id AS other_id FROM j26
    UNION ALL SELECT page_id, 'warning', 'missing_copied_image_asset_cleanup', region_id, target_id FROM j27
    UNION ALL SELECT page_id, 'error', 'invalid_copied_image_asset_cleanup', region_id, target_id FROM j28
    UNION ALL SELECT page_id, 'error', 'non_visible_action_has_visible_claim', region_id, NULL FROM acted WHERE action NOT IN {VIS} AND region_id % 17 = 0"""))
def q4(spark, sf_dir):
    # some hidden rows wrongly name a role
    plan = acted(spark, sf_dir).withColumn("role", F.expr("CASE WHEN region_id % 17 = 0 THEN 'm29_text' ELSE role END"))
    edges = cut_lineage(rp.object_edges(plan))
    targets = rp.cleanup_targets(edges).where("target_id % 3 <> 0")
    return own.conflict_report(plan, edges, targets, wild_claims(spark, sf_dir, plan, edges))


_AREA = "(other_w * other_h)"
_CHILD = "(own_w * own_h)::DOUBLE"
_IMB = even("(abs((own_x - other_x) - (other_x + other_w - own_x - own_w)) / greatest(1, other_w)::DOUBLE + abs((own_y - other_y) - (other_y + other_h - own_y - own_h)) / greatest(1, other_h)::DOUBLE) / 2", 6)
_CV = "CASE {c} WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 WHEN 'low' THEN 0.4 ELSE 0.5 END::DOUBLE"
_HI = "greatest(0, least(own_x + own_w, other_x + other_w) - greatest(own_x, other_x)) * greatest(0, least(own_y + own_h, other_y + other_h) - greatest(own_y, other_y))"
fixture("parenting", f"""
    SELECT *, CASE WHEN score >= 0.74 THEN 'high' WHEN score >= 0.52 THEN 'medium' ELSE 'low' END AS confidence FROM (
      SELECT page_id, other_id AS parent_id, own_id AS child_id, least(1.0, {_IMB}) AS imbalance, {_AREA} AS parent_area,
        array_to_string(list_filter([CASE WHEN primary_rel = 'overlaps' THEN 'overlap_not_strict_containment' END, CASE WHEN own_confidence = 'low' OR other_confidence = 'low' THEN 'low_confidence_member' END,
          CASE WHEN {_AREA} / {_CHILD} > 60 THEN 'parent_may_be_page_region' END], lambda s: s IS NOT NULL), ',') AS risks,
        {even(f"greatest(0::DOUBLE, least(1::DOUBLE, own_in_other * 0.48::DOUBLE + {_HI} / {_CHILD} * 0.24::DOUBLE + least({_CV.format(c='own_confidence')}, {_CV.format(c='other_confidence')}) * 0.2::DOUBLE + CASE other_pixel_owner WHEN 'shape_geometry' THEN 0.04 WHEN 'preserve_raster' THEN 0.03 ELSE 0 END::DOUBLE - least(0.28::DOUBLE, greatest(0::DOUBLE, ({_AREA} / {_CHILD} - 12) / 80)) - least(1.0, {_IMB}) * 0.12::DOUBLE))", 3)} AS score
      FROM dedges WHERE other_action IN ('image_replay', 'shape_replay') AND own_action IN {VIS} AND primary_rel <> 'near_equal'
        AND (contained OR (primary_rel = 'overlaps' AND own_in_other >= 0.55)))""", "dedges")
fixture("best_parent", """
    SELECT page_id, child_id, parent_id, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id, child_id ORDER BY score DESC, parent_area, parent_id) AS n FROM parenting) WHERE n = 1""", "parenting")


@query("j25_hierarchy_candidates", sql("parenting", "SELECT page_id, parent_id, child_id, score, confidence, imbalance, parent_area, risks FROM parenting"))
def j25(spark, sf_dir):
    return hi.parent_candidates(edges_of(spark, sf_dir)).withColumn("risks", F.array_join("risks", ","))


@query("a11_containers", sql("parenting", f"""
    SELECT page_id, parent_id, count(*) AS children, {even('avg(score)', 3)} AS score, arg_min(child_id, (-score, child_id)) AS best_child,
      CASE WHEN {even('avg(score)', 3)} >= 0.74 THEN 'high' WHEN {even('avg(score)', 3)} >= 0.52 THEN 'medium' ELSE 'low' END AS confidence FROM parenting GROUP BY 1, 2"""))
def a11(spark, sf_dir):
    return hi.containers(hi.parent_candidates(edges_of(spark, sf_dir)))


@query("t6_best_parent", sql("best_parent", "SELECT * FROM best_parent"))
def t6(spark, sf_dir):
    return hi.best_parents(hi.parent_candidates(edges_of(spark, sf_dir)))
