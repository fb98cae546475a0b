"""Trees: flattening, closure, metrics and comparison of two trees."""

from pyspark.sql import functions as F

from boxloom.operators import matching as m
from boxloom.operators import tree as tr
from boxloom.plans import evaluation as ev
from boxloom.queries import fixtures as fx
from boxloom.queries.fixture_sql import even, fixture, iou
from boxloom.queries.registry import query, sql

C = F.col


def _walk_sql(source):
    return f"""
        SELECT t.*, 0 AS depth, 0 AS frames_above, 'root' AS path, []::BIGINT[] AS ancestors, x AS abs_x, y AS abs_y FROM {source} t WHERE parent_id IS NULL
        UNION ALL SELECT c.*, p.depth + 1, p.frames_above + CASE WHEN p.type = 'frame' AND p.node_id % 2 = 0 THEN 1 ELSE 0 END,
          p.path || '.children[' || c.ord || ']', list_append(p.ancestors, p.node_id), p.abs_x + c.x, p.abs_y + c.y
        FROM {source} c JOIN {{me}} p ON c.tree_id = p.tree_id AND c.parent_id = p.node_id"""


fixture("walked", _walk_sql("trees").format(me="walked"), "trees")
fixture("walked4", _walk_sql("trees4").format(me="walked4"), "trees4")


# of the lists, what containers need
_ABOVE = ("ancestors",)


def walked(spark, sf_dir, arity=3, lists=True):
    return tr.walk(fx.trees(spark, sf_dir, arity), (C("type") == "frame") & (C("node_id") % 2 == 0), lists=lists)


@query("src9_flatten_tree", sql("walked", "SELECT tree_id, node_id, parent_id, depth, path FROM walked", recursive=True))
def src9(spark, sf_dir):
    return walked(spark, sf_dir).select("tree_id", "node_id", "parent_id", "depth", "path")


@query("src10_absolute_coordinates", sql("walked", "SELECT tree_id, node_id, abs_x, abs_y, w, h FROM walked", recursive=True))
def src10(spark, sf_dir):
    return walked(spark, sf_dir, lists=False).select("tree_id", "node_id", "abs_x", "abs_y", "w", "h")


def _facts_sql(walk):
    return f"""
        SELECT d.tree_id, d.anc AS node_id, count(*) AS descendants, count(*) FILTER (type <> 'frame') AS leaves, min(x) FILTER (type <> 'frame') AS x,
          min(y) FILTER (type <> 'frame') AS y, max(x + w) FILTER (type <> 'frame') - min(x) FILTER (type <> 'frame') AS w,
          max(y + h) FILTER (type <> 'frame') - min(y) FILTER (type <> 'frame') AS h, max((type = 'text')::INT) AS has_text, max((type = 'image')::INT) AS has_image
        FROM (SELECT *, unnest(ancestors) AS anc FROM {walk}) d GROUP BY 1, 2"""


fixture("facts", _facts_sql("walked"), "walked")
fixture("facts4", _facts_sql("walked4"), "walked4")


@query("g4_subtree_facts", sql("facts", "SELECT * FROM facts", recursive=True))
def g4(spark, sf_dir):
    return tr.subtree_facts(walked(spark, sf_dir, lists=_ABOVE))


@query("g4_marked_depth", sql("walked", "SELECT tree_id, node_id, depth, frames_above FROM walked", recursive=True))
def g4_marked(spark, sf_dir):
    return walked(spark, sf_dir, lists=False).select("tree_id", "node_id", "depth", C("marked_depth").alias("frames_above"))


fixture("sized", """
    SELECT w.*, coalesce(c.n, 0) AS children FROM {w} w LEFT JOIN (SELECT tree_id, parent_id, count(*) AS n FROM {w} GROUP BY 1, 2) c
      ON w.tree_id = c.tree_id AND w.node_id = c.parent_id""".format(w="walked"), "walked")
fixture("sized4", """
    SELECT w.*, coalesce(c.n, 0) AS children FROM {w} w LEFT JOIN (SELECT tree_id, parent_id, count(*) AS n FROM {w} GROUP BY 1, 2) c
      ON w.tree_id = c.tree_id AND w.node_id = c.parent_id""".format(w="walked4"), "walked4")


def _metrics_sql(sized):
    return f"""
        SELECT tree_id, count(*) AS total, max(depth) AS max_depth, max(CASE WHEN depth = 0 THEN children END) AS top_children,
          count(*) FILTER (children > 0) AS containers, count(*) FILTER (children = 0) AS leaves, count(*) FILTER (type = 'frame') AS n_frame,
          count(*) FILTER (type = 'text') AS n_text, count(*) FILTER (type = 'image') AS n_image, {even('avg(depth)', 2)} AS avg_depth,
          coalesce({even('avg(children) FILTER (children > 0)', 2)}, 0) AS avg_fanout FROM {sized} GROUP BY tree_id"""


@query("a19_tree_metrics", sql("sized", _metrics_sql("sized"), recursive=True))
def a19(spark, sf_dir):
    return tr.tree_metrics(walked(spark, sf_dir, lists=False))


_CMP = f"""
    , r AS (SELECT * FROM facts WHERE leaves >= 2), c AS (SELECT * FROM facts4 WHERE leaves >= 2),
    rm AS (SELECT r.tree_id, r.node_id, max(CASE WHEN c.node_id IS NULL THEN 0 ELSE {iou('r', 'c')} END) AS best FROM r LEFT JOIN c ON r.tree_id = c.tree_id GROUP BY 1, 2),
    cm AS (SELECT c.tree_id, c.node_id, max(CASE WHEN r.node_id IS NULL THEN 0 ELSE {iou('c', 'r')} END) AS best FROM c LEFT JOIN r ON r.tree_id = c.tree_id GROUP BY 1, 2)"""
_GROUPING = _CMP + """
    , rs AS (SELECT tree_id, count(*) AS n, count(*) FILTER (best >= 0.6) AS hit FROM rm GROUP BY 1),
    cs AS (SELECT tree_id, count(*) AS n, count(*) FILTER (best >= 0.6) AS hit FROM cm GROUP BY 1),
    q AS (SELECT d.doc_id AS tree_id, coalesce(rs.n, 0) AS reference_n, coalesce(cs.n, 0) AS candidate_n, coalesce(rs.hit, 0) AS matched, coalesce(cs.hit, 0) AS matched_candidate,
        CASE WHEN rs.n > 0 THEN rs.hit / rs.n::DOUBLE ELSE 0 END AS r0, CASE WHEN cs.n > 0 THEN cs.hit / cs.n::DOUBLE ELSE 0 END AS p0
      FROM documents d LEFT JOIN rs ON rs.tree_id = doc_id LEFT JOIN cs ON cs.tree_id = doc_id)"""
_ROUNDED = f"""{even('r0', 3)} AS recall, {even('p0', 3)} AS precision, CASE WHEN r0 + p0 > 0 THEN {even('2 * r0 * p0 / (r0 + p0)', 3)} ELSE 0 END AS f1,
      CASE WHEN reference_n > 0 THEN {even('candidate_n / reference_n::DOUBLE', 3)} ELSE 0 END AS container_ratio"""


@query("a20_grouping_quality", sql("facts facts4", _GROUPING + f"""
    SELECT tree_id, reference_n, candidate_n, matched, matched_candidate, {_ROUNDED} FROM q""", recursive=True))
def a20(spark, sf_dir):
    trees = fx.table(spark, sf_dir, "documents").select(C("doc_id").alias("tree_id"))
    return ev.grouping_quality(trees, tr.containers(walked(spark, sf_dir, 3, _ABOVE)), tr.containers(walked(spark, sf_dir, 4, _ABOVE)))


@query("a20_container_verdicts", sql("facts facts4", _CMP + """
    SELECT tree_id, node_id, CASE WHEN best >= 0.6 THEN 'matched' ELSE 'extra' END AS verdict FROM cm""", recursive=True))
def a20_verdicts(spark, sf_dir):
    found = ev.container_verdicts(tr.containers(walked(spark, sf_dir, 4, _ABOVE)), tr.containers(walked(spark, sf_dir, 3, _ABOVE)))
    return found.select("tree_id", "node_id", "verdict")


@query("a21_batch_score", sql("facts facts4 sized sized4", _GROUPING + f"""
    , k AS (SELECT q.*, {_ROUNDED}, rm.max_depth AS rd, cm.max_depth AS cd FROM q JOIN (SELECT tree_id, max(depth) AS max_depth FROM sized GROUP BY 1) rm USING (tree_id)
      JOIN (SELECT tree_id, max(depth) AS max_depth FROM sized4 GROUP BY 1) cm USING (tree_id)),
    s AS (SELECT *, {even('0.7::DOUBLE * recall + 0.3::DOUBLE * (least(cd, rd) / greatest(rd, 1)::DOUBLE)', 3)} AS score FROM k)
    SELECT count(*) AS cases, {even('avg(score)', 3)} AS mean_score, min(score) AS worst_score, {even('avg(container_ratio)', 3)} AS mean_ratio FROM s""", recursive=True))
def a21(spark, sf_dir):
    trees = fx.table(spark, sf_dir, "documents").select(C("doc_id").alias("tree_id"))
    reference, candidate = walked(spark, sf_dir, 3, _ABOVE), walked(spark, sf_dir, 4, _ABOVE)
    quality = ev.grouping_quality(trees, tr.containers(reference), tr.containers(candidate))
    return ev.batch_score(quality, reference, candidate)


# group evidence records: container verdicts joined to tree facts and to the first create event of a node
fixture("records", f"""
    SELECT cm.tree_id, cm.node_id, CASE WHEN best >= 0.6 THEN 'matched' ELSE 'extra' END AS verdict, f.leaves, f.has_text = 1 AS has_text, f.has_image = 1 AS has_image,
      s.children, s.depth, least(s.w, s.h) AS short_side, s.parent_id, e.event_id,
      CASE WHEN p.w * p.h > 0 THEN {even('s.w * s.h / (p.w * p.h)::DOUBLE', 4)} END AS area_ratio, s.node_id % 2 = 0 AS spatial
    FROM ({_CMP.strip().lstrip(',').strip().replace('r AS (', 'WITH r AS (', 1)} SELECT * FROM cm) cm
    JOIN facts4 f ON f.tree_id = cm.tree_id AND f.node_id = cm.node_id JOIN sized4 s ON s.tree_id = cm.tree_id AND s.node_id = cm.node_id
    LEFT JOIN sized4 p ON p.tree_id = s.tree_id AND p.node_id = s.parent_id
    LEFT JOIN (SELECT (props->>'$.k')::BIGINT AS node_id, min(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1) e ON e.node_id = cm.node_id""",
        "facts facts4 sized4")


def records(spark, sf_dir):
    cand = walked(spark, sf_dir, 4, _ABOVE)
    verdicts = ev.container_verdicts(tr.containers(cand), tr.containers(walked(spark, sf_dir, 3, _ABOVE)))
    events = fx.table(spark, sf_dir, "events").where("event_type = 'signup'").selectExpr(
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS node_id", "event_id")
    return ev.feature_records(verdicts, cand, events)


@query("j30_feature_records", sql("records", """
    SELECT tree_id, node_id, verdict, leaves, has_text, has_image, children, depth, short_side, area_ratio, event_id FROM records""", recursive=True))
def j30(spark, sf_dir):
    return records(spark, sf_dir).select("tree_id", "node_id", "verdict", "leaves", "has_text", "has_image", "children", "depth",
                                         "short_side", "area_ratio", "event_id")


_BINS = """CASE WHEN short_side IS NULL THEN 'missing' WHEN short_side <= 8 THEN '000-008' WHEN short_side <= 20 THEN '009-020' WHEN short_side <= 40 THEN '021-040'
      WHEN short_side <= 80 THEN '041-080' ELSE '081+' END AS side_bin, CASE WHEN area_ratio IS NULL THEN 'missing' WHEN area_ratio <= 0.01 THEN '0.00-0.01'
      WHEN area_ratio <= 0.05 THEN '0.01-0.05' WHEN area_ratio <= 0.15 THEN '0.05-0.15' WHEN area_ratio <= 0.4 THEN '0.15-0.40' ELSE '0.40+' END AS area_bin"""


@query("a22_feature_distribution", sql("records", f"""
    , b AS (SELECT *, {_BINS} FROM records),
    u AS (SELECT 'has_text' AS feature, has_text::VARCHAR AS value, verdict FROM b UNION ALL SELECT 'side_bin', side_bin, verdict FROM b
      UNION ALL SELECT 'area_bin', area_bin, verdict FROM b UNION ALL SELECT 'depth', depth::VARCHAR, verdict FROM b)
    SELECT feature, value, count(*) FILTER (verdict = 'matched') AS matched, count(*) FILTER (verdict = 'extra') AS extra,
      {even("count(*) FILTER (verdict = 'matched') / count(*)::DOUBLE", 3)} AS precision FROM u GROUP BY feature, value""", recursive=True))
def a22(spark, sf_dir):
    return ev.feature_distribution(records(spark, sf_dir))


@query("a22_top_extra_signatures", sql("records", f"""
    , b AS (SELECT *, {_BINS} FROM records)
    SELECT concat_ws('|', has_text::VARCHAR, side_bin, area_bin) AS signature, count(*) FILTER (verdict = 'matched') AS matched,
      count(*) FILTER (verdict = 'extra') AS extra FROM b GROUP BY 1 ORDER BY extra DESC, matched, signature LIMIT 12""", recursive=True))
def a22_signatures(spark, sf_dir):
    return ev.top_extra_signatures(records(spark, sf_dir), 12)


@query("a23_rule_backtest", sql("records", """
    , r AS (SELECT 'spatial<=20' AS rule, spatial AND NOT has_text AND short_side <= 20 AS hit, verdict FROM records
      UNION ALL SELECT 'spatial<=32', spatial AND NOT has_text AND short_side <= 32, verdict FROM records
      UNION ALL SELECT 'layer<=8', NOT spatial AND NOT has_text AND short_side <= 8, verdict FROM records
      UNION ALL SELECT 'any<=8', NOT has_text AND short_side <= 8, verdict FROM records)
    SELECT rule, count(*) FILTER (hit) AS collapsed, count(*) FILTER (hit AND verdict = 'extra') AS extra, count(*) FILTER (hit AND verdict = 'matched') AS matched_lost,
      CASE WHEN count(*) FILTER (hit) > 0 THEN round_even(count(*) FILTER (hit AND verdict = 'extra') / count(*) FILTER (hit)::DOUBLE * 1000, 0) / 1000 ELSE 0 END AS precision,
      CASE WHEN count(*) FILTER (verdict = 'matched') > 0 THEN round_even(count(*) FILTER (hit AND verdict = 'matched') / count(*) FILTER (verdict = 'matched')::DOUBLE * 1000, 0) / 1000
        ELSE 0 END AS recall_risk FROM r GROUP BY rule""", recursive=True))
def a23(spark, sf_dir):
    return ev.rule_backtest(records(spark, sf_dir))


@query("st6_first_create_event", sql("", """
    , c AS (SELECT event_id, unnest([(props->>'$.k')::BIGINT, user_id]) AS node_id FROM events WHERE event_type = 'signup')
    SELECT node_id, min(event_id) AS event_id FROM c GROUP BY node_id""".replace(", c AS", "WITH c AS", 1)))
def st6(spark, sf_dir):
    """First create event of each node; the ids of an event are exploded first."""
    events = fx.table(spark, sf_dir, "events").where("event_type = 'signup'").selectExpr(
        "event_id", "array(CAST(get_json_object(props, '$.k') AS BIGINT), user_id) AS ids")
    return ev.first_events(events.select("event_id", F.explode("ids").alias("node_id")))


@query("g5_slice_parent_depth", sql("parents", """
    , d AS (SELECT page_id, region_id, parent_id, 1 AS depth FROM parents WHERE parent_id IS NULL
      UNION ALL SELECT c.page_id, c.region_id, c.parent_id, d.depth + 1 FROM parents c JOIN d ON c.page_id = d.page_id AND c.parent_id = d.region_id)
    SELECT page_id, region_id, depth FROM d""", recursive=True))
def g5(spark, sf_dir):
    """Parent links of slices with their depth; no depth cap applies."""
    linked = m.smallest_parents(fx.slices(spark, sf_dir)).select(
        C("page_id").alias("tree_id"), C("region_id").alias("node_id"), "parent_id", F.lit(0).alias("ord"), C("rel_x").alias("x"), C("rel_y").alias("y"), "w", "h")
    return tr.walk(linked, lists=False).select(C("tree_id").alias("page_id"), C("node_id").alias("region_id"), (C("depth") + 1).alias("depth"))




@query("g17_tree_checks", sql("", """
    WITH RECURSIVE l AS (SELECT event_id // 50 AS page_id, event_id % 50 AS child_id, (event_id % 50 * 7 + user_id % 10 * 3) % 60 AS parent_id FROM events
      UNION SELECT event_id // 50, event_id % 50, (event_id + 1) % 50 FROM events WHERE event_type = 'error' AND user_id % 3 = 0),
    r AS (SELECT page_id, child_id AS src, parent_id AS dst FROM l UNION SELECT r.page_id, r.src, l.parent_id FROM r JOIN l ON r.page_id = l.page_id AND r.dst = l.child_id)
    SELECT page_id, child_id AS id, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.page_id = l.page_id AND r.src = r.dst AND r.src = l.child_id) THEN 'cycle'
      WHEN NOT EXISTS (SELECT 1 FROM l p WHERE p.page_id = l.page_id AND p.child_id = l.parent_id) THEN 'root' ELSE 'ok' END AS state FROM l"""))
def g17(spark, sf_dir):
    """Fifty events make a proposed grouping; each names a parent, some of them two, and some parents are unknown."""
    events = fx.table(spark, sf_dir, "events")
    links = events.selectExpr("event_id div 50 AS page_id", "event_id % 50 AS child_id", "(event_id % 50 * 7 + user_id % 10 * 3) % 60 AS parent_id")
    second = events.where("event_type = 'error' AND user_id % 3 = 0").selectExpr("event_id div 50 AS page_id", "event_id % 50 AS child_id", "(event_id + 1) % 50 AS parent_id")
    return ev.tree_states(links.unionByName(second).distinct())


@query("g17_unreached_nodes", sql("", """
    WITH RECURSIVE l AS (SELECT event_id // 50 AS page_id, event_id % 50 AS node_id, CASE WHEN event_id % 50 < 4 THEN NULL ELSE (event_id % 50 * 7 + user_id % 10 * 3) % 55 END AS parent_id FROM events),
    up AS (SELECT page_id, node_id, node_id AS at, parent_id, 0 AS n FROM l UNION ALL SELECT u.page_id, u.node_id, l.node_id, l.parent_id, n + 1 FROM up u JOIN l ON u.page_id = l.page_id AND u.parent_id = l.node_id WHERE n < 60),
    top AS (SELECT page_id, node_id, max(n) AS n, arg_max(parent_id, n) AS last, bool_or(parent_id IS NULL) AS rooted FROM up GROUP BY 1, 2)
    SELECT page_id, node_id, CASE WHEN n >= 60 THEN 'on_or_below_a_cycle' WHEN n = 0 THEN 'missing_parent' ELSE 'below_a_missing_parent' END AS reason FROM top WHERE NOT rooted"""))
def g17_unreached(spark, sf_dir):
    """Members of a proposed grouping that hang on no root, and why."""
    links = fx.table(spark, sf_dir, "events").selectExpr(
        "event_id div 50 AS page_id", "event_id % 50 AS node_id", "CASE WHEN event_id % 50 < 4 THEN NULL ELSE (event_id % 50 * 7 + user_id % 10 * 3) % 55 END AS parent_id")
    return tr.unreached(links, "page_id")


@query("g17_batch_check", sql("cases", """
    SELECT coalesce(i.batch, r.batch) AS batch, CASE WHEN i.batch IS NULL THEN 'unknown_batch_id' WHEN r.batch IS NULL THEN 'missing_model_result' ELSE 'ok' END AS state
    FROM (SELECT DISTINCT case_id AS batch FROM cases WHERE status <> 'skipped') i FULL JOIN (SELECT DISTINCT case_id AS batch FROM cases WHERE missing <> 3) r USING (batch)"""))
def g17_batches(spark, sf_dir):
    cases = fx.cases(spark, sf_dir)
    return ev.batch_states(cases.where("status <> 'skipped'").select(C("case_id").alias("batch")), cases.where("missing <> 3").select(C("case_id").alias("batch")))
