"""DuckDB twins of the derivations in ``fixtures``, and small SQL text helpers."""

from __future__ import annotations

from boxloom.queries import fixtures as fx


def duck(expr: str) -> str:
    """Spark spelling to DuckDB spelling for the few tokens that differ."""
    return expr.replace(" div ", " // ").replace("0L", "0").replace("1L", "1").replace("D AS", " AS")


_BASE = ", ".join(duck(e) for e in fx.REGION_BASE)
_BOX = ", ".join(fx.REGION_BOX)
_KIND = ", ".join(f"{e} AS {n}" for n, e in fx.KIND.items())

FIXTURE_SQL = {
    "regions": f"""
        SELECT page_id, region_id, {_BOX}, score_milli, kind_no, {_KIND}, partkey, suppkey, copy_no
        FROM (SELECT {_BASE} FROM (SELECT *, unnest(CASE (l_partkey + l_linenumber) % 10 WHEN 0 THEN [0, 1]
              WHEN 5 THEN [0, 2] WHEN 7 THEN [0, 3] ELSE [0] END) AS copy_no FROM lineitem))""",
    "layers": """
        SELECT page_id, region_id, x, y, w, h, score_milli AS z, score_milli % 10 <> 0 AS visible,
          CASE kind_no WHEN 0 THEN 'text' WHEN 3 THEN 'shape' ELSE 'raster' END AS kind,
          CASE WHEN suppkey % 3 = 0 THEN NULL ELSE suppkey % 3 END AS group_id,
          CASE WHEN score_milli % 17 = 0 THEN NULL ELSE concat('asset_', partkey) END AS asset_id,
          CASE WHEN score_milli % 13 = 0 THEN NULL ELSE replay_decision END AS decision FROM regions""",
    "detections": """
        SELECT page_id, region_id, x + suppkey % 7 AS x, y, w, h, score_milli / 1000.0 AS score,
          CASE WHEN copy_no = 3 OR kind_no = 3 THEN 'overview' ELSE 'tile' END AS source_kind,
          CASE WHEN kind_no = 4 THEN NULL ELSE concat('item ', partkey) END AS name,
          CASE kind_no WHEN 0 THEN 'Text' WHEN 1 THEN 'Image' WHEN 2 THEN 'Icon' WHEN 3 THEN 'TextButton' ELSE 'Card' END AS class_name FROM regions""",
    "slices": """
        SELECT page_id, region_id, x, y, w, h, CASE kind_no WHEN 0 THEN 'rect' WHEN 1 THEN 'subject' WHEN 2 THEN 'shape'
          ELSE 'card' END AS cut_mode FROM regions WHERE confidence = 'high'""",
    "primitives": """
        SELECT page_id, region_id, x, y, w, h, kind_no, w * h AS area, (score_milli % 100) / 100.0 AS fill_ratio,
          score_milli % 40 AS color_count, (suppkey % 50) / 100.0 AS edge_density,
          least(1.0, (suppkey % 50) / 100.0 + (score_milli % 40) / 96.0) AS texture_score FROM regions""",
    "text_lines": """
        SELECT page_id, region_id AS line_id, x, y, w, h, score_milli % 101 AS conf, concat('Line ', partkey) AS text
        FROM regions WHERE kind_no = 0""",
    "ocr_words": """
        SELECT page_id, pos, text, pos // 24 AS block, 0::BIGINT AS par, (pos // 6) % 4 AS line, pos % 6 AS word,
          20 + 90 * (pos % 6) AS x, 30 + 28 * (pos // 6) AS y, least(8 * length(text), 88) AS w, 20::BIGINT AS h,
          (page_id * 13 + pos * 7) % 100 AS conf
        FROM (SELECT doc_id AS page_id, unnest(toks) AS text, unnest(range(len(toks))) AS pos
              FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g'), ' '),
                    lambda t: t <> '') AS toks FROM documents))""",
    "trees": "", "trees4": "",
    "style_elements": """
        SELECT *, CASE WHEN (tree_id + node_id) % 11 = 0 THEN 'red' WHEN (tree_id + node_id) % 5 = 0
            THEN concat(' #', lpad(lower(hex(((node_id * 7919) % 12) * 1381653)), 6, '0'))
            ELSE concat('#', lpad(hex(((node_id * 7919) % 12) * 1381653), 6, '0')) END AS fill,
          CASE WHEN type = 'text' THEN concat('#', lpad(hex((tree_id % 7) * 2236962), 6, '0')) END AS color,
          CASE WHEN type = 'text' AND node_id % 4 <> 0 THEN 10 + 2 * (tree_id % 5) END AS font_size,
          CASE WHEN type = 'text' AND node_id % 3 = 0 THEN 700 WHEN type = 'text' THEN 400 END AS font_weight,
          CASE WHEN type = 'text' THEN concat('Family', tree_id % 2) END AS font_family,
          CASE WHEN node_id % 6 = 0 THEN NULL ELSE (node_id % 4) * 4.5::DOUBLE END AS radius,
          CASE WHEN node_id % 6 = 0 THEN [(tree_id % 3) * 2.5::DOUBLE, 4.0, -1.0, (node_id % 2) * 8.0::DOUBLE] END AS corners
        FROM trees""",
    "projects": """
        SELECT o_orderkey AS project_id, o_custkey AS user_id, concat('Project ', o_orderkey) AS name,
          o_orderdate AS updated_at FROM orders""",
    "catalog_pages": """
        SELECT l_orderkey AS project_id, l_linenumber::BIGINT AS page_index,
          concat('page_', lpad(l_linenumber::VARCHAR, 3, '0')) AS page_name,
          400 + 16 * (l_orderkey % 9) + 8 * l_linenumber AS width,
          600 + 20 * (l_orderkey % 7) + 10 * l_linenumber AS height, count(*) AS n_lines
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "catalog_slices": """
        SELECT l_orderkey AS project_id, l_linenumber::BIGINT AS page_index,
          (l_partkey * 1000 + l_suppkey % 1000) * 64 + CAST(l_quantity AS BIGINT) AS slice_id,
          CASE WHEN l_returnflag = 'R' THEN concat('Hero ', l_partkey)
            ELSE concat('slice_', lpad((l_partkey % 1000)::VARCHAR, greatest(2, length((l_partkey % 1000)::VARCHAR))::INT, '0')) END AS name,
          CASE l_returnflag WHEN 'A' THEN 'rect' WHEN 'N' THEN 'subject' ELSE 'card' END AS cut_mode,
          12 * (l_partkey % 75) AS x, 24 * (l_suppkey % 70) AS y,
          8 * (1 + l_partkey % 20) AS w, 8 * (1 + CAST(l_quantity AS BIGINT) % 12) AS h FROM lineitem""",
    "job_events": """
        SELECT event_id, user_id AS job_id, ts, value, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running'
          WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'canceled' END AS status FROM events""",
    "cases": """
        SELECT doc_id AS case_id, lang, source, CASE WHEN toxic = 1 THEN 'failed' WHEN n_chars % 23 = 0 THEN 'skipped'
            ELSE 'completed' END AS status, n_chars % 97 AS visible, n_chars % 13 AS conflicts, doc_id % 5 AS missing,
          n_chars % 41 AS nodes, n_chars % 29 AS text_blocks, doc_id % 19 AS fallbacks, n_chars * 7 % 1000 AS elapsed_ms,
          coalesce(quality, 0) AS quality
        FROM documents LEFT JOIN labels USING (doc_id)""",
}


def _trees(arity: int) -> str:
    return f"""
        SELECT tree_id, node_id, CASE WHEN node_id = 1 THEN NULL ELSE (node_id - 2) // {arity} + 1 END AS parent_id,
          CASE WHEN node_id = 1 THEN 0 ELSE (node_id - 2) % {arity} END AS ord,
          CASE WHEN {arity} * (node_id - 1) + 2 <= n_nodes THEN 'frame' WHEN size % 2 = 0 THEN 'text'
            ELSE 'image' END AS type,
          12 * ((size * 7 + node_id * 37) % 75) AS x, 24 * ((size * 5 + node_id * 29) % 70) AS y,
          8 * (1 + (node_id * 11 + size) % 20) AS w, 8 * (1 + (node_id * 7 + size) % 12) AS h
        FROM (SELECT doc_id AS tree_id, len(parts) AS n_nodes, unnest(range(1, len(parts) + 1)) AS node_id, length(unnest(parts)) AS size
              FROM (SELECT doc_id, list_filter(string_split_regex(text, '[.\n]+'), lambda s: trim(s) <> '') AS parts FROM documents))"""


FIXTURE_SQL["trees"] = _trees(3)
FIXTURE_SQL["trees4"] = _trees(4)

FIXTURE_NEEDS = {
    "layers": ["regions"], "detections": ["regions"], "slices": ["regions"], "primitives": ["regions"],
    "text_lines": ["regions"], "style_elements": ["trees"],
}


def fixture(name: str, text: str, needs: str = "") -> None:
    """Add a derived input used by several statements."""
    FIXTURE_SQL[name] = text
    FIXTURE_NEEDS[name] = needs.split()


def inter(a: str, b: str) -> str:
    return (
        f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
        f" * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    )


def iou(a: str, b: str) -> str:
    i = inter(a, b)
    return f"(CASE WHEN {i} > 0 THEN {i} / ({a}.w * {a}.h + {b}.w * {b}.h - {i})::DOUBLE ELSE 0.0 END)"


def ioa(a: str, b: str) -> str:
    return f"({inter(a, b)} / greatest(1, {a}.w * {a}.h)::DOUBLE)"


def gapx(a: str, b: str) -> str:
    return f"greatest(0, greatest({a}.x, {b}.x) - least({a}.x + {a}.w, {b}.x + {b}.w))"


def gapy(a: str, b: str) -> str:
    return f"greatest(0, greatest({a}.y, {b}.y) - least({a}.y + {a}.h, {b}.y + {b}.h))"


def gap(a: str, b: str) -> str:
    return f"greatest({gapx(a, b)}, {gapy(a, b)})"


def inside(outer: str, inner: str, t: int) -> str:
    return (
        f"({inner}.x >= {outer}.x - {t} AND {inner}.y >= {outer}.y - {t} AND {inner}.x + {inner}.w <= {outer}.x + {outer}.w + {t}"
        f" AND {inner}.y + {inner}.h <= {outer}.y + {outer}.h + {t})"
    )


def even(expr: str, digits: int) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


def up(expr: str, digits: int = 0) -> str:
    return f"(floor(({expr}) * 1e{digits} + 0.5) / 1e{digits})" if digits else f"floor(({expr}) + 0.5)"


def greedy(source: str, fields: str, order: str, pred: str) -> str:
    """Rows kept when taken in ``order`` per page unless ``pred`` holds between a kept row k and the candidate x[1]."""
    struct = "{" + ", ".join(f"'{f}': {f}" for f in fields.split()) + "}"
    return f"""
        SELECT page_id, unnest(list_reduce(list([{struct}] ORDER BY {order}), lambda acc, x: CASE WHEN
          len(list_filter(acc, lambda k: {pred})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS r
        FROM {source} GROUP BY page_id"""
