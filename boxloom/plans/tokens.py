"""Design tokens of layout trees: colours, radii, text styles and spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxloom.functions.color import normal_hex
from boxloom.functions.ladders import confidence_for_count
from boxloom.operators.ranking import first_per_group, following, has_large_groups, row_numbers
from boxloom.session import cut_lineage

C = F.col


def ranked_tokens(uses: DataFrame, value: list[str], order: list[Column] | None = None, paths: int = 12) -> DataFrame:
    """Tokens per tree ranked by use, with the first ``paths`` places of use in reading order.

    ``uses`` holds tree_id, the value columns, preorder, part and path.
    """
    # read three times
    keyed = cut_lineage(uses.withColumn("_key", F.to_json(F.struct(*value), {"ignoreNullFields": "false"})))
    counts = keyed.groupBy("tree_id", "_key").agg(F.count("*").alias("count"), *[F.first(v).alias(v) for v in value])
    early = first_per_group(keyed, ["tree_id", "_key"], [C("preorder"), C("part"), C("path")], paths, "_n")
    places = early.groupBy("tree_id", "_key").agg(F.array_sort(F.collect_list(F.struct("_n", "path"))).alias("_p"))
    joined = counts.join(places, ["tree_id", "_key"])
    ranked = row_numbers(joined, ["tree_id"], [-C("count"), *(order or [C(v) for v in value])], "rank", has_large_groups(counts, ["tree_id"]))
    return ranked.select("tree_id", "rank", *value, "count", confidence_for_count(C("count")).alias("confidence"), C("_p.path").alias("paths"))


def color_tokens(elements: DataFrame) -> DataFrame:
    def use(column: str, part: int) -> Column:
        return F.struct(normal_hex(C(column)).alias("value"), F.lit(part).alias("part"), F.concat("path", F.lit(f".style.{column}")).alias("path"))

    uses = elements.select("tree_id", "preorder", F.explode(F.array(use("fill", 0), use("color", 1))).alias("u")).select("tree_id", "preorder", "u.*")
    return ranked_tokens(uses.where("value IS NOT NULL"), ["value"])


def radius_tokens(elements: DataFrame) -> DataFrame:
    values = F.filter(F.coalesce(F.when(C("radius").isNotNull(), F.array("radius")), C("corners"), F.array().cast("array<double>")), lambda r: F.rint(r) >= 0)
    uses = elements.select("tree_id", "preorder", F.concat("path", F.lit(".style.radius")).alias("path"), F.posexplode(values).alias("part", "r"))
    return ranked_tokens(uses.select("tree_id", "preorder", "part", "path", F.rint("r").cast("bigint").alias("value")), ["value"])


def text_style_tokens(elements: DataFrame) -> DataFrame:
    key = ["font_family", "font_size", "font_weight", "line_height", "color"]
    uses = elements.where("type = 'text'").select("tree_id", "preorder", F.lit(0).alias("part"), "path", "font_family", "font_size", "font_weight",
                                                  F.lit(None).cast("bigint").alias("line_height"), normal_hex(C("color")).alias("color"))
    return ranked_tokens(uses, key, [C(c) for c in key])


def spacing_tokens(elements: DataFrame) -> DataFrame:
    """Positive gaps between neighbouring siblings along each axis."""
    axes = [("horizontal", "x", "w", "y"), ("vertical", "y", "h", "x")]
    kids = cut_lineage(elements.where("parent_id IS NOT NULL").select("tree_id", "parent_id", "node_id", *"xywh", "preorder", "path"))

    def next_by(p: str, q: str) -> Column:
        return F.lead(p).over(Window.partitionBy("tree_id", "parent_id").orderBy(p, q, "node_id"))

    def gaps(nxt: DataFrame, axis: str, p: str, s: str) -> DataFrame:
        return nxt.select("tree_id", F.lit(axis).alias("axis"), (C("next_" + p) - C(p) - C(s)).alias("value"), "preorder", F.lit(0).alias("part"), "path")

    if has_large_groups(kids, ["tree_id", "parent_id"]):
        sides = [gaps(following(kids, ["tree_id", "parent_id"], C(p), [C(p), C(q), C("node_id")], [p]), axis, p, s) for axis, p, s, q in axes]
        uses = sides[0].unionByName(sides[1])
    else:
        # both neighbours from one exchange
        both = kids.withColumns({"next_" + p: next_by(p, q) for _, p, _, q in axes})
        found = F.array(*[F.struct(F.lit(axis).alias("axis"), (C("next_" + p) - C(p) - C(s)).alias("value")) for axis, p, s, _ in axes])
        uses = both.select("tree_id", F.explode(found).alias("g"), "preorder", F.lit(0).alias("part"), "path").select("tree_id", "g.*", "preorder", "part", "path")
    return ranked_tokens(uses.where("value > 0"), ["axis", "value"])
