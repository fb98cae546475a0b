"""Ordered claims: owners take what earlier owners left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxloom.functions.geometry import box, contains, iou, overlap, share_of
from boxloom.functions.ladders import ladder
from boxloom.operators.greedy import keep_greedily, suppressed
from boxloom.operators.matching import attach, not_overlapping
from boxloom.operators.ranking import first_per_group
from boxloom.operators.spatial import near_pairs
from boxloom.operators.tree import walk
from boxloom.plans.clusters import member_overlaps
from boxloom.session import cut_lineage

C = F.col
KEY = ["page_id", "region_id"]


def merge_new_slices(boxes: DataFrame, slices: DataFrame, order: list[Column], limit: float = 0.6) -> DataFrame:
    """Boxes to add as slices: none that repeats a slice or a box added before it."""
    return keep_greedily(not_overlapping(boxes, slices, limit), order, lambda k, c: iou(k, c) >= limit)


def controlled_groups(groups: DataFrame, members: DataFrame, order: list[Column], most: int = 24) -> DataFrame:
    """Groups accepted in order while their members are still free, at most ``most`` per page."""
    info = groups.select("page_id", "group_id", F.struct(*order, C("group_id").alias("_id")).alias("rank"))
    # one common member is enough
    shared = member_overlaps(members, 0.0)
    one, two = [info.select("page_id", C("group_id").alias(n), C("rank").alias("r_" + n)) for n in ("one", "two")]
    edges = shared.join(one, ["page_id", "one"]).join(two, ["page_id", "two"]).where(C("r_one") < C("r_two"))
    lost = suppressed(edges.select("page_id", C("r_one").alias("rank"), C("one").alias("first"), C("two").alias("second")))
    kept = groups.join(lost.withColumnRenamed("id", "group_id"), ["page_id", "group_id"], "left_anti")
    # stopping at the limit equals taking the first accepted ones
    return first_per_group(kept, ["page_id"], [*order, C("group_id")], most, "position")


def major_groups(layers: DataFrame, min_area: int) -> DataFrame:
    """Owners (smallest first) with the layers they hold, each layer in one group.

    An owner needs two held layers still free, one of them text or raster.  In every round an owner decides once no
    undecided smaller owner wants any of its layers; accepted owners take their layers, and a taken owner drops out.
    """
    a, b = box("a_"), box("b_")
    shown = layers.where("visible").select(*KEY, "kind", "x", "y", "w", "h")
    owners = shown.where(C("kind").isin("shape", "raster") & (C("w") * C("h") >= min_area))
    held = near_pairs(owners, shown, (C("a_region_id") != C("b_region_id")) & (b.area * 100 < a.area * 94) & (share_of(b, a) >= 0.92))
    rank = F.struct((C("w") * C("h")).alias("area"), C("region_id").alias("id"))
    own = owners.select("page_id", C("region_id").alias("owner_id"), C("region_id").alias("item_id"), C("kind"), rank.alias("rank"))
    inner = held.select("page_id", C("a_region_id").alias("owner_id"), C("b_region_id").alias("item_id"), C("b_kind").alias("kind"),
                        F.struct(a.area.alias("area"), C("a_region_id").alias("id")).alias("rank"))
    open_rows, out = cut_lineage(own.unionByName(inner)), None
    while not open_rows.isEmpty():
        wanted = open_rows.groupBy("page_id", "item_id").agg(F.min("rank").alias("first"))
        state = open_rows.join(wanted, ["page_id", "item_id"])
        mine = state.groupBy("page_id", "owner_id").agg(
            F.min((C("rank") == C("first")).cast("int")).alias("ready"), F.count(F.when(C("item_id") != C("owner_id"), 1)).alias("n"),
            F.count(F.when((C("item_id") != C("owner_id")) & C("kind").isin("text", "raster"), 1)).alias("rich"))
        decided = cut_lineage(mine.where("ready = 1").withColumn("accepted", (C("n") >= 2) & (C("rich") > 0)))
        won = cut_lineage(open_rows.join(decided.where("accepted").select("page_id", "owner_id"), ["page_id", "owner_id"], "left_semi"))
        taken = won.select("page_id", "item_id").distinct()
        rest = open_rows.join(decided.select("page_id", "owner_id"), ["page_id", "owner_id"], "left_anti")
        rest = rest.join(taken, ["page_id", "item_id"], "left_anti").join(taken.withColumnRenamed("item_id", "owner_id"), ["page_id", "owner_id"], "left_anti")
        open_rows = cut_lineage(rest)
        out = won if out is None else out.unionByName(won)
    return out.select("page_id", "owner_id", C("item_id").alias("region_id"), "kind")


# fixed values: priority of a crop by role, and the largest part of the page a parent of that role may take
CROP_PRIORITY = {"image_region": 60, "surface_region": 50, "unknown_region": 45, "art_text_region": 40, "symbol_region": 30, "rect": 10}
PARENT_SHARE = {"image_region": 0.55, "surface_region": 0.32, "unknown_region": 0.32, "art_text_region": 0.24, "symbol_region": 0.18}


def crop_owners(layers: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Crops given up for another: the better one of nearly the same region, or the smallest enclosing component.

    ``layers`` carry role and z.  ``root_id`` follows the owners to the one that stays.
    """
    page = page_w * page_h
    p, c = box("b_"), box("a_")

    def priority(role: Column) -> Column:
        return ladder([(role == k, v) for k, v in CROP_PRIORITY.items()], 20)

    slim = layers.select(*KEY, "role", "z", "x", "y", "w", "h", priority(C("role")).alias("prio"))

    def score(s: str) -> Column:
        return F.struct(C(s + "prio").alias("p"), (C(s + "w") * C(s + "h")).alias("a"), C(s + "z").alias("z"), C(s + "region_id").alias("i"))

    same = (iou(p, c) >= 0.92) & (score("b_") > score("a_"))
    image = C("b_role") == "image_region"
    canvas = (p.w >= page_w * 0.96) & (p.h >= page_h * 0.82)
    share = ladder([(C("b_role") == k, v) for k, v in PARENT_SHARE.items()], 0.12)
    margins = sum(((m >= 3).cast("int") for m in (c.y - p.y, p.x2 - c.x2, p.y2 - c.y2)), (c.x - p.x >= 3).cast("int"))
    parent = (p.area > c.area) & (C("b_role") != "rect") & ~canvas & (p.area >= c.area * F.when(image, 1.03).otherwise(1.12)) & (
        p.area <= share * page) & (share_of(c, p) >= 0.9) & (image | (margins >= 2))
    pairs = near_pairs(slim, slim, overlap(p, c) > 0, spread=True, first=C("a_region_id") != C("b_region_id")).where(same | parent)
    best = pairs.groupBy("page_id", C("a_region_id").alias("region_id")).agg(
        F.max(F.when(same, F.struct(score("b_").alias("s"), C("b_region_id").alias("id")))).alias("twin"),
        F.min(F.when(~same, F.struct(p.area.alias("a"), (-C("b_prio")).alias("p"), C("b_region_id").alias("id")))).alias("around"))
    owner = cut_lineage(best.select(*KEY, F.coalesce("twin.id", "around.id").alias("owner_id"),
                                    F.when(C("twin").isNotNull(), "same_region_duplicate").otherwise("internal_fragment_covered_by_component_crop").alias("reason")))
    # only crops on a link are walked; those that stay are the roots
    kept = owner.select("page_id", C("owner_id").alias("region_id")).distinct().join(owner.select(*KEY), KEY, "left_anti")
    rows = owner.unionByName(kept, allowMissingColumns=True)
    linked = rows.select(C("page_id").alias("tree_id"), C("region_id").alias("node_id"), C("owner_id").alias("parent_id"), "reason", F.lit(0).alias("ord"),
                         *[F.lit(0).cast("bigint").alias(n) for n in "xy"])
    found = walk(linked, lists=False).where("parent_id IS NOT NULL")
    return found.select(C("tree_id").alias("page_id"), C("node_id").alias("region_id"), C("parent_id").alias("owner_id"), "reason", "root_id")


def replaced_parents(parents: DataFrame, crops: DataFrame, tolerance: int = 3) -> DataFrame:
    """Raster parents replaced by their internal crops: four or more, in three rows, three of them repeated slots.

    ``crops`` carry repeated.  Rows are counted over the distinct (y, height) pairs of a parent's crops.
    """
    a, b = box("a_"), box("b_")
    pairs = near_pairs(parents.select(*KEY, "x", "y", "w", "h"), crops.select(*KEY, "repeated", "x", "y", "w", "h"),
                       (C("a_region_id") != C("b_region_id")) & contains(a, b, tolerance) & (b.area * 100 < a.area * 80), margin=tolerance)
    spots = pairs.groupBy("page_id", C("a_region_id").alias("region_id"), b.y.alias("y"), b.h.alias("h")).agg(
        F.min("b_region_id").alias("id"), F.count("*").alias("n"), F.count(F.when(C("b_repeated"), 1)).alias("rep"))
    lists = spots.groupBy(*KEY).agg(F.sum("n").alias("crops"), F.sum("rep").alias("repeated"), F.array_sort(F.collect_list(F.struct("y", "id", "h"))).alias("s"))
    zero = F.struct(F.lit(0).alias("rows"), F.lit(0).cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("h"))

    def step(acc: Column, s: Column) -> Column:
        new = (acc["rows"] == 0) | (F.abs(s["y"] - acc["y"]) >= F.floor(F.least(s["h"], F.greatest(F.lit(1).cast("bigint"), acc["h"])) / 2))
        return F.struct((acc["rows"] + new.cast("int")).alias("rows"), F.when(new, s["y"]).otherwise(acc["y"]).alias("y"), F.when(new, s["h"]).otherwise(acc["h"]).alias("h"))

    counted = lists.withColumn("rows", F.aggregate("s", zero, step)["rows"])
    return counted.select(*KEY, "crops", "rows", "repeated", ((C("crops") >= 4) & (C("rows") >= 3) & (C("repeated") >= 3)).alias("replaced"))


def promoted_duplicates(items: DataFrame, order: list[Column]) -> DataFrame:
    """Promoted objects dropped for a better one of the same place, with the kept one they overlap most."""
    def clash(k, c) -> Column:
        shift = F.greatest(F.abs(k.cx - c.cx) / F.greatest(F.lit(1), F.least(k.w, c.w)), F.abs(k.cy - c.cy) / F.greatest(F.lit(1), F.least(k.h, c.h)))
        drift = F.greatest(F.abs(k.w - c.w) / F.greatest(k.w, c.w), F.abs(k.h - c.h) / F.greatest(k.h, c.h))
        ka, ca = share_of(k, c), share_of(c, k)
        return (overlap(k, c) > 0) & ((iou(k, c) >= 0.72) | (F.greatest(ka, ca) >= 0.82) | ((shift <= 0.25) & (drift <= 0.25) & (F.least(ka, ca) >= 0.50)))

    kept = keep_greedily(items, order, clash)
    gone = items.join(kept.select(*KEY), KEY, "left_anti")
    slim = [*KEY, "role", "x", "y", "w", "h"]
    ranked = [df.select(*slim, F.struct(*order, C("region_id").alias("_id")).alias("rank")) for df in (kept, gone)]
    a, b = box("a_"), box("b_")
    pairs = near_pairs(ranked[0], ranked[1], (C("a_rank") < C("b_rank")) & clash(a, b))
    most = F.greatest(iou(a, b), share_of(a, b), share_of(b, a))
    best = pairs.groupBy("page_id", C("b_region_id").alias("region_id")).agg(
        F.min_by(F.struct(C("a_region_id").alias("owner_id"), (C("a_role") == C("b_role")).alias("same")), F.struct(-most, C("a_rank"))).alias("o"))
    return best.select(*KEY, "o.owner_id", F.when(C("o.same"), "duplicate").otherwise("role_conflict").alias("reason"))


def token_passes(primitives: DataFrame, image_area: int) -> DataFrame:
    """Token of each primitive by the passes that need no clustering, in pass order; single symbols stay symbols."""
    a, b = box("a_"), box("b_")
    slim = primitives.select(*KEY, "primitive_type", "x", "y", "w", "h")
    rasters = slim.where((C("primitive_type") == "image_region") & (C("w") * C("h") >= max(1, image_area // 2000)))
    surfaces = slim.where("primitive_type = 'surface_region'")

    def inside(parents: DataFrame, name: str) -> DataFrame:
        hit = near_pairs(slim, parents, (C("a_region_id") != C("b_region_id")) & contains(b, a, 3), margin=3)
        # the largest parent, as parents are tried from large to small
        return hit.groupBy("page_id", C("a_region_id").alias("region_id")).agg(F.min_by("b_region_id", F.struct(-b.area, C("b_region_id"))).alias(name))

    j = slim.join(inside(rasters, "raster_id"), KEY, "left").join(inside(surfaces, "surface_id"), KEY, "left")
    kind = C("primitive_type")
    parent = (kind == "image_region") & (C("w") * C("h") >= max(1, image_area // 2000))
    fragment = C("surface_id").isNull() & C("raster_id").isNotNull() & ~kind.isin("symbol_region", "rect", "line")
    token = ladder([
        (kind == "text_region", "text_token/main"), (kind == "surface_region", "surface_region_token/main"), (parent, "raster_region_token/main"),
        (fragment, "texture_fragment_token/suppressed"), (kind == "rect", "layer_background_token/main"), (kind == "line", "line_token/main"),
        (kind == "image_region", "raster_region_token/main"), (kind == "symbol_region", "symbol_cluster_token/main"),
    ], "unknown_token/review")
    parts = F.split(token, "/")
    return j.select(*KEY, parts[0].alias("token"), parts[1].alias("disposition"), F.when(parts[0] == "texture_fragment_token", C("raster_id")).alias("raster_id"))
