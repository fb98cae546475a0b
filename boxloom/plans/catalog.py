"""The relational catalog: projects, pages, slices, sessions and export jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxloom.functions.geometry import half_up
from boxloom.functions.text import slug
from boxloom.operators.ranking import first_per_group, row_numbers, running_sum

C = F.col
PAGE = ["project_id", "page_index"]


def project_cards(projects: DataFrame, pages: DataFrame) -> DataFrame:
    """Every project with its first page, or nulls when it has none."""
    first = pages.groupBy("project_id").agg(
        F.min_by(F.struct("page_index", "page_name"), C("page_index")).alias("first"))
    return projects.join(first, "project_id", "left").select(
        *projects.columns, C("first.page_index").alias("first_page_index"), C("first.page_name").alias("first_page_name"))


def project_detail(projects: DataFrame, pages: DataFrame, slices: DataFrame) -> DataFrame:
    """Project, page and slice on one row; pages without slices and projects without pages stay."""
    return projects.join(pages, "project_id", "left").join(slices, PAGE, "left")


def nested_pages(slices: DataFrame, chunk: int = 500) -> DataFrame:
    """Slice lists per page in documents of at most ``chunk`` slices, numbered so that readers can join them up."""
    placed = slices.withColumn("part", F.floor((C("position") - 1) / chunk))
    return placed.groupBy(*PAGE, "part").agg(
        F.sort_array(F.collect_list(F.struct("position", "slice_id", "name", "cut_mode", "filename", "x", "y", "w", "h"))).alias("slices"))


def active_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Unexpired sessions of active users."""
    return sessions.where(C("expires_at") > now).join(users.where("status = 'active'"), "user_id")


def counts_per_project(projects: DataFrame, pages: DataFrame, slices: DataFrame) -> DataFrame:
    """Page and slice counts, zero where there are none."""
    p = pages.groupBy("project_id").agg(F.count("*").alias("page_count"))
    s = slices.groupBy("project_id").agg(F.count("*").alias("slice_count"))
    joined = projects.select("project_id").join(p, "project_id", "left").join(s, "project_id", "left")
    return joined.fillna(0, ["page_count", "slice_count"])


def slice_positions(slices: DataFrame) -> DataFrame:
    """Slice order inside a page."""
    return row_numbers(slices, PAGE, [C("slice_id"), C("x"), C("y"), C("w"), C("h"), C("name")], "position")


def default_names(slices: DataFrame) -> DataFrame:
    """Names of the form slice_N follow the position; other names stay."""
    number = C("position").cast("string")
    padded = F.concat(F.lit("slice_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))
    return slices.withColumn("name", F.when(F.trim("name").rlike("^slice_[0-9]+$"), padded).otherwise(C("name")))


def reindexed_pages(pages: DataFrame) -> DataFrame:
    """Dense page numbers in the old order."""
    return row_numbers(pages, ["project_id"], [C("page_index")], "new_index")


def next_page_number(pages: DataFrame) -> DataFrame:
    """One above the highest page_N of each project."""
    number = F.regexp_extract("page_name", "^page_([0-9]+)$", 1)
    return pages.groupBy("project_id").agg(
        (F.coalesce(F.max(F.when(number != "", number.cast("bigint"))), F.lit(0)) + 1).alias("next_number"))


def frame_positions(pages: DataFrame, gap: int = 160) -> DataFrame:
    """Left edge of each page laid out in one row."""
    step = half_up(C("width")) + gap
    return running_sum(pages, ["project_id"], F.floor(C("page_index") / 64), [C("page_index")], step, "frame_x")


def grid_positions(pages: DataFrame, gap: int = 200) -> DataFrame:
    """Grid placement: 2 columns when the first page is landscape-like, else 5."""
    ranked = reindexed_pages(pages).withColumn("_i", C("new_index") - 1)
    first = ranked.where("_i = 0").select("project_id", F.when(
        (C("width") >= C("height")) | (C("width") / F.greatest(F.lit(1), C("height")) >= 0.85), 2).otherwise(5).alias("columns"))
    cells = ranked.join(first, "project_id").withColumn("_col", C("_i") % C("columns")).withColumn("_row", F.floor(C("_i") / C("columns")))
    cols = cells.groupBy("project_id", "_col").agg(F.max("width").alias("_size"))
    rows = cells.groupBy("project_id", "_row").agg(F.max("height").alias("_size"))
    # at most 12 columns; rows are summed in slots like any other running sum
    x = running_sum(cols, ["project_id"], F.lit(0), [C("_col")], C("_size") + gap, "grid_x").drop("_size")
    y = running_sum(rows, ["project_id"], F.floor(C("_row") / 64), [C("_row")], C("_size") + gap, "grid_y").drop("_size")
    return cells.join(x, ["project_id", "_col"]).join(y, ["project_id", "_row"]).drop("_i", "_col", "_row", "new_index")


def page_directory(index: Column, name: Column) -> Column:
    part = slug(name)
    return F.concat(F.lit("P"), index.cast("string"), F.when(part != "", F.concat(F.lit("-"), part)).otherwise(""))


def manifest(pages: DataFrame, slices: DataFrame, root: str = "slices") -> DataFrame:
    """Flat export manifest: one row per slice with its page directory and file name."""
    named = default_names(slice_positions(slices))
    folder = page_directory(C("page_index"), C("page_name"))
    number = C("position").cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return pages.join(named, PAGE, "left").select(
        *PAGE, folder.alias("page_directory"), "position", "slice_id", "name", "cut_mode",
        F.when(C("slice_id").isNotNull(), F.concat(F.lit(root + "/"), folder, F.lit("/slice_"), padded, F.lit(".png"))).alias("filename"),
        "x", "y", "w", "h")


def extended_manifest(flat: DataFrame, page_text: DataFrame, placements: DataFrame) -> DataFrame:
    """The manifest with page text and trimmed placements, or the default block where they are absent."""
    joined = flat.join(page_text, PAGE, "left").join(placements, [*PAGE, "slice_id", "position"], "left")
    status = F.coalesce("text_status", F.lit("skipped"))
    return joined.select(
        *flat.columns, status.alias("text_status"), F.when(C("text_status").isNull(), "not_run").alias("text_reason"),
        F.coalesce("text_layers", F.lit(0)).alias("text_layers"),
        *[F.coalesce(C("placed_" + c), C(c)).alias("placed_" + c) for c in "xywh"])


def slice_violations(slices: DataFrame, pages: DataFrame) -> DataFrame:
    """Rejected slices: repeated ids within a project, pages that do not exist, unknown kinds."""
    repeated = slices.groupBy("project_id", "slice_id").agg(F.count("*").alias("n")).where("n > 1").select(
        "project_id", F.lit(None).cast("bigint").alias("page_index"), "slice_id", F.lit("duplicate_slice_id").alias("rule"))
    orphan = slices.join(pages.select(*PAGE), PAGE, "left_anti").select(*PAGE, "slice_id", F.lit("unknown_page").alias("rule"))
    kinds = slices.where(~C("cut_mode").isin("rect", "subject", "card")).select(*PAGE, "slice_id", F.lit("bad_kind").alias("rule"))
    return repeated.unionByName(orphan).unionByName(kinds)


def job_request_errors(requests: DataFrame) -> DataFrame:
    """Page exports need a page; other kinds must not name one."""
    blank = F.coalesce(F.trim("page_id"), F.lit("")) == ""
    return requests.withColumn("error", F.when((C("kind") == "page_project") & blank, "pageId is required for page_project export jobs")
                               .when((C("kind") != "page_project") & ~blank, "pageId is only valid for page_project export jobs"))


def order_mismatches(existing: DataFrame, requested: DataFrame) -> DataFrame:
    """Groups whose requested ids are not exactly the existing ones, with both counts."""
    keys = ["project_id", "page_index"]
    both = existing.groupBy(*keys).agg(F.count("*").alias("have")).join(
        requested.groupBy(*keys).agg(F.count("*").alias("want")), keys, "full").fillna(0, ["have", "want"])
    return both.where("have <> want").groupBy("project_id").agg(
        F.sum(F.greatest(C("have") - C("want"), F.lit(0))).alias("missing"),
        F.sum(F.greatest(C("want") - C("have"), F.lit(0))).alias("unexpected"))


def paint_order(page_w: int, page_h: int, texts: DataFrame, slices: DataFrame) -> DataFrame:
    """Paint list of a page: what is left of the image first, then text, then slices."""
    cols = ["page_id", "kind_rank", "kind", "ref_id", "x", "y", "w", "h"]
    pages = texts.select("page_id").unionByName(slices.select("page_id")).distinct()
    rest = pages.select("page_id", F.lit(0).alias("kind_rank"), F.lit("remainder").alias("kind"), F.lit(0).cast("bigint").alias("ref_id"),
                        *[F.lit(v).cast("bigint").alias(c) for c, v in zip("xywh", (0, 0, page_w, page_h))])
    text = texts.select("page_id", F.lit(1).alias("kind_rank"), F.lit("text").alias("kind"), C("line_id").alias("ref_id"), *"xywh")
    cut = slices.select("page_id", F.lit(2).alias("kind_rank"), F.lit("slice").alias("kind"), C("region_id").alias("ref_id"), *"xywh")
    both = rest.unionByName(text).unionByName(cut).select(*cols)
    return row_numbers(both, ["page_id"], [C("kind_rank"), C("ref_id")], "paint_order")


def latest(df: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """Newest row per key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v")).select(*keys, "v.*")


def expired_jobs(jobs: DataFrame, keep: int) -> DataFrame:
    """Oldest finished jobs to remove so that ``keep`` remain; unfinished ones are never removed.

    Only the excess is ranked: a top-k by update time over one row per job.
    """
    excess = jobs.agg(F.greatest(F.lit(0), F.count("*") - keep).alias("excess"))
    finished = jobs.where(C("status").isin("succeeded", "failed", "canceled"))
    ranked = row_numbers(finished.withColumn("_all", F.lit(1)), ["_all"], [C("updated_at"), C("job_id")], "age_rank")
    # a one-row aggregate: its size is fixed
    return ranked.join(F.broadcast(excess.withColumn("_all", F.lit(1))), "_all").where(C("age_rank") <= C("excess")).drop("_all", "excess")


def review_pages(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Review lists for every candidate page: unknown ids dropped, repeats removed, missing pages added empty."""
    known = state.join(candidates.select("page_id", "region_id"), ["page_id", "region_id"], "left_semi").distinct()
    lists = known.groupBy("page_id").agg(F.count(F.when(C("mark") == "rejected", 1)).alias("rejected"),
                                         F.count(F.when(C("mark") == "hidden", 1)).alias("hidden"))
    pages = candidates.groupBy("page_id").agg(F.count("*").alias("candidates"))
    return pages.join(lists, "page_id", "left").fillna(0, ["rejected", "hidden"])


def review_totals(pages: DataFrame, review: DataFrame, selected: DataFrame) -> DataFrame:
    """Candidates, selected, rejected and completed pages per project."""
    picked = selected.groupBy("page_id").agg(F.count("*").alias("selected"))
    joined = pages.join(review, "page_id").join(picked, "page_id", "left").fillna(0, ["selected"])
    return joined.groupBy("project_id").agg(
        F.count("*").alias("pages"), F.sum("candidates").alias("candidates"), F.sum("selected").alias("selected"),
        F.sum("rejected").alias("rejected"), F.count(F.when(C("selected") > 0, 1)).alias("completed"))


def fingerprints(pages: DataFrame, slices: DataFrame) -> DataFrame:
    """Content fingerprint of a project: hash per slice, then per page, then over the project.

    Each level hashes an order-free digest of the level below (counts and sums of 64-bit hashes), so no list of a whole
    project is ever gathered.
    """
    def digest(h: Column) -> list[Column]:
        return [F.count("*").alias("n"), F.sum(F.shiftrightunsigned(h, 32)).alias("hi"),
                F.sum(F.pmod(h, F.lit(2**32))).alias("lo"), F.bit_xor(h).alias("mix")]

    own = slices.select(*PAGE, F.xxhash64("slice_id", "name", "cut_mode", "x", "y", "w", "h").alias("h"))
    by_page = own.groupBy(*PAGE).agg(*digest(C("h")))
    page_hash = pages.join(by_page, PAGE, "left").select(
        "project_id", F.xxhash64("page_index", "page_name", "width", "height", "n", "hi", "lo", "mix").alias("h"))
    by_project = page_hash.groupBy("project_id").agg(*digest(C("h")))
    return by_project.select("project_id", F.sha2(F.to_json(F.struct("project_id", "n", "hi", "lo", "mix")), 256).alias("fingerprint"))


def cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """A request hits when all fields of the cached record for its key agree."""
    fields = ("kind", "version", "fingerprint", "asset_count", "page_count")
    joined = requests.join(cache.select("zip_key", *[C(f).alias("c_" + f) for f in fields]), "zip_key", "left")
    same = C("c_kind").isNotNull()
    for f in fields:
        same = same & C(f).eqNullSafe(C("c_" + f))
    return joined.select("zip_key", same.alias("hit"))
