"""Statistics over pixel samples (page_id, x, y, r, g, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxloom.functions.geometry import half_up

C = F.col
RGB = ("r", "g", "b")


def order_statistic(df: DataFrame, keys: list[str], value: Column, index: Column, name: str) -> DataFrame:
    """The value at a 0-based position of each sorted group, from value counts (at most 256 per channel)."""
    counts = df.groupBy(*keys, value.alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("_n", F.sum("_c").over(w)).withColumn("_to", F.sum("_c").over(w.orderBy("_v")))
    return run.where(C("_to") > index).groupBy(*keys).agg(F.min("_v").alias(name))


def channel_medians(df: DataFrame, keys: list[str]) -> DataFrame:
    """Upper-middle element of each channel."""
    out = None
    for c in RGB:
        part = order_statistic(df, keys, C(c), F.floor(C("_n") / 2), c)
        out = part if out is None else out.join(part, keys)
    return out


def background(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Median colour of the page edge and the distance threshold that separates foreground.

    Each side is sampled once, so corners count twice.
    """
    sides = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate((C("y") == 0, C("y") == height - 1, C("x") == 0, C("x") == width - 1))]))
    edge = pixels.where((C("x") == 0) | (C("y") == 0) | (C("x") == width - 1) | (C("y") == height - 1)).withColumn("_side", F.explode(sides))
    color = channel_medians(edge, ["page_id"])
    named = color.select("page_id", *[C(c).alias("m" + c) for c in RGB])
    square = sum(((C(c) - C("m" + c)) * (C(c) - C("m" + c)) for c in RGB[1:]), (C("r") - C("mr")) * (C("r") - C("mr")))
    # ranked by the integer square, which orders like the distance
    far = order_statistic(edge.join(named, "page_id"), ["page_id"], square, half_up((C("_n") - 1) * 0.95), "_d2")
    threshold = F.greatest(F.lit(18.0), F.least(F.lit(52.0), F.greatest(F.lit(18.0), F.sqrt(C("_d2").cast("double")) * 2.2)))
    return color.join(far, "page_id").select("page_id", *RGB, threshold.alias("threshold"))


def dominant_color(pixels: DataFrame) -> DataFrame:
    """Median colour of the fullest colour bucket; the bucket seen first wins ties."""
    bucketed = pixels.withColumns({"k" + c: half_up(C(c) / 20) for c in RGB})
    keys = ["page_id", "kr", "kg", "kb"]
    sizes = bucketed.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("seen"))
    best = sizes.groupBy("page_id").agg(F.min_by(F.struct("kr", "kg", "kb", "n"), F.struct(-C("n"), C("seen"))).alias("b")).select("page_id", "b.*")
    members = bucketed.join(best, keys)
    return channel_medians(members.drop("n"), ["page_id"]).join(best.select("page_id", C("n").alias("pixels")), "page_id")


def tile_maps(pixels: DataFrame, tile: int) -> DataFrame:
    """Texture, edge, entropy, colour variety and dominant share of each tile."""
    keys = ["page_id", "tr", "tc"]
    # thousandths of a grey level, so that sums do not depend on their order
    gray = C("r") * 299 + C("g") * 587 + C("b") * 114
    p = pixels.withColumns({"tr": F.floor(C("y") / tile), "tc": F.floor(C("x") / tile), "gray": gray})
    # neighbours inside a tile row or column: windows no longer than the tile side
    right = F.lead("gray").over(Window.partitionBy(*keys, "y").orderBy("x"))
    below = F.lead("gray").over(Window.partitionBy(*keys, "x").orderBy("y"))
    p = p.withColumn("_dx", F.abs(right - C("gray"))).withColumn("_dy", F.abs(below - C("gray")))
    base = p.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_dx").alias("_gx"), F.avg("_dy").alias("_gy"),
                                *[F.sum(C(c)).alias(c + "1") for c in RGB], *[F.sum(C(c) * C(c)).alias(c + "2") for c in RGB])
    bins = p.groupBy(*keys, F.floor(C("gray") / 16000).alias("bin")).agg(F.count("*").alias("k")).join(base.select(*keys, "n"), keys)
    entropy = bins.groupBy(*keys).agg((-F.sum(C("k") / C("n") * F.log2(C("k") / C("n")))).alias("_ent"))
    codes = p.groupBy(*keys, (F.floor(C("r") / 32) * 64 + F.floor(C("g") / 32) * 8 + F.floor(C("b") / 32)).alias("code")).agg(F.count("*").alias("k"))
    variety = codes.groupBy(*keys).agg(F.count("*").alias("_u"), F.max("k").alias("_top"))
    s = base.join(entropy, keys).join(variety, keys)

    def unit(v: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    spread = sum(((C("n") * C(c + "2") - C(c + "1") * C(c + "1")) for c in RGB[1:]), C("n") * C("r2") - C("r1") * C("r1")) / (C("n") * C("n")) / 3
    s = s.withColumns({
        "texture": unit((F.sqrt(spread) - 6.0) / 44.0), "edge": unit((F.coalesce("_gx", F.lit(0.0)) + F.coalesce("_gy", F.lit(0.0))) / 48000.0),
        "entropy": unit(C("_ent") / 4.0), "variety": unit((C("_u") - 1) / 24.0), "dominant": C("_top") / C("n")})
    return s.withColumn("raster", C("texture") * 0.32 + C("edge") * 0.28 + C("entropy") * 0.25 + C("variety") * 0.15).select(
        *keys, "texture", "edge", "entropy", "variety", "dominant", "raster")


def region_scores(boxes: DataFrame, tiles: DataFrame, tile: int, rows: int, cols: int) -> DataFrame:
    """Mean tile scores under each box (page_id, region_id, x, y, w, h)."""
    def span(low: Column, high: Column, n: int) -> Column:
        first = F.greatest(F.lit(0), F.least(F.lit(n), F.floor(low / tile)))
        return F.sequence(first, F.greatest(first + 1, F.least(F.lit(n), F.ceil(high / tile))) - 1)

    covered = boxes.withColumn("tr", F.explode(span(C("y"), C("y") + C("h"), rows))).withColumn("tc", F.explode(span(C("x"), C("x") + C("w"), cols)))
    return covered.join(tiles, ["page_id", "tr", "tc"]).groupBy("page_id", "region_id").agg(
        *[F.avg(c).alias(c) for c in ("texture", "edge", "entropy", "variety", "dominant", "raster")])


def pixel_difference(source: DataFrame, rendered: DataFrame, masked: Column) -> DataFrame:
    """Mean absolute channel error and share of changed pixels per page, over all pixels and outside the mask."""
    other = rendered.select("page_id", "x", "y", *[C(c).alias("_" + c) for c in RGB])
    d = source.join(other, ["page_id", "x", "y"]).withColumn("_out", ~masked)
    err = [F.abs(C(c) - C("_" + c)) for c in RGB]
    d = d.withColumn("_sum", err[0] + err[1] + err[2]).withColumn("_max", F.greatest(*err))
    out = C("_out")
    s = d.groupBy("page_id").agg(
        F.count("*").alias("pixels"), F.sum("_sum").alias("_all"), F.count(F.when(C("_max") > 10, 1)).alias("_ch"), F.max("_max").alias("max_error"),
        F.count(F.when(out, 1)).alias("free_pixels"), F.coalesce(F.sum(F.when(out, C("_sum"))), F.lit(0)).alias("_free"),
        F.count(F.when(out & (C("_max") > 10), 1)).alias("_fch"))

    def ratio(a: Column, b: Column, digits: int) -> Column:
        scale = 10.0**digits
        return F.rint(a / F.greatest(F.lit(1), b) * scale) / scale

    return s.select("page_id", "pixels", ratio(C("_all"), C("pixels") * 3, 4).alias("mean_error"), ratio(C("_ch"), C("pixels"), 6).alias("changed"),
                    "free_pixels", ratio(C("_free"), C("free_pixels") * 3, 4).alias("free_mean_error"), ratio(C("_fch"), C("free_pixels"), 6).alias("free_changed"), "max_error")
