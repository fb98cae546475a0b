"""Row numbers, running sums and neighbours inside groups, without sending a whole group to one task.

Ranks come from range partitions with sampled bounds.  For running sums and neighbours the order is cut into slots: the
leading order value, coarsened by the caller.  Rows are counted per ``(group, slot)`` first (partial aggregation), slot offsets
are running sums over those small counts, and only the rows of one slot are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxloom.session import cut_lineage


# rows of a group that a task sorts
GROUP = 100_000


def has_large_groups(df: DataFrame, keys: list[str]) -> bool:
    """Some group has more rows than a task should sort; one job that counts."""
    return not df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP).isEmpty()


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str, large: bool = True) -> DataFrame:
    """1-based rank of each row in its group, by ``order`` (whose ties are broken anyhow).

    Where no group is ``large`` a window ranks them.  Else rows are dealt to range partitions of (keys, order), whose bounds Spark samples, so a group of any size is cut into pieces
    that fit a task; the pieces are counted and a running sum over the counts shifts the ranks inside each piece.
    """
    if not large:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    names = [f"_o{i}" for i in range(len(order))]
    shown = df.select("*", *[o.alias(n) for o, n in zip(order, names)])
    # the piece of a row must not change when a task runs again
    dealt = cut_lineage(shown.repartitionByRange(*keys, *names).withColumn("_piece", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_piece").orderBy(*names)
    joined = dealt.join(offsets, [*keys, "_piece"])
    return joined.withColumn(name, F.row_number().over(inside) + F.col("_before")).drop("_piece", "_before", *names)


def running_sum(df: DataFrame, keys: list[str], slot: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows strictly before, in (slot, order)."""
    slotted = df.withColumn("_slot", slot).withColumn("_value", value)
    sums = slotted.groupBy(*keys, "_slot").agg(F.sum("_value").alias("_s"))
    earlier = Window.unboundedPreceding, -1
    offsets = sums.select(
        *keys, "_slot",
        F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(*earlier)), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(*earlier)
    joined = slotted.join(offsets, [*keys, "_slot"])
    return joined.withColumn(name, F.coalesce(F.sum("_value").over(inside), F.lit(0)) + F.col("_before")).drop(
        "_slot", "_before", "_value")


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str) -> DataFrame:
    """The first ``n`` rows of each group with their rank.

    A rank filter becomes a group limit that runs before the shuffle, so a task receives at most n rows per
    group and map partition.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= n)


def following(df: DataFrame, keys: list[str], slot: Column, order: list[Column], values: list[str], prefix: str = "next_") -> DataFrame:
    """The given columns of the next row in (slot, order), null on the last row of a group."""
    slotted = df.withColumn("_slot", slot).withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    payload = F.struct(*values)
    firsts = slotted.groupBy(*keys, "_slot").agg(F.min_by(payload, F.col("_order")).alias("_first"))
    nexts = firsts.select(*keys, "_slot", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_slot")).alias("_beyond"))
    inside = F.lead(payload).over(Window.partitionBy(*keys, "_slot").orderBy("_order"))
    joined = slotted.join(nexts, [*keys, "_slot"]).withColumn("_next", F.coalesce(inside, F.col("_beyond")))
    return joined.select(*df.columns, *[F.col("_next")[v].alias(prefix + v) for v in values])
