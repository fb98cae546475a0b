"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import stored


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node on its smallest neighbour.

    The large star moves the larger neighbours of a node, the small star the node and its smaller ones.  Both use
    ``hi > lo`` links; a hub's neighbours are joined to one row with its minimum, which adaptive execution can split.
    """
    if small:
        least = links.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = links.join(least.withColumnRenamed("hi", "node"), F.col("hi") == F.col("node")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).where(F.col("hi") > F.col("lo")).distinct()
    below = links.select(F.col("hi").alias("node"), F.col("lo").alias("other")).groupBy("node").agg(F.min("other").alias("m"))
    moved = links.join(below, F.col("lo") == F.col("node"), "left").select("hi", F.coalesce("m", "lo").alias("lo"))
    own = below.select(F.col("node").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(own)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) of each node of ``links`` (columns ``a``, ``b``), smallest nodes left out.

    The stars preserve components and end when no link changes; the number of rounds follows the logarithm of the
    longest chain.  Each round is written to the shared folder.
    """
    now = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    state = None
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")), F.lit(0))).first()
        if mark == state:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        state = mark
        now = stored(_star(_star(now, False), True), "links")
