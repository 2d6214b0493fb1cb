"""Connected components of an undirected link table by alternating large-star and small-star steps.

Every step is a pair of group-bys on node keys with map-side minimum; no links, labels or components reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillrank.llm.common import merged, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step on links (a > b): every node's chosen neighbours are linked to its least neighbour (or itself)."""
    if large:
        around = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("m")
    )
    joined = around.join(merged(least), around.a == least.node)
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns a, b); component is the least node reachable.

    Self-links and repeated links are allowed; an empty table gives an empty result.
    """
    state = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links"
    )
    before = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        state = written(_star(_star(state, large=True), large=False), "links")
    own = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own)
