"""Connected components of a link table by alternating stars, with skew-safe joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import scratch, written


def components(links: DataFrame) -> DataFrame:
    """links: u, v (any order, repeats and loops allowed). Returns node, component (its smallest node).

    Large-star and small-star steps rewire links towards the smallest neighbour until every component is a
    star around its smallest node. Each step is a minimum per node (partial aggregate) joined back; steps are
    written to the shared folder; the result is a written table. Nulls and loops are dropped; no links give no rows.
    """
    with scratch(links.sparkSession):
        edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                        "links")
        state = _state(edges)
        while True:
            both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            down = written(down, "large-star")
            low = down.groupBy("u").agg(F.min("v").alias("m"))
            small = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
            edges = written(small, "small-star")
            now = _state(edges)
            if now == state:
                break
            state = now
        stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return written(stars.unionByName(roots), "components", keep=True)


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
