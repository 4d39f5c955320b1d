"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import release, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b); the component is its smallest id.

    Each round joins every vertex's larger (then smaller) neighbours to its least
    neighbour; rounds grow with the logarithm of the edges. Only counts reach the
    driver. A star's centre is aggregated with map-side minima, so hubs stay cheap."""
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), few_files="narrow")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(links)
    while before[0]:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        passed, links = links, stored(small.where("u <> v").distinct(), few_files="narrow")
        release(passed)
        after = state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
