"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewise.llm.work import written


def _toward_least(links: DataFrame, both_sides: bool) -> DataFrame:
    """Link every neighbour of a node to the least of node and neighbours.

    ``both_sides``: neighbours are those on either side and only greater ones are linked (large star); otherwise only
    smaller neighbours count, and the node itself is linked too (small star).
    """
    if both_sides:
        around = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        linked = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        linked = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return linked.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v): each linked node that is not the least of its component, with that least node.

    ``links`` has columns u, v of one orderable type. Rounds grow with the logarithm of the longest chain; each ends
    in a written table. Nothing but two numbers a round reaches the driver.
    """
    links = links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen = None
    while True:
        links = written(_toward_least(_toward_least(links, True), False))
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return links
        seen = state
