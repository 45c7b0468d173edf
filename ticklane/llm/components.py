"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node reachable.

    Each step links neighbours to the smallest neighbour, so stars and chains shrink fast.
    A step is two joins on a node with map-side combined minima; a hot node is only a
    join key. Steps are stored, so a lost executor repeats little.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "links")
    if links.isEmpty():
        return links.selectExpr("hi node", "lo root")
    while True:
        both = links.select("hi", "lo").union(links.selectExpr("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        large = stored(large, "large-star")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo").filter("hi <> lo").distinct()
        )
        new = stored(small, "small-star")
        same = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first() == links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")
        ).first()
        links = new
        if same:
            return links.selectExpr("hi node", "lo root")
