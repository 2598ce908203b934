"""Connected components of a graph given as links, each vertex named by its smallest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cutline.llm.frames import few, stored


def components(links: DataFrame) -> DataFrame:
    """(`vertex`, `root`) for each vertex of links (`a`, `b`), root being the smallest vertex it is connected with.

    Alternating star contraction: larger neighbours are linked to the smallest neighbour, then smaller ones are. Each round
    is two aggregations with map-side minima, whose results are joined back, so that no neighbourhood is ever gathered;
    rounds grow with the logarithm of the longest path. Each round is written to the shared folder. Loops, repeated links
    and links in both directions are fine; links with a null end are ignored."""
    edges = few(stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") != F.col("v"))).distinct(), "links"))

    def told(frame: DataFrame):
        """The number of links and the sum of their hashes: a round that leaves them as they are is the last."""
        return frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = told(edges)
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = few(stored(large, "large-star"))
        # The least neighbour of a vertex takes over its other neighbours; the vertex itself stays linked to it.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        taken = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        small = large.join(least, "u").select(taken).select("e.*").where("u != v").distinct()
        edges = few(stored(small, "small-star"))
        state = told(edges)
        if state == before:
            return edges.select(F.explode(F.array(F.struct(F.col("u").alias("vertex"), F.col("v").alias("root")),
                                                  F.struct(F.col("v").alias("vertex"), F.col("v").alias("root")))).alias("e")).select("e.*").distinct()
        before = state
