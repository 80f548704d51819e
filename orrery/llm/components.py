"""Connected components by alternating large-star and small-star steps, as joins and aggregates.

Each step replaces a node's neighbours by its least neighbour, so paths shrink by
halves; no node's neighbours are ever gathered. Steps are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import small, written


# The least neighbours are a table of their own: few rows are broadcast, and with many the
# join can split a node that has very many neighbours, as no aggregate shares its shuffle.
def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
    return both.filter("b > a").join(small(least), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("low")))
    return down.join(small(least), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs to (node, root): root is the least node that is connected; every node of a pair occurs once."""
    edges = edges.filter("a != b")
    seen = None
    while True:
        edges = written(_large(edges).filter("a != b").distinct())
        edges = written(_small(edges).filter("a != b").distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
