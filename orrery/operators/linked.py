"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

A step moves a node's neighbours to its least neighbour, so paths shrink by halves and no
node's neighbours meet in one group. Nodes are values of any type that has an order. Edges
are counted first: a few need no steps, as a task joins them at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from orrery.sources.tables import dropped, stored

#: Edges that one task joins at once.
FEW = 100_000


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours to the least neighbour (or the node itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """The node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))


def _key(value):
    """A node that a dict can look up."""
    if isinstance(value, dict):
        return tuple(map(_key, value.values()))
    return tuple(map(_key, value)) if isinstance(value, list) else value


def _joined(batches):
    """Edges with the number of their component: a forest of places in the order in which nodes come."""
    import pyarrow as pa

    batches, place, up = list(batches), {}, []

    def top(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def at(value):
        k = place.setdefault(_key(value), len(up))
        if k == len(up):
            up.append(k)
        return k

    ends = []
    for batch in batches:
        ends.append([at(a) for a in batch.column("a").to_pylist()])
        for a, b in zip(ends[-1], batch.column("b").to_pylist()):
            a, b = top(a), top(at(b))
            up[max(a, b)] = min(a, b)
    for batch, own in zip(batches, ends):
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([top(k) for k in own], pa.int32())], names=["a", "b", "of"])


def roots(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b) to (node, root): root is the least node of the component; each node of an edge once. Nulls are no nodes."""
    now = stored(edges.select("a", "b").filter("a != b"))
    if now.count() <= few:
        of = now.coalesce(1).mapInArrow(_joined, StructType(now.schema.fields).add("of", IntegerType()))
        return of.select(F.explode(F.array("a", "b")).alias("node"), "of").distinct().select("node", F.min("node").over(Window.partitionBy("of")).alias("root"))
    seen = None
    while True:
        large = stored(_large(now).filter("a != b").distinct())
        small = stored(_small(large).filter("a != b").distinct())
        dropped(now, large)
        now = small
        state = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if state == seen or not state[0]:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
