"""Mixing sources to target weights (1), with DataFrame functions only.

Sizes are summed per source, targets follow from weights, and each document is emitted
floor(rate) times plus once more if a number hashed from seed, id and text is below the
fraction; rate = target / source size, so the expected size of a source is its target.

One row per source is all that is ever gathered; the largest source is summed before
the shuffle and its documents stay where they are.

Defined results: a null text has size 0; a null source is a source of its own (last);
a source without words has rate 0 and emits nothing; rows that share an id, or have none,
get numbers by their texts, and rows that are equal in both the same number; a text of any
length is one row; sources of equal rank in the filling are taken in their order; an empty
table gives an empty one. Columns of the input keep their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import normalised, renamed

#: Hexadecimal digits of the hash that make the number: 52 bits, exact in a double.
DIGITS = 13
#: Up to so many sources their targets are sent to all executors; beyond, the join shuffles.
MOST_SOURCES = 100_000


def words(text: Column) -> Column:
    """The number of runs of anything but white space; null: 0.

    Runs of white space become single spaces, which are then counted in bytes: no array
    of words is made, so a long text costs no more memory than its copy.
    """
    one = F.trim(normalised(text))
    return (F.octet_length(one) - F.octet_length(F.replace(one, F.lit(" "), F.lit(""))) + (F.octet_length(one) > 0).cast("int")).cast("long")


def unit(seed: str, id_col: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on seed, id and text alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size) to (source, size, target).

    Targets share `share` times all sizes by weight and stop at `most` times their own
    size; what is over goes to the others by weight. In order of cap / weight the full
    ones come first, so one pass settles all: a source is full if its cap is no more
    than its part of what those before it leave.
    """
    every = Window.partitionBy(F.lit(0))
    n = (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % F.lit(len(weights))
    weighed = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int")))
        .withColumn("cap", F.col("size") * F.lit(float(most)))
        .withColumn("goal", F.sum("size").over(every) * F.lit(float(share)))
    )
    up = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    stands = weighed.withColumn("full", F.col("cap") <= F.col("weight") * left / F.sum("weight").over(after))
    rest = F.col("goal") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    others = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return stands.select("source", "size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rest / others).alias("target"))


def with_copies(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, dict[str, str]]:
    """docs with four more columns, and their names: size, source_size, target, copies."""
    size, source_size, target, copies, key = renamed(docs, "size", "source_size", "target", "copies", "source_key")
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(words(F.col(text_col))).alias("size"))
    goals = targets(sizes, weights, share, most).select(F.col("source").alias(key), F.col("size").alias(source_size), F.col("target").alias(target))
    few = docs.select(source_col).distinct().limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    out = (
        docs.withColumn(size, words(F.col(text_col)))
        .join(F.broadcast(goals) if few else goals, F.col(source_col).eqNullSafe(F.col(key)), "left")
        .withColumn(copies, (F.floor(rate) + (unit(seed, F.col(id_col), F.col(text_col)) < rate - F.floor(rate)).cast("long")).cast("long"))
        .drop(key)
    )
    return out, {"size": size, "source_size": source_size, "target": target, "copies": copies}


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture: each document as often as it is taken. Columns as in docs."""
    out, names = with_copies(docs, **how)
    (again,) = renamed(out, "again")
    return out.filter(F.col(names["copies"]) > 0).withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["copies"])))).select(*docs.columns)
