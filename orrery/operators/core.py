"""Loading and linking the relational core."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of all parts with the part's name as `source`."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("source", F.lit(k)) for k, df in sorted(parts.items())))


def organisation_ids(names: DataFrame) -> DataFrame:
    """One organisation for each name and country, whatever the case; the id follows from both."""
    key = F.concat_ws("|", F.lower(F.trim("name")), F.upper(F.coalesce("country_code", F.lit(""))))
    return names.groupBy(F.sha2(key, 256).alias("id")).agg(F.min("name").alias("name"), F.upper(F.min("country_code")).alias("country_code"))


def link_documents(permits: DataFrame, documents: DataFrame) -> DataFrame:
    """permits with the document of their reference; a permit without one keeps what it has."""
    found = documents.groupBy("reference_id").agg(F.max("id").alias("linked_id"))
    linked = permits.join(found, "reference_id", "left")
    return linked.withColumn("document_id", F.coalesce("linked_id", "document_id")).select(*permits.columns)


def replace_source(documents: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """documents without the rows of a source, with new ones in place; of equal hashes the new path stays."""
    keep = documents.filter(F.coalesce(F.col("source") != source, F.lit(True)))
    paths = new.groupBy("doc_sha256").agg(F.max("storage_path").alias("new_path"))
    keep = keep.join(paths, "doc_sha256", "left").withColumn("storage_path", F.coalesce("new_path", "storage_path")).drop("new_path").select(*documents.columns)
    return keep.unionByName(new.join(keep.select("doc_sha256"), "doc_sha256", "left_anti").withColumn("source", F.lit(source)).select(*documents.columns))


def index_sample(lines: DataFrame, n: int, order: str, text: str = "text", words: int = 60) -> DataFrame:
    """Of the first n lines those with at least so many words."""
    return lines.orderBy(order).limit(n).filter(F.size(F.split(F.trim(text), r"\s+")) >= words)


def without_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.length(F.trim(text)) > 0)


#: Ranges of the order that `numbered` counts apart, and rows that it draws to find them.
RANGES, DRAWN = 200, 10_000


def numbered(rows: DataFrame, by: str, then: Sequence[str] = (), name: str = "nth", descending: bool = False) -> DataFrame:
    """rows numbered from 1 in the order of `by` and `then`; nulls first, or last if `by` is descending.

    Ranges of `by` are counted, then numbered each for itself, so no task sees all rows. The
    bounds between ranges come from a sample of about DRAWN values and only even out the work.
    """
    n = rows.count()
    drawn = sorted(r[0] for r in rows.select(by).filter(F.col(by).isNotNull()).sample(min(1.0, DRAWN / max(n, 1)), 7).collect()) if n > DRAWN else []
    bounds = sorted(set(drawn[:: max(1, len(drawn) // RANGES)]))
    before = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast(f"array<{dict(rows.dtypes)[by]}>")
    passed = F.size(F.filter(before, lambda b: b > F.col(by) if descending else b < F.col(by)))
    slab = F.when(F.col(by).isNull(), F.lit(RANGES * DRAWN if descending else -1)).otherwise(passed)
    own = rows.withColumn("slab", slab)
    sums = own.groupBy("slab").agg(F.count("*").alias("in_slab"))
    earlier = Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sums.select("slab", F.coalesce(F.sum("in_slab").over(earlier), F.lit(0)).alias("rows_before"))
    order = Window.partitionBy("slab").orderBy(F.desc(by) if descending else F.asc(by), *then)
    return own.join(F.broadcast(offsets), "slab").withColumn(name, F.col("rows_before") + F.row_number().over(order)).drop("slab", "rows_before")


def first_existing(df: DataFrame, names: Sequence[str], default=None):
    """The first of these columns that df has, else a constant."""
    have = {c.lower(): c for c in df.columns}
    return next((F.col(have[n.lower()]) for n in names if n.lower() in have), F.lit(default))
