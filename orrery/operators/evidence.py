"""Evidence: documents, clauses and assets joined; citation counts; knowledge-graph edges; bundle ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clauses(docs: DataFrame, keywords: dict[str, str], text_col: str = "text") -> DataFrame:
    """A row per document and class whose keyword it has as a whole word: doc_sha256, clause_type, page, text."""
    edge = r"($|[^\p{L}\p{N}_])"
    hits = [F.when(F.col(text_col).rlike(rf"(^|[^\p{{L}}\p{{N}}_]){w}{edge}"), F.lit(k)) for k, w in keywords.items()]
    return docs.select("doc_sha256", F.explode(F.array_compact(F.array(*hits))).alias("clause_type"), F.lit(1).alias("page"), F.col(text_col).alias("text"))


def clause_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_sha256").agg(F.count("*").alias("clause_count"))


def citation_counts(docs: DataFrame, found: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """Every document's count: an override, else its clauses, else 0."""
    out = docs.select("doc_sha256", "doc_id").join(clause_counts(found), "doc_sha256", "left")
    count = F.coalesce("clause_count", F.lit(0))
    if override is not None:
        out = out.join(override.select("doc_sha256", "citation_count"), "doc_sha256", "left")
        count = F.coalesce("citation_count", "clause_count", F.lit(0))
    return out.select("doc_sha256", "doc_id", count.cast("long").alias("clause_count"))


def docs_with_assets(docs: DataFrame, assets: DataFrame) -> DataFrame:
    return docs.join(assets.select("asset_id", "name"), "asset_id").select("doc_sha256", "doc_id", "asset_id", "name", "title", "source", "lang", "published_at")


def current_events(docs: DataFrame, assets: DataFrame, found: DataFrame, as_of: Column, days: int = 60, keep_undated: bool = False, citations: int = 2) -> DataFrame:
    """Documents of assets within the days before as_of, with their count and whether it is enough."""
    recent = F.col("published_at") >= F.date_sub(as_of, days)
    rows = docs_with_assets(docs, assets).filter((recent | F.col("published_at").isNull()) if keep_undated else recent)
    n = F.coalesce("clause_count", F.lit(0)).cast("long")
    return rows.join(clause_counts(found), "doc_sha256", "left").select("asset_id", "name", "doc_sha256", "doc_id", "title", "published_at", n.alias("citation_count"), (n >= citations).alias("has_min_citations"))


def evidence(docs: DataFrame, found: DataFrame, asset_id, as_of: Column, days: int, enough_only: bool, most: int, citations: int = 2) -> DataFrame:
    """The documents of an asset, newest first and undated last, at most so many."""
    rows = docs.filter((F.col("asset_id") == asset_id) & (F.col("published_at").isNull() | (F.col("published_at") >= F.date_sub(as_of, days))))
    n = F.coalesce("clause_count", F.lit(0)).cast("long")
    out = rows.join(clause_counts(found), "doc_sha256", "left").select("doc_sha256", "doc_id", "title", "published_at", n.alias("citation_count"))
    out = out.filter(F.col("citation_count") >= citations) if enough_only else out
    return out.orderBy(F.desc_nulls_last("published_at"), "doc_id").limit(most)


def edge_type(clause_type: Column) -> Column:
    low = F.lower(F.coalesce(clause_type, F.lit("")))
    return F.when(low == "metric", "metric").when(low == "permit", "permit").when(low == "operational", "operation").otherwise("policy")


def kg_edges(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One edge from an asset to each clause of its documents."""
    kind, page = F.coalesce("clause_type", F.lit("")), F.coalesce(F.col("page").cast("string"), F.lit(""))
    rows = found.join(docs.select("doc_sha256", "asset_id"), "doc_sha256")
    return rows.select(
        F.md5(F.concat_ws(":", "doc_sha256", kind, page)).alias("edge_id"),
        F.lit("asset").alias("src_type"),
        F.col("asset_id").cast("string").alias("src_id"),
        edge_type(F.col("clause_type")).alias("dst_type"),
        F.md5(F.concat_ws(":", kind, F.coalesce("text", F.lit("")))).alias("dst_id"),
        kind.alias("label"),
        F.lit(0.7).alias("weight"),
        "doc_sha256",
    )


def bundle_ids(docs: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """Each document's bundle: an override, else pb- and 12 digits of its hash's md5."""
    own = F.concat(F.lit("pb-"), F.substring(F.md5("doc_sha256"), 1, 12))
    if override is None:
        return docs.select("doc_sha256", "doc_id", own.alias("bundle_id"))
    return docs.join(override.select("doc_sha256", F.col("bundle_id").alias("given")), "doc_sha256", "left").select("doc_sha256", "doc_id", F.coalesce("given", own).alias("bundle_id"))
