"""Risk views for regulators, investors and the public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.config import PublicPolicy
from orrery.functions import security, severity
from orrery.operators.alerts import iso, safe_id, title


def is_open() -> Column:
    """An enforcement alert of at least medium that nobody has acknowledged."""
    return F.coalesce(F.col("topic") == "policy.enforcement", F.lit(False)) & (severity.rank(F.col("severity")) >= 2) & ~F.coalesce(F.col("acknowledged"), F.lit(False))


def heatmap(matched: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Risk by asset over every matched row: risk, open_count, last_ts (text), and lat, lon if locations are given."""
    rows = matched.filter(F.coalesce("asset_id", F.lit("")) != "")
    risk = severity.weight(F.coalesce("severity", F.lit("info")))
    out = rows.groupBy("asset_id").agg(F.sum(risk).alias("risk"), F.count("*").alias("open_count"), F.max(iso(F.col("ts"))).alias("last_ts"), F.min("pos").alias("first_pos"))
    if locations is not None:
        out = out.join(locations.select("asset_id", "lat", "lon"), "asset_id", "left")
    return out.orderBy(F.desc("risk"), F.desc("open_count"), "first_pos").drop("first_pos")


def open_violations(matched: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """Open violations, newest first; a bundle that the index lacks becomes null."""
    rows = matched.filter(is_open())
    shown = ["pos", safe_id("v_").alias("id"), iso(F.col("ts")).alias("ts"), "asset_id", "rule_type", "severity", title().alias("title")]
    if bundles is not None and "bundle_id" in matched.columns:
        known = bundles.select(F.col("bundle_id").alias("known_id")).distinct()
        rows = rows.join(known, F.col("bundle_id") == F.col("known_id"), "left")
        shown.append(F.col("known_id").alias("bundle_id"))
    return rows.select(*shown).orderBy(F.desc("ts"), "pos").drop("pos")


def risk_daily(matched: DataFrame) -> DataFrame:
    """Score by asset and day of the ISO text; a missing severity counts as low."""
    return (
        matched.filter(F.coalesce("asset_id", F.lit("")) != "")
        .groupBy("asset_id", F.substring("ts", 1, 10).alias("date"))
        .agg(F.sum(severity.weight(F.coalesce("severity", F.lit("low")))).alias("score"))
    )


def trajectory(daily: DataFrame, rows: int = 7) -> DataFrame:
    """daily with the mean of the last `rows` observations."""
    trailing = Window.partitionBy("asset_id").orderBy("date").rowsBetween(1 - rows, 0)
    return daily.withColumn("roll7", F.round(F.avg("score").over(trailing), 3))


def trajectory_ends(rolled: DataFrame) -> DataFrame:
    """By asset the last value and its rise over the first one, largest last value first."""
    last, first = F.max_by("roll7", "date"), F.min_by("roll7", "date")
    return rolled.groupBy("asset_id").agg(last.alias("last_roll7"), F.round(last - first, 3).alias("slope")).orderBy(F.desc("last_roll7"), "asset_id")


def roi(rolled: DataFrame, snapshot: DataFrame, metric: str = "energy_kwh") -> DataFrame:
    """Assets by the fall of risk together with the last value of a causal series (null if there is none)."""
    last = snapshot.filter(F.col("metric") == metric).groupBy("asset_id").agg(F.max_by("y", "date").alias("last_y"))
    ends = trajectory_ends(rolled).join(last, "asset_id", "left")
    return ends.withColumn("roi", -F.col("slope")).orderBy(F.desc("roi"), "asset_id")


def sentiment_counts(news: DataFrame) -> DataFrame:
    label = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("sentiment", "label") if c in news.columns], F.lit("neutral"))
    return news.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def public_items(matched: DataFrame, policy: PublicPolicy = PublicPolicy(), salt: str = "public") -> DataFrame:
    """Masked items of at least the least severity, newest first, at most max_items (<= 0: all)."""
    region = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in policy.aoi_to_region.items() for x in kv]), F.col("aoi_id")), F.lit(policy.fallback_region))
    shown = matched.filter(severity.rank(F.coalesce("severity", F.lit("info"))) >= severity.RANKS.get(policy.min_severity, 0)).select(
        "pos", "sub_pos", iso(F.col("ts")).alias("ts"), "topic", "severity", "aoi_id", "rule_type", region.alias("region"),
        (security.pseudonym(salt, F.col("asset_id"), policy.pseudonym_prefix) if policy.anonymize_asset_id else F.col("asset_id")).alias("asset_id"),
    )
    keep = [c for c in policy.visible_fields if c in shown.columns] + (["asset_id"] if policy.include_asset_id_field else [])
    # Without a visible ts there is nothing to sort by: input order stays.
    rows = shown.orderBy(*([F.desc("ts")] if "ts" in keep else []), "pos", "sub_pos")
    return (rows.limit(policy.max_items) if policy.max_items > 0 else rows).select(*keep)


def public_scores(items: DataFrame, fallback: str = "Unknown") -> DataFrame:
    """Counts by region and severity of the items that are shown."""
    region = F.col("region") if "region" in items.columns else F.lit(fallback)
    return items.groupBy(region.alias("region"), "severity").agg(F.count("*").alias("n"))


def investor_score(citations: Column, published: Column, as_of: Column) -> Column:
    """3 x citations + 2 x freshness within a year."""
    fresh = F.greatest(F.lit(0.0), (365 - F.datediff(as_of, published)) / 365.0)
    return 3.0 * citations + 2.0 * F.coalesce(fresh, F.lit(0.0))
