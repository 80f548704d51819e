"""The driver's tables in the shapes of the domain's schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as alerts: pos, id, ts (ISO text, whole seconds), moment (the time itself), topic, asset_id, aoi_id, rule_type, severity, acknowledged, delta."""
    k = F.get_json_object("props", "$.k").cast("int")
    topic = F.when(F.col("event_type") == "error", "policy.enforcement").when(F.col("event_type") == "purchase", "sat.change").when(F.col("event_type") == "signup", "zk.issue").when(F.col("event_type") == "click", "zk.verify").otherwise("doc.ingested")
    v = F.col("value")
    severity = F.when(v < 5, "info").when(v < 20, "low").when(v < 60, "medium").when(v < 150, "high").otherwise("critical")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"),
        F.concat(F.lit("e"), F.col("event_id")).alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.to_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("moment"),
        topic.alias("topic"),
        F.concat(F.lit("asset_"), F.col("user_id") % 20).alias("asset_id"),
        F.when(k % 5 != 4, F.concat(F.lit("aoi_"), k % 5)).alias("aoi_id"),
        F.element_at(F.array(F.lit("emissions_exceedance"), F.lit("water_breach"), F.lit("other_rule")), k % 3 + 1).alias("rule_type"),
        severity.alias("severity"),
        (F.col("event_id") % 7 == 0).alias("acknowledged"),
        F.create_map(F.lit("ndvi"), v / 100).alias("delta"),
    )


#: The same in DuckDB, as the head of a WITH clause.
ALERTS_SQL = """
ev0 AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
ev AS (
  SELECT event_id AS pos, 'e' || event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, ts AS moment,
    CASE event_type WHEN 'error' THEN 'policy.enforcement' WHEN 'purchase' THEN 'sat.change' WHEN 'signup' THEN 'zk.issue' WHEN 'click' THEN 'zk.verify' ELSE 'doc.ingested' END AS topic,
    'asset_' || (user_id % 20) AS asset_id,
    CASE WHEN k % 5 <> 4 THEN 'aoi_' || (k % 5) END AS aoi_id,
    CASE k % 3 WHEN 0 THEN 'emissions_exceedance' WHEN 1 THEN 'water_breach' ELSE 'other_rule' END AS rule_type,
    CASE WHEN value < 5 THEN 'info' WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' WHEN value < 150 THEN 'high' ELSE 'critical' END AS severity,
    event_id % 7 = 0 AS acknowledged, value / 100 AS ndvi
  FROM ev0
), rk(severity, rank, weight) AS (VALUES ('info', 0, 0), ('low', 1, 1), ('medium', 2, 2), ('high', 3, 4), ('critical', 4, 8)),
matched AS (
  SELECT e.*, r.rank, r.weight, s.sub_pos, s.subscription_id FROM ev e JOIN rk r USING (severity)
  JOIN (VALUES (0, 'policy_high_plus'), (1, 'sat_ndvi_drop'), (2, 'zk_attest_issues')) s(sub_pos, subscription_id) ON
    (sub_pos = 0 AND topic = 'policy.enforcement' AND rank >= 3 AND rule_type IN ('emissions_exceedance', 'water_breach', 'waste_violation') AND NOT acknowledged)
    OR (sub_pos = 1 AND topic = 'sat.change' AND rank >= 2 AND aoi_id IN ('aoi_1', 'aoi_2') AND ndvi >= 0.2)
    OR (sub_pos = 2 AND topic IN ('zk.issue', 'zk.verify') AND rank >= 1)
)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as hourly sensor readings: timestamp, asset_id, energy_kwh, temp_c."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"), F.concat(F.lit("asset_"), F.col("user_id") % 20).alias("asset_id"), F.col("value").alias("energy_kwh"), (15 + k / 10.0).cast("double").alias("temp_c")
    )


READINGS_SQL = """
readings AS (
  SELECT ts AS timestamp, 'asset_' || (user_id % 20) AS asset_id, value AS energy_kwh, 15 + CAST(json_extract(props, '$.k') AS INTEGER) / 10.0::DOUBLE AS temp_c FROM events
)"""


def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a hash, an asset and a publication date."""
    return table(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("doc_sha256"),
        "doc_id",
        (F.col("doc_id") % 100 + 1).alias("asset_id"),
        F.concat(F.lit("doc "), F.col("doc_id")).alias("title"),
        "source",
        "lang",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).alias("published_at"),
        "text",
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
    return table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("asset_id"), F.col("s_name").alias("name"), "country")


INDEX_SQL = """
doc_index AS (
  SELECT sha256(text) AS doc_sha256, doc_id, doc_id % 100 + 1 AS asset_id, 'doc ' || doc_id AS title, source, lang, DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER) AS published_at, text FROM documents
), assets AS (
  SELECT s_suppkey AS asset_id, s_name AS name, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey
), clauses AS (
  SELECT doc_sha256, k AS clause_type, 1 AS page, text FROM doc_index, (VALUES ('metric', 'with'), ('permit', 'und'), ('operational', 'que'), ('policy', 'les')) c(k, w)
  WHERE regexp_matches(text, '(^|[^\\p{L}\\p{N}_])' || w || '($|[^\\p{L}\\p{N}_])')
)"""

#: Keywords that the generated documents have, by clause class.
TEST_KEYWORDS = {"metric": "with", "permit": "und", "operational": "que", "policy": "les"}
