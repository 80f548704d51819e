"""Queries that write a table with a sink and read it again with the matching reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import series
from orrery.sources import readers, sinks
from orrery.sources.adapters import ALERTS_SQL, READINGS_SQL, alert_events, readings, table
from orrery.sources.tables import folder


EVENT_COLUMNS = ("id", "ts", "topic", "asset_id", "aoi_id", "rule_type", "severity", "acknowledged")


def lines(s, d):
    path = folder(s)
    sinks.json_rows(alert_events(s, d), path)
    kinds = dict(alert_events(s, d).dtypes)
    return readers.json_lines(s, path, ", ".join(f"{c} {kinds[c]}" for c in ("pos", *EVENT_COLUMNS)))


def array(s, d):
    """The nations' array holds a number in place of every third item, which the reader drops before it counts positions."""
    path = folder(s)
    item = F.when(F.col("n_nationkey") % 3 == 1, "17").otherwise(F.to_json(F.struct(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("topic"), F.lit("high").alias("severity"))))
    items = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", item.alias("item")))), lambda x: x["item"])  # a row for each nation
    table(s, d, "nation").agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("value")).write.text(path)
    return readers.json_array(s, path).select("pos", "id", "topic", "severity")


def matched(s, d):
    """Records of which some lack an event or a subscription."""
    path = folder(s)
    event = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("topic"))
    record = F.to_json(F.struct(F.when(F.col("n_nationkey") % 5 != 2, F.lit("s")).alias("subscription_id"), F.when(F.col("n_nationkey") % 4 != 1, event).alias("event")))
    items = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", record.alias("item")))), lambda x: x["item"])  # a row for each nation
    table(s, d, "nation").agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("value")).write.text(path)
    return readers.matched_records(s, path).select("subscription_id", "id", "topic")


def parquet(s, d):
    path = folder(s)
    sinks.parquet(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    return readers.parquet(s, path, ["o_orderkey", "o_orderstatus"])


def csv(s, d):
    """Two appends of half of the suppliers each; columns come out with s_name first, then by name."""
    path = folder(s)
    rows = table(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    for k in (0, 1):
        sinks.csv(rows.filter(F.col("s_suppkey") % 2 == k), path, ["s_name"])
    return readers.optional_csv(s, path, "s_name string, s_nationkey int, s_suppkey bigint").withColumn("s_nationkey", F.col("s_nationkey").cast("bigint"))


def logs(s, d):
    path = folder(s)
    sinks.logs(alert_events(s, d).select("id", "ts", "severity"), path)
    read = s.read.schema("id string, ts string, severity string, day string").json(path)
    return read.groupBy("day", "severity").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


def metrics(s, d):
    path = folder(s)
    sinks.prometheus(table(s, d, "events").groupBy(F.concat(F.lit("n-"), "event_type").alias("name")).agg(F.count("*").alias("value")), path)
    return readers.prometheus(s, path)


def news(s, d):
    """Parts as news, some with a body, some with title and snippet, some with neither."""
    path = folder(s)
    key = F.col("p_partkey")
    rows = table(s, d, "part").select(F.when(key % 3 == 0, F.col("p_name")).alias("body"), F.when(key % 3 == 1, F.col("p_brand")).alias("title"), F.when(key % 3 == 1, F.col("p_type")).alias("snippet"))
    sinks.json_rows(rows, path)
    return readers.news(s, path).groupBy("text").agg(F.count("*").alias("n"))


def causal(s, d):
    """Daily series, a file for each asset; of one the dates and values differ in number, so it is dropped."""
    path = folder(s)
    days = F.sort_array(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), "energy_kwh")))
    each = series.daily(readings(s, d)).groupBy("asset_id").agg(days.alias("v"))
    bad = F.when(F.col("asset_id") == "asset_3", F.slice("v.energy_kwh", 2, 100_000)).otherwise(F.col("v.energy_kwh"))
    rows = each.select("asset_id", F.lit("energy_kwh").alias("metric"), F.col("v.date").alias("date"), bad.alias("y"), F.col("asset_id").alias("file"))
    sinks_path = f"{path}/series"
    rows.repartition("file").write.partitionBy("file").json(sinks_path)
    return readers.causal_series(s, sinks_path).select("asset_id", "date", F.round("y", 4).alias("y"))


QUERIES = {
    "file_json_lines": lines,
    "file_json_array": array,
    "file_matched_records": matched,
    "file_parquet": parquet,
    "file_csv": csv,
    "file_logs": logs,
    "file_metrics": metrics,
    "file_news": news,
    "file_causal_series": causal,
}

ORACLES = {
    "file_json_lines": f"WITH {ALERTS_SQL} SELECT pos, id, ts, topic, asset_id, aoi_id, rule_type, severity, acknowledged FROM ev",
    "file_json_array": "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, 'n' || n_nationkey AS id, n_name AS topic, 'high' AS severity FROM nation WHERE n_nationkey % 3 <> 1",
    "file_matched_records": "SELECT 's' AS subscription_id, 'n' || n_nationkey AS id, n_name AS topic FROM nation WHERE n_nationkey % 5 <> 2 AND n_nationkey % 4 <> 1",
    "file_parquet": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders",
    "file_csv": "SELECT s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(s_suppkey AS BIGINT) AS s_suppkey FROM supplier",
    "file_logs": f"WITH {ALERTS_SQL} SELECT strftime(moment, '%Y%m%d') AS day, severity, count(*) AS n, min(ts) AS first_ts FROM ev GROUP BY 1, 2",
    "file_metrics": "SELECT 'orrery_n_' || event_type AS name, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1",
    "file_news": "SELECT CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand || '. ' || p_type END AS text, count(*) AS n FROM part WHERE p_partkey % 3 <> 2 GROUP BY 1",
    "file_causal_series": f"WITH {READINGS_SQL} SELECT asset_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, round(sum(energy_kwh), 4) AS y FROM readings WHERE asset_id <> 'asset_3' GROUP BY 1, 2",
}
