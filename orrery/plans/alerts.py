"""Queries on alerts and portals."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from orrery.config import ROUTES, SUBSCRIPTIONS, Dedupe, PublicPolicy, Route
from orrery.operators import alerts, portals
from orrery.sources.adapters import ALERTS_SQL, READINGS_SQL, alert_events, readings

PLAIN = ("id", "ts", "topic", "asset_id", "aoi_id", "rule_type", "severity", "acknowledged")
#: Limits so small that they take effect on the test tables.
SMALL = tuple(Route(r.id, tuple(replace(c, max_per_run=n) for c, n in zip(r.channels, (5, 7))), r.subscription_ids, r.topics, r.severity_at_least) for r in ROUTES)
SMALL_TOTAL = 12


def matched(spark, d):
    return alerts.match(alert_events(spark, d), SUBSCRIPTIONS)


def attempts(spark, d):
    return alerts.limit(alerts.route(matched(spark, d), SMALL), SMALL_TOTAL)


def pseudonyms(spark, d):
    from orrery.functions.security import pseudonym

    return alert_events(spark, d).select("asset_id").distinct().select("asset_id", pseudonym("public", F.col("asset_id")).alias("alias"))


def flaps(spark, d):
    config = replace(Dedupe(), ttl_seconds=0, min_interval_seconds=0, flap=replace(Dedupe().flap, window_seconds=259_200))
    by_second = matched(spark, d).drop("moment")  # its SQL counts whole seconds
    return alerts.dedupe(by_second, config).groupBy("status").agg(F.count("*").alias("n"))


def roi(spark, d):
    snapshot = readings(spark, d).select("asset_id", F.lit("energy_kwh").alias("metric"), F.struct("timestamp", "energy_kwh").alias("date"), F.col("energy_kwh").alias("y"))
    return portals.roi(portals.trajectory(portals.risk_daily(matched(spark, d))), snapshot)


QUERIES = {
    "alert_match": lambda s, d: matched(s, d).select("subscription_id", *PLAIN),
    "alert_match_metrics": lambda s, d: alerts.match_metrics(alert_events(s, d), SUBSCRIPTIONS),
    "alert_unmatched": lambda s, d: alerts.unmatched(alert_events(s, d), SUBSCRIPTIONS).select(*PLAIN),
    "alert_dedupe_ttl": lambda s, d: alerts.dedupe(matched(s, d)).select("subscription_id", "id", F.when(F.col("status") == "kept", "kept").otherwise("suppressed").alias("status")),
    "alert_dedupe_metrics": lambda s, d: alerts.dedupe_metrics(alerts.dedupe(matched(s, d))),
    "alert_flapping": flaps,
    "alert_flap_changes": lambda s, d: alerts.flap_changes(matched(s, d), ["subscription_id", "asset_id"], "severity", 86_400).select("subscription_id", "id", "changes"),
    "alert_routes": lambda s, d: alerts.route(matched(s, d), SMALL).select("subscription_id", "id", "route_id", "channel_id"),
    "channel_limiter": lambda s, d: attempts(s, d).select("subscription_id", "id", "route_id", "channel_id", "status"),
    "channel_counts": lambda s, d: alerts.channel_counts(attempts(s, d)),
    "channel_outbox": lambda s, d: alerts.outbox(attempts(s, d), SMALL),
    "alert_feed": lambda s, d: alerts.feed(matched(s, d)),
    "feed_counts": lambda s, d: alerts.feed(matched(s, d)).groupBy("severity").agg(F.count("*").alias("n")),
    "regulator_heatmap": lambda s, d: portals.heatmap(matched(s, d)),
    "regulator_open_violations": lambda s, d: portals.open_violations(matched(s, d)),
    "investor_risk_daily": lambda s, d: portals.risk_daily(matched(s, d)),
    "investor_roll7": lambda s, d: portals.trajectory(portals.risk_daily(matched(s, d))),
    "investor_trajectory": lambda s, d: portals.trajectory_ends(portals.trajectory(portals.risk_daily(matched(s, d)))),
    "investor_roi": roi,
    "public_feed": lambda s, d: portals.public_items(matched(s, d)),
    "public_scores": lambda s, d: portals.public_scores(portals.public_items(matched(s, d))),
    "public_pseudonym": pseudonyms,
    "public_unlimited": lambda s, d: portals.public_items(matched(s, d), PublicPolicy(min_severity="high", max_items=0, include_asset_id_field=True)),
}

_W = f"WITH RECURSIVE {ALERTS_SQL}"
_PLAIN = ", ".join(PLAIN)
_ISO = "replace(ts, 'Z', '+00:00')"
_ROUTED = """,
routed AS (
  SELECT m.pos, m.sub_pos, m.subscription_id, m.id, r.* FROM matched m
  JOIN (VALUES (0, 'route_policy_to_webhook', 0, 'wh_policy', 5), (1, 'route_sat_to_email', 0, 'email_sat_ops', 5), (2, 'route_zk_to_both', 0, 'wh_zk', 5), (2, 'route_zk_to_both', 1, 'email_zk', 7)) r(route_pos, route_id, channel_pos, channel_id, lim)
  ON (route_pos = 0 AND subscription_id = 'policy_high_plus' AND rank >= 3) OR (route_pos = 1 AND subscription_id = 'sat_ndvi_drop') OR (route_pos = 2 AND topic IN ('zk.issue', 'zk.verify'))
)"""
_LIMITED = f"""{_ROUTED}, cand AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY channel_id ORDER BY pos, sub_pos, route_pos, channel_pos) <= lim THEN 1 ELSE 0 END AS c FROM routed
), att AS (
  SELECT *, CASE WHEN coalesce(sum(c) OVER (ORDER BY pos, sub_pos, route_pos, channel_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 12 THEN 'global_rate_limited' WHEN c = 0 THEN 'channel_rate_limited' ELSE 'sent' END AS status FROM cand
)"""
_PAYLOAD = """'{"subscription_id":"' || m.subscription_id || '","event":{"pos":' || m.pos || ',"id":"' || m.id || '","ts":"' || ts || '","topic":"' || topic || '","asset_id":"' || asset_id || '",' ||
  CASE WHEN aoi_id IS NULL THEN '' ELSE '"aoi_id":"' || aoi_id || '",' END || '"rule_type":"' || rule_type || '","severity":"' || severity || '","acknowledged":' || CAST(acknowledged AS VARCHAR) || ',"delta":{"ndvi":' || CAST(ndvi AS VARCHAR) || '}}}'"""
_DEDUPE = """,
d0 AS (SELECT *, row_number() OVER (PARTITION BY subscription_id, topic, asset_id, rule_type ORDER BY pos, sub_pos) AS n FROM matched),
dd AS (
  SELECT pos, subscription_id, id, topic, asset_id, rule_type, n, moment AS last, 'kept' AS status FROM d0 WHERE n = 1
  UNION ALL
  SELECT b.pos, b.subscription_id, b.id, b.topic, b.asset_id, b.rule_type, b.n, CASE WHEN epoch(b.moment) - epoch(a.last) < 3600 THEN a.last ELSE b.moment END, CASE WHEN epoch(b.moment) - epoch(a.last) < 3600 THEN 'suppressed' ELSE 'kept' END
  FROM dd a JOIN d0 b ON b.n = a.n + 1 AND b.subscription_id = a.subscription_id AND b.topic = a.topic AND b.asset_id = a.asset_id AND b.rule_type = a.rule_type
)"""
_DAILY = ", daily AS (SELECT asset_id, substr(ts, 1, 10) AS date, CAST(sum(weight) AS BIGINT) AS score FROM matched GROUP BY 1, 2)"
_ROLL = f"{_DAILY}, roll AS (SELECT *, round(avg(score) OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 3) AS roll7 FROM daily)"
_ENDS = f"{_ROLL}, ends AS (SELECT asset_id, arg_max(roll7, date) AS last_roll7, round(arg_max(roll7, date) - arg_min(roll7, date), 3) AS slope FROM roll GROUP BY 1)"
_FEED = f""", feed AS (SELECT id, {_ISO} AS ts, subscription_id, topic, severity, rank AS severity_rank, asset_id, aoi_id, rule_type,
  '[' || upper(severity) || '] ' || topic || ' / ' || rule_type || ' @ ' || asset_id || ' (' || subscription_id || ')' AS title FROM matched ORDER BY ts DESC, pos, sub_pos LIMIT 100)"""
_PUBLIC = f""", pub AS (SELECT {_ISO} AS ts, topic, severity, aoi_id, CASE aoi_id WHEN 'aoi_1' THEN 'Region A' WHEN 'aoi_2' THEN 'Region B' ELSE 'Unknown' END AS region, asset_id, pos, sub_pos, rank FROM matched WHERE rank >= 2)"""
_KEY = "7075626c6963" + "00" * 58  # the key, padded to a block
_pad = lambda b: "".join(f"{int(_KEY[i:i + 2], 16) ^ b:02x}" for i in range(0, 128, 2))
_HMAC = f"substr(sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(asset_id)))), 1, 16)"
_ALIAS = f"'asset_' || translate(replace(base64(unhex({_HMAC})), '=', ''), '+/', '-_')"

ORACLES = {
    "alert_match": f"{_W} SELECT subscription_id, {_PLAIN} FROM matched",
    "alert_match_metrics": f"""{_W} SELECT subscription_id, count(*) AS n FROM matched GROUP BY 1
      UNION ALL SELECT 'unmatched', count(*) FROM ev WHERE pos NOT IN (SELECT pos FROM matched) UNION ALL SELECT 'events', count(*) FROM ev""",
    "alert_unmatched": f"{_W} SELECT {_PLAIN} FROM ev WHERE pos NOT IN (SELECT pos FROM matched)",
    "alert_dedupe_ttl": f"{_W}{_DEDUPE} SELECT subscription_id, id, status FROM dd",
    "alert_dedupe_metrics": f"{_W}{_DEDUPE} SELECT count(*) AS input, count(*) FILTER (WHERE status = 'kept') AS kept, count(*) FILTER (WHERE status <> 'kept') AS suppressed FROM dd",
    "alert_flapping": f"""{_W}, k AS (SELECT pos, subscription_id, asset_id, rule_type, severity, CAST(epoch(date_trunc('second', moment)) AS BIGINT) AS t FROM matched),
      l AS (SELECT *, lag(severity) OVER w AS before, lag(t) OVER w AS t0 FROM k WINDOW w AS (PARTITION BY subscription_id, asset_id, rule_type ORDER BY pos)),
      n AS (SELECT e.pos, count(c.pos) AS changes FROM l e LEFT JOIN l c ON c.subscription_id = e.subscription_id AND c.asset_id = e.asset_id AND c.rule_type = e.rule_type AND c.pos <= e.pos AND c.before <> c.severity AND c.t0 >= e.t - 259200 GROUP BY 1)
      SELECT CASE WHEN changes > 3 THEN 'flapping' ELSE 'kept' END AS status, count(*) AS n FROM n GROUP BY 1""",
    "alert_flap_changes": f"""{_W}, c AS (SELECT *, CASE WHEN lag(severity) OVER w <> severity THEN 1 ELSE 0 END AS changed FROM matched WINDOW w AS (PARTITION BY subscription_id, asset_id ORDER BY moment, pos))
      SELECT subscription_id, id, CAST(sum(changed) OVER (PARTITION BY subscription_id, asset_id ORDER BY epoch(moment)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS changes FROM c""",
    "alert_routes": f"{_W}{_ROUTED} SELECT subscription_id, id, route_id, channel_id FROM routed",
    "channel_limiter": f"{_W}{_LIMITED} SELECT subscription_id, id, route_id, channel_id, status FROM att",
    "channel_outbox": f"{_W}{_LIMITED} SELECT channel_id, 'outbox/' || CASE WHEN channel_id LIKE 'wh%' THEN 'webhook' ELSE 'email' END || '/' || channel_id || '/' || m.id || '__' || m.subscription_id || '.json' AS path, {_PAYLOAD} AS payload FROM att JOIN matched m USING (pos, sub_pos) WHERE status = 'sent'",
    "channel_counts": f"{_W}{_LIMITED} SELECT channel_id, count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER (WHERE status <> 'sent') AS skipped FROM att GROUP BY 1",
    "alert_feed": f"{_W}{_FEED} SELECT * FROM feed",
    "feed_counts": f"{_W}{_FEED} SELECT severity, count(*) AS n FROM feed GROUP BY 1",
    "regulator_heatmap": f"{_W} SELECT asset_id, CAST(sum(weight) AS BIGINT) AS risk, count(*) AS open_count, max({_ISO}) AS last_ts FROM matched GROUP BY 1",
    "regulator_open_violations": f"""{_W} SELECT id, {_ISO} AS ts, asset_id, rule_type, severity,
      '[' || upper(severity) || '] ' || topic || ' / ' || rule_type || ' @ ' || asset_id || ' (' || subscription_id || ')' AS title FROM matched WHERE topic = 'policy.enforcement' AND rank >= 2 AND NOT acknowledged""",
    "investor_risk_daily": f"{_W}{_DAILY} SELECT * FROM daily",
    "investor_roll7": f"{_W}{_ROLL} SELECT * FROM roll",
    "investor_trajectory": f"{_W}{_ENDS} SELECT * FROM ends",
    "investor_roi": f"""{_W}{_ENDS}, {READINGS_SQL} SELECT e.*, (SELECT arg_max(energy_kwh, (timestamp, energy_kwh)) FROM readings r WHERE r.asset_id = e.asset_id) AS last_y, -slope AS roi FROM ends e""",
    "public_feed": f"{_W}{_PUBLIC} SELECT ts, topic, severity, aoi_id, region FROM (SELECT * FROM pub ORDER BY ts DESC, pos, sub_pos LIMIT 200)",
    "public_scores": f"{_W}{_PUBLIC} SELECT region, severity, count(*) AS n FROM (SELECT * FROM pub ORDER BY ts DESC, pos, sub_pos LIMIT 200) GROUP BY 1, 2",
    "public_pseudonym": f"{_W} SELECT DISTINCT asset_id, {_ALIAS} AS alias FROM ev",
    "public_unlimited": f"{_W}{_PUBLIC} SELECT ts, topic, severity, aoi_id, region, {_ALIAS} AS asset_id FROM pub WHERE rank >= 3",
}
