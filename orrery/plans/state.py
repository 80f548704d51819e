"""Queries that keep state across runs or run as streams; the same results come from one run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.config import SUBSCRIPTIONS, Dedupe
from orrery.operators import alerts, evaluation, graph
from orrery.plans import alerts as alert_plans
from orrery.plans import evidence, retrieval
from orrery.sources.adapters import alert_events, table
from orrery.sources.buckets import BucketTable
from orrery.sources.tables import folder
from orrery.streaming import bus as streams


def in_parts(rows, column, parts=3):
    """rows by equal parts of a number's range."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None:
        return [rows]
    part = F.least(F.floor((F.col(column) - low) * parts / (high - low + 1)), F.lit(parts - 1))
    return [rows.filter(part == k) for k in range(parts)]


def deduped(s, d):
    """Alerts of three runs, each of which goes on from the state of the one before."""
    path = folder(s, "runs")
    events = in_parts(alert_events(s, d), "pos")
    decided = [alerts.dedupe_run(alerts.match(e, SUBSCRIPTIONS), path, run, Dedupe()) for run, e in enumerate(events)]
    return reduce(DataFrame.unionByName, decided).select("subscription_id", "id", F.when(F.col("status") == "kept", "kept").otherwise("suppressed").alias("status"))


def upserted(s, d):
    """Suppliers, then customers in three runs over the same keys."""
    t = BucketTable(s, folder(s, "runs"), "id long, name string", ["id"], 16)
    graph.upsert_into(t, table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), 0)
    new = table(s, d, "customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))
    for run, part in enumerate(in_parts(new, "seq"), 1):
        graph.upsert_into(t, part, run, "seq")
    return t.read()


def dispatched(s, d):
    """Outcomes by topic of events that arrive as files of envelopes; errors are of no known type."""
    path = folder(s, "runs")
    kind = F.when(F.col("event_type") == "error", "Nothing").when(F.col("event_type") == "signup", "AlertRaised").otherwise("PolicyUpdated")
    payload = F.struct(*[F.lit("x").alias(f) for f in ("policy_id", "name", "version", "effective_at", "actor", "alert_id", "title", "message", "severity", "created_at")])
    envelope = F.struct(
        F.lit("6f1c1a9e-5b1f-4c68-9a53-0c6c2d1b7e11").alias("event_id"), kind.alias("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"), F.lit("s").alias("source"), F.lit("1.0.0").alias("version"), F.lit("r").alias("schema_ref"),
        F.sha2("props", 256).alias("content_hash"), F.concat(F.lit("key-"), F.col("user_id"), F.lit("-"), F.col("event_type")).alias("idempotency_key"), payload.alias("payload"),
    )
    table(s, d, "events").select(F.to_json(envelope).alias("value")).repartition(4).write.text(f"{path}/in")
    streams.dispatch(streams.inbox(s, f"{path}/in", 2), f"{path}/out", f"{path}/cp", buckets=8).awaitTermination()
    parts = [s.read.parquet(f"{path}/out/{o}").select(F.coalesce("topic", F.lit("none")).alias("topic"), F.lit(o).alias("outcome")) for o in ("done", "dup", "err")]
    out = reduce(DataFrame.unionByName, parts)
    return out.groupBy("topic").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("done", "dup", "err")])


def last_metrics(s, d):
    """Of a stream that reads the events in four batches."""
    path = folder(s, "runs")
    rows = table(s, d, "events").select("event_id", "value", (F.col("event_type") != "error").alias("ok"))
    rows.repartition(4).write.parquet(f"{path}/in")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streams.service_metrics(stream, lambda df: evaluation.service_metrics(df, "event_id", "value", passed="ok"), path, f"{path}/cp", "event_id").awaitTermination()
    return streams.latest_metrics(s, path).select("n", F.round("avg", 6).alias("avg"), "p95", F.round("pass_rate", 6).alias("pass_rate"), F.col("requests_total").cast("long").alias("requests_total"))


QUERIES = {"alert_dedupe_runs": deduped, "upsert_buckets": upserted, "stream_dispatch": dispatched, "stream_last_metrics": last_metrics}

ORACLES = {
    "alert_dedupe_runs": alert_plans.ORACLES["alert_dedupe_ttl"],
    "upsert_buckets": evidence.ORACLES["upsert_rows"],
    "stream_dispatch": """WITH e AS (SELECT CASE event_type WHEN 'error' THEN 'none' WHEN 'signup' THEN 'alert.raised' ELSE 'policy.updated' END AS topic, 'key-' || user_id || '-' || event_type AS k FROM events),
      n AS (SELECT topic, count(*) AS n, count(DISTINCT k) AS keys FROM e GROUP BY 1)
      SELECT topic, CASE WHEN topic = 'none' THEN 0 ELSE keys END AS done, CASE WHEN topic = 'none' THEN 0 ELSE n - keys END AS dup, CASE WHEN topic = 'none' THEN n ELSE 0 END AS err FROM n""",
    "stream_last_metrics": f"SELECT m.*, (SELECT count(*) FROM events) AS requests_total FROM ({retrieval.ORACLES['p95_nearest_rank']}) m",
}
