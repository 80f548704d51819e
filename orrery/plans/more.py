"""Further queries: investor ranking, labels, gates, links, metrics text."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import security, severity, text
from orrery.operators import bus, core, evaluation, evidence, geo, graph, portals, retrieval, series
from orrery.plans.evidence import _docs
from orrery.plans.retrieval import hits
from orrery.sources import sinks
from orrery.sources.adapters import ALERTS_SQL, INDEX_SQL, READINGS_SQL, alert_events, doc_index, readings, table


def investor_top(s, d):
    docs, found = _docs(s, d)
    counts = evidence.citation_counts(docs, found).select("doc_id", "clause_count")
    rows = docs.join(counts, "doc_id").filter("clause_count >= 1")
    score = portals.investor_score(F.col("clause_count"), F.col("published_at"), F.lit("2025-01-15").cast("date"))
    return rows.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


def permit_links(s, d):
    permits = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").cast("string").alias("reference_id"), F.when(F.col("o_orderkey") % 2 == 0, "old").alias("document_id"))
    documents = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("reference_id"), F.concat(F.lit("d"), F.col("c_custkey")).alias("id"))
    return core.link_documents(permits, documents)


def metric_lines(s, d):
    rows = table(s, d, "events").groupBy(F.concat(F.lit("n-"), "event_type").alias("name")).agg(F.count("*").alias("value"))
    return sinks.prometheus_lines(rows)


def ordered(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return retrieval.ordered_distinct(rows, "doc_id")


def severities(s, d):
    return alert_events(s, d).groupBy("severity").agg(F.max(severity.rank(F.col("severity"))).alias("rank"), F.max(severity.weight(F.col("severity"))).alias("weight"), F.count("*").alias("n"))


def nli_accepted(s, d):
    rows = table(s, d, "events").select("event_id", (F.col("event_id") % 101 / 100.0).cast("double").alias("entailment"), (F.col("event_id") % 37 / 100.0).cast("double").alias("contradiction"))
    return retrieval.accepted(rows).select("event_id")


def joined_clauses(s, d):
    return doc_index(s, d).select("doc_id", F.array_join(text.clause_classes(F.col("text"), {"a": "the", "b": "la|le", "c": "und"}), ",").alias("classes"))


def jaccard(s, d):
    asked = text.rag_tokens(F.lit("the and of it was"))
    return hits(s, d).select("pos", F.round(text.smoothed_jaccard(asked, text.rag_tokens(F.col("text"))), 9).alias("score"))


QUERIES = {
    "severity_ladder": severities,
    "investor_top10": investor_top,
    "news_labels": lambda s, d: portals.sentiment_counts(table(s, d, "events").select(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("sentiment"), F.when(F.col("event_id") % 2 == 0, "other").alias("label"))),
    "permit_links": permit_links,
    "metric_lines": metric_lines,
    "ordered_distinct": ordered,
    "nli_accepted": nli_accepted,
    "clause_classes": joined_clauses,
    "smoothed_jaccard": jaccard,
    "metric_first_int": lambda s, d: table(s, d, "events").select("event_id", evaluation.first_int(F.get_json_object("props", "$.none"), F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.get_json_object("props", "$.k"))).alias("n")),
    "insert_or_ignore": lambda s, d: graph.insert_or_ignore(table(s, d, "nation").select(F.col("n_nationkey").alias("k")), table(s, d, "customer").select((F.col("c_custkey") % 100).alias("k"), "c_custkey"), "k", "c_custkey"),
    "topic_counts": lambda s, d: table(s, d, "events").select(bus.topic(F.element_at(F.array(F.lit("AlertRaised"), F.lit("ProofIssued"), F.lit("Nothing")), (F.col("event_id") % 3 + 1).cast("int"))).alias("topic")).groupBy("topic").agg(F.count("*").alias("n")),
    "slugs": lambda s, d: table(s, d, "part").select("p_partkey", text.slug(F.concat(F.lit(" ++"), "p_name", F.lit(" / Part!"))).alias("slug")),
    "hash_to_int": lambda s, d: table(s, d, "customer").select("c_custkey", security.bounded_hash(F.col("c_name")).alias("n")),
    "mercator": lambda s, d: table(s, d, "supplier").select("s_suppkey", *[F.round(c, 3).alias(n) for n, c in zip("xy", geo.to_mercator((F.col("s_suppkey") % 340 - 170).cast("double"), (F.col("s_suppkey") % 120 - 59.5).cast("double")))]),
    "trailing_energy": lambda s, d: series.daily(readings(s, d)).groupBy("weekday").agg(F.round(F.avg("energy_kwh"), 6).alias("energy_kwh"), F.sum("obs").alias("obs")),
}

_W = f"WITH {INDEX_SQL}"
_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
ORACLES = {
    "severity_ladder": f"WITH {ALERTS_SQL} SELECT severity, max(rank) AS rank, max(weight) AS weight, count(*) AS n FROM ev JOIN rk USING (severity) GROUP BY 1",
    "investor_top10": f"""{_W}, n AS (SELECT doc_sha256, count(*) AS c FROM clauses GROUP BY 1) SELECT doc_id, round(3.0::DOUBLE * c + 2.0::DOUBLE * greatest(0, (365 - date_diff('day', published_at, DATE '2025-01-15')) / 365.0::DOUBLE), 6) AS score
      FROM doc_index JOIN n USING (doc_sha256) ORDER BY score DESC, doc_id LIMIT 10""",
    "news_labels": "SELECT CASE WHEN event_id % 3 <> 0 THEN event_type WHEN event_id % 2 = 0 THEN 'other' ELSE 'neutral' END AS label, count(*) AS n FROM events GROUP BY 1",
    "permit_links": "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS reference_id, CASE WHEN c_custkey IS NOT NULL THEN 'd' || c_custkey WHEN o_orderkey % 2 = 0 THEN 'old' END AS document_id FROM orders LEFT JOIN customer ON c_custkey = o_orderkey",
    "metric_lines": """WITH c AS (SELECT 'orrery_n_' || event_type AS name, count(*) AS n FROM events GROUP BY 1) SELECT '# HELP ' || name || ' pipeline metric' AS value FROM c UNION ALL SELECT '# TYPE ' || name || ' gauge' FROM c UNION ALL SELECT name || ' ' || n || '.000000' FROM c""",
    "ordered_distinct": "SELECT l_suppkey AS doc_id, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1 ORDER BY first",
    "nli_accepted": "SELECT event_id FROM events WHERE (event_id % 101) / 100.0 >= 0.55 AND (event_id % 37) / 100.0 <= 0.30",
    "clause_classes": f"""{_W}, b AS (SELECT doc_id, text, '(^|[^\\p{{L}}\\p{{N}}_])' AS l, '($|[^\\p{{L}}\\p{{N}}_])' AS r FROM doc_index)
      SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, l || '(?i:the)' || r) THEN 'a' END, CASE WHEN regexp_matches(text, l || '(?i:la|le)' || r) THEN 'b' END, CASE WHEN regexp_matches(text, l || '(?i:und)' || r) THEN 'c' END], lambda x: x IS NOT NULL), ',') AS classes FROM b""",
    "smoothed_jaccard": f"""WITH t AS (SELECT item_id AS pos, {_TOK.format('text')} AS k, ['the', 'and', 'of', 'it', 'was'] AS q FROM benchmark)
      SELECT pos, round(CASE WHEN len(k) = 0 THEN 0 ELSE (len(list_intersect(k, q)) + 0.5) / (len(list_distinct(list_concat(k, q))) + 0.5) END, 9) AS score FROM t""",
    "metric_first_int": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS n FROM events",
    "insert_or_ignore": "SELECT c_custkey % 100 AS k, min(c_custkey) AS c_custkey FROM customer WHERE c_custkey % 100 NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1",
    "topic_counts": "SELECT CASE event_id % 3 WHEN 0 THEN 'alert.raised' WHEN 1 THEN 'proof.issued' END AS topic, count(*) AS n FROM events GROUP BY 1",
    "slugs": r"""WITH a AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(' ++' || p_name || ' / Part!'), '[^a-z0-9]+', '.', 'g'), '^\.+|\.+$', '', 'g') AS s FROM part) SELECT p_partkey, regexp_replace(substr(s, 1, 48), '\.+$', '') AS slug FROM a""",
    "hash_to_int": "SELECT c_custkey, CAST('0x' || substr(md5(c_name), 25, 8) AS BIGINT) & 268435455 AS n FROM customer",
    "mercator": "SELECT s_suppkey, round(radians((s_suppkey % 340 - 170)::DOUBLE) * 6378137.0::DOUBLE, 3) AS x, round(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians((s_suppkey % 120 - 59.5)::DOUBLE) / 2)), 3) AS y FROM supplier",
    "trailing_energy": f"WITH {READINGS_SQL}, d AS (SELECT asset_id, CAST(timestamp AS DATE) AS date, sum(energy_kwh) AS e, count(*) AS o FROM readings GROUP BY ALL) SELECT CAST(isodow(date) - 1 AS INTEGER) AS weekday, round(avg(e), 6) AS energy_kwh, CAST(sum(o) AS BIGINT) AS obs FROM d GROUP BY 1",
}
