"""Queries on evidence, graph and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import evidence, graph, rules
from orrery.sources.adapters import ALERTS_SQL, INDEX_SQL, TEST_KEYWORDS, alert_events, assets, doc_index, table

AS_OF = "2025-01-15"


def _docs(s, d):
    docs = doc_index(s, d)
    return docs, evidence.clauses(docs, TEST_KEYWORDS)


def citation_override(s, d):
    docs, found = _docs(s, d)
    given = docs.filter("doc_id % 10 = 0").dropDuplicates(["doc_sha256"]).select("doc_sha256", F.lit(9).alias("citation_count"))
    return evidence.citation_counts(docs, found, given)


def current(keep_undated):
    def query(s, d):
        docs, found = _docs(s, d)
        docs = docs.withColumn("published_at", F.when(F.col("doc_id") % 11 != 0, F.col("published_at")))
        return evidence.current_events(docs, assets(s, d), found, F.lit(AS_OF).cast("date"), 60, keep_undated)

    return query


def fetched(s, d):
    docs, found = _docs(s, d)
    return evidence.evidence(docs, found, 7, F.lit(AS_OF).cast("date"), 365, True, 20)


def core(s, d):
    """The driver's tables as the core schema."""
    orders, customers = table(s, d, "orders"), table(s, d, "customer")
    key = F.col("p_partkey")
    return {
        "organization": customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "asset": table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 500).alias("owner_org_id")),
        "event": orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 300).alias("asset_id"), F.col("o_custkey").alias("related_document_id"), F.col("o_orderstatus").alias("event_key")),
        "document": table(s, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("title")),
        "permit": table(s, d, "part").select(key.alias("id"), F.col("p_name").alias("reference_id"), (key % 300).alias("asset_id"), (key % 700).alias("org_id"), (key % 900).alias("document_id")),
    }


RULES = [
    {"meta": {"id": "big_critical", "version": 1, "status": "active"}, "severity": "high", "scope": {"assets": ["*"]}, "trigger": {"type": "event", "match": {"event.topic": "sat.change"}},
     "conditions": {"aggregator": "all", "clauses": [{"path": "event.value", "op": "gt", "value": 60}, {"path": "event.severity", "op": "in", "value": ["high", "critical"]}]}},
    {"meta": {"id": "no_area", "version": 2, "status": "deprecated"}, "severity": "low", "scope": {"assets": ["asset_3", "asset_4"]}, "trigger": {"type": "schedule"},
     "conditions": {"aggregator": "any", "clauses": [{"path": "aoi", "op": "exists"}, {"path": "event.rule", "op": "regex", "value": "^water"}, {"path": "event.missing", "op": "eq", "value": 1}]}},
    {"meta": {"id": "proposed", "version": 1, "status": "proposed"}, "severity": "low", "trigger": {"type": "schedule"}, "conditions": {"clauses": []}},
    {"meta": {"id": "loose", "version": 1, "status": "active"}, "severity": "medium", "trigger": {"type": "event", "match": {"event.ack": 1}},
     "conditions": {"clauses": [{"path": "event.missing", "op": "neq", "value": "x"}, {"path": "event.severity", "op": "lt", "value": 5}]}},
]


def enforced(s, d):
    rows = alert_events(s, d).select("id", "asset_id", F.to_json(F.struct("topic", "severity", F.col("rule_type").alias("rule"), F.col("aoi_id").alias("aoi"), F.col("acknowledged").alias("ack"), (F.element_at("delta", "ndvi") * 100).alias("value"))).alias("event"))
    out = rules.enforce(rows, [rules.compiled(r) for r in RULES])
    return out.select("id", "asset_id", "rule_id", "rule_severity", F.size(F.filter("evidence", lambda e: e["ok"])).alias("n_ok"))


def dated(query):
    """query with its publication date as text."""
    return lambda s, d: query(s, d).withColumn("published_at", F.col("published_at").cast("string"))


QUERIES = {
    "citation_counts": lambda s, d: evidence.citation_counts(*_docs(s, d)),
    "citation_override": citation_override,
    "clause_counts": lambda s, d: evidence.clause_counts(_docs(s, d)[1]),
    "docs_with_assets": dated(lambda s, d: evidence.docs_with_assets(doc_index(s, d), assets(s, d))),
    "evidence_events": dated(current(False)),
    "evidence_events_undated": dated(current(True)),
    "evidence_fetch": dated(fetched),
    "kg_edges": lambda s, d: evidence.kg_edges(*_docs(s, d)),
    "proof_bundle_ids": lambda s, d: evidence.bundle_ids(doc_index(s, d)),
    "distinct_assets": lambda s, d: doc_index(s, d).agg(F.count_distinct("asset_id").alias("n"), F.count("*").alias("docs")),
    "kg_nodes": lambda s, d: graph.nodes(core(s, d)),
    "kg_node_edges": lambda s, d: graph.edges(core(s, d)),
    "permit_round_robin": lambda s, d: graph.round_robin(table(s, d, "supplier").select("s_suppkey", "s_name"), ["c", "a", "b"], "s_name"),
    "upsert_rows": lambda s, d: graph.upsert(core(s, d)["asset"].select("id", "name"), table(s, d, "customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq")), ["id"], "seq"),
    "unique_violations": lambda s, d: graph.violations(table(s, d, "customer"), ["c_nationkey"], {"balance": "c_acctbal >= 0"}),
    "rule_enforce": enforced,
}

_W = f"WITH {INDEX_SQL}"
_CURRENT = """ , docs AS (SELECT * REPLACE (CASE WHEN doc_id % 11 <> 0 THEN published_at END AS published_at) FROM doc_index), n AS (SELECT doc_sha256, count(*) AS c FROM clauses GROUP BY 1)
 SELECT d.asset_id, a.name, d.doc_sha256, d.doc_id, d.title, CAST(d.published_at AS VARCHAR) AS published_at, coalesce(c, 0) AS citation_count, coalesce(c, 0) >= 2 AS has_min_citations
 FROM docs d JOIN assets a USING (asset_id) LEFT JOIN n USING (doc_sha256) WHERE d.published_at >= DATE '2025-01-15' - 60"""
ORACLES = {
    "citation_counts": f"{_W} SELECT d.doc_sha256, d.doc_id, coalesce(n.c, 0) AS clause_count FROM doc_index d LEFT JOIN (SELECT doc_sha256, count(*) AS c FROM clauses GROUP BY 1) n USING (doc_sha256)",
    "citation_override": f"""{_W}, o AS (SELECT DISTINCT doc_sha256 FROM doc_index WHERE doc_id % 10 = 0) SELECT d.doc_sha256, d.doc_id, CASE WHEN o.doc_sha256 IS NOT NULL THEN 9 ELSE coalesce(n.c, 0) END AS clause_count
      FROM doc_index d LEFT JOIN (SELECT doc_sha256, count(*) AS c FROM clauses GROUP BY 1) n USING (doc_sha256) LEFT JOIN o USING (doc_sha256)""",
    "clause_counts": f"{_W} SELECT doc_sha256, count(*) AS clause_count FROM clauses GROUP BY 1",
    "docs_with_assets": f"{_W} SELECT doc_sha256, doc_id, asset_id, name, title, source, lang, CAST(published_at AS VARCHAR) AS published_at FROM doc_index JOIN assets USING (asset_id)",
    "evidence_events": _W + _CURRENT,
    "evidence_events_undated": _W + _CURRENT + " OR d.published_at IS NULL",
    "evidence_fetch": f"""{_W}, n AS (SELECT doc_sha256, count(*) AS c FROM clauses GROUP BY 1) SELECT doc_sha256, doc_id, title, CAST(x.published_at AS VARCHAR) AS published_at, coalesce(c, 0) AS citation_count FROM doc_index x LEFT JOIN n USING (doc_sha256)
      WHERE asset_id = 7 AND x.published_at >= DATE '2025-01-15' - 365 AND coalesce(c, 0) >= 2 ORDER BY x.published_at DESC NULLS LAST, doc_id LIMIT 20""",
    "kg_edges": f"""{_W} SELECT md5(doc_sha256 || ':' || clause_type || ':' || page) AS edge_id, 'asset' AS src_type, CAST(asset_id AS VARCHAR) AS src_id, CASE clause_type WHEN 'operational' THEN 'operation' ELSE clause_type END AS dst_type,
      md5(clause_type || ':' || c.text) AS dst_id, clause_type AS label, 0.7::DOUBLE AS weight, doc_sha256 FROM clauses c JOIN doc_index USING (doc_sha256)""",
    "proof_bundle_ids": f"{_W} SELECT doc_sha256, doc_id, 'pb-' || substr(md5(doc_sha256), 1, 12) AS bundle_id FROM doc_index",
    "distinct_assets": f"{_W} SELECT count(DISTINCT asset_id) AS n, count(*) AS docs FROM doc_index",
    "kg_nodes": """SELECT 'organization:' || c_custkey AS node, 'organization' AS entity, c_name AS name FROM customer UNION ALL SELECT 'asset:' || s_suppkey, 'asset', s_name FROM supplier
      UNION ALL SELECT 'event:' || o_orderkey, 'event', o_orderstatus FROM orders UNION ALL SELECT 'document:' || doc_id, 'document', CASE WHEN doc_id % 5 <> 0 THEN coalesce(source, '') ELSE '' END FROM documents
      UNION ALL SELECT 'permit:' || p_partkey, 'permit', p_name FROM part""",
    "kg_node_edges": """SELECT 'asset:' || s_suppkey AS src, 'organization:' || c_custkey AS dst, 'owned_by' AS rel FROM supplier JOIN customer ON s_suppkey % 500 = c_custkey
      UNION ALL SELECT 'event:' || o_orderkey, 'asset:' || s_suppkey, 'about' FROM orders JOIN supplier ON o_orderkey % 300 = s_suppkey
      UNION ALL SELECT 'event:' || o_orderkey, 'document:' || doc_id, 'refers_to' FROM orders JOIN documents ON o_custkey = doc_id
      UNION ALL SELECT 'permit:' || p_partkey, 'asset:' || s_suppkey, 'applies_to' FROM part JOIN supplier ON p_partkey % 300 = s_suppkey
      UNION ALL SELECT 'permit:' || p_partkey, 'organization:' || c_custkey, 'issued_by' FROM part JOIN customer ON p_partkey % 700 = c_custkey
      UNION ALL SELECT 'permit:' || p_partkey, 'document:' || doc_id, 'document' FROM part JOIN documents ON p_partkey % 900 = doc_id""",
    "permit_round_robin": "SELECT s_suppkey, s_name, ['a', 'b', 'c'][(row_number() OVER (ORDER BY s_name) - 1) % 3 + 1] AS dealt_to FROM supplier",
    "upsert_rows": "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey * 2 FROM customer) UNION ALL SELECT c_custkey * 2, c_name FROM customer",
    "unique_violations": """SELECT 'unique c_nationkey' AS rule, CAST(sum(n) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1) UNION ALL SELECT 'balance', count(*) FROM customer WHERE NOT c_acctbal >= 0""",
    "rule_enforce": f"""WITH {ALERTS_SQL}, t AS (SELECT *, ndvi * 100 AS v FROM ev) SELECT id, asset_id, 'big_critical' AS rule_id, 'high' AS rule_severity, 2 AS n_ok FROM t WHERE topic = 'sat.change' AND v > 60 AND severity IN ('high', 'critical')
      UNION ALL SELECT id, asset_id, 'no_area', 'low', CAST(aoi_id IS NOT NULL AS INTEGER) + CAST(rule_type = 'water_breach' AS INTEGER) FROM t WHERE asset_id IN ('asset_3', 'asset_4') AND (aoi_id IS NOT NULL OR rule_type = 'water_breach')""",
}
