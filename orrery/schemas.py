"""Schemas of the domain as DDL; geometry is WKT text, open documents are variants."""

from __future__ import annotations

from pyspark.sql import DataFrame

# The ten tables of the relational core.
CORE = {
    "organization": "id string, name string, org_type string, country_code string, created_at timestamp",
    "asset": "id string, name string, kind string, status string, owner_org_id string, centroid string, footprint string, address string, city string, region string, country_code string, created_at timestamp, updated_at timestamp",
    "document": "id string, title string, source string, lang string, url string, storage_path string, doc_sha256 string, doc_date date, ingested_at timestamp",
    "policy_clause": "id string, document_id string, clause_ref string, jurisdiction string, theme string, clause_text string, clause_hash string",
    "permit": "id string, asset_id string, org_id string, permit_type string, status string, issue_date date, expiry_date date, document_id string, reference_id string, geom string",
    "satellite_tile": "id string, asset_id string, aoi_name string, capture_date date, sensor string, path string, cloud_cover float, footprint string, band_summary variant",
    "iot_stream": "id string, asset_id string, stream_name string, unit string, started_at timestamp, ended_at timestamp, location string, meta variant",
    "event": "id string, event_key string, event_type string, asset_id string, related_document_id string, occurred_at timestamp, payload variant, created_at timestamp",
    "rule": "id string, rule_code string, name string, description string, severity short, version string, definition variant, target_selector variant, created_at timestamp",
    "proof_bundle": "id string, asset_id string, rule_id string, event_id string, document_id string, status string, proof_hash string, evidence_url string, meta variant, created_at timestamp",
}
# What must be unique and what must hold, by table.
UNIQUE = {"document": ("doc_sha256",), "event": ("event_key",), "rule": ("rule_code",)}
CHECKS = {"rule": {"severity": "severity IS NULL OR severity BETWEEN 1 AND 5"}, "satellite_tile": {"cloud cover": "cloud_cover IS NULL OR cloud_cover BETWEEN 0 AND 100"}}
# Document tables.
DOCUMENTS = {
    "doc_pages": "doc_id string, doc_path string, source string, page int, text string, lang string, doc_sha256 string, words int, extractor string",
    "doc_chunks": "doc_id string, doc_path string, source string, doc_sha256 string, chunk_index int, text string, lang string, n_words int, n_sentences int, page_start int, page_end int",
    "doc_entities": "doc_sha256 string, doc_id string, doc_path string, source string, page int, span_start int, span_end int, text string, label string, lang string, extractor string",
    "doc_clauses": "doc_sha256 string, doc_id string, doc_path string, source string, page int, clause_type string, span_start int, span_end int, text string, lang string, pattern string",
}


def broken(table: str, df: DataFrame) -> DataFrame:
    """(rule, n): constraints of a core table that its rows break."""
    from orrery.operators.graph import violations

    if not UNIQUE.get(table) and not CHECKS.get(table):
        return df.sparkSession.createDataFrame([], "rule string, n long")
    return violations(df, UNIQUE.get(table, ()), CHECKS.get(table))
