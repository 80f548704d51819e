"""Event envelopes: contracts, routing, idempotent ingest, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.config import TOPICS

# Fields of the envelope and of each payload, with their patterns and least lengths.
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
ENVELOPE = {
    "event_id": UUID,
    "event_type": "^(" + "|".join(TOPICS) + ")$",
    "occurred_at": ".+",
    "source": ".+",
    "version": r"^[0-9]+\.[0-9]+\.[0-9]+$",
    "schema_ref": ".+",
    "content_hash": "^[0-9a-f]{64}$",
    "idempotency_key": "^.{8,}$",
}
PAYLOADS = {
    "DocumentIngested": ("doc_id", "uri", "title", "lang", "checksum_sha256", "bytes", "mime_type", "indexed_at"),
    "TileFetched": ("tile_id", "aoi_id", "satellite", "sensed_at", "bands", "url", "checksum_sha256"),
    "PolicyUpdated": ("policy_id", "name", "version", "effective_at", "actor"),
    "ViolationFlagged": ("violation_id", "policy_id", "subject_id", "severity", "description", "first_seen"),
    "ProofIssued": ("proof_id", "subject_id", "policy_id", "proof_type", "proof_uri", "issued_at", "issuer", "hash"),
    "AlertRaised": ("alert_id", "title", "message", "severity", "created_at"),
}
OPTIONAL = ("trace_id", "payload")


def errors(raw: str = "value") -> Column:
    """What is wrong with a JSON envelope, as an array; empty if nothing is. An unknown type is an error like others.

    The envelope's fields are read once and bound as one struct; of payloads only the fields of the event's type are read.
    """
    get = lambda p: F.get_json_object(raw, p)
    read = F.struct(*[get(f"$.{name}").alias(name) for name in ENVELOPE], F.json_object_keys(raw).alias("keys"), F.try_parse_json(F.col(raw)).isNull().alias("broken"), get("$.payload.cloud_cover").try_cast("double").alias("cloud"))

    def tests(x: Column) -> Column:
        keys, cloud = x["keys"], x["cloud"]
        found = [F.when(x["broken"] | keys.isNull(), "not an object")]
        for name, pattern in ENVELOPE.items():
            found.append(F.when(x[name].isNull(), f"{name} is missing").when(~x[name].rlike(pattern), f"{name} does not fit"))
        known = F.array(*[F.lit(k) for k in (*ENVELOPE, *OPTIONAL)])
        found.append(F.when(F.size(F.array_except(keys, known)) > 0, "unknown field"))
        of_kind = F.array().cast("array<string>")
        for kind, fields in PAYLOADS.items():
            of_kind = F.when(x["event_type"] == kind, F.array(*[F.when(get(f"$.payload.{f}").isNull(), f"payload.{f} is missing") for f in fields])).otherwise(of_kind)
        return F.array_compact(F.concat(F.array(*found), of_kind, F.array(F.when((cloud < 0) | (cloud > 1), "payload.cloud_cover is out of range"))))

    return F.transform(F.array(read), tests)[0]


def topic(event_type: Column) -> Column:
    """The topic of an event type; unknown: null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TOPICS.items() for x in kv]), event_type)


def ingest(seen: DataFrame | None, arrivals: DataFrame, key: str = "idempotency_key", order: str = "arrival", fails: Column | None = None) -> DataFrame:
    """arrivals with outcome: err, dup (the key was seen, or came earlier) or done. The first arrival of a key wins."""
    bad = (F.coalesce(fails, F.lit(False)) if fails is not None else F.lit(False)) | F.col(key).isNull()
    good = arrivals.filter(~bad).withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    known = F.lit(False)
    if seen is not None:
        good = good.join(seen.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
        known = F.coalesce("known", F.lit(False))
    good = good.withColumn("outcome", F.when(known | (F.col("nth") > 1), "dup").otherwise("done"))
    return good.select(*arrivals.columns, "outcome").unionByName(arrivals.filter(bad).withColumn("outcome", F.lit("err")))


def within(start: str | None, end: str | None, column: str = "occurred_at") -> Column:
    """start <= time < end; a time that cannot be read never fits, whatever the bounds."""
    t = F.col(column).cast("string").try_cast("timestamp")
    test = t.isNotNull()
    if start:
        test &= t >= F.lit(start).cast("timestamp")
    if end:
        test &= t < F.lit(end).cast("timestamp")
    return F.coalesce(test, F.lit(False))


def replay(events: DataFrame, start: str | None = None, end: str | None = None, topics: tuple[str, ...] = (), most: int = 0, order: str = "occurred_at", tie: str = "idempotency_key") -> DataFrame:
    """Past events in order, keys unchanged, so that ingesting them again finds duplicates."""
    rows = events.filter(within(start, end))
    if topics:
        rows = rows.filter(F.col("topic").isin(*topics))
    rows = rows.orderBy(order, tie)
    return rows.limit(most) if most > 0 else rows
