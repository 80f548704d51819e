"""Feature commitments, signed result bundles and their index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.security import COMMIT_DOMAIN, canonical_json, hmac_sha256

SEPARATOR = b"\x1f"
# What a failed check says.
WRONG_ID, WRONG_DECISION, WRONG_SIGNATURE = "bundle_id mismatch (recomputed != provided)", "decision mismatch (recomputed != provided)", "signature mismatch (HMAC invalid)"


def commitments(df: DataFrame, domain: str = COMMIT_DOMAIN, features: str = "features") -> DataFrame:
    """df with payload_json, payload_sha256 and commit_sha256 of (features, model_id, model_version, salt, precision).

    Canonical JSON writes numbers as Python does, so it is made in Arrow batches there;
    the hashes are built in.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    names = df.columns
    more = [c for c in ("model_id", "model_version", "salt") if c in names]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                p = int(r.get("precision") if r.get("precision") is not None else 6)
                payload = {"features": [round(float(x), p) for x in r[features]], "precision": p} | {c: r[c] for c in more if r[c] is not None}
                out.append(canonical_json(payload))
            yield pdf.assign(payload_json=out)

    made = df.mapInPandas(run, StructType([*df.schema.fields, StructField("payload_json", StringType())]))
    domained = F.concat(F.lit(domain), F.lit(SEPARATOR.decode()), "payload_json")
    return made.withColumns({"payload_sha256": F.sha2("payload_json", 256), "commit_sha256": F.sha2(domained, 256)})


def number_json(x: Column) -> Column:
    """A double as canonical JSON writes it: whole numbers keep their .0, exponents only below 1e-4 and from 1e16 on.

    The digits are the JVM's. Java before 19 may write one that is not the shortest, in rare
    values of 16 or 17 digits.
    """
    plain = x.cast("double").cast("string")
    part = lambda k: F.regexp_extract(plain, r"^(-?)(\d)\.(\d+)E(-?\d+)$", k)
    power = part(4).try_cast("int")
    rest = F.when(part(3) == "0", "").otherwise(part(3))
    digits, zeros = F.concat(part(2), rest), lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    point = F.length(rest) - power
    large = F.when(point <= 0, F.concat(digits, zeros(-point), F.lit(".0"))).otherwise(F.concat(F.left(digits, power + 1), F.lit("."), F.right(digits, point)))
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    short = F.concat(part(2), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), exponent)
    return F.when(power.isNull(), plain).otherwise(F.concat(part(1), F.when(power.between(7, 15), large).when(power == -4, F.concat(F.lit("0.000"), digits)).otherwise(short)))


def payload_json(version: bool = True) -> Column:
    """The canonical JSON of a bundle's signed part, keys in order; a null version is left out."""
    text = lambda c: F.substring(F.to_json(F.array(F.col(c))), F.lit(2), F.length(F.to_json(F.array(F.col(c)))) - 2)
    parts = [F.concat(F.lit('"feature_commit":'), text("feature_commit")), F.concat(F.lit('"model_id":'), text("model_id"))]
    if version:
        parts.append(F.when(F.col("model_version").isNotNull(), F.concat(F.lit('"model_version":'), text("model_version"))))
    parts += [F.concat(F.lit('"pdf_hash":'), text("pdf_hash")), F.concat(F.lit('"score":'), number_json(F.col("score"))), F.concat(F.lit('"threshold":'), number_json(F.col("threshold")))]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def decision() -> Column:
    return F.when(F.col("score") >= F.col("threshold"), "pass").otherwise("fail")


def _signed(payload: Column, secret: str, domain: str) -> Column:
    return F.lower(F.hex(hmac_sha256(secret.encode(), F.concat(F.lit(domain), F.lit(SEPARATOR.decode()), payload))))


def issue(requests: DataFrame, secret: str, domain: str = COMMIT_DOMAIN) -> DataFrame:
    """requests with bundle_id, signature and decision."""
    payload = payload_json("model_version" in requests.columns)
    return requests.withColumns({"bundle_id": F.sha2(payload, 256), "signature": _signed(payload, secret, domain), "decision": decision()})


def verify(bundles: DataFrame, secret: str, domain: str = COMMIT_DOMAIN) -> DataFrame:
    """bundles with reasons (what does not fit, in a fixed order) and valid."""
    payload = payload_json("model_version" in bundles.columns)
    differs = lambda c, want: ~F.coalesce(F.col(c) == want, F.lit(False))
    reasons = F.array_compact(
        F.array(F.when(differs("bundle_id", F.sha2(payload, 256)), WRONG_ID), F.when(differs("decision", decision()), WRONG_DECISION), F.when(differs("signature", _signed(payload, secret, domain)), WRONG_SIGNATURE))
    )
    return bundles.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


def latest(records: DataFrame, order: str, key: str = "bundle_id") -> DataFrame:
    """The last record of each key."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return records.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth")


def listed(index: DataFrame, model: str | None = None, verdict: str | None = None, text: str | None = None, offset: int = 0, most: int = 50) -> DataFrame:
    """A page of the index, newest first, with the number of all rows that fit as `total`.

    text is sought without case in the fields joined together, so it may span two of them.
    """
    rows = index
    if model is not None:
        rows = rows.filter(F.col("model_id") == model)
    if verdict is not None:
        rows = rows.filter(F.col("decision") == verdict)
    if text:
        fields = [F.coalesce(c, F.lit("")) for c in ("bundle_id", "pdf_hash", "feature_commit", "model_id")]
        rows = rows.filter(F.lower(F.concat(*fields)).contains(text.lower()))
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("issued_at"), F.desc("bundle_id")).offset(offset).limit(most)
    return page.join(F.broadcast(total), F.lit(True))  # one row


