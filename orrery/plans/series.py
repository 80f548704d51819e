"""Queries on series, rasters, geometry, bundles and the bus."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import bus, geo, proof, raster, series, tiles
from orrery.sources.adapters import READINGS_SQL, readings, table

POLICY = "2024-01-15"
#: Pixels along a tile of the queries: less than the images have, so that components pass from tile to tile.
TILE = 32


def daily(s, d):
    return series.daily(readings(s, d))


def dates(s, d):
    given = s.createDataFrame([("asset_1", POLICY), ("asset_2", "2024-01-10")], "asset_id string, policy_start_date string")
    return series.policy_dates(daily(s, d), given)


def fixed_dates(s, d):
    return daily(s, d).select("asset_id", F.lit(POLICY).cast("date").alias("policy_date")).distinct()


def text_dates(query):
    def run(s, d):
        df = query(s, d)
        return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})

    return run


def pivot(s, d):
    rows = readings(s, d).select("timestamp", "asset_id", F.explode(F.array(F.struct(F.lit("kwh").alias("metric"), F.col("energy_kwh").alias("value")), F.struct(F.lit("temperature").alias("metric"), F.col("temp_c").alias("value")))).alias("x")).select("timestamp", "asset_id", "x.*")
    out = series.pivoted(rows.withColumn("timestamp", F.date_trunc("hour", "timestamp")))
    return out.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "asset_id", F.round("energy_kwh", 6).alias("energy_kwh"), F.round("temp_c", 6).alias("temp_c"))


def ols(s, d):
    rows = series.design(daily(s, d), fixed_dates(s, d))
    return rows, series.regression(series.normal_sums(rows))


def scm_sums(s, d):
    sums = series.normal_sums(ols(s, d)[0])
    return sums.select("asset_id", "n", *[F.round(c, 6).alias(c) for c in sums.columns if c not in ("asset_id", "n")])


def what_if(s, d):
    rows, fits = ols(s, d)
    return series.what_if(rows, fits).groupBy("asset_id").agg(F.round(F.sum("effect"), 4).alias("effect"), F.round(F.sum("effect_co2"), 4).alias("effect_co2"))


#: Pixels above this percentile of an image's scores are its mask.
CUT = 40.0


def pixels(s, d):
    """Two bands before and after of three areas: vectors as rows of an image, their components as columns; a pixel's values are its component and the three to the right of it, as reflectances."""
    x = table(s, d, "embeddings").select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("n")).select("vec_id", "v", "n", F.posexplode("v").alias("col", "x"))
    value = lambda band, timing, k, base: F.struct(F.lit(band).alias("band"), F.lit(timing).alias("timing"), (base + 1000 * (F.get("v", F.pmod(F.col("col") + k, F.col("n"))) + 1)).alias("value"))
    bands = F.array(value("B4", "before", 0, 2000.0), value("B8", "before", 1, 4000.0), value("B4", "after", 2, 2000.0), value("B8", "after", 3, 4000.0))
    return x.select(F.concat(F.lit("aoi_"), F.col("vec_id") % 3).alias("aoi_id"), F.expr("cast(vec_id div 3 AS int)").alias("row"), "col", F.explode(bands).alias("x")).select("aoi_id", "row", "col", "x.*")


def change(s, d):
    return raster.masked(raster.ndvi_difference(raster.scaled(pixels(s, d)), "abs").drop("diff"), CUT)


def bundles(s, d):
    return table(s, d, "orders").select(
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("pdf_hash"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("feature_commit"), F.col("o_totalprice").cast("double").alias("score"), F.lit(150000.0).alias("threshold"),
        F.col("o_orderpriority").alias("model_id"), F.when(F.col("o_orderkey") % 3 != 0, "v1").alias("model_version"), F.col("o_orderdate").cast("string").alias("issued_at"),
    )


def verified(s, d):
    out = proof.issue(bundles(s, d), "secret")
    spoilt = out.withColumns({"decision": F.when(F.col("bundle_id") < "3", "fail").otherwise(F.col("decision")), "signature": F.when(F.substring("bundle_id", 2, 1) < "3", "00").otherwise(F.col("signature"))})
    return proof.verify(spoilt, "secret").groupBy(F.array_join("reasons", "; ").alias("reasons"), "valid").agg(F.count("*").alias("n"))


def arrivals(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("arrival"), F.concat(F.lit("key-"), F.col("user_id"), F.lit("-"), F.col("event_type")).alias("idempotency_key"), F.col("event_type").alias("topic"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"))


def ingested(s, d):
    seen = table(s, d, "events").filter("event_id % 50 = 0").select(F.concat(F.lit("key-"), F.col("user_id") + 100, F.lit("-"), F.col("event_type")).alias("idempotency_key"))
    return bus.ingest(seen, arrivals(s, d), fails=F.col("topic") == "error").select("arrival", "outcome")


def contracts(s, d):
    raw = table(s, d, "events").select("event_id", F.to_json(F.struct(
        F.when(F.col("event_id") % 4 != 0, F.lit("6f1c1a9e-5b1f-4c68-9a53-0c6c2d1b7e11")).alias("event_id"), F.element_at(F.array(F.lit("PolicyUpdated"), F.lit("Nothing")), (F.col("event_id") % 2 + 1).cast("int")).alias("event_type"), F.col("ts").cast("string").alias("occurred_at"),
        F.lit("s").alias("source"), F.lit("1.0.0").alias("version"), F.lit("r").alias("schema_ref"), F.sha2("props", 256).alias("content_hash"), F.when(F.col("event_id") % 3 == 0, "short").otherwise("long-enough").alias("idempotency_key"),
        F.struct(F.lit("p").alias("policy_id"), F.lit("n").alias("name"), F.lit("1").alias("version"), F.lit("t").alias("effective_at"), F.when(F.col("event_id") % 5 != 0, "a").alias("actor")).alias("payload"))).alias("value"))
    return raw.select("event_id", F.array_join(bus.errors(), "; ").alias("errors"))


def rings(s, d):
    rows = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 340 - 170).cast("double").alias("lon"), (F.col("s_suppkey") % 120 - 60).cast("double").alias("lat"))
    ring = rows.withColumn("ring", geo.buffer(F.col("lon"), F.col("lat")))
    c = geo.centroid(F.col("ring"))
    return ring.select("id", F.size("ring").alias("corners"), geo.is_valid(F.col("ring")).alias("valid"), (F.abs(c[0] - F.col("lon")) < 1e-3).alias("centred"))


#: Corners of a buffer that its query tells, counted from the east in steps of 11.25 degrees.
CORNERS = (0, 3, 8, 21)


def corners(s, d):
    """Some corners of the buffers around points from all latitudes."""
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3400 / 10.0 - 170).alias("lon"), (F.col("c_custkey") % 1580 / 10.0 - 79).alias("lat"))
    ring = rows.withColumn("ring", geo.buffer(F.col("lon"), F.col("lat")))
    return ring.select("id", *[F.round(F.col("ring")[k][j], 7).alias(f"{name}{k}") for k in CORNERS for j, name in enumerate(("lon", "lat"))])


def boxes(s, d):
    rows = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 50).alias("r0"), (F.col("s_suppkey") % 30).alias("c0"))
    bbox = F.array(*[F.lit(x) for x in (54.4, 24.3, 54.6, 24.6)])
    ring = geo.pixel_ring(F.col("r0"), F.col("c0"), F.col("r0") + 20, F.col("c0") + 10, F.lit(64), F.lit(64), bbox)
    return rows.select("id", *[F.round(ring[k][j], 9).alias(f"{'xy'[j]}{k}") for k in (0, 2) for j in (0, 1)], F.round(geo.area_km2(F.array(ring[0][0], ring[2][1], ring[2][0], ring[0][1])), 6).alias("km2"))


def commitments(s, d):
    rows = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.lit("m").alias("model_id"), F.lit(4).alias("precision"))
    return proof.commitments(rows).select("vec_id", "payload_sha256", "commit_sha256")


QUERIES = {
    "iot_daily": text_dates(lambda s, d: daily(s, d).withColumns({c: F.round(c, 6) for c in ("energy_kwh", "temp_c", "co2_kg")})),
    "iot_pivot": pivot,
    "iot_window": text_dates(lambda s, d: series.within(daily(s, d), [("2024-01-03", "2024-01-06"), ("2024-01-20", None)]).select("asset_id", "date", "obs")),
    "policy_dates": text_dates(dates),
    "effect_fallback": text_dates(lambda s, d: series.effect(daily(s, d), dates(s, d), min_pre_days=7).select("asset_id", "policy_date", "pre_days", "post_days", *[F.round(c, 6).alias(c) for c in ("yhat", "avg_effect", "cum_effect")], "used_fallback")),
    "effect_structural": lambda s, d: series.effect_summary(series.structural_effect(daily(s, d), fixed_dates(s, d), min_pre_days=7)),
    "series_filled": text_dates(lambda s, d: series.filled(daily(s, d).withColumn("temp_c", F.when(F.col("obs") % 3 != 0, F.round("temp_c", 6))), ["temp_c"]).select("asset_id", "date", "temp_c")),
    "scm_ols_sums": scm_sums,
    "scm_what_if": what_if,
    "ndvi_change": lambda s, d: raster.difference(raster.ndvi(raster.scaled(pixels(s, d))), "neg").select("aoi_id", "row", "col", F.round("diff", 9).alias("diff"), F.round("score", 9).alias("score")),
    "percentile_mask": lambda s, d: raster.change_metrics(change(s, d)).withColumn("changed_frac", F.round("changed_frac", 9)),
    "raster_grey": lambda s, d: raster.grey(raster.scaled(pixels(s, d)), ("B4", "B8", "none")).withColumn("value", F.round("value", 9)),
    "raster_cleaned": lambda s, d: raster.change_metrics(tiles.cleaned(change(s, d).select("aoi_id", "row", "col", "mask"), 1, 1, 6, side=TILE)),
    "raster_components": lambda s, d: raster.boxes(tiles.labelled(tiles.cleaned_tiles(change(s, d).select("aoi_id", "row", "col", "mask"), 1, 1, 6, side=TILE), side=TILE)),
    "change_events": lambda s, d: raster.change_events(raster.change_metrics(change(s, d)), "2024-03-15").withColumn("score", F.round("score", 9)),
    "geo_buffer": rings,
    "geo_buffer_corners": corners,
    "geo_pixel_boxes": boxes,
    "bundle_issue": lambda s, d: proof.issue(bundles(s, d), "secret").select("pdf_hash", "bundle_id", "signature", "decision"),
    "bundle_verify": verified,
    "bundle_list": lambda s, d: proof.listed(proof.issue(bundles(s, d), "secret"), verdict="pass", text="urgent", offset=5, most=20).select("pdf_hash", "model_id", "issued_at", "total"),
    "feature_commit": commitments,
    "idempotent_ingest": ingested,
    "replay_window": lambda s, d: bus.replay(arrivals(s, d), "2024-01-05", "2024-01-06", ("click", "signup"), 100),
    "contract_errors": contracts,
}

_R = f"WITH {READINGS_SQL}, daily AS (SELECT asset_id, CAST(timestamp AS DATE) AS date, coalesce(sum(energy_kwh), 0) AS energy_kwh, avg(temp_c) AS temp_c, count(*) AS obs, CAST(isodow(CAST(timestamp AS DATE)) - 1 AS INTEGER) AS weekday FROM readings GROUP BY ALL)"
_DATES = ", dates AS (SELECT asset_id, coalesce(CASE asset_id WHEN 'asset_1' THEN DATE '2024-01-15' WHEN 'asset_2' THEN DATE '2024-01-10' END, (list_sort(list(DISTINCT date)))[count(DISTINCT date) // 2 + 1]) AS policy_date FROM daily GROUP BY 1)"
_X = ", x AS (SELECT asset_id, energy_kwh AS y, 1.0::DOUBLE AS one, temp_c AS temp, CASE WHEN weekday >= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS weekend, CASE WHEN date >= DATE '2024-01-15' THEN 1.0 ELSE 0.0 END::DOUBLE AS policy FROM daily)"
_PAIRS = [(a, b) for i, a in enumerate(series.TERMS) for b in series.TERMS[i:]] + [(a, "y") for a in series.TERMS] + [("y", "y")]
_BAND = lambda k, base: f"({base} + 1000 * (v[(col + {k}) % len(v) + 1] + 1)) / 10000"
_PIXELS = f"""WITH g AS (SELECT vec_id, embedding::DOUBLE[] AS v, CAST(unnest(range(len(embedding))) AS INTEGER) AS col FROM embeddings),
 p AS (SELECT 'aoi_' || vec_id % 3 AS aoi_id, CAST(vec_id // 3 AS INTEGER) AS row, col, {_BAND(0, "2000.0::DOUBLE")} AS r0, {_BAND(1, "4000.0::DOUBLE")} AS n0, {_BAND(2, "2000.0::DOUBLE")} AS r1, {_BAND(3, "4000.0::DOUBLE")} AS n1 FROM g),
 dif AS (SELECT aoi_id, row, col, (n1 - r1) / greatest(n1 + r1, 1e-6) - (n0 - r0) / greatest(n0 + r0, 1e-6) AS diff FROM p), sc AS (SELECT *, least(greatest(-diff, 0), 1) AS neg, abs(diff) AS score FROM dif)"""
_MASK = ", th AS (SELECT aoi_id, quantile_cont(score, 0.4) AS t FROM sc GROUP BY 1), m AS (SELECT aoi_id, CAST(sum(CASE WHEN score >= t THEN 1 ELSE 0 END) AS BIGINT) AS changed, count(*) AS total FROM sc JOIN th USING (aoi_id) GROUP BY 1)"
_AROUND = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) d(dr, dc)"
_SHRUNK = f"SELECT aoi_id, row + dr AS row, col + dc AS col FROM {{0}}, {_AROUND} GROUP BY ALL HAVING count(*) = 5"
_GROWN = f"SELECT DISTINCT aoi_id, m.row + dr AS row, m.col + dc AS col FROM {{0}} m JOIN ends USING (aoi_id), {_AROUND} WHERE m.row + dr BETWEEN 0 AND bottom AND m.col + dc BETWEEN 0 AND edge"
# The mask opened and closed once, without holes and without components below 6 pixels; seed: a component's first pixel.
_CLEANED = f"""{_PIXELS.replace('WITH ', 'WITH RECURSIVE ', 1)}{_MASK}, ends AS (SELECT aoi_id, max(row) AS bottom, max(col) AS edge FROM sc GROUP BY 1), m0 AS (SELECT aoi_id, row, col FROM sc JOIN th USING (aoi_id) WHERE score >= t),
 m1 AS ({_SHRUNK.format('m0')}), m2 AS ({_GROWN.format('m1')}), m3 AS ({_GROWN.format('m2')}), m4 AS ({_SHRUNK.format('m3')}),
 back AS (SELECT aoi_id, row, col FROM sc ANTI JOIN m4 USING (aoi_id, row, col)),
 flood AS (SELECT back.* FROM back JOIN ends USING (aoi_id) WHERE row IN (0, bottom) OR col IN (0, edge) UNION SELECT back.* FROM flood, {_AROUND}, back WHERE back.aoi_id = flood.aoi_id AND back.row = flood.row + dr AND back.col = flood.col + dc),
 m5 AS (SELECT aoi_id, row, col FROM sc ANTI JOIN flood USING (aoi_id, row, col)),
 reach AS (SELECT *, row * 65536 + col AS seed FROM m5 UNION SELECT m5.*, seed FROM reach, {_AROUND}, m5 WHERE m5.aoi_id = reach.aoi_id AND m5.row = reach.row + dr AND m5.col = reach.col + dc),
 own AS (SELECT aoi_id, row, col, min(seed) AS seed FROM reach GROUP BY ALL), clean AS (SELECT *, count(*) OVER (PARTITION BY aoi_id, seed) AS area FROM own QUALIFY area >= 6)"""
# The policy's coefficient from moments about the means, by determinants of three regressors.
_MOMENT = lambda a, b: f"covar_pop({a}, {b})"
_COLUMNS = [[_MOMENT(a, b) for a in ("temp", "weekend", "policy")] for b in ("temp", "weekend", "policy", "y")]
_DET = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {b[0]} * ({a[1]} * {c[2]} - {a[2]} * {c[1]}) + {c[0]} * ({a[1]} * {b[2]} - {a[2]} * {b[1]}))"
_EFFECT = f"sum(policy) * {_DET(_COLUMNS[0], _COLUMNS[1], _COLUMNS[3])} / {_DET(_COLUMNS[0], _COLUMNS[1], _COLUMNS[2])}"
_NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({0} AS VARCHAR) END"
_BUNDLES = f"""WITH b AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS pdf_hash, sha256(CAST(o_custkey AS VARCHAR)) AS feature_commit, CAST(o_totalprice AS DOUBLE) AS score, o_orderpriority AS model_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'v1' END AS model_version, CAST(o_orderdate AS VARCHAR) AS issued_at FROM orders),
 j AS (SELECT *, CASE WHEN score >= 150000 THEN 'pass' ELSE 'fail' END AS decision, '{{"feature_commit":"' || feature_commit || '","model_id":"' || model_id || '"' || CASE WHEN model_version IS NOT NULL THEN ',"model_version":"v1"' ELSE '' END || ',"pdf_hash":"' || pdf_hash || '","score":' || {_NUM.format('score')} || ',"threshold":150000.0}}' AS payload FROM b)"""
_pad = lambda key, b: "".join(f"{c ^ b:02x}" for c in key.ljust(64, b"\0"))
_HMAC = f"sha256(unhex('{_pad(b'secret', 0x5C)}') || unhex(sha256(unhex('{_pad(b'secret', 0x36)}') || encode('{proof.COMMIT_DOMAIN}' || chr(31) || payload))))"
ORACLES = {
    "iot_daily": f"{_R} SELECT asset_id, CAST(date AS VARCHAR) AS date, round(energy_kwh, 6) AS energy_kwh, round(temp_c, 6) AS temp_c, obs, weekday, CASE WHEN weekday >= 5 THEN 1 ELSE 0 END AS is_weekend, round(energy_kwh * 0.4, 6) AS co2_kg FROM daily",
    "iot_pivot": f"WITH {READINGS_SQL} SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS timestamp, asset_id, round(avg(energy_kwh), 6) AS energy_kwh, round(avg(temp_c), 6) AS temp_c FROM readings GROUP BY 1, 2",
    "iot_window": f"{_R} SELECT asset_id, CAST(date AS VARCHAR) AS date, obs FROM daily WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-06'",
    "policy_dates": f"{_R}{_DATES} SELECT asset_id, CAST(policy_date AS VARCHAR) AS policy_date FROM dates",
    "effect_fallback": f"""{_R}{_DATES}, e AS (SELECT asset_id, policy_date, count(*) FILTER (WHERE date < policy_date) AS pre_days, count(*) FILTER (WHERE date >= policy_date) AS post_days, avg(energy_kwh) FILTER (WHERE date < policy_date) AS m, sum(energy_kwh) FILTER (WHERE date >= policy_date) AS s FROM daily JOIN dates USING (asset_id) GROUP BY 1, 2)
      SELECT asset_id, CAST(policy_date AS VARCHAR) AS policy_date, pre_days, post_days, round(m, 6) AS yhat, round((s - post_days * m) / post_days, 6) AS avg_effect, round(s - post_days * m, 6) AS cum_effect, true AS used_fallback FROM e WHERE pre_days >= 7""",
    "series_filled": f"""{_R}, g AS (SELECT asset_id, date, CASE WHEN obs % 3 <> 0 THEN round(temp_c, 6) END AS t FROM daily)
      SELECT asset_id, CAST(date AS VARCHAR) AS date, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY date), first_value(t IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS temp_c FROM g""",
    "scm_ols_sums": f"{_R}{_X} SELECT asset_id, count(*) AS n, " + ", ".join(f"round(sum({a} * {b}), 6) AS {a}_{b}" for a, b in _PAIRS) + " FROM x GROUP BY 1",
    "scm_what_if": f"{_R}{_X}, e AS (SELECT asset_id, {_EFFECT} AS effect FROM x GROUP BY 1) SELECT asset_id, round(effect, 4) AS effect, round(effect * 0.4, 4) AS effect_co2 FROM e",
    "raster_cleaned": f"{_CLEANED} SELECT aoi_id, count(clean.seed) AS changed, count(*) AS total, count(clean.seed) / count(*) AS changed_frac FROM sc LEFT JOIN clean USING (aoi_id, row, col) GROUP BY 1",
    "raster_components": f"{_CLEANED}, b AS (SELECT aoi_id, seed, min(row) AS r0, min(col) AS c0, max(row) + 1 AS r1, max(col) + 1 AS c1, count(*) AS pixels FROM clean GROUP BY 1, 2) SELECT aoi_id, CAST(row_number() OVER (PARTITION BY aoi_id ORDER BY seed) AS INTEGER) AS label, r0, c0, r1, c1, pixels FROM b",
    "ndvi_change": f"{_PIXELS} SELECT aoi_id, row, col, round(diff, 9) AS diff, round(neg, 9) AS score FROM sc",
    "percentile_mask": f"{_PIXELS}{_MASK} SELECT aoi_id, changed, total, round(changed / total, 9) AS changed_frac FROM m",
    "raster_grey": f"{_PIXELS} SELECT aoi_id, 'before' AS timing, row, col, round(0.2989 * r0 + 0.5870 * n0, 9) AS value FROM p UNION ALL SELECT aoi_id, 'after', row, col, round(0.2989 * r1 + 0.5870 * n1, 9) FROM p",
    "change_events": f"{_PIXELS}{_MASK} SELECT sha256(aoi_id || '|2024-03-15T00:00:00Z|p95') AS event_id, aoi_id, '2024-03-15T00:00:00Z' AS occurred_at, round(changed / total, 9) AS score, CASE WHEN changed / total >= 0.05 THEN 'high' WHEN changed / total >= 0.01 THEN 'medium' ELSE 'low' END AS severity FROM m",
    "geo_buffer": "SELECT s_suppkey AS id, 33 AS corners, true AS valid, true AS centred FROM supplier",
    "geo_buffer_corners": """WITH p AS (SELECT c_custkey AS id, radians(c_custkey % 3400 / 10.0::DOUBLE - 170) * 6378137 AS x, 6378137 * ln(tan(pi() / 4 + radians(c_custkey % 1580 / 10.0::DOUBLE - 79) / 2)) AS y FROM customer)
      SELECT id, """
    + ", ".join(f"round(degrees((x + 250 * cos({k} * pi() / 16)) / 6378137), 7) AS lon{k}, round(degrees(2 * atan(exp((y + 250 * sin({k} * pi() / 16)) / 6378137)) - pi() / 2), 7) AS lat{k}" for k in CORNERS)
    + " FROM p",
    "geo_pixel_boxes": """WITH b AS (SELECT s_suppkey AS id, s_suppkey % 50 AS r0, s_suppkey % 30 AS c0 FROM supplier), x AS (SELECT id, 54.4::DOUBLE + (54.6::DOUBLE - 54.4::DOUBLE) * c0 / 64 AS a, least(54.4::DOUBLE + (54.6::DOUBLE - 54.4::DOUBLE) * (c0 + 10) / 64, 54.6) AS b, 24.6::DOUBLE - (24.6::DOUBLE - 24.3::DOUBLE) * r0 / 64 AS c, greatest(24.6::DOUBLE - (24.6::DOUBLE - 24.3::DOUBLE) * (r0 + 20) / 64, 24.3) AS d FROM b)
      SELECT id, round(a, 9) AS x0, round(c, 9) AS y0, round(b, 9) AS x2, round(d, 9) AS y2, round(abs(b - a) * 111.32 * cos(radians((c + d) / 2)) * abs(d - c) * 111.32, 6) AS km2 FROM x""",
    "bundle_issue": f"{_BUNDLES} SELECT pdf_hash, sha256(payload) AS bundle_id, {_HMAC} AS signature, decision FROM j",
    "bundle_list": f"{_BUNDLES}, f AS (SELECT *, count(*) OVER () AS total, sha256(payload) AS bundle_id FROM j WHERE decision = 'pass' AND contains(lower(sha256(payload) || pdf_hash || feature_commit || model_id), 'urgent')) SELECT pdf_hash, model_id, issued_at, total FROM f ORDER BY issued_at DESC, bundle_id DESC LIMIT 20 OFFSET 5",
    "bundle_verify": f"""{_BUNDLES}, i AS (SELECT *, sha256(payload) AS bundle_id FROM j),
      v AS (SELECT array_to_string(list_filter([CASE WHEN bundle_id < '3' AND decision = 'pass' THEN '{proof.WRONG_DECISION}' END, CASE WHEN substr(bundle_id, 2, 1) < '3' THEN '{proof.WRONG_SIGNATURE}' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM i)
      SELECT reasons, reasons = '' AS valid, count(*) AS n FROM v GROUP BY 1, 2""",
    "feature_commit": f"""WITH p AS (SELECT vec_id, '{{"features":[' || array_to_string(list_transform(embedding, lambda x: CAST(round_even(x::DOUBLE, 4) AS VARCHAR)), ',') || '],"model_id":"m","precision":4}}' AS payload FROM embeddings)
      SELECT vec_id, sha256(payload) AS payload_sha256, sha256('{proof.COMMIT_DOMAIN}' || chr(31) || payload) AS commit_sha256 FROM p""",
    "idempotent_ingest": """WITH a AS (SELECT event_id, event_type, 'key-' || user_id || '-' || event_type AS k FROM events), seen AS (SELECT DISTINCT 'key-' || (user_id + 100) || '-' || event_type AS k FROM events WHERE event_id % 50 = 0),
      f AS (SELECT k, min(event_id) AS f FROM a WHERE event_type <> 'error' GROUP BY 1)
      SELECT event_id AS arrival, CASE WHEN event_type = 'error' THEN 'err' WHEN seen.k IS NOT NULL OR event_id > f THEN 'dup' ELSE 'done' END AS outcome FROM a LEFT JOIN f USING (k) LEFT JOIN seen USING (k)""",
    "replay_window": "SELECT event_id AS arrival, 'key-' || user_id || '-' || event_type AS idempotency_key, event_type AS topic, strftime(ts, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM events WHERE date_trunc('second', ts) >= '2024-01-05' AND date_trunc('second', ts) < '2024-01-06' AND event_type IN ('click', 'signup') ORDER BY occurred_at, idempotency_key LIMIT 100",
    "contract_errors": """SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 4 = 0 THEN 'event_id is missing' END, CASE WHEN event_id % 2 = 1 THEN 'event_type does not fit' END, CASE WHEN event_id % 3 = 0 THEN 'idempotency_key does not fit' END,
      CASE WHEN event_id % 2 = 0 AND event_id % 5 = 0 THEN 'payload.actor is missing' END], lambda x: x IS NOT NULL), '; ') AS errors FROM events""",
}
