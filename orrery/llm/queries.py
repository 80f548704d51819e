"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import re
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import ann, chat, decontaminate, exactdup, mixing, neardup, phrases, pieces, pii, quality, toxicity, urlfilter, vafile
from orrery.llm.common import drop_tables, folded_out, table, tables


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out, c = mixing.with_copies(docs)
    return out.select("doc_id", F.col(c["size"]).alias("size"), F.col(c["source_size"]).alias("source_size"), F.col(c["target"]).alias("target"), (F.col(c["size"]) * F.col(c["copies"])).alias("taken"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(rows.unionByName(more)).drop("refused_at")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.report(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("member")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = toxicity.score(docs, model, column="score", keep_text=False)
    return out.select("doc_id", folded_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", folded_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find(docs, pii.fit(docs), keep_text=False)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in pii.KINDS]), s["kind"])
    keyed = F.array_sort(F.transform(F.concat("base_spans", "added_spans"), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return out.select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(keyed).alias("spans"), F.size("added_spans").cast("long").alias("n_added"), F.size(keyed).cast("long").alias("n_spans")
    )


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.tokenised(docs).select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), "decoded_sha256", "round_trip")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.report(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def tidy(query):
    """The query, after which the tables that its result doesn't read are dropped."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mark = len(tables)
        out = query(spark, sf_dir)
        if len(tables) > mark:
            drop_tables(spark, mark, out)
        return out

    return run


QUERIES = {f.__name__: tidy(f) for f in (op1_mixing, op2_quality, op3_pii, op4_chat, op5_near_dedup, op6_pieces, op7_exact_dedup, op8_url_filter, op9_nearest, op10_toxicity, op11_codes, op12_phrases, op13_decontaminate)}

_MARKS = "|".join(re.escape(m).replace("\\ ", " ").replace("\\#", "#").replace("\n", "\\n") for m in chat.CHAT.marks())
_RULES = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what else a}'" for a, h, p in _RULES) + " END"
_ORDERS = "".join(
    f""", o{k} AS (SELECT gram, allow, block, (sum(allow) OVER (PARTITION BY substr(gram, {5 - k}, {k})) + 2.0::DOUBLE * pa) / (sum(allow) OVER (PARTITION BY substr(gram, {5 - k}, {k - 1})) + 2.0::DOUBLE) AS pa,
  (sum(block) OVER (PARTITION BY substr(gram, {5 - k}, {k})) + 2.0::DOUBLE * pb) / (sum(block) OVER (PARTITION BY substr(gram, {5 - k}, {k - 1})) + 2.0::DOUBLE) AS pb FROM o{k - 1})"""
    for k in (2, 3, 4)
)

_LOWER = lambda text: f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# Nearest entries and their means, round by round; a distance and an entry are one number, of which the least counts.
_ROUNDS = "".join(
    f""", a{k} AS (SELECT id, p, min(16 * list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + e) AS m FROM x JOIN c{k} c USING (p) GROUP BY id, p),
s{k} AS (SELECT p, e, j, sum(v) AS s, count(*) AS n FROM (SELECT p, CAST(m % 16 AS INTEGER) AS e, unnest(range(1, len(v) + 1)) AS j, unnest(v) AS v FROM a{k} JOIN x USING (id, p)) GROUP BY ALL),
c{k + 1} AS (SELECT p, e, coalesce(w.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS HUGEINT) ORDER BY j) AS v FROM s{k} GROUP BY ALL) w USING (p, e))"""
    for k in range(vafile.ROUNDS)
)
_KEY = "a.lang || chr(0) || array_to_string(a.ws[{}:{}], ' ')"
_CUT = lambda k, j: f"SELECT a.id, {j} AS j, l.f AS l, r.f AS r FROM ok a JOIN part l ON l.key = {_KEY.format(1, j)} JOIN part r ON r.key = {_KEY.format(j + 1, k)} WHERE a.k = {k}"
_WITHIN = lambda k, m: [f"SELECT lang, {k} AS k, array_to_string(ws[{i + 1}:{i + k}], ' ') AS phrase, f FROM c WHERE k = {m}" for i in range(m - k + 1)]

ORACLES = {
    "op11_codes": f"""
WITH g AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(4096.0::DOUBLE * x) AS HUGEINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT id, p, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS v FROM (SELECT id, q, unnest(range(8)) AS p FROM g)),
c0 AS (SELECT p, id - 1 AS e, v FROM x WHERE id <= 16){_ROUNDS},
a AS (SELECT id, p, min(16 * list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + e) AS m FROM x JOIN c{vafile.ROUNDS} c USING (p) GROUP BY id, p),
d AS (SELECT id, string_agg(printf('%02x', CAST(m % 16 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a GROUP BY id),
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{vafile.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM d JOIN g USING (id), b""",
    "op12_phrases": rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER('text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS ({" UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: ws[i:i + {k - 1}])) AS ws FROM w" for k in range(1, 5))}),
f AS (SELECT lang, k, ws, array_to_string(ws, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
above AS (SELECT lang, k, phrase, max(f) AS f FROM ({" UNION ALL ".join(q for k in (2, 3) for m in range(k + 1, 5) for q in _WITHIN(k, m))}) GROUP BY 1, 2, 3),
ok AS (SELECT row_number() OVER () AS id, c.lang, c.k, c.ws, c.phrase, c.f AS a FROM c LEFT JOIN above USING (lang, k, phrase) WHERE above.f IS NULL OR 100 * above.f < 80 * c.f),
part AS (SELECT lang || chr(0) || phrase AS key, f FROM f WHERE f >= 30),
cut AS ({" UNION ALL ".join(_CUT(k, j) for k in (2, 3, 4) for j in range(1, k))}),
s AS (SELECT ok.lang, phrase, a, l, r, CAST(2000000::HUGEINT * a // (l + r) AS BIGINT) AS score FROM cut JOIN ok USING (id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY 2000000::HUGEINT * a // (l + r), j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op13_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWER('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOWER('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item, span, array_to_string(ws[k:k + span - 1], ' ') AS phrase FROM (SELECT item, ws, least(len(ws), 10) AS span, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS k FROM b WHERE len(ws) > 0)),
t AS (SELECT id, span, unnest(range(1, len(ws) - span + 2)) AS k, unnest(list_transform(range(1, len(ws) - span + 2), lambda k: array_to_string(ws[k:k + span - 1], ' '))) AS phrase FROM d, (SELECT DISTINCT span FROM i)),
h AS (SELECT id, k, span, item FROM t JOIN i USING (span, phrase)),
n AS (SELECT id, count(DISTINCT word) AS n_hit FROM (SELECT id, unnest(range(k, k + span)) AS word FROM (SELECT DISTINCT id, k, span FROM h)) GROUP BY 1),
m AS (SELECT id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (id) LEFT JOIN m USING (id)""",
    "op4_chat": rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, CASE role WHEN 'system' THEN 'S' WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' WHEN 'tool' THEN 'T' ELSE 'X' END AS code,
    CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN len('### ' || role || ': ') ELSE len('### Role ' || to_json(role)::VARCHAR || ': ') END
      + len(regexp_replace(t, '(\\|{_MARKS})', '\\\1', 'g')) + len(' </turn>_') AS chars FROM r
), a AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
    CAST(coalesce(sum(len(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars, string_agg(code, '' ORDER BY turn NULLS FIRST, role, t) AS codes
  FROM s GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, regexp_full_match(codes, 'S?UA([UT]A)*') AS valid FROM a""",
    "op8_url_filter": rf"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
j AS (SELECT *, {_FITS(True)} AS rule, {_FITS(False)} AS action FROM h),
u AS (SELECT host, path, action, count(*) AS n, '^^^' || regexp_replace(regexp_replace(lower(host || path), '[0-9]', '0', 'g'), '[^a-z0./_-]', '~', 'g') || '$' AS padded FROM j GROUP BY host, path, action),
g AS (SELECT host, path, action, n, substr(padded, i, 4) AS gram FROM (SELECT *, unnest(range(1, len(padded) - 2)) AS i FROM u)),
c AS (SELECT gram, coalesce(sum(n) FILTER (WHERE action = 'allow'), 0)::DOUBLE AS allow, coalesce(sum(n) FILTER (WHERE action = 'block'), 0)::DOUBLE AS block FROM g GROUP BY gram),
l AS (SELECT substr(gram, 4, 1) AS last, sum(allow) AS a, sum(block) AS b FROM c GROUP BY 1),
l1 AS (SELECT last, (a + 2.0::DOUBLE / {urlfilter.SYMBOLS}) / (sum(a) OVER () + 2.0::DOUBLE) AS pa, (b + 2.0::DOUBLE / {urlfilter.SYMBOLS}) / (sum(b) OVER () + 2.0::DOUBLE) AS pb FROM l),
o1 AS (SELECT c.*, pa, pb FROM c JOIN l1 ON last = substr(gram, 4, 1)){_ORDERS},
s AS (SELECT host, path, action, avg(ln(pa) - ln(pb)) AS score FROM g JOIN o4 USING (gram) GROUP BY host, path, action),
m AS (SELECT avg(score) FILTER (WHERE action = 'allow') AS ma, avg(score) FILTER (WHERE action = 'block') AS mb, coalesce(stddev(score) FILTER (WHERE action = 'allow'), 0) AS da, coalesce(stddev(score) FILTER (WHERE action = 'block'), 0) AS db FROM s)
SELECT page_id, j.host, j.path, j.rule, coalesce(j.action, CASE WHEN ma IS NULL OR mb IS NULL OR score >= (ma * (db + 1e-9) + mb * (da + 1e-9)) / (da + db + 2e-9) THEN 'allow' ELSE 'block' END) AS verdict
FROM j JOIN s ON j.host = s.host AND j.path = s.path, m""",
    "op1_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS t5, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS w
  FROM d GROUP BY source
), t AS (SELECT 1.5::DOUBLE * sum(size)::DOUBLE AS goal FROM s),
ranked AS (SELECT *, 2.0::DOUBLE * size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * size / w, source NULLS LAST) AS k FROM s),
fill AS (
  SELECT 0::BIGINT AS k, (SELECT goal FROM t) AS rest, (SELECT sum(w) FROM s)::DOUBLE AS ws, true AS full_
  UNION ALL
  SELECT r.k, CASE WHEN r.cap <= r.w * f.rest / f.ws THEN f.rest - r.cap ELSE f.rest END,
         CASE WHEN r.cap <= r.w * f.rest / f.ws THEN f.ws - r.w ELSE f.ws END, r.cap <= r.w * f.rest / f.ws
  FROM fill f JOIN ranked r ON r.k = f.k + 1 WHERE f.full_
), done AS (SELECT count(*) FILTER (WHERE full_ AND k > 0) AS n, arg_min(rest, ws * 1e6 - k) AS rest, min(ws) AS ws FROM fill),
goals AS (SELECT source, size AS source_size, CASE WHEN k <= n THEN cap ELSE w * rest / ws END AS target FROM ranked, done),
rated AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.t5), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated""",
    # Queries that meet few candidates are compared with all, so small tables have the exact result.
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d""",
}
