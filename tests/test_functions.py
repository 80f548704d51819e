"""Functions against plain Python, and goldens of the evaluation sets."""

import base64
import hashlib
import hmac
import math
import random

import numpy as np
from pyspark.sql import functions as F

from orrery.functions import security, severity, text
from orrery.operators import documents, evaluation, geo, proof, raster, rules


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("out")).first()["out"]


def test_text(spark):
    t = F.col("t")
    assert one(spark, text.normalize_ws(t), t=" a \t b ") == "a b"
    assert one(spark, text.word_count(t), t="") == 0
    assert one(spark, text.detect_lang(t), t="مرحبا ok") == "ar"
    assert one(spark, text.sentences(t), t="See e.g. Fig. 1. It works! ok? Yes") == ["See e.g. Fig.", "1.", "It works!", "ok?", "Yes"]
    assert one(spark, text.sentences(t), t=" By 1 of e.g.  2 cases.  1 of 1. 2 are 2. Mr.\n Dr. No") == ["By 1 of e.g. 2 cases.", "1 of 1.", "2 are 2.", "Mr. Dr. No"]
    assert one(spark, text.rag_sentences(t), t="0 a 0. 1 b 1! 2 c 2") == ["0 a 0.", "1 b 1!", "2 c 2"]
    assert one(spark, text.clause_classes(t), t="CO₂ and wastewater; microenergy") == ["emissions", "water"]
    assert one(spark, text.slug(t), t="  A -- big/Thing! ") == "a.big.thing"
    assert one(spark, text.kwh_threshold(t), t="drop of more than 350 kWh or 20 kwh") == 350.0
    assert one(spark, severity.rank(t), t="unheard") == 0
    assert one(spark, severity.of_change(t), t=0.01) == "medium"


def test_security(spark):
    for key in (b"k", b"x" * 100):
        want = hmac.new(key, "ü message".encode(), hashlib.sha256).digest()
        assert bytes(one(spark, security.hmac_sha256(key, F.col("t")), t="ü message")) == want
    short = base64.urlsafe_b64encode(hmac.new(b"salt", b"asset_1", hashlib.sha256).digest()[:8]).rstrip(b"=").decode()
    assert one(spark, security.pseudonym("salt", F.col("t")), t="asset_1") == f"asset_{short}"
    token = security.issue_token("ann", "regulator", b"s", "me", 60, now=100)
    assert security.verify_token(token, b"s", "me", now=159)["role"] == "regulator"
    assert security.verify_token(token, b"s", "me", now=160) is None
    assert security.verify_token(token, b"t", "me", now=100) is None


def test_chunks_are_the_greedy_loop(spark):
    rng = random.Random(5)
    docs = [(f"d{k}", p, "en", " ".join(" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(1, 60))).capitalize() + "." for _ in range(rng.randint(0, 12)))) for k in range(6) for p in (1, 2)]
    df = spark.createDataFrame(docs, "doc_sha256 string, page int, lang string, text string")
    got = sorted((r.doc_sha256, r.chunk_index, r.n_words, r.page_start, r.page_end) for r in documents.chunk(df, 40, 80).collect())
    want = []
    for d in sorted({x[0] for x in docs}):
        held, words, index = [], 0, 0
        for _, page, _, t in (x for x in docs if x[0] == d):
            for s in (x for x in t.replace(". W", ".\nW").split("\n") if x):
                n = len(s.split())
                if words >= 40 and words + n > int(80 * 1.2):
                    index += 1
                    want.append((d, index, words, held[0], held[-1]))
                    held, words = [], 0
                held.append(page)
                words += n
                if words >= 80:
                    index += 1
                    want.append((d, index, words, held[0], held[-1]))
                    held, words = [], 0
        if held:
            want.append((d, index + 1, words, held[0], held[-1]))
    assert got == sorted(want)


def test_evaluation_goldens(spark):
    items = spark.createDataFrame([("q1", ["a", "b"], ["a"]), ("q2", ["c"], ["d", "e"]), ("q3", [], [])], "id string, citations_pred array<string>, citations_gold array<string>")
    m = evaluation.citation_metrics(items).first()
    assert (m.micro_f1, m.macro_f1) == (0.3333, round((2 / 3 + 0 + 1) / 3, 4))
    assert math.isnan(one(spark, evaluation.rmse(F.array().cast("array<double>"), F.array().cast("array<double>"))))
    ranked = spark.createDataFrame([(k, float(k % 3), k % 2) for k in range(25)], "tile_id int, score double, label int")
    assert {r.k for r in evaluation.precision_at(ranked, (0, 5, 99), (0.1,)).collect()} == {0, 2, 5, 25}


def test_rules(spark):
    rows = [('{"a": {"b": 3}, "s": "x1", "f": true}',), ('{"a": {"b": "3"}, "s": 5}',), ("{}",), ("broken",)]
    df = spark.createDataFrame(rows, "event string")
    c = rules.Compiler()
    test = lambda *a: [r[0] for r in df.select(c.test(*a)).collect()]
    assert test(["event", "a", "b"], "gt", 2) == [True, False, False, False]
    assert test(["a", "b"], "eq", 3) == [True, False, False, False]
    assert test(["a", "b"], "neq", 3) == [False, True, True, True]
    assert test(["s"], "regex", "^x") == [True, False, False, False]
    assert test(["f"], "eq", 1) == [True, False, False, False]
    assert test(["s"], "in", ["x1", 5]) == [True, True, False, False]
    assert test(["s"], "exists", None) == [True, True, False, False]
    assert rules.validate({"meta": {"id": "r", "version": 1, "status": "odd"}, "severity": "low", "trigger": {"type": "event"}, "conditions": {"clauses": [{"path": "a", "op": "gt", "value": "x"}]}}) == ["meta.status is unknown", "clause 0 needs a number"]


def test_bundles(spark):
    df = spark.createDataFrame([("h", 'a"b', 0.5, 0.4, "m", None), ("h2", "c", 0.1, 0.4, "m", "v")], "pdf_hash string, feature_commit string, score double, threshold double, model_id string, model_version string")
    out = proof.issue(df, "key", "dom")
    r = out.filter("pdf_hash = 'h'").first()
    payload = security.canonical_json({"pdf_hash": "h", "feature_commit": 'a"b', "score": 0.5, "threshold": 0.4, "model_id": "m"}).encode()
    assert r.bundle_id == hashlib.sha256(payload).hexdigest()
    assert r.signature == hmac.new(b"key", b"dom\x1f" + payload, hashlib.sha256).hexdigest()
    assert [x.valid for x in proof.verify(out, "key", "dom").collect()] == [True, True]
    bad = proof.verify(out.withColumn("score", F.lit(0.3)), "key", "dom").filter("pdf_hash = 'h'").first()
    assert bad.reasons == [proof.WRONG_ID, proof.WRONG_DECISION, proof.WRONG_SIGNATURE]


def test_raster():
    rng = np.random.default_rng(1)
    for connectivity in (4, 8):
        m = rng.random((20, 30)) < 0.45
        got, want, n = raster.label(m, connectivity), np.zeros(m.shape, int), 0
        for start in zip(*np.nonzero(m)):
            if want[start]:
                continue
            n += 1
            todo = [start]
            while todo:
                r, c = todo.pop()
                if 0 <= r < 20 and 0 <= c < 30 and m[r, c] and not want[r, c]:
                    want[r, c] = n
                    todo += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if connectivity == 8 or abs(a) + abs(b) == 1]
        assert (got == want).all()
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert raster.fill_holes(ring).sum() == 25


def test_geo(spark):
    square = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]])
    assert one(spark, geo.centroid(square)) == [1.0, 1.0]
    assert one(spark, geo.area(square)) == 4.0
    assert one(spark, geo.is_valid(F.slice(square, 1, 4))) is False


def test_spans_apart():
    from orrery.operators.documents import ENGLISH_ENTITIES, apart

    assert apart([(0, 3, "A"), (0, 9, "B"), (8, 12, "C"), (12, 14, "D"), (13, 14, "E")]) == [(0, 9, "B"), (12, 14, "D")]
    import re

    found = lambda k, t: [m.group() for m in re.finditer(ENGLISH_ENTITIES[k], t)]
    assert found("ORG", "we met Masdar Clean PLC and Acme inc. there") == ["Masdar Clean PLC", "Acme inc."]
    assert found("GPE", "in Dubai and the UAE") == ["Dubai", "UAE"] and found("MONEY", "paid $ 3.50 or €20") == ["$ 3.50", "€20"]
    assert found("PERCENT", "by 12.5 % and 3%") == ["12.5 %", "3%"] and found("DATE", "2030, not 20301 or 3.2030 or x2030") == ["2030"]


def test_numbered_in_ranges(spark, monkeypatch):
    from orrery.operators import core

    monkeypatch.setattr(core, "DRAWN", 50)
    monkeypatch.setattr(core, "RANGES", 10)
    rows = [(k, None if k % 11 == 0 else float(k * 37 % 23)) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, score double")
    up = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    down = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for descending, want in ((False, up), (True, down)):
        got = core.numbered(df, "score", ["id"], descending=descending).orderBy("nth").collect()
        assert [r.nth for r in got] == list(range(1, 401)) and [r.id for r in got] == [i for i, _ in want]
    assert core.numbered(df.limit(0), "score", ["id"]).count() == 0


def test_history_is_the_plain_count():
    import random

    from orrery.operators.alerts import History

    draw = random.Random(5)
    for late in (0, 0.1, 1):
        past, rows, at = History(), [], 0
        for _ in range(300):
            at += draw.randrange(3)
            t = draw.randrange(at + 1) if draw.random() < late else at
            v = draw.choice("ab")
            recent = [x for s, x in rows if s >= t - 20]
            assert past.changed(t - 20, v) == sum(a != b for a, b in zip(recent, [*recent[1:], v]))
            past.add(t, v)
            rows.append((t, v))


def test_numbers_are_written_as_in_canonical_json(spark):
    import json

    from orrery.operators import proof

    values = [0.0, -0.0, 1.0, -2.5, 1e-3, 1e-4, 1.5e-4, 9.25e-5, -1e-5, 1.25e7, 12345678.5, 1e15, 1.5e15, 123456789012345.6, 1e16, -2.5e16, 1e100, 3e-10, 1.5e-300, 1e7]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", proof.number_json(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [json.dumps(r.v) for r in got]


def test_names_and_lists(spark):
    assert text.quoted("a`b") == "`a``b`" and text.quoted('a"b', '"') == '"a""b"'
    assert one(spark, text.latin1(F.lit("caf\u00e9 \u2192 \u0645\U0001f600x"))) == "caf\u00e9  x"
    assert one(spark, text.paired(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))) is None
