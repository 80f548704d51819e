"""Queries of the subpackage against SQL or brute force on the smallest tables."""

import hashlib
import re

import numpy as np
import pytest
from compare import check
from pyspark.sql import functions as F

from orrery.llm import bagminhash, pii, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, data, duck, name):
    check(queries.QUERIES[name](spark, data), duck, queries.ORACLES[name])


def texts(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def brute_spans(t):
    found = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(patterns):
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m.group())
            if (k == 1 and any(int(x) > 255 for x in m.group().split("."))) or (k == 2 and not (14 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 10 <= len(d) <= 15):
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


def test_personal_data(spark, data):
    docs = texts(spark, data)
    for r in queries.op3_pii(spark, data).collect():
        want = brute_spans(docs[r.doc_id] or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_base_spans_on_random_text():
    rng = np.random.default_rng(9)
    parts = ["1", "2", "55", "4", "0", ".", "@", "+", " ", "-", "a", "b.c", "(", ")", "é", "\n", "4111111111111111", "300"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, rng.integers(0, 30)))
        assert pii.base_spans(t) == brute_spans(t)


def test_chat(spark, data):
    rows = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    got = {r.conv_id: r for r in queries.op4_chat(spark, data).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted(x for x in rows if x[0] == c)
        said = "".join(t for _, _, role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(said)
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in own).encode()).hexdigest()


def test_signature_is_unbiased():
    rng = np.random.default_rng(10)
    errors = []
    for _ in range(80):
        a = rng.integers(0, 60, 250).astype(str).tolist()
        b = list(a)
        for k in rng.integers(0, 250, 8):
            b[k] = f"x{k}"
        bags = bagminhash.bags([" ".join(a * 2), " ".join(b * 2)])
        both, either = bagminhash.overlap(*bags)
        s = bagminhash.signatures(bags)
        errors.append((s[0] == s[1]).mean() - both / either)
    assert abs(np.mean(errors)) < 0.02


def test_word_hashes_in_parts(monkeypatch):
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(["a", "bb", " ", "\n", "éé", "c" * 40], rng.integers(0, 60))) for _ in range(50)]
    want = bagminhash.word_hashes(texts)
    for most in (1, 7, 64):
        monkeypatch.setattr(bagminhash, "AT_ONCE", most)
        got = bagminhash.word_hashes(texts)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert [b - a for a, b in zip(want[1], want[1][1:])] == [len(re.findall("[^\\x20\\x09-\\x0d]+", t)) for t in texts]


@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality", "quality", 0.95), ("op10_toxicity", "toxic", 0.85)])
def test_held_out(spark, name, label, least):
    data = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least


def test_pieces(spark, data):
    assert queries.op6_pieces(spark, data).filter("NOT round_trip").count() == 0
