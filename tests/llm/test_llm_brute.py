"""Operators and stages of the pipeline against plain versions on whole tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import mixing, pieces, quality, queries, toxicity

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def test_quality_against_numpy(spark):
    """Scores of all documents by moments, shrinkage, densities and calibration in numpy."""
    data = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.doc_id in texts and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    part = {y: np.array([x[i] for i, q in labels if q == y]) for y in (0, 1)}
    total = sum(map(len, part.values()))
    pooled = sum(len(p) * p.var(axis=0) for p in part.values()) / total

    def density(v, y):
        cov = (1 - quality.SHRINK) * np.cov(part[y].T, bias=True) + np.diag(quality.SHRINK * np.maximum(pooled, quality.FLOOR**2) + quality.FLOOR**2)
        d = v - part[y].mean(axis=0)
        return np.log(len(part[y]) / total) - np.linalg.slogdet(cov)[1] / 2 - (d @ np.linalg.inv(cov) * d).sum(axis=-1) / 2

    z = lambda v: (density(v, 1) - density(v, 0)) / quality.SOFTEN
    at = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    middle = (at(z(part[0]), 0.999) + at(z(part[1]), 0.001)) / 2
    for r in queries.op2_quality(spark, data).collect():
        want = 1 / (1 + np.exp(-np.clip(z(x[r.doc_id][None])[0] - middle, -700, 700)))
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_quality_statistics_of_one_text():
    text = "One two, two three.\nOne two, two three.\nÉtat 42 % !!"
    got = dict(zip(quality.STATISTICS, quality.statistics(text)))
    assert got["words"] == np.log1p(12)
    assert abs(got["lines"] - np.sqrt(1 / 3)) < 1e-12
    assert got["distinct"] == np.log1p(len(set(text.lower().split()))) / np.log1p(13)
    counts = np.array(list(Counter(text.encode()).values())) / len(text.encode())
    assert abs(got["entropy"] + (counts * np.log2(counts)).sum()) < 1e-12
    assert got["digits"] == np.sqrt(2 / len(text))


def test_pieces_are_the_librarys(spark, data, docs):
    """Ids of all whole documents as the library has them, and what they decode to."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = pieces.tokenised(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")).collect()
    assert len(out) == len(docs)
    for r in out:
        text = docs[r.doc_id].text or ""
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if pieces.MARK not in text:
            assert r.ids == library.encode(text) and r.n_tokens == len(r.ids)


def classes(texts: dict) -> dict:
    """By brute force over all pairs: multiset Jaccard of runs of five words of at least 0.8; texts of fewer words only if equal."""
    bags = {}
    for i, t in texts.items():
        w = [x for x in SPACE.split(t) if x]
        bags[i] = Counter(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else Counter([tuple(w)])
    out, ids = {i: i for i in texts}, sorted(texts)
    sizes = {i: sum(b.values()) for i, b in bags.items()}
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]) and out[a] != out[b]:
                both = sum((bags[a] & bags[b]).values())
                if both >= 0.8 * (sizes[a] + sizes[b] - both) - 1e-9:
                    old, new = max(out[a], out[b]), min(out[a], out[b])
                    out = {i: new if c == old else c for i, c in out.items()}
    return out


def test_near_by_word_tuples(spark, data, docs):
    want = classes({i: r.text or "" for i, r in docs.items()})
    assert {r.doc_id: r.class_id for r in queries.op5_near_dedup(spark, data).collect()} == want


def test_stages(spark, data, docs):
    """Each stage on its own input against a plain version; decisions take effect, clean rows stay as they are."""
    stage = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.fit(table, spark.read.parquet(f"{data}/labels.parquet"))
    scores = {r.doc_id: r.toxicity for r in toxicity.score(table.select("doc_id", "text"), model).collect()}
    left = stage["toxicity"](spark, table, data)
    assert sorted(tuple(r) for r in left.collect()) == sorted(tuple(r) for i, r in docs.items() if scores[i] < 0.5)

    first: dict = {}
    for i in sorted(docs):
        first.setdefault(SPACE.sub(" ", docs[i].text or ""), i)
    exact = stage["exact_dedup"](spark, table, data)
    assert sorted(tuple(r) for r in exact.collect()) == sorted(tuple(docs[i]) for i in first.values())

    near = stage["near_dedup"](spark, table, data)
    of = classes({i: r.text or "" for i, r in docs.items()})
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(of.values()))

    out, c = mixing.with_copies(table)
    copies = {r.doc_id: r.n for r in out.select("doc_id", F.col(c["copies"]).alias("n")).collect()}
    mixed = Counter(tuple(r) for r in stage["mixing"](spark, table, data).collect())
    assert mixed == Counter({tuple(docs[i]): n for i, n in copies.items() if n})
    sizes = {i: len([w for w in SPACE.split(r.text or "") if w]) for i, r in docs.items()}
    by_source: dict = {}
    for i, r in docs.items():
        by_source.setdefault(r.source, []).append(i)
    for ids in by_source.values():
        assert len({copies[i] for i in ids}) <= 2 and max(copies[i] for i in ids) - min(copies[i] for i in ids) <= 1
    targets = {r.source: r.t for r in out.groupBy("source").agg(F.first(c["target"]).alias("t")).collect()}
    for source, ids in by_source.items():
        size = sum(sizes[i] for i in ids)
        low = int(targets[source] // size)
        assert all(copies[i] in (low, low + 1) for i in ids)


def test_mixing_of_rows_without_ids(spark):
    """Rows that share an id, or have none, are drawn apart."""
    rows = spark.range(6_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).cast("long").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    out, c = mixing.with_copies(rows)
    for r in out.groupBy("source").agg(F.first(c["target"]).alias("t"), F.sum(F.col(c["size"]) * F.col(c["copies"])).alias("n")).collect():
        assert abs(r.n - r.t) < 0.05 * r.t


def test_shared_folder_is_needed_off_one_machine():
    from types import SimpleNamespace

    from orrery.llm import common

    conf = SimpleNamespace(get=lambda *a: None)
    spark = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://somewhere:7077"), conf=conf)
    with pytest.raises(ValueError):
        common.shared_dir(spark)
