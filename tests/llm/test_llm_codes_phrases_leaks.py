"""Operators 11 to 13 against brute force on small tables with nulls, ties, repeats and hot keys."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import common, decontaminate, phrases, vafile

VECTORS = "vec_id long, embedding array<double>, label int, code string, n int"


def test_filtered_search_is_exact():
    rng = np.random.default_rng(1)
    for wide in (1, 2**31):
        for m, d in ((1, 1), (2, 3), (16, 8), (16, 1)):
            book, x = rng.integers(-9, 9, (m, d)) * wide, rng.integers(-12, 12, (300, d)) * wide
            book, x = (vafile._exact(v.astype(object) if wide > 1 else v) for v in (book, x))
            best, gap, refined = vafile.Cells.of(book).nearest(x)
            for row, b, g in zip(x, best, gap):
                far = [sum((int(p) - int(q)) ** 2 for p, q in zip(row, e)) for e in book]
                assert (b, g) == (far.index(min(far)), min(far))
            assert refined <= m * len(x)
    book = rng.integers(-(2**20), 2**20, (16, 8))
    assert vafile.Cells.of(book).nearest(book)[2] < 16 * 16 / 2  # most entries are filtered


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, code, error, label) and the codebooks' digest, by Python's integers."""
    kept = [(i, [int(np.floor(x * scale)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    counts = Counter(len(v) for _, v, _ in kept if v)
    length = min((-n, d) for d, n in counts.items())[1] if counts else 0
    width = -(-length // parts)
    cut = lambda v: [(v + [0] * (parts * width - length))[p * width : (p + 1) * width] for p in range(parts)]
    own = sorted((((i is None, i or 0), cut(v)) for i, v, _ in kept if length and len(v) == length))
    books = [[c[p] for _, c in own[:entries]] for p in range(parts)]
    near = lambda q, b: min((sum((x - y) ** 2 for x, y in zip(q, e)), k) for k, e in enumerate(b))
    for _ in range(rounds if own else 0):
        for p in range(parts):
            of = defaultdict(list)
            for _, c in own:
                of[near(c[p], books[p])[1]].append(c[p])
            for e, cs in of.items():
                books[p][e] = [sum(col) // len(cs) for col in zip(*cs)]
    out = []
    for i, v, lab in kept:
        found = [near(c, books[p]) for p, c in enumerate(cut(v))] if length and len(v) == length else None
        out.append((i, "".join(f"{e:02x}" for _, e in found) if found else None, sum(d for d, _ in found) if found else None, lab))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("case", ["mixed", "few", "odd", "wide", "nothing"])
def test_codes(spark, case):
    rng = random.Random(case)
    vector = lambda d, s=1.0: [rng.randint(-3, 3) * s / 4 for _ in range(d)]
    rows = {
        "mixed": [(k, vector(16), k % 3 or None) for k in range(80)] + [(3, vector(16), 1), (None, vector(16), 2), (200, None, 1), (201, [None] + [0.0] * 15, 1), (202, [float("nan")] * 16, 1), (203, [float("-inf")] * 16, 1), (204, [], 1), (205, [1.0] * 8, 1)],
        "few": [(k, vector(8), 1) for k in (5, 2, 9)],
        "odd": [(k, vector(11), k % 2) for k in range(40)] + [(k, [0.25] * 11, None) for k in range(40, 90)],
        "wide": [(k, vector(8, 1e6), 1) for k in range(40)],
        "nothing": [(1, None, 1), (2, [], None)],
    }[case]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(5)
    want, digest = brute_codes(rows)
    got = vafile.report(df).collect()
    total = defaultdict(int)
    for _, _, e, lab in want:
        total[lab] += e or 0
    some = {lab for _, _, e, lab in want if e is not None}
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(((r.vec_id, r.code or "", r.error, r.label_error) for r in got), key=key) == sorted(((i, c or "", e, total[lab] if lab in some else None) for i, c, e, lab in want), key=key)
    assert {r.codebooks_sha256 for r in got} <= {digest}


def test_codes_keep_columns(spark):
    df = spark.createDataFrame([(1, [1.0] * 8, 3, "own", 9)], VECTORS)
    books = vafile.fit(df)
    assert vafile.encode(df, books, code="c", error="e").collect()[0][:] == (1, [1.0] * 8, 3, "own", 9, "0000000000000000", 0)


def brute_phrases(docs, least, most=2000):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    counts[lang, tuple(ws[i : i + k])] += 1
    found = defaultdict(list)
    cands = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    for (lang, p), a in cands.items():
        if any(lang == m and len(q) > len(p) and 100 * f >= 80 * a and inside(p, q) for (m, q), f in cands.items()):
            continue
        score, _, left, right = min((2000000 * a // (counts[lang, p[:j]] + counts[lang, p[j:]]), j, counts[lang, p[:j]], counts[lang, p[j:]]) for j in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, totals[lang], -s) for lang, rows in found.items() for k, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1))


def test_phrases(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["a", "B", "b", "É", "é", "one", "Two", " x", "l" * 3000, "q\x0ar", "-"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))
    docs = [(text(), rng.choice(["en", "en", "de", None, "und"])) for _ in range(120)] + [("spam ham eggs now", "en")] * 60 + [(None, "en"), ("", None), (" ...\n", "xx"), ("only", "yy")]
    df = spark.createDataFrame([(k, t, lang, "c", 1) for k, (t, lang) in enumerate(docs)], "doc_id int, text string, lang string, chunk string, id int").repartition(3)
    for least, most, size in ((5, 2000, 1_000), (2, 7, 8_000_000)):
        got = phrases.collocations(df, most, least=least, chunk_bytes=size)
        assert sorted(tuple(r) for r in got.collect()) == brute_phrases(docs, least, most)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # joins that deal by key, hot ones to several tasks
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    assert sorted(tuple(r) for r in phrases.collocations(df, least=5).collect()) == brute_phrases(docs, 5)
    assert phrases.collocations(df.limit(0)).collect() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_leaks(docs, items, span=10):
    ws = lambda t: WORD.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))
    where = defaultdict(set)
    for i, t in items:
        w = ws(t)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            where[tuple(w[k : k + n])].add("null" if i is None else str(i))
    lengths = {len(p) for p in where}
    for i, t in docs:
        w, hit, own = ws(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in where:
                    hit |= set(range(k, k + n))
                    own |= where[tuple(w[k : k + n])]
        yield (-1 if i is None else i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))


@pytest.mark.parametrize("short", [False, True])
def test_leaks(spark, short, monkeypatch):
    rng = random.Random(short)
    vocabulary = [f"W{k}" for k in range(40)] + ["É", "é", "9", "a", "a"]
    run = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    tests = [run(rng.randint(10, 30)) for _ in range(25)] + [["a"] * 40, ["same"] * 10 + run(12)] + ([run(n) for n in (1, 3, 5, 6, 9)] if short else [])
    items = [(k, "-".join(t)) for k, t in enumerate(tests)] + [(3, " ".join(tests[5])), (None, "; ".join(tests[6])), (70, None), (71, " .. "), (100, " ".join(tests[2]))]
    docs = []
    for _ in range(120):
        w = run(rng.randint(0, 50))
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(tests)
            a = rng.randrange(len(t))
            at = rng.randint(0, len(w))
            w[at:at] = t[a : a + rng.randint(8, 20)]
        docs.append(rng.choice([" ", ", ", "\n"]).join(w))
    docs += [None, "", "...", " ".join(["A"] * 90)] + [" ".join(tests[1])] * 50 + [" ".join(run(3000) + tests[4] + run(3000))]
    docs = [(None if k == 7 else k // 2, t) for k, t in enumerate(docs)]
    d = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id int, text string, key string, at int").repartition(4)
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id int, text string, span string")
    order = lambda rows: sorted((-1 if r[0] is None else r[0], *r[1:]) for r in rows)
    want = sorted(brute_leaks(docs, items))
    assert order(tuple(r) for r in decontaminate.report(d, b).collect()) == want
    for m in (common, decontaminate):
        monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(m, "HOT_ROWS", 10)
    assert order(tuple(r) for r in decontaminate.report(d, b).collect()) == want
    dirty = {t for (_, t), r in zip(docs, brute_leaks(docs, items)) if r[5]}
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns and sorted(r.text or "" for r in left.collect()) == sorted(t or "" for _, t in docs if t not in dirty)


def test_leaks_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id int, text string")
    b = spark.createDataFrame([], "item_id int, text string")
    assert sorted(tuple(r)[:4] for r in decontaminate.report(d, b).collect()) == [(1, 3, 0, 0), (2, 0, 0, 0)]
    assert decontaminate.report(d.limit(0), b).collect() == []


def test_a_planted_passage_is_always_met(spark):
    """Every window of SPAN words that a document shares with an item is under a fingerprint that both keep."""
    rng = random.Random(2)
    words = [str(rng.randint(0, 9)) for _ in range(400)]
    row = spark.createDataFrame([(" ".join(words),)], "t string")
    kept = row.select(decontaminate.fingerprints(F.split("t", " "), 10).alias("p")).collect()[0].p
    of = lambda k: spark.createDataFrame([(" ".join(words[k : k + 10]),)], "t string")
    for k in range(0, 390, 65):
        (one,) = of(k).select(decontaminate.fingerprints(F.split("t", " "), 10).alias("p")).collect()[0].p
        assert any(p.hash == one.hash and p.at <= k < p.at + 6 for p in kept)
