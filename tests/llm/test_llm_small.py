"""Edge cases of every operator: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import ann, chat, exactdup, mixing, neardup, pieces, pii, quality, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and other words here " * 20_000
ROWS = [
    (1, "The same text  here\nnow ok", "en", "a", 1),
    (2, "The same text here now ok", "en", "a", 1),
    (2, "The same text here now ok", "en", "a", 1),
    (3, None, "en", "b", None),
    (4, "", None, "b", 0),
    (None, "a lonely text without an id", "en", None, 3),
    (5, LONG, "en", "a", 1),
    (6, "   \n ", "en", "c", 1),
    (7, "write to ann.smith@mail.example.com or +1 (555) 555-0100, at 10.0.0.1", "en", "c", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def clash(df):
    """df with columns named like those that operators make."""
    names = ("winner", "none", "part", "twice", "no_id", "size", "target", "copies", "digest", "keep_id", "ids", "n_tokens", "toxicity", "statistics", "score", "own_id", "text_class", "source_key", "again", "rounds")
    return df.withColumns({n: F.lit("mine") for n in names})


def test_exact(docs, empty):
    got = {(r.doc_id, r.text_sha256): r for r in exactdup.report(docs).collect()}
    assert {(i, r.keep_id, r.group_size, r.kept) for (i, _), r in got.items()} == {
        (1, 1, 3, True), (2, 1, 3, False), (3, 3, 2, True), (4, 3, 2, False), (None, None, 1, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)
    }
    left = exactdup.dedup(clash(docs))
    assert left.columns == clash(docs).columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 5, 6, 7]
    assert exactdup.dedup(empty).count() == exactdup.report(empty).count() == 0
    twice = docs.filter("doc_id = 2")
    assert exactdup.dedup(twice).count() == 1


def test_exact_history(spark, docs):
    past = spark.createDataFrame([(-5, "The same text here now ok"), (-4, "other")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.member) for r in exactdup.report(docs, past).collect()}
    assert got[1] == got[2] == (-5, True)
    assert got[4] == (3, False)
    assert sorted(r.doc_id or 0 for r in exactdup.dedup(docs, past).collect()) == [0, 3, 5, 6, 7]


def test_exact_where_rows_are_many(spark, monkeypatch):
    """Groups that are dealt over several tasks, ids at the ends of the range, repeated rows, against a plain count."""
    monkeypatch.setattr(exactdup, "HOT_ROWS", 3)
    monkeypatch.setattr(exactdup, "SHARD_DIGESTS", 4)
    rng = np.random.default_rng(13)
    ids = [None, None, 2**63 - 1, -(2**63), *range(40)]
    rows = [(ids[int(k)], f"text {int(x)}" if x else None) for k, x in zip(rng.integers(0, 44, 150), rng.integers(0, 25, 150) % 20)] + [(None, "alone"), (2**63 - 1, "alone"), (None, "none"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = lambda i: (i is None, i or 0)
    of: dict = {}
    for i, t in rows:
        of.setdefault(t or "", []).append(i)
    best = {t: min(v, key=order) for t, v in of.items()}
    import hashlib

    want = sorted(((hashlib.sha256((t or "").encode()).hexdigest(), i, best[t or ""], len(of[t or ""]), i == best[t or ""]) for i, t in rows), key=str)
    assert sorted(((r.text_sha256, r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdup.report(df).collect()), key=str) == want
    assert sorted(((r.text or "", r.doc_id) for r in exactdup.dedup(df).collect()), key=str) == sorted(best.items(), key=str)


def test_exact_rests_on_its_slots(spark):
    """A slot with a wrong byte no longer joins its members to its group."""
    rows = spark.range(60).select("id", F.sha2((F.col("id") % 20).cast("string"), 256).alias("text")).select(F.col("id").alias("doc_id"), F.unhex("text").alias("digest"))
    past, new = exactdup.distinct_digests(rows.filter("doc_id < 40")), exactdup.distinct_digests(rows.filter("doc_id >= 40"))
    index = exactdup.build_index(past, 1)
    whole = {(bytes(r.digest), r.winner, r.group_size) for r in exactdup.lookup(new, index, 1, True).collect()}
    assert len(whole) == 20 and {x[2] for x in whole} == {3}
    spoilt = index.withColumn("digests", F.concat(F.lit(b"?"), F.expr("substring(digests, 2)")))
    got = [r for r in exactdup.lookup(new, spoilt, 1, True).collect()]
    assert len(got) == 21 and sum(not r.member for r in got) == 1 and sorted(r.group_size for r in got)[:2] == [1, 2]


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5000):
        digests = rng.integers(0, 256, (n, 32), np.uint8)
        sizes, bits, slot = exactdup.build_mph(digests)
        assert sorted(slot) == list(range(n))
        assert (exactdup.find_slots(digests, sizes, bits) == slot).all()


def test_mixing(docs, empty):
    out, c = mixing.with_copies(clash(docs))
    rows = out.select("doc_id", "source", *[F.col(v).alias(k) for k, v in c.items()]).collect()
    assert sum(r["size"] for r in rows if r.doc_id == 1) == 6
    assert all(r["size"] == 0 for r in rows if r.doc_id in (3, 4, 6))
    assert all(r["copies"] <= 2 for r in rows)
    assert [r["size"] for r in rows if r.doc_id is None] == [6]
    assert mixing.mix(clash(docs)).columns == clash(docs).columns
    assert mixing.mix(empty).count() == 0
    nothing = docs.filter("doc_id IN (3, 4)")
    assert mixing.mix(nothing).count() == 0


def test_targets_are_the_loop(spark):
    rng = np.random.default_rng(3)
    for _ in range(3):
        sizes = {f"s{k}": int(rng.integers(0, 10_000)) for k in range(7)}
        weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
        want, free, rest = {}, set(sizes), 1.5 * sum(sizes.values())
        while free:
            total = sum(weights[s] for s in free)
            over = {s for s in free if weights[s] * rest / total > 2 * sizes[s]}
            if not over:
                want |= {s: weights[s] * rest / total for s in free}
                break
            want |= {s: 2.0 * sizes[s] for s in over}
            rest -= sum(2.0 * sizes[s] for s in over)
            free -= over
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mixing_comes_near_its_targets(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("source"))
    out, c = mixing.with_copies(rows)
    for r in out.groupBy("source").agg(F.first(c["target"]).alias("t"), F.sum(F.col(c["size"]) * F.col(c["copies"])).alias("n")).collect():
        assert abs(r.n - r.t) < 0.03 * r.t


def test_quality(docs, empty, labels):
    got = quality.score(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in quality.score(docs, labels.filter("quality = 1")).collect()] == [0.5] * len(ROWS)
    assert quality.score(empty, labels).count() == 0
    assert len(quality.statistics("")) == len(quality.statistics(LONG)) == len(quality.STATISTICS)


def test_quality_density(spark):
    rng = np.random.default_rng(4)
    d = len(quality.STATISTICS)
    a = rng.normal(size=(d, d))
    part = {"mean": rng.normal(size=d).tolist(), "inverse": np.linalg.inv(np.linalg.cholesky(a @ a.T + np.eye(d))).tolist(), "constant": 0.3}
    x = rng.normal(size=d)
    got = spark.createDataFrame([(x.tolist(),)], "statistics array<double>").select(quality.density("statistics", part).alias("z")).first().z
    diff = x - part["mean"]
    assert abs(got - (0.3 - diff @ np.linalg.inv(a @ a.T + np.eye(d)) @ diff / 2)) < 1e-8


def test_pii(docs, empty):
    model = pii.fit(docs)
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.base_spans] for r in pii.find(docs, model).collect()}
    assert [k for k, _, _ in got[7]] == ["email", "phone", "ip"]
    assert got[3] == got[4] == got[5] == []
    assert pii.find(empty, None).count() == 0 and pii.fit(empty) is None
    masked = {r.doc_id: r.text for r in pii.masked(docs, None).collect()}
    assert masked[7] == "write to <email> or <phone>, at <ip>" and masked[3] is None


def test_pii_names(docs):
    mine = docs.withColumns({"base_spans": F.lit("mine"), "added_spans": F.lit("mine"), "masked_text": F.lit("mine")})
    assert pii.find(mine, None).columns == [*mine.columns, "base_spans_", "added_spans_"]
    assert pii.masked(mine, None).columns == mine.columns


@pytest.fixture(scope="module")
def planted(spark):
    """Texts with personal data that patterns see, and others with what they lose: (text, added spans wanted)."""
    rng = np.random.default_rng(17)
    number = lambda n: "".join(rng.integers(0, 10, n).astype(str))

    def card(right: bool) -> str:
        while pii.luhn(x := "4" + number(15)) != right:
            pass
        return x

    plain, lost = [], []
    for k in range(300):
        far, a, b = "some words that keep them apart " * int(rng.integers(2, 12)), int(rng.integers(200, 990)), number(4)
        phone, mail, ip = f"+1 ({a}) 555-{b}", f"name{k}.of@mail{k % 9}.example.com", ".".join(rng.integers(0, 256, 4).astype(str))
        parts = [phone, mail, f"at {ip}", f"with {card(True)}", f"order {card(False)}", f"of {number(6)}", number(3), number(10), far, far]
        plain.append(" and, ".join(parts[int(i)] for i in rng.permutation(10)))
        kind = k % 6
        if kind == 0:  # another number follows at once
            lost.append((f"{far}{phone} {ip} {far}", [("phone", phone)]))
        if kind == 1:
            x, y = card(True), card(False)
            lost.append((f"{far}{x} {y} {far}", [("card", x)]))
        if kind == 2:  # repeated in another form far away
            again = (f"{a}-555-{b}", f"({a}) 555-{b}", f"{a}555{b}")[k // 6 % 3]
            lost.append((f"{far}{phone} {far}{again} {far}", [("phone", again)]))
        if kind == 3:
            lost.append((f"{far}{mail} {far}name{k}.of@mail {far}", [("email", f"name{k}.of@mail")]))
        if kind == 4:  # what looks alike without a link or a pattern
            lost.append((f"{far}{card(False)} {far}{number(10)} {far}{a}-555-{b} and x@y and {a + 300}.1.2.3 {far}", []))
        if kind == 5:
            lost.append((f"{far}{card(False)} {far} {number(3)} {number(3)} token = \"{number(9)}ab{number(9)}c\"", []))
    return plain, lost


def test_pii_adds_what_patterns_lose(spark, planted):
    plain, lost = planted
    df = spark.createDataFrame([(k, t) for k, t in enumerate(plain + [t for t, _ in lost])], "doc_id long, text string")
    model = pii.fit(df)
    got = {r.doc_id: {(s.kind, r.text[s.start : s.stop]) for s in r.added_spans} for r in pii.find(df, model).collect()}
    right = wanted = found = 0
    for k, (_, want) in enumerate(lost, len(plain)):
        right, wanted, found = right + len(got[k] & set(want)), wanted + len(want), found + len(got[k])
    assert not any(got[k] for k in range(len(plain)))
    assert right >= 0.95 * wanted and right >= 0.95 * found
    # Without skip links the repeated forms are lost.
    alone = {**model, "potentials": [model["potentials"][0], *([[[0.0] * 5] * 5] * 2)]}
    less = {r.doc_id: r.added_spans for r in pii.find(df, alone).collect()}
    assert all(not less[k] for k, (t, w) in enumerate(lost, len(plain)) if w and w[0][0] == "email")
    # What a document gets does not depend on those beside it.
    texts = [t for t, _ in lost]
    assert [pii.all_spans([t], model)[0] for t in texts] == pii.all_spans(texts, model)


def test_pii_fit_does_not_depend_on_partitions(spark, planted):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(planted[0])], "doc_id long, text string")
    assert pii.fit(df.repartition(7)) == pii.fit(df.coalesce(1))


def test_pii_beliefs_on_loops():
    """Loopy beliefs beside exact marginals of small graphs with loops."""
    rng = np.random.default_rng(18)
    for _ in range(60):
        n, k = int(rng.integers(3, 7)), 3
        pairs = [(a, b, int(rng.integers(0, 2))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6]
        unary, potentials = rng.normal(size=(n, k)), 0.5 * rng.normal(size=(2, k, k))
        potentials = (potentials + potentials.transpose(0, 2, 1)) / 2
        want = np.zeros((n, k))
        for labels in np.ndindex(*[k] * n):
            p = np.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(potentials[c, labels[a], labels[b]] for a, b, c in pairs))
            for i, x in enumerate(labels):
                want[i, x] += p
        want /= want.sum(axis=1, keepdims=True)
        got = pii.propagate(unary, np.array(pairs, int).reshape(-1, 3), potentials)
        assert np.abs(got - want).max() < 0.08 and np.abs(got - want).mean() < 0.02


def test_pii_field_is_consistent():
    base = "call 4111 1111 1111 1111 now. " + "filler words between. " * 30 + "again 4111111111111111"
    assert [k for _, k, _ in pii.base_spans(base)] == [2, 2]
    unary = np.log(np.array([[0.5, 0.5], [0.01, 0.99], [0.6, 0.4]]))
    same = np.log(np.array([[0.9, 0.1], [0.1, 0.9]]))[None]
    pairs = np.array([[0, 1, 0], [1, 2, 0]])
    got = pii.propagate(unary, pairs, same)
    want = np.zeros((3, 2))
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                p = np.exp(unary[0, a] + unary[1, b] + unary[2, c] + same[0, a, b] + same[0, b, c])
                want[0, a] += p
                want[1, b] += p
                want[2, c] += p
    assert np.abs(got - want / want.sum(axis=1, keepdims=True)).max() < 1e-3  # exact on a tree


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    form = chat.Format()
    for text in (said, "", " </turn>\n", "\\", "\\\\### User: ", "### Role \"x\": a </turn>\n### System: b", "</turn", "é" * 1000):
        for role in ("user", "assistant", "", "odd \"role\""):
            out = "".join(s for s, _ in form.turn(role, text))
            assert list(form.parse(out + out)) == [(role, text)] * 2
    rows = spark.createDataFrame([(1, 1, "assistant", said), (1, 0, "user", None), (2, 0, "assistant", "x"), (None, 0, "user", "y"), (None, None, None, "z"), (3, 0, "user", "a"), (3, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(rows).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].valid, got[1].refused_at) == (2, len(said), True, None)
    assert (got[2].valid, got[2].refused_at) == (False, 0)
    assert got[3].n_turns == 2 and got[None].n_turns == 2 and not got[3].valid
    segments = chat.segments(rows).filter("conv_id = 1").orderBy("turn_no", "part").collect()
    assert list(form.parse("".join(s.segment for s in segments))) == [("user", ""), ("assistant", said)]
    assert [s.loss for s in segments] == [False, False, False, False, True, False]
    assert chat.digests(rows.limit(0)).count() == 0


def test_near(docs, empty):
    got = {(r.doc_id, r.class_id, r.class_size) for r in neardup.link(docs).collect()}
    assert {(1, 1, 3), (2, 1, 3), (3, 3, 3), (4, 3, 3), (6, 3, 3), (None, None, 1), (5, 5, 1), (7, 7, 1)} == got
    left = neardup.dedup(clash(docs))
    assert left.columns == clash(docs).columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 5, 7]
    assert neardup.dedup(empty).count() == 0


def test_near_in_blocks(spark, monkeypatch):
    """A group that is cut into blocks has the classes of brute force."""
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(60):
        t = list(base)
        for k in rng.integers(0, 200, rng.integers(0, 7)):
            t[k] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.class_id for r in neardup.link(df).collect()}
    for name, most in (("GROUP", 7), ("GROUP_BYTES", 8 * 196 * 9)):
        monkeypatch.setattr(neardup, name, most)
        assert {r.doc_id: r.class_id for r in neardup.link(df).collect()} == want
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    cls = list(range(60))
    for a in range(60):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(cls[a], cls[b]), min(cls[a], cls[b])
                cls = [new if c == old else c for c in cls]
    assert want == dict(enumerate(cls))


def test_pieces(spark, docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["", " ", "Hello  world.\n\tx é 日本 🙂 ", "don't; stop!! <s> <0x0A> 3.14,5", "a" * 500, "▁ is kept ▁▁"]
    codec = pieces.Codec(pieces.vocabulary())
    for t, x in zip(texts, codec.encode(texts)):
        ids = np.frombuffer(x, "<i4")
        assert codec.decode(ids) == t
        if pieces.MARK not in t:
            assert ids.tolist() == library.encode(t)
    out = pieces.tokenised(clash(docs))
    assert out.filter("NOT round_trip").count() == 0 and out.count() == len(ROWS)
    back = pieces.decode(pieces.encode(docs))
    assert pieces.encode(empty).count() == pieces.decode(pieces.encode(empty)).count() == 0
    assert back.filter("decoded = coalesce(text, '')").count() == len(ROWS)
    assert pieces.tokenised(empty).count() == 0


def test_urls(spark):
    rows = [(1, "https://WWW.Example.com/en/x?q#f"), (2, "http://a.example.com/en/1"), (3, "http://b.net/fr/"), (4, "http://b.org/a/b?x"), (5, None), (6, "no scheme"), (7, "x://é.com"), (7, "x://é.com")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("net/fr/", "block")
    assert got[4][:3] == ("b.org", "/a/b", None) and got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7][:3] == ("é.com", "", None)
    few = spark.createDataFrame([(1, "http://b.org/")], "page_id long, url string")
    assert [r.verdict for r in urlfilter.judge(few).collect()] == ["allow"]
    assert urlfilter.judge(few.limit(0)).count() == 0
    assert urlfilter.keep(few.withColumn("host", F.lit("mine"))).columns == ["page_id", "url", "host"]


def test_urls_where_rows_are_many(spark, monkeypatch):
    """A URL of many rows, whose rows are dealt over several tasks, and columns of clashing names."""
    rows = [(k, None if k % 2 else "http://b.org/a") for k in range(50)] + [(99, "http://b.com/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({n: F.lit("mine") for n in ("host", "n_rows", "part", "parts", "score")})
    want = sorted(map(tuple, urlfilter.judge(df).collect()))
    monkeypatch.setattr(urlfilter, "HOT_ROWS", 4)
    assert sorted(map(tuple, urlfilter.judge(df).collect())) == want and len(want) == 51
    assert urlfilter.judge(df).columns == [*df.columns, "host_", "path", "rule", "verdict", "score_"]
    long = spark.createDataFrame([(1, "http://c.org/" + "a/" * 200_000)], "page_id long, url string")
    assert [len(r.path) for r in urlfilter.judge(long).collect()] == [400_001]


def test_clashing_names(spark, docs, empty, labels):
    mine = clash(docs)
    assert quality.score(mine, labels, columns=mine.columns).columns == [*mine.columns, "score_"]
    assert quality.score(empty, labels).count() == 0
    assert pieces.decode(pieces.encode(mine), ids_col="ids_").columns == [*mine.columns, "ids_", "decoded"]
    assert toxicity.score(mine, {"entries": {}, "stems": {}, "weights": None}).columns == [*mine.columns, "toxicity_"]
    turns = spark.createDataFrame([(1, 0, "user", "a " * 300_000), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string").withColumns({n: F.lit("mine") for n in ("n_turns", "segment", "loss", "valid")})
    assert [(r.n_turns, r.loss_chars) for r in chat.digests(turns).collect()] == [(2, 1)] and chat.segments(turns).count() == 6


def test_url_model_learns(spark):
    rows = [(k, f"http://s{k}.com/shop/item{k}") for k in range(60)] + [(100 + k, f"http://s{k}.net/fr/casino{k}") for k in range(60)] + [(300, "http://z.org/shop/item5"), (301, "http://z.org/xx/casino")]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[300], got[301]) == ("allow", "block")


def nearest(ids, x, q, k=10):
    """Ids of the k nearest of query id q by brute force, an id by its nearest vector."""
    d = np.min([np.sqrt(((x - y) ** 2).sum(axis=1)) for y in x[ids == q]], axis=0)
    best = {}
    for i in np.lexsort((ids, d)):
        if ids[i] != q:
            best.setdefault(int(ids[i]), float(d[i]))
    return sorted(best.items(), key=lambda p: (p[1], p[0]))[:k]


def test_nearest(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(400, 16)).round(2)
    v[100], v[200] = v[0], v[0]
    v[301:340] = v[300]  # more copies of a query than it asks for
    ids = np.arange(400)
    ids[[17, 18, 19]] = 0  # an id with several vectors, which is a query
    rows = [(int(k), [float(x) for x in y]) for k, y in zip(ids, v)] + [(5, v[5].tolist()), (500, None), (600, [0.0] * 16), (700, [float("nan")] * 16), (800, [1.0]), (900, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit("mine") for n in ("v", "no", "q", "same", "score", "rank", "block")})
    got = {}
    every = {"tables": 1, "hashes": 1, "probes": 32}  # all buckets: all candidates
    for r in ann.search(df, F.col("vec_id") % 100 == 0, **every).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300}
    for q, found in got.items():
        want = nearest(ids, v, q)
        assert [k for k, _ in found] == [k for k, _ in want]
        assert all(abs(s - d) < 1e-12 for (_, s), (_, d) in zip(found, want))
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    for few in (1, 8):
        own = df.filter((F.col("vec_id") >= 40) & (F.col("vec_id") < 40 + few))
        assert ann.search(own, F.col("vec_id") == 40).count() == min(10, few - 1)
    assert {r.query_id for r in ann.search(df, F.col("vec_id") % 100 == 0).collect()} == {0, 100, 200, 300}


def test_long_words_are_not_remembered():
    """What a worker remembers does not grow with texts without spaces, and these are encoded as ever."""
    import base64

    codec, rng = pieces.Codec(pieces.vocabulary()), np.random.default_rng(4)
    for _ in range(20):
        texts = [base64.b64encode(rng.bytes(15_000)).decode(), "some words " + "漢字" * 3_000, "some words"]
        got = codec.encode(texts)
        assert [codec.decode(np.frombuffer(x, "<i4")) for x in got] == texts
        assert all(len(w) <= pieces.LONG for w in codec.cores) and sum(map(len, codec.cores.values())) < 2_000
    assert codec.encode(texts) == got == pieces.Codec(pieces.vocabulary()).encode(texts)


def test_fewest_of_sorted_sums():
    """The buckets that lose least are those of all combinations of axes, in order."""
    x = ann.units(np.random.default_rng(3).normal(size=(20, 16)))
    got = ann.keys(x, 5, 30, 2)
    sides = []
    for h in range(2):
        r = ann.rotate(x, 10 + h)
        both = np.stack((r, -r), axis=2).reshape(20, -1)
        sides.append((both.max(axis=1, keepdims=True) - both) ** 2)
    total = (sides[0][:, :, None] + sides[1][:, None, :]).reshape(20, -1)
    assert np.allclose(np.take_along_axis(total, got, axis=1), np.sort(total, axis=1)[:, :30])
    assert all(len(set(row)) == 30 for row in got)


def test_nearest_of_whole_table(spark):
    """The production parameters find 0.9 of what brute force finds in sf0.1, by hashing and not by comparing all."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    told: list = []
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, report=told).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    for q in ids[ids % 100 == 0]:
        want = dict(nearest(ids, v, q))
        assert len(got[q]) == 10 and all(abs(got[q][k] - want[k]) < 1e-12 for k in set(want) & set(got[q]))
        hits += len(set(want) & set(got[q]))
    assert hits >= 0.9 * 10 * told[1] and told[2] < 0.5 * told[0] * told[1]


def test_nearest_in_blocks(spark, monkeypatch):
    """Hashing alone, over several blocks and copies, finds most of what brute force finds, with few candidates."""
    monkeypatch.setattr(ann, "BLOCK", 700)
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "SPAN", 2)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 64))
    v = centres[rng.integers(0, 60, 3000)] + 0.25 * rng.normal(size=(3000, 64))
    df = spark.createDataFrame([(k, y.tolist()) for k, y in enumerate(v)], "vec_id long, embedding array<double>")
    told: list = []
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, report=told).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & {k for k, _ in nearest(np.arange(3000), v, q)}) for q in range(0, 3000, 100)]
    assert sum(hits) >= 0.9 * 300 and told[:2] == [3000, 30] and told[2] < 0.25 * 3000 * 30


def test_distances_of_any_size():
    v = np.array([[1e200, 0.0], [3e-200, 4e-200], [3.0, 4.0], [0.0, 0.0], [1.7e308, -1.7e308]])
    got = ann.distances(v, np.zeros(2))
    assert np.allclose(got[:4], [1e200, 5e-200, 5.0, 0.0], rtol=1e-12, atol=0) and got[4] > 1.7e308


def test_rotation_keeps_lengths():
    x = np.random.default_rng(8).normal(size=(5, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.abs(np.linalg.norm(ann.rotate(x.astype(np.float32), 3), axis=1) - 1).max() < 1e-5


def test_toxicity(spark, docs, empty, labels):
    assert [r.toxicity for r in toxicity.score(docs, {"entries": {}, "stems": {}, "weights": None}).collect()] == [0.0] * len(ROWS)
    assert toxicity.clean(clash(docs), labels).columns == clash(docs).columns
    assert toxicity.clean(empty, labels).count() == 0
    rows = [(k, f"{a} word{k} the next, you {'grumpf' if k % 4 == 0 else 'nice'} thing{''.join(chr(97 + int(c)) for c in str(k))}. {a} more", "en", "s", 1) for k in range(400) for a in (f"w{k * 7 % 31}",)]
    df = spark.createDataFrame(rows, DOCS)
    known = df.select("doc_id", F.lit(1).alias("quality"), F.col("text").contains("grumpf").cast("int").alias("toxic"))
    model = toxicity.fit(df, known)
    assert list(model["entries"]) == ["grumpf"]
    wrong = toxicity.score(df, model).filter("(toxicity >= 0.5) != (text LIKE '%grumpf%')").count()
    assert wrong == 0


def test_grammar():
    g = toxicity.Grammar({"oaf": 1.0}, {"blurg": 2.0})
    kinds = lambda t: dict(zip(toxicity.KINDS, (x > 0 for x in g.features(t))))
    assert kinds("an OAF!") == {"plain": True, "negated": False, "reported": False, "aimed": False, "threat": False}
    assert kinds("you oaf")["aimed"] and kinds("not an oaf")["negated"] and kinds("he wrote that one is an oaf")["reported"]
    assert kinds("i kill you")["threat"] and not any(kinds("kill time. you").values())
    assert kinds("blurgish")["plain"] and not any(kinds("loaf").values())
    only = lambda t: [k for k, v in kinds(t).items() if v]
    assert only("I will not kill you") == ["negated"] and only("he said he would kill you") == ["reported"]
    assert only("that one is not an oaf, you know") == ["negated"] and only("an oaf, you know") == ["plain", "aimed"]
    assert only("never kill the time we had before you") == []


def plain_features(text: str, entries: dict, stems: dict) -> list[float]:
    """The same by looking back from each word, without transducers."""
    import math
    import re

    sums = [0.0] * 5
    lists = {w: c for c, ws in (("R", toxicity.REPORTS), ("N", toxicity.NEGATIONS), ("T", toxicity.TARGETS), ("H", toxicity.THREATS)) for w in ws}
    for clause in re.split(r"[.!?;:|\n]+", text.lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        kinds, weights = [], []
        for w in words:
            stem = next((w[:n] for n in range(1, len(w) + 1) if w[:n] in stems), None)
            insult = entries.get(w, stems.get(stem))
            kinds.append("I" if insult is not None else lists.get(w, "O"))
            weights.append(insult if insult is not None else 1.0)

        def weak(i: int) -> int | None:
            if "N" in kinds[max(0, i - 4) : i]:
                return 1
            return 2 if "R" in kinds[:i] else None

        for i, k in enumerate(kinds):
            if k == "I":
                how = weak(i)
                sums[how if how is not None else 3 if "T" in kinds[max(0, i - 4) : i] else 0] += weights[i]
            if k == "T":
                j = next((j for j in range(i - 1, max(-1, i - 5), -1) if kinds[j] in "IHT"), None)
                if j is not None and kinds[j] != "T":
                    how = weak(j)
                    if kinds[j] == "H":
                        sums[4 if how is None else how] += 1.0
                    elif how is None:
                        sums[3] += 1.0
    return [math.log1p(s) for s in sums]


def test_grammar_against_plain_rules():
    rng = np.random.default_rng(15)
    entries, stems = {"oaf": 1.5, "dolt": 0.5}, {"blurg": 2.0, "zak": 1.0}
    words = ["oaf", "dolt", "blurgs", "zakko", "kill", "hurt", "you", "he", "not", "never", "said", "one", "two", "three", "loaf", ".", "!", ";"]
    g = toxicity.Grammar(entries, stems)
    for _ in range(4000):
        t = " ".join(rng.choice(words, rng.integers(0, 25)))
        assert np.allclose(g.features(t), plain_features(t, entries, stems))


def test_toxicity_scores_are_the_plain_ones(spark):
    """The operator's scores of all rows, given its model, are those of the plain rules."""
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model, keep_text=False).collect()}
    *w, rest = model["weights"]
    for r in docs.collect():
        z = rest + float(np.dot(w, plain_features(r.text or "", model["entries"], model["stems"])))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_logistic_is_a_minimum():
    rng = np.random.default_rng(16)
    x = rng.normal(size=(300, 3))
    y = (x @ [2.0, -1.0, 0.5] + rng.normal(size=300) > 1).astype(float)
    w = toxicity.logistic(x, y)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * 300

    def loss(v):
        z = x @ v[:3] + v[3]
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 1e-2 * 3 / 2 * (v[:3] @ v[:3] + 1e-3 * v[3] ** 2)

    assert all(loss(w) <= loss(w + d) for d in 1e-3 * rng.normal(size=(50, 4)))


def test_pipeline(spark, data, docs, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns
        assert stage(spark, empty, data).count() == 0
    out = corpus_pipeline.run(spark, data)
    assert out.filter("NOT round_trip").count() == 0 and out.count() > 0
