"""Entities of token rules against an independent matcher, and spans that point at their texts."""

import itertools
import random
import re

from orrery.functions import tokens
from orrery.plans import registry, retrieval


def coded(words):
    """A letter for each token: which of the tests that the rules of one or more tokens use hold."""
    of = {}
    for k, flags in enumerate(itertools.product((0, 1), repeat=5)):
        of[flags] = chr(0x4E00 + k)
    tests = (lambda t: t.istitle(), lambda t: t.lower() in ("llc", "plc", "pjsc", "inc.", "inc"), tokens.like_number, lambda t: t == "%", tokens.is_currency)
    line = "".join(of[tuple(int(bool(f(t))) for f in tests)] for t in words)
    some = lambda n: "[" + "".join(c for flags, c in of.items() if flags[n]) + "]"
    return line, [("ORG", f"{some(0)}{some(0)}?{some(1)}?"), ("PERCENT", f"{some(2)}{some(3)}"), ("MONEY", f"{some(4)}{some(2)}")]


def brute(text):
    spots = tokens.tokens(text)
    words = [text[a:b] for a, b in spots]
    line, patterns = coded(words)
    rank = ["ORG", "GPE", "PERCENT", "MONEY", "DATE"]
    found = [(n, at, rank.index(label)) for at in range(len(words)) for n in (1, 2, 3) for label, p in patterns if at + n <= len(words) and re.fullmatch(p, line[at : at + n])]
    found += [(1, at, 1) for at, t in enumerate(words) if re.search("UAE|Dubai|Abu Dhabi|KSA|Saudi|Qatar|Bahrain|Oman|Kuwait", t)] + [(1, at, 4) for at, t in enumerate(words) if t.isdigit() and len(t) >= 4]
    kept = []
    for n, at, k in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        if all(at + n <= a or a + m <= at for m, a, _ in kept):
            kept.append((n, at, k))
    return sorted((spots[at][0], spots[at + n - 1][1], rank[k]) for n, at, k in kept)


def test_rules():
    named = lambda t: [(t[a:b], k) for a, b, k in tokens.entities(t)]
    assert named("in 2025 we cut 12% and ten %, or $1,200 for acme") == [("2025", "DATE"), ("12%", "PERCENT"), ("ten %", "PERCENT"), ("$1,200", "MONEY")]
    assert named("by Acme Holdings Inc. of KSA.") == [("Acme Holdings Inc.", "ORG"), ("KSA", "GPE")]
    assert named("€ million, 1/2 %, 3rd %, -4.5 % of -2030 20301") == [("€ million", "MONEY"), ("1/2 %", "PERCENT"), ("3rd %", "PERCENT"), ("-4.5 %", "PERCENT"), ("20301", "DATE")]
    assert tokens.shape("Ab12345.x") == "Xxdddd.x" and tokens.entities("") == [] and tokens.entities(" \n") == []
    assert [t for a, b in tokens.tokens("(Scope 2's co-op, U.A.E.) 15kg 7%") for t in ["(Scope 2's co-op, U.A.E.) 15kg 7%"[a:b]]] == ["(", "Scope", "2", "'", "s", "co-op", ",", "U.A.E", ".", ")", "15kg", "7", "%"]


def test_random_texts():
    rng = random.Random(3)
    parts = ["Acme", "acme", "LLC", "Inc.", "inc", "Dubai", "UAE's", "2030", "12", "1,5", "%", "$", "€", "ten", "Third", "3rd", "-", ".", ",", "'s", "É", "\n", "(", ")", "Abu Dhabi", "x", "+7", "1/4", "²"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) + rng.choice(["", " ", " ", "\t"]) for _ in range(rng.randint(0, 14)))
        spots = tokens.tokens(t)
        assert "".join(t[a:b] for a, b in spots) == "".join(t.split()) and all(a < b <= c for (a, b), (c, _) in zip(spots, [*spots[1:], (len(t), 0)]))
        assert tokens.entities(t) == brute(t)
        for a, b, s in tokens.sentence_spans(t):
            assert t.strip()[a:b] == s


def test_whole_query(spark, data):
    docs = {r.doc_sha256: r.text for r in retrieval.pages(spark, data).collect()}
    found = {}
    for r in registry.QUERIES["doc_entities"](spark, data).collect():
        found.setdefault(r.doc_sha256, set()).add((r.span_start, r.span_end, r.label))
        assert docs[r.doc_sha256][r.span_start : r.span_end] == r.text
    assert found == {k: set(v) for k, t in docs.items() if (v := brute(t or ""))}


def test_a_word_is_looked_at_once():
    """Rules are tried where a word can begin one; what a word begins is remembered, so that repeats cost no test."""
    seen = []

    def is_seven(t):
        seen.append(t)
        return t == "seven"

    rules = (("N", ((is_seven, False),)), ("M", ((lambda t: t == "a", True), (lambda t: t == "b", False))))
    assert tokens.entities("seven a b c " * 50, rules)[:3] == [(0, 5, "N"), (6, 9, "M"), (12, 17, "N")]
    assert len(seen) == 4 + 50  # each word once, and the match itself
