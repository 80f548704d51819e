"""Personal data (3): fixed patterns, completed by a skip-chain conditional random field.

The patterns give base spans. They and all other tokens with a digit or an @ are the nodes
of a random field over each document, and so are runs of tokens that read on like a phone
number, which a base pattern loses where more digits follow. Neighbours in the text share
a chain potential. Distant nodes that repeat each other (same letters and digits, or same
last ten digits) or resemble each other (same last seven digits, same name before an @) share a skip
potential: every occurrence is linked to the first one, so a token that occurs n times has
n - 1 links. Loopy message passing, with base spans held fixed, makes labels consistent;
nodes whose belief in a kind reaches CONFIDENT become additional spans. Every document is
passed the same number of rounds, so its spans do not depend on what is read beside it.

Training covers all documents. Base spans are labels; other nodes count as none, but for
those that are hidden: ones that are linked to a base span, or stand in a run, of which the
patterns cannot tell. Weights of shapes and of both kinds of links are fitted jointly, by
pseudo-likelihood: a softmax of a node's label given its shape and its neighbours' labels.
Only counts of distinct shapes with neighbours leave the executors; there are as many as
shapes, whatever the input. Where links are rare in the data their weights stay near PRIOR.

Whole texts are read, in time linear in their length. Defined results: a null text is
empty and has no spans; a text of any length is one row; positions are code points; repeated
rows get equal results; without any node nothing is added to the base spans. Columns of the
input may have any names; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import blocks, renamed, with_columns_of_text

KINDS = ("email", "ip", "card", "phone")
LABELS = (None, *KINDS)
ROUNDS, DAMP, CONFIDENT = 12, 0.3, 0.9
#: Kinds of links, and the log-odds of equal labels that their fit starts from and is drawn to.
CHAIN, REPEAT, RESEMBLE = range(3)
PRIOR = (0.0, 14.0, 12.0)
#: Neighbours of one kind and label that count in the fit.
COUNTED = 2

# Possessive, so that no text takes more than linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\s,;]*[0-9@][^\s,;]*")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[-1::-2]]
    even = [2 * int(c) for c in digits[-2::-2]]
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if (m := DOMAIN.match(text, at)) and at > end:
            start = at
            while start > end and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
                start -= 1
            if start < at:
                out.append((start, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order of start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


def shape(s: str) -> list[int]:
    """What a node looks like, whatever the patterns say of it."""
    digits = NOT_DIGIT.sub("", s)
    n, parts = len(digits), s.split(".")
    name, at, domain = s.partition("@")
    return [
        1,
        int(bool(at and name and domain)),
        int("." in domain.strip(".")),
        int(n == 0),
        int(1 <= n <= 5),
        int(6 <= n <= 9),
        int(10 <= n <= 13),
        int(14 <= n <= 19),
        int(n >= 20),
        int(len(parts) == 4 and n == len(s) - 3 and all(len(p) <= 3 and int(p or 256) <= 255 for p in parts)),
        int(14 <= n <= 19 and not any(c.isalpha() for c in s) and luhn(digits)),
        int(s[:1] == "+"),
        int(s[:1] == "+" and 10 <= n <= 15),
        int(any(c.isalpha() for c in s)),
        int(n == len(s)),
        int("=" in s or '"' in s),
    ]


SHAPES = len(shape(""))


def nodes(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """(start, end, label, in a run) of base spans and of what else has a digit or an @; label -1: not known.

    Tokens with digits that stand a space apart are a run. One that begins with + or ( and
    gets ten to fifteen digits by those that follow is a node with them, the fewest that do.
    """
    out = [(s, e, k + 1, False) for s, k, e in spans]
    if not (spans or "@" in text or DIGIT.search(text)):
        return out
    held, last, tokens = sorted((s, e) for s, _, e in spans), 0, []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while s < e and not (text[s].isalnum() or text[s] in "+("):
            s += 1
        while s < e and not text[e - 1].isalnum():
            e -= 1
        while last < len(held) and held[last][1] <= s:
            last += 1
        if s < e and not any(a < e and s < b for a, b in held[max(0, last - 1) : last + 4]):
            tokens.append((s, e))
    k = 0
    while k < len(tokens):
        stop = k + 1
        while stop < len(tokens) and tokens[stop][0] - tokens[stop - 1][1] <= 2 and not any(c.isalnum() for c in text[tokens[stop - 1][1] : tokens[stop][0]]):
            stop += 1
        run = stop - k > 1 or any(0 <= s - tokens[stop - 1][1] <= 1 for s, _ in held[max(0, last - 1) : last + 1])
        while k < stop:
            s, end, n = tokens[k][0], k, 0
            if text[s] in "+(":
                while end < stop and n < 10 and not any(c.isalpha() for c in text[tokens[end][0] : tokens[end][1]]):
                    n += len(NOT_DIGIT.sub("", text[tokens[end][0] : tokens[end][1]]))
                    end += 1
            if not 10 <= n <= 15:
                end = k + 1
            out.append((s, tokens[end - 1][1], -1, run))
            k = end
    return sorted(out)


def links(text: str, found: list[tuple[int, int, int, bool]], first: int = 0) -> list[tuple[int, int, int]]:
    """(node, node, kind of link), numbered from first. Each occurrence is linked to the first one."""
    out, seen = [], {}
    for i, (s, e, _, _) in enumerate(found):
        if i and s - found[i - 1][1] <= 40:
            out.append((first + i - 1, first + i, CHAIN))
        word = text[s:e].lower()
        digits = NOT_DIGIT.sub("", word)
        keys = {("word", "".join(filter(str.isalnum, word))): REPEAT}
        if len(digits) >= 7:
            keys |= {("digits", digits[-10:]): REPEAT, ("tail", digits[-7:]): RESEMBLE}  # a country code may be left out
        if "@" in word and word[0] != "@":
            keys["name", word.split("@")[0]] = RESEMBLE
        kinds: dict[int, int] = {}
        for k, kind in keys.items():
            if k in seen:
                kinds[seen[k]] = min(kind, kinds.get(seen[k], kind))
            else:
                seen[k] = first + i
        out += [(a, first + i, kind) for a, kind in sorted(kinds.items())]
    return out


def propagate(unary: np.ndarray, pairs: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Beliefs of loopy sum-product message passing. unary: nodes x labels; pairs: (a, b, kind); potentials: kind x labels x labels, all logs."""
    n, k = unary.shape

    def norm(x):
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    if not len(pairs):
        return np.exp(norm(unary))
    a, b, kind = pairs.T
    source, target = np.r_[a, b], np.r_[b, a]
    table = np.concatenate([potentials[kind], potentials[kind].transpose(0, 2, 1)])
    back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
    message = np.full((len(source), k), -math.log(k))
    for _ in range(ROUNDS):  # as many for every document
        belief = unary.copy()
        np.add.at(belief, target, message)
        out = (belief[source] - message[back])[:, :, None] + table
        top = out.max(axis=1, keepdims=True)
        new = norm((top + np.log(np.exp(out - top).sum(axis=1, keepdims=True)))[:, 0, :])
        message = norm(DAMP * message + (1 - DAMP) * new)
    belief = unary.copy()
    np.add.at(belief, target, message)
    return np.exp(norm(belief))


def all_spans(texts: list[str], model: dict | None) -> list[tuple[list, list]]:
    """Of each text the base spans and the ones that the field adds, as (start, kind, end)."""
    base = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    if model is not None:
        where, found, pairs = [], [], []
        for i, (t, spans) in enumerate(zip(texts, base)):
            own = nodes(t, spans)
            if any(label < 0 for _, _, label, _ in own):  # else there is nothing to decide
                pairs += links(t, own, len(found))
                where += [i] * len(own)
                found += own
        if found:
            weights = np.array(model["weights"])
            unary = np.array([shape(texts[i][s:e]) for i, (s, e, _, _) in zip(where, found)]) @ weights.T
            label = np.array([x for _, _, x, _ in found])
            known = label >= 0
            unary[known] = -30.0
            unary[known, label[known]] = 0.0
            belief = propagate(unary, np.array(pairs, int).reshape(-1, 3), np.array(model["potentials"]))
            best = belief.argmax(axis=1)
            for j in np.flatnonzero(~known & (best > 0) & (belief.max(axis=1) >= CONFIDENT)):
                s, e, _, _ = found[j]
                added[where[j]].append((s, int(best[j]) - 1, e))
    return list(zip(base, added))


def softmax_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, ridge: float = 1e-5, steps: int = 4_000) -> np.ndarray:
    """Weights, classes x features, by accelerated gradient descent; the ridge draws them to where they start."""
    w = z = start.copy()
    weight = weight / weight.sum()
    hot, t = np.eye(len(start))[y], 1.0
    rate = 1 / (0.5 * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + ridge)
    for _ in range(steps):
        s = x @ z.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = z - rate * (((p - hot) * weight[:, None]).T @ x + ridge * (z - start))
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (old - 1) / t * (new - w), new
    return w


def examples(text: str) -> list[tuple[bytes, int]]:
    """Of each node that is not hidden its shape with its neighbours' labels, and its label."""
    own = nodes(text, base_spans(text))
    if not own:
        return []
    pairs = links(text, own)
    label = [max(0, x) for _, _, x, _ in own]
    hidden = [x < 0 and run for _, _, x, run in own]
    for a, b, kind in pairs:
        if kind != CHAIN and (own[a][2] < 0) != (own[b][2] < 0):
            hidden[a if own[a][2] < 0 else b] = True
    beside = [[0] * (len(PRIOR) * len(LABELS)) for _ in own]
    for a, b, kind in pairs:
        for i, j in ((a, b), (b, a)):
            if not hidden[j]:
                at = kind * len(LABELS) + label[j]
                beside[i][at] = min(COUNTED, beside[i][at] + 1)
    return [(bytes([*shape(text[s:e]), *beside[i]]), label[i]) for i, (s, e, _, _) in enumerate(own) if not hidden[i]]


def _counts(batches):
    import pyarrow as pa

    for batch in batches:
        for part in blocks(batch, 0) if batch.num_rows else ():
            found = Counter(x for t in part.column(0).to_pylist() if t for x in examples(t))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["x", "y", "n"])


def fit(docs: DataFrame, text_col: str = "text") -> dict | None:
    """The field's weights from all documents, labelled by their base spans; None without a node."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_counts, "x binary, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).orderBy("x", "y").collect()  # a row for each shape
    if not rows:
        return None
    k = len(LABELS)
    start = np.zeros((k, SHAPES + len(PRIOR) * k))
    for kind, odds in enumerate(PRIOR):
        start[:, SHAPES + kind * k : SHAPES + (kind + 1) * k] = odds * np.eye(k)
    w = softmax_fit(np.array([list(r["x"]) for r in rows], float), np.array([r["y"] for r in rows]), np.array([r["n"] for r in rows], float), start)
    both = w[:, SHAPES:].reshape(k, len(PRIOR), k).transpose(1, 0, 2)
    return {"weights": w[:, :SHAPES].tolist(), "potentials": ((both + both.transpose(0, 2, 1)) / 2).tolist()}


def find(docs: DataFrame, model: dict | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs (without the text unless it is kept) with two arrays of structs (kind, start, stop): base spans and added ones.

    They are named base_spans and added_spans, with _ after names that docs has (see common.renamed).
    """
    base, added = renamed(docs, "base_spans", "added_spans")

    def of():
        def structs(spans):
            return [{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in sorted(spans)]

        def work(texts):
            found = all_spans(texts, model)
            return [[structs(b) for b, _ in found], [structs(a) for _, a in found]]

        return work

    kind = "array<struct<kind:string,start:long,stop:long>>"
    return with_columns_of_text(docs, text_col, f"`{base}` {kind}, `{added}` {kind}", of, keep_text=keep_text)


def masked(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """docs with the text of each span replaced by its kind in angle brackets. Columns as in docs."""
    (name,) = renamed(docs, "masked_text")

    def of():
        def one(text: str, spans) -> str:
            out, at = [], 0
            for s, k, e in sorted(spans):
                if s >= at:
                    out += [text[at:s], f"<{KINDS[k]}>"]
                at = max(at, e)
            return "".join(out) + text[at:]

        return lambda texts: [[one(t, b + a) for t, (b, a) in zip(texts, all_spans(texts, model))]]

    out = with_columns_of_text(docs, text_col, f"`{name}` string", of)
    return out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col(name))).select(*docs.columns)
