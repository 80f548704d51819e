"""Near dedup against counts that share nothing with it: multiset Jaccard of runs of words."""

from collections import Counter

import numpy as np

from orrery.llm import neardup


def jaccard(a: str, b: str) -> float:
    x, y = (Counter(zip(*(t.split()[k:] for k in range(5)))) for t in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def test_near_of_texts_with_and_without_repeats(spark):
    """Near copies of which only one repeats a run of words are in one class."""
    rng = np.random.default_rng(14)
    texts = []
    for group in range(12):
        words = [f"g{group}w{k}" for k in range(120 + 10 * group)]
        texts += [" ".join(words), " ".join(words + words[40 : 46 + group]), " ".join(words + words[:7] + words[:7])]
        words[int(rng.integers(len(words)))] = "changed"
        texts.append(" ".join(words))
    assert 0.8 < min(jaccard(texts[0], t) for t in texts[1:4])
    cls = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8:
                old, new = max(cls[a], cls[b]), min(cls[a], cls[b])
                cls = [new if c == old else c for c in cls]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.link(df).collect()} == dict(enumerate(cls))


def test_dedup_where_ids_repeat(spark):
    """Each class keeps one row, also where its id, or no id, is that of rows of other classes."""
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(60))
    rows = [(None, text(k)) for k in range(6)] + [(None, text(0) + " more"), (None, text(1)), (None, None), (None, "")]
    rows += [(3, text(7) + " and"), (7, text(7)), (7, text(8)), (7, text(8)), (9, text(8) + " and"), (9, text(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [(r.doc_id, (r.text or "").split()[:1]) for r in neardup.dedup(docs).collect()]
    want = [(None, [f"t{k}w0"]) for k in range(6)] + [(None, []), (3, ["t7w0"]), (7, ["t8w0"]), (9, ["t9w0"])]
    assert sorted(left, key=str) == sorted(want, key=str)
