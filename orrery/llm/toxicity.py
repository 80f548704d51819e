"""Toxicity (10): a weighted finite-state pattern grammar over clauses.

Five small transducers read a clause's tokens by class: insults, threats, targets,
negation and reported speech. Their product is built once, over reachable states; its
output on a token says what kind of attack a match is: plain, aimed at a target,
negated or only reported. Negation and report stay with the attack that they came before
until the token that completes it (a threat needs its target, and a target may follow an
insult). A document's score is a logistic function of the weighted outputs of its clauses,
so matches in a clause count, not words alone.

What is learned from labelled rows: the insult acceptor (whole words, and stems that
take many endings), the weight of each of its entries, and the weight of each output.
Fitting uses at most MAX_TOXIC and MAX_CLEAN labelled rows, those with the smallest
hashes, and of equal texts one; the lexicon holds all that this sample bears out. The
lists of function words are fixed.

Defined results: a null or empty text has no clause and gets the score of the intercept
alone; a text of any length is one document, whose matches count by their logarithm;
repeated rows get equal scores; an id with several labels counts as toxic if one says so;
with no toxic or no clean labelled row nothing can be learned and all scores are 0;
documents without a label only get a score; a score of exactly the threshold is toxic.
Columns of the input may have any names; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import cache, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import blocks, folded_out, renamed, with_columns_of_text, written

#: Most labelled rows of each class that a fit looks at.
MAX_TOXIC, MAX_CLEAN = 4_000, 12_000
#: Tokens over which a negation or a target reaches.
REACH = 4
#: An entry's share of toxic documents must be this high, and this improbable by chance (natural log).
PRECISION, EVIDENCE = 0.9, math.log(1e6)
#: Largest intercept: a document in which nothing matches is never called toxic.
NO_MATCH = -1.0

#: Fixed word lists in English, French, German and Spanish.
TARGETS = "you your yours yourself he she they them him her tu toi vous il elle ils elles du dich dir ihr euch er sie usted ustedes ellos ellas tú ti".split()
NEGATIONS = "not no never neither nor without cannot ne pas jamais sans aucun nicht kein keine nie niemals ohne nunca jamás sin ningún".split()
REPORTS = "said says say called calls told wrote writes quoted quote claimed dit disait écrit appelé sagte sagt schrieb nannte dijo dice escribió llamó".split()
THREATS = "kill murder hurt destroy beat burn tuer détruire frapper töten zerstören schlagen matar destruir golpear".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
CLAUSE = re.compile(r"[.!?;:|\n]+")
TOKEN = re.compile(r"[^\W\d_]+")


# Transducers: (start, step), where step(state, class) gives (state, output or "").
def insults():
    return 0, lambda s, c: (0, "insult" if c == INSULT else "")


def negations():
    """A negation shortly before an attack; it holds for the target that completes the attack, too."""

    def step(s, c):
        near, attack = s
        if c in (INSULT, THREAT):
            return (max(0, near - 1), REACH if near else 0), "negated" if near else ""
        if c == TARGET:
            return (max(0, near - 1), 0), "negated" if attack else ""
        return (REACH if c == NEGATION else max(0, near - 1), max(0, attack - 1)), ""

    return (0, 0), step


def reports():
    """A report anywhere before an attack in the clause; it holds for the target that completes the attack, too."""

    def step(s, c):
        told, attack = s
        if c in (INSULT, THREAT):
            return (told, REACH if told else 0), "reported" if told else ""
        if c == TARGET:
            return (told, 0), "reported" if attack else ""
        return (int(told or c == REPORT), max(0, attack - 1)), ""

    return (0, 0), step


def targets():
    """A target shortly before an insult, or shortly after it."""

    def step(s, c):
        near, attack = s
        said = "aimed" if (c == INSULT and near) or (c == TARGET and attack) else ""
        return (REACH if c == TARGET else max(0, near - 1), REACH if c == INSULT else 0 if c == TARGET else max(0, attack - 1)), said

    return (0, 0), step


def threats():
    """A threat counts once its target follows; an insult in between takes the target."""

    def step(s, c):
        return REACH if c == THREAT else 0 if c in (TARGET, INSULT) else max(0, s - 1), "threat" if s and c == TARGET else ""

    return 0, step


def compose(machines: Iterable):
    """The product of transducers over reachable states: next states and outputs by (state, class)."""
    machines = [m() for m in machines]
    first = tuple(m[0] for m in machines)
    numbers, todo, moves, outputs = {first: 0}, [first], [], []
    for state in todo:
        row, said = [], []
        for c in range(6):
            steps = [step(s, c) for s, (_, step) in zip(state, machines)]
            to = tuple(s for s, _ in steps)
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
            said.append(frozenset(o for _, o in steps if o))
        moves.append(row)
        outputs.append(said)
    return moves, outputs


@cache
def product():
    """The grammar's product: next states and kinds of outputs."""
    moves, outputs = compose((insults, negations, reports, targets, threats))
    return moves, [[kind_of(o) for o in row] for row in outputs]


#: What the outputs of the product count as.
KINDS = ("plain", "negated", "reported", "aimed", "threat")


def kind_of(said: frozenset) -> int | None:
    """An output's kind; negation and report weaken an attack before its target strengthens it."""
    weak = 1 if "negated" in said else 2 if "reported" in said else None
    if "threat" in said:
        return 4 if weak is None else weak
    if "insult" in said:
        return weak if weak is not None else 3 if "aimed" in said else 0
    # A target that follows an insult adds to it, but not to one that is denied or only told.
    return 3 if "aimed" in said and weak is None else None


def automaton(words: Iterable[str]):
    """One automaton for all words: a text is read once, however many there are."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for w in words:
        made.add_word(w, 0)
    made.make_automaton()
    return made


def met(needles, text: str) -> bool:
    return next(needles.iter(text), None) is not None


class Grammar:
    """The product transducer with a lexicon: features of a text."""

    def __init__(self, entries: dict[str, float], stems: dict[str, float]):
        self.entries, self.stems = entries, stems
        self.classes = {w: c for c, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}
        self.needles = automaton([*entries, *stems, *THREATS])
        self.lengths = sorted({len(s) for s in stems})
        self.moves, self.kinds = product()

    def token(self, w: str) -> tuple[int, float]:
        if w in self.entries:
            return INSULT, self.entries[w]
        for n in self.lengths:
            if w[:n] in self.stems:
                return INSULT, self.stems[w[:n]]
        return self.classes.get(w, OTHER), 1.0

    def features(self, text: str) -> list[float]:
        """The weight of all matches by kind, damped: the logarithm of one more."""
        low, sums = text.lower(), [0.0] * len(KINDS)
        if met(self.needles, low):
            for clause in CLAUSE.split(low):
                if met(self.needles, clause):
                    state = 0
                    for w in TOKEN.findall(clause):
                        c, weight = self.token(w)
                        kind = self.kinds[state][c]
                        state = self.moves[state][c]
                        if kind is not None:
                            sums[kind] += weight
        return [math.log1p(s) for s in sums]


def sample(docs: DataFrame, labels: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of the labelled training rows with the smallest hashes, at most MAX_TOXIC and MAX_CLEAN; equal texts once."""
    rows = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~folded_out(F.col("doc_id"), 5, 0))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    pick = lambda y, n: rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
    few = pick(1, MAX_TOXIC).unionByName(pick(0, MAX_CLEAN)).withColumnRenamed("doc_id", "labelled_id")
    # At most MAX_TOXIC + MAX_CLEAN pairs of numbers.
    rows = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")).join(F.broadcast(few), F.col("own_id") == F.col("labelled_id"))
    return rows.groupBy("text").agg(F.max("y").cast("int").alias("y"))


def _terms(batches):
    """Counts of documents by term and class, summed within a batch: words, and stems of 3 to 6 letters."""
    import pyarrow as pa

    for batch in batches:
        for part in blocks(batch, 0) if batch.num_rows else ():
            counts: dict[tuple[str, int], int] = {}
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ws = set(TOKEN.findall((text or "").lower()))
                for t in {f"w{w}" for w in ws} | {f"s{w[:k]}" for w in ws for k in range(3, 7) if len(w) >= k}:
                    counts[t, y] = counts.get((t, y), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "y", "n"])


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that mark toxic rows, with log-odds as weights."""
    total = {x["y"]: x["count"] for x in rows.groupBy("y").count().collect()}
    if not total.get(1) or not total.get(0):
        return {}, {}
    base = total[1] / (total[0] + total[1])
    counts = rows.mapInArrow(_terms, "term string, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    counts = written(counts.filter("a >= 2"))
    share = F.col("a") / (F.col("a") + F.col("b"))
    log_or_0 = lambda c: F.when(c > 0, F.log(c)).otherwise(0.0)
    told = (F.col("a") * log_or_0(share / base) + F.col("b") * log_or_0((1 - share) / (1 - base))).alias("told")
    best = counts.filter((share >= PRECISION) & (told >= EVIDENCE)).collect()  # each in ten or more of the sample's toxic texts
    odds = lambda a, b: math.log((a + 0.5) / (b + 0.5) * total[0] / total[1])
    words = {x["term"][1:]: (x["a"], x["b"]) for x in best if x["term"][0] == "w"}
    stems = {x["term"][1:]: (x["a"], x["b"]) for x in best if x["term"][0] == "s"}
    if not stems:
        return varied(rows, words, {}, base, odds)
    # A stem needs several endings, none of which stands for most of it.
    heads = [F.substring("word", 1, k) for k in range(3, 7)]
    ends = counts.filter("term LIKE 'w%'").select(F.expr("substring(term, 2)").alias("word"), "a").withColumn("stem", F.explode(F.array_distinct(F.array(*heads)))).filter(F.col("stem").isin(list(stems)))
    ends = {x["stem"]: (x["n"], x["top"]) for x in ends.groupBy("stem").agg(F.count("*").alias("n"), F.max("a").alias("top")).collect()}
    good = {s: x for s, x in stems.items() if ends.get(s, (0, 0))[0] >= 4 and ends[s][1] < 0.6 * x[0]}
    chosen = {}
    for s in sorted(good, key=len):
        if any(s[:k] in good for k in range(3, len(s))):
            continue  # reached from the shorter one
        while longer := [c for c in good if len(c) == len(s) + 1 and c.startswith(s) and good[c][0] >= 0.9 * good[s][0]]:
            s = max(longer, key=lambda c: good[c][0])
        chosen[s] = good[s]
    return varied(rows, {w: x for w, x in words.items() if not any(w.startswith(s) for s in chosen)}, chosen, base, odds)


def varied(rows: DataFrame, words: dict, stems: dict, base: float, odds) -> tuple[dict[str, float], dict[str, float]]:
    """Those of the words and stems that stand in enough different contexts.

    Copies of one toxic document make all its words look toxic, but there each stands
    between the same words. So evidence is told again with no more toxic rows than there
    are different pairs of neighbours of the entry in them.
    """
    entries = [(w, False, *x) for w, x in words.items()] + [(s, True, *x) for s, x in stems.items()]
    at = {(w, is_stem): k for k, (w, is_stem, _, _) in enumerate(entries)}

    def found():
        def of(text: str) -> list[str]:
            ws = TOKEN.findall(text.lower())
            return sorted({f"{at[t]} {before} {w} {after}" for before, w, after in zip(["", *ws], ws, [*ws[1:], ""]) for t in ((w, False), *((w[:k], True) for k in range(3, 7))) if t in at})

        return lambda texts: [[of(t) for t in texts]]

    hits = with_columns_of_text(rows.filter("y = 1"), "text", "hits array<string>", found).select(F.explode("hits").alias("hit")).distinct()
    contexts = {x["k"]: x["count"] for x in hits.groupBy(F.substring_index("hit", " ", 1).cast("int").alias("k")).count().collect()}  # a row for each entry

    def stands(k: int) -> bool:
        a, b = min(entries[k][2], contexts.get(k, 0)), entries[k][3]
        share = a / max(1, a + b)
        return share > base and a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0.0) >= EVIDENCE

    weigh = lambda stem: {w: odds(a, b) for k, (w, is_stem, a, b) in enumerate(entries) if is_stem == stem and stands(k)}
    return weigh(False), weigh(True)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights and intercept by Newton's method, classes weighed alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    penalty = ridge * len(y) * np.r_[np.ones(x.shape[1] - 1), 1e-3] / 100
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        d = np.linalg.solve(h, g)
        w -= d / max(1.0, np.abs(d).max())
        if np.abs(d).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: the lexicon and the weights of KINDS with an intercept."""
    rows = written(sample(docs, labels, id_col=id_col, text_col=text_col))
    entries, stems = learn_lexicon(rows)

    def features():
        grammar = Grammar(entries, stems)
        return lambda texts: [[grammar.features(t) for t in texts]]

    got = with_columns_of_text(rows, "text", "x array<double>", features).select("y", "x").collect()  # at most MAX_TOXIC + MAX_CLEAN rows
    y = np.array([r["y"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return {"entries": {}, "stems": {}, "weights": None}
    x = np.array([r["x"] for r in got], float)
    # Kinds of insults are fitted as differences from insults as such: where rows do not
    # show that negation or report excuses one, it counts like any other.
    w = logistic(np.column_stack([x[:, :4].sum(axis=1), x[:, 1:]]), y)
    weights = [w[0], w[0] + w[1], w[0] + w[2], w[0] + w[3], w[4], min(w[5], NO_MATCH)]
    return {"entries": entries, "stems": stems, "weights": [float(v) for v in weights]}


def score(docs: DataFrame, model: dict, text_col: str = "text", column: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs (without the text unless it is kept) with a column of scores from 0 to 1."""
    (name,) = [column] if column else renamed(docs, "toxicity")

    def scores():
        grammar, w = Grammar(model["entries"], model["stems"]), model["weights"]

        def of(text: str) -> float:
            if w is None:
                return 0.0
            z = w[-1] + reduce(lambda s, p: s + p[0] * p[1], zip(w, grammar.features(text)), 0.0)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return lambda texts: [[of(t) for t in texts]]

    return with_columns_of_text(docs, text_col, f"`{name}` double", scores, keep_text=keep_text)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that score the threshold or more. Columns as in docs."""
    (name,) = renamed(docs, "toxicity")
    return score(docs, fit(docs, labels, id_col, text_col), text_col, column=name).filter(F.col(name) < threshold).select(*docs.columns)
