"""Quality classifier (2): regularised quadratic discriminant over document statistics.

Statistics of whole texts (shares of kinds of characters, word and line repetition,
compressibility, entropy) are transformed to be roughly normal. Each class gets its
mean and covariance, shrunk towards the pooled diagonal. The score is a logistic
function of the difference of the classes' Mahalanobis log-densities, computed from
Cholesky factors that are inverted once. The moments are sums over all labelled training
rows, made where the rows are; the driver sees one row per class.

Defined results: a null text counts as empty; an empty text has the statistics of an
empty text and gets a score like any other; a class without labelled rows makes every
score 0.5; repeated rows get equal scores; several labels of an id count separately; a
text of any length is one row; a score of exactly the threshold is of the better class.
Columns of the input may have any names; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import folded_out, renamed, with_columns_of_text, written

STATISTICS = ("words", "letters", "upper", "odd", "stops", "commas", "digits", "word_length", "distinct", "lines", "zipped", "entropy")
#: Share of the pooled diagonal in each class covariance, and least standard deviation.
SHRINK, FLOOR = 0.1, 0.02
#: Log-density differences are divided by this before the logistic function, so that scores do not all end at 0 or 1.
SOFTEN = 4.0

_KINDS = np.zeros((256, 7))
for _at, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".?", b",;:", b" \t\n\v\f\r")):
    _KINDS[list(_bytes), _at] = 1
_KINDS[33:127, 6] = _KINDS[33:127].sum(axis=1) == 0  # what else is printed
_KINDS[list(b"'-\"()"), 6] = 0
_KINDS[0xC2:0xF5, 0] = 1  # the first byte of a letter beyond ASCII


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper, digits, stops, commas, spaces, odd = (counts @ _KINDS).tolist()
    chars = max(1.0, len(text))
    words = text.lower().split()
    n = len(words)
    letters = lower + upper
    lines = [x for x in text.split("\n") if x.strip()]
    p = counts[counts > 0] / max(1, len(raw))
    logit = lambda x: math.log((x + 0.002) / (1.002 - x))
    return [
        math.log1p(n),
        logit(min(1.0, letters / chars)),
        logit(upper / max(1.0, letters)),
        math.sqrt(odd / chars),
        math.sqrt(stops / (n + 1)),
        math.sqrt(commas / (n + 1)),
        math.sqrt(digits / chars),
        math.log1p((chars - spaces) / (n + 1)),
        math.log1p(len(set(words))) / math.log1p(n + 1),
        math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        math.log(len(zlib.compress(raw, 1)) / (len(raw) + 20)),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
    ]


def with_statistics(docs: DataFrame, text_col: str = "text", column: str = "statistics", keep_text: bool = True) -> DataFrame:
    return with_columns_of_text(docs, text_col, f"`{column}` array<double>", lambda: lambda texts: [[statistics(t) for t in texts]], keep_text=keep_text)


def moments(rows: DataFrame, x: str, y: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """By class: number of rows, mean and covariance."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    at = lambda i: F.element_at(x, i + 1)
    sums = [F.sum(at(i)).alias(f"s{i}") for i in range(d)] + [F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for r in rows.filter(F.col(y).isin(0, 1)).groupBy(y).agg(F.count("*").alias("n"), *sums).collect():
        n, mean, cov = r["n"], np.array([r[f"s{i}"] for i in range(d)]) / r["n"], np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / n - mean[i] * mean[j]
        out[int(r[y])] = (float(n), mean, cov)
    return out


def fit(rows: DataFrame, x: str = "statistics", y: str = "quality") -> dict | None:
    """The discriminant: by class the mean, the inverse Cholesky factor and the constant; None without both classes."""
    found = moments(rows, x, y)
    if set(found) != {0, 1}:
        return None
    total = sum(n for n, _, _ in found.values())
    pooled = sum(n * np.diag(c) for n, _, c in found.values()) / total
    model = {}
    for k, (n, mean, cov) in found.items():
        shrunk = (1 - SHRINK) * cov + np.diag(SHRINK * np.maximum(pooled, FLOOR**2) + FLOOR**2)
        chol = np.linalg.cholesky(shrunk)
        model[k] = {"mean": mean.tolist(), "inverse": np.linalg.inv(chol).tolist(), "constant": math.log(n / total) - float(np.log(np.diag(chol)).sum())}
    return model


def density(x: str, part: dict) -> Column:
    """The class's log-density up to a constant that both share."""
    d = len(STATISTICS)
    centred = F.zip_with(F.col(x), F.array(*[F.lit(m) for m in part["mean"]]), lambda a, b: a - b)
    rows = F.array(*[F.array(*[F.lit(v) for v in row]) for row in part["inverse"]])
    dots = F.transform(rows, lambda row: F.aggregate(F.zip_with(row, centred, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    assert len(part["mean"]) == d
    return F.lit(part["constant"]) - F.aggregate(dots, F.lit(0.0), lambda s, v: s + v * v) / 2


def difference(model: dict, x: str = "statistics") -> Column:
    return (density(x, model[1]) - density(x, model[0])) / SOFTEN


def calibrated(rows: DataFrame, model: dict, x: str = "statistics", y: str = "quality") -> float:
    """The difference that parts the classes: midway between the tails that face each other."""
    tails = {0: 0.999, 1: 0.001}
    got = rows.filter(F.col(y).isin(0, 1)).withColumn("z", difference(model, x)).groupBy(y).agg(*[F.percentile_approx("z", q, 100_000).alias(f"t{k}") for k, q in tails.items()]).collect()
    found = {r[y]: r[f"t{r[y]}"] for r in got}
    return (found[0] + found[1]) / 2


def score(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """The given columns of docs (default: the id) and a score. Learns from labels whose id is not held out."""
    (x, s) = renamed(docs, "statistics", "score")
    seen = written(with_statistics(docs, text_col, x, keep_text=text_col in (columns or [])).select(*(columns or [id_col]), x))
    train = labels.filter(~folded_out(F.col("doc_id"), 3, 1)).select(F.col("doc_id").alias("labelled_id"), "quality")
    rows = seen.join(train, F.col(id_col) == F.col("labelled_id")).select(x, "quality")
    model = fit(rows, x)
    if model is None:
        return seen.withColumn(s, F.lit(0.5)).drop(x)
    z = difference(model, x) - F.lit(calibrated(rows, model, x))
    return seen.withColumn(s, 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-700.0)), F.lit(700.0))))).drop(x)
