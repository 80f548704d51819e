"""Evaluation: retrieval, causal fit, change ranking, service metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.core import numbered

LABELS = ("entailment", "neutral", "contradiction")


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def citation_scores(items: DataFrame) -> DataFrame:
    """items with hits, n_pred, n_gold, precision, recall and f1 of their citation sets."""
    pred, gold = F.array_distinct(F.coalesce("citations_pred", F.array().cast("array<string>"))), F.array_distinct(F.coalesce("citations_gold", F.array().cast("array<string>")))
    rows = items.withColumns({"hits": F.size(F.array_intersect(pred, gold)), "n_pred": F.size(pred), "n_gold": F.size(gold)})
    both = (F.col("n_pred") == 0) & (F.col("n_gold") == 0)
    share = lambda n: F.when(both, F.lit(1.0)).when(F.col(n) == 0, F.lit(0.0)).otherwise(F.col("hits") / F.col(n))
    rows = rows.withColumns({"precision": share("n_pred"), "recall": share("n_gold")})
    return rows.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def citation_metrics(items: DataFrame) -> DataFrame:
    """Micro and macro precision, recall and f1, four digits. Nothing predicted or wanted at all: 1; no items: macro 0."""
    of = lambda n: F.when(F.coalesce(F.sum(n), F.lit(0)) > 0, F.sum("hits") / F.sum(n)).otherwise(F.lit(1.0))
    out = citation_scores(items).agg(
        F.count("*").alias("items"), of("n_pred").alias("micro_precision"), of("n_gold").alias("micro_recall"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    )
    out = out.withColumn("micro_f1", _f1(F.col("micro_precision"), F.col("micro_recall")))
    return out.select("items", *[F.round(c, 4).alias(c) for c in out.columns if c != "items"])


def nli_accuracy(pairs: DataFrame) -> DataFrame:
    """Share of right predictions among pairs whose gold label is one of LABELS."""
    return pairs.filter(F.col("gold").isin(*LABELS)).agg(F.round(F.coalesce(F.avg((F.col("gold") == F.col("pred")).cast("double")), F.lit(0.0)), 4).alias("nli_accuracy"))


def rmse(true: Column, pred: Column) -> Column:
    """Over the shorter length; a pair that is no number counts 0; empty: NaN."""
    n = F.least(F.size(true), F.size(pred))
    pairs = F.zip_with(F.slice(true, F.lit(1), n), F.slice(pred, F.lit(1), n), lambda a, b: F.coalesce((a - b) * (a - b), F.lit(0.0)))
    return F.when(n > 0, F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / n)).otherwise(F.lit(float("nan")))


def causal_metrics(items: DataFrame) -> DataFrame:
    """Mean rise of the error after the policy over before, and the share of assets where it fell."""
    rows = items.select("asset_id", rmse(F.col("pre.y_true"), F.col("pre.y_pred")).alias("pre"), rmse(F.col("post.y_true"), F.col("post.y_pred")).alias("post"))
    delta = F.col("post") - F.col("pre")
    fine = ~F.isnan(delta)
    return rows.agg(F.count("*").alias("assets"), F.round(F.avg(F.when(fine, delta)), 4).alias("delta_rmse_mean"), F.round(F.count_if(fine & (delta < 0)) / F.count_if(fine), 4).alias("improved_fraction"))


def causal_metrics_of_rows(rows: DataFrame) -> DataFrame:
    """causal_metrics from a row for each asset and day: asset_id, post (after the policy), y_true, y_pred. No series is gathered."""
    gap = F.coalesce((F.col("y_true") - F.col("y_pred")) * (F.col("y_true") - F.col("y_pred")), F.lit(0.0))
    each = rows.groupBy("asset_id").agg(F.sqrt(F.avg(F.when(~F.col("post"), gap))).alias("pre"), F.sqrt(F.avg(F.when(F.col("post"), gap))).alias("after"))
    delta = F.col("after") - F.col("pre")
    return each.agg(F.count("*").alias("assets"), F.round(F.avg(delta), 4).alias("delta_rmse_mean"), F.round(F.count_if(delta < 0) / F.count(delta), 4).alias("improved_fraction"))


def precision_at(items: DataFrame, ks: tuple[int, ...] = (), fractions: tuple[float, ...] = (), score: str = "score", label: str = "label", tie: str = "tile_id") -> DataFrame:
    """(k, precision): share of positives among the k best. A fraction stands for half-even(fraction x n), at least 1."""
    n = items.count()
    wanted = sorted({min(k, n) for k in ks} | {max(1, round(f * n)) for f in fractions}) if n else []
    most = max([k for k in wanted if k > 0], default=0)
    ranked = numbered(items.select(score, tie, F.col(label).cast("double").alias("y")), score, [tie], "rn", descending=True)
    best = ranked.filter(F.col("rn") <= most)
    sums = [F.struct(F.lit(k).alias("k"), F.round(F.coalesce(F.avg(F.when(F.col("rn") <= k, F.col("y"))), F.lit(0.0)), 4).alias("precision")) for k in wanted]
    return best.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*") if sums else items.sparkSession.createDataFrame([], "k int, precision double")


def service_metrics(requests: DataFrame, order: str, latency: str, last: int = 256, passed: str | None = None) -> DataFrame:
    """Mean, nearest-rank 95th percentile and pass rate of the last requests; the limit keeps all this small."""
    rows = requests.orderBy(F.desc(order)).limit(last)
    values = F.sort_array(F.collect_list(latency))
    rate = F.avg(F.col(passed).cast("double")) if passed else F.lit(None).cast("double")
    out = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(latency), F.lit(0.0)).alias("avg"), values.alias("v"), F.coalesce(rate, F.lit(0.0)).alias("pass_rate"))
    at = F.greatest(F.lit(1), F.bround(F.lit(0.95) * F.col("n"), 0).cast("int"))
    return out.select("n", "avg", F.coalesce(F.try_element_at("v", at), F.lit(0.0)).alias("p95"), "pass_rate")


def first_int(*columns: Column) -> Column:
    """The first value that is a whole number, else 0."""
    return F.coalesce(*[c.cast("string").try_cast("long") for c in columns], F.lit(0))
