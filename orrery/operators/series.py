"""Sensor series and policy effects."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names under which readings' columns come.
SYNONYMS = {
    "timestamp": ("timestamp", "ts", "time", "datetime", "date"),
    "asset_id": ("asset_id", "asset", "site", "meter_id"),
    "energy_kwh": ("energy_kwh", "kwh", "energy", "consumption_kwh"),
    "temp_c": ("temp_c", "temperature_c", "temperature", "temp"),
}
METRICS = {"kwh": "energy_kwh", "energy": "energy_kwh", "temperature": "temp_c", "temperature_c": "temp_c", "temp": "temp_c"}
FACTOR = 0.4


def first_column(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of the names that df has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n] for n in names if n in have), None)


def pivoted(long: DataFrame) -> DataFrame:
    """(timestamp, asset_id, metric, value) to one column for each known metric; repeats are averaged."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv]), F.lower("metric")), F.lower("metric"))
    rows = long.withColumns({"metric": name, "value": F.col("value").cast("string").try_cast("double")})
    return rows.groupBy("timestamp", "asset_id").pivot("metric", ["energy_kwh", "temp_c"]).agg(F.avg("value"))


def normalised(df: DataFrame, default_asset: str = "asset_01") -> DataFrame:
    """Readings with the columns timestamp, asset_id, energy_kwh, temp_c; what cannot be read is null."""
    at = {k: first_column(df, names) for k, names in SYNONYMS.items()}
    if {"metric", "value"} <= {c.lower() for c in df.columns}:
        return pivoted(df.select(F.col(at["timestamp"]).alias("timestamp"), (F.col(at["asset_id"]) if at["asset_id"] else F.lit(default_asset)).alias("asset_id"), "metric", "value"))
    number = lambda k: (F.col(at[k]).cast("string").try_cast("double") if at[k] else F.lit(None).cast("double")).alias(k)
    asset = F.col(at["asset_id"]).cast("string") if at["asset_id"] else F.lit(default_asset)
    return df.select(F.col(at["timestamp"]).cast("string").try_cast("timestamp").alias("timestamp"), asset.alias("asset_id"), number("energy_kwh"), number("temp_c"))


def daily(readings: DataFrame, factor: float = FACTOR, tz: str = "UTC") -> DataFrame:
    """By asset and local day: summed energy (nothing known: 0), mean temperature, count, weekday and CO2."""
    day = F.to_date(F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), tz)) if tz != "UTC" else F.to_date("timestamp")
    out = readings.filter("timestamp IS NOT NULL").groupBy("asset_id", day.alias("date")).agg(F.coalesce(F.sum("energy_kwh"), F.lit(0.0)).alias("energy_kwh"), F.avg("temp_c").alias("temp_c"), F.count("*").alias("obs"))
    return out.withColumns({"weekday": F.weekday("date"), "is_weekend": (F.weekday("date") >= 5).cast("int"), "co2_kg": F.col("energy_kwh") * factor})


def within(df: DataFrame, ranges: Sequence[tuple[str | None, str | None]], column: str = "date") -> DataFrame:
    """Rows in any range whose both ends are set; if that leaves nothing, all rows."""
    set_ = [(a, b) for a, b in ranges if a and b]
    if not set_:
        return df
    test = F.lit(False)
    for a, b in set_:
        test = test | F.col(column).between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    kept = df.filter(test)
    return df if kept.isEmpty() else kept


def policy_dates(series: DataFrame, given: DataFrame, default: str | None = None) -> DataFrame:
    """(asset_id, policy_date): given for the asset, else the default, else its middle observed day."""
    days = series.groupBy("asset_id").agg(F.sort_array(F.collect_set("date")).alias("days"))
    own = given.select("asset_id", F.col("policy_start_date").cast("string").try_cast("date").alias("given"))
    middle = F.element_at("days", F.floor(F.size("days") / 2).cast("int") + 1)
    return days.join(own, "asset_id", "left").select("asset_id", F.coalesce("given", F.lit(default).cast("date"), middle).alias("policy_date"))


def filled(series: DataFrame, columns: Sequence[str], backward: bool = True, rest: float | None = 0.0) -> DataFrame:
    """Gaps filled with the last known value, then the next one, then a constant."""
    by = Window.partitionBy("asset_id").orderBy("date")
    past, future = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    for c in columns:
        tries = [F.last(c, True).over(past)] + ([F.first(c, True).over(future)] if backward else []) + ([F.lit(rest)] if rest is not None else [])
        series = series.withColumn(c, F.coalesce(*tries))
    return series


def effect(series: DataFrame, dates: DataFrame, metric: str = "energy_kwh", min_pre_days: int = 30) -> DataFrame:
    """Effect after the policy against the mean before it: the counterfactual where no model is fitted."""
    rows = series.join(dates, "asset_id")
    pre, post = F.col("date") < F.col("policy_date"), F.col("date") >= F.col("policy_date")
    y = F.col(metric)
    out = rows.groupBy("asset_id", "policy_date").agg(F.count_if(pre).alias("pre_days"), F.count_if(post).alias("post_days"), F.avg(F.when(pre, y)).alias("mean_pre"), F.sum(F.when(post, y)).alias("sum_post"), F.count(F.when(post, y)).alias("n_post"))
    cumulative = F.col("sum_post") - F.col("n_post") * F.col("mean_pre")
    return out.filter(F.col("pre_days") >= min_pre_days).select("asset_id", "policy_date", "pre_days", "post_days", F.col("mean_pre").alias("yhat"), (cumulative / F.col("n_post")).alias("avg_effect"), cumulative.alias("cum_effect"), F.lit(None).cast("double").alias("p_value"), F.lit(True).alias("used_fallback"))


def two_sided_p(cumulative: float, variance: float) -> float:
    if not np.isfinite(variance) or variance <= 0:
        return float("nan")
    return 2 * (1 - NormalDist().cdf(abs(cumulative / variance**0.5)))


#: Powers of ten between which the ratios of level and season to the irregular variance are sought, points of a grid along one of them, and where it is fine enough.
RATIOS, POINTS, FINE = (-8.0, 3.0), 5, 0.02


def level_model(y: np.ndarray, x: np.ndarray, start: int, period: int, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kalman filters of a local level, seasonal places and regression with a diffuse start, one for each row of ratios.

    ratios: variances of the level's and the season's steps in units of the irregular one.
    Days before `start` are taken in, the rest is forecast. Gives one-step predictions, their
    variances, the log-likelihood with the irregular variance at its best, and that variance.
    """
    n, m = len(y), period + x.shape[1]
    t = np.eye(m)
    t[1:period, 1:period] = 0
    t[1, 1:period] = -1
    t[range(2, period), range(1, period - 1)] = 1
    k = len(ratios)
    a, p, q = np.zeros((k, m)), np.tile(np.eye(m) * 1e6, (k, 1, 1)), np.zeros((k, m, m))
    q[:, 0, 0] = ratios[:, 0]
    if period > 1:
        q[:, 1, 1] = ratios[:, 1]
    pred, var = np.zeros((k, n)), np.zeros((k, n))
    squares, logs, used = np.zeros(k), np.zeros(k), np.zeros(k)
    for i in range(n):
        z = np.r_[1.0, np.ones(min(1, period - 1)), np.zeros(max(0, period - 2)), x[i]]
        pz = p @ z
        pred[:, i], f = a @ z, pz @ z + 1.0
        var[:, i] = f
        if i < start and np.isfinite(y[i]):
            v = y[i] - pred[:, i]
            a, p = a + (v / f)[:, None] * pz, p - pz[:, :, None] * pz[:, None, :] / f[:, None, None]
            counts = f < 1e5  # the first days only settle the start
            squares += np.where(counts, v * v / f, 0.0)
            logs += np.where(counts, np.log(f), 0.0)
            used += counts
        a, p = a @ t.T, t @ p @ t.T + q
    used = np.maximum(used, 1)
    sigma = squares / used
    return pred, var * sigma[:, None], -0.5 * (used * np.log(np.maximum(sigma, 1e-12)) + logs), sigma


def likeliest(y: np.ndarray, x: np.ndarray, start: int, period: int) -> np.ndarray:
    """The ratios of greatest likelihood: a grid of both that follows its best point and halves where that is its middle."""
    low, high = RATIOS
    middle, reach = np.array([-2.0, -3.0]), 4.0
    while reach > FINE:
        steps = np.linspace(-reach, reach, POINTS)
        grid = np.clip(np.array([(middle[0] + a, middle[1] + b) for a in steps for b in steps]), low, high)
        best = grid[int(np.argmax(level_model(y, x, start, period, 10.0**grid)[2]))]
        reach = reach / 2 if np.allclose(best, middle) or np.abs(best - middle).max() < reach * 0.75 or best.min() == low or best.max() == high else reach
        middle = best
    return 10.0**middle


def structural_effect(series: DataFrame, dates: DataFrame, metric: str = "energy_kwh", period: int = 7, alpha: float = 0.05, min_pre_days: int = 30) -> DataFrame:
    """Counterfactual of a structural model by asset and day: y, yhat, lower, upper, post.

    Level, season and regression on temperature and on weekdays less the last, fitted before the policy, with
    the variances of level and season by likelihood. One asset's daily series is one group: a row a
    day. Assets with too few days before get the mean before, without bands.
    """
    z = NormalDist().inv_cdf(1 - alpha / 2)
    rows = filled(filled(series.join(dates, "asset_id"), ["temp_c"]), [metric], backward=False, rest=None)

    def run(pdf):
        pdf = pdf.sort_values("date")
        y, post = pdf[metric].to_numpy(float), (pdf["date"] >= pdf["policy_date"]).to_numpy()
        start = int((~post).sum())
        known = np.isfinite(y[:start])
        out = pdf[["asset_id", "date"]].assign(y=y, post=post)
        if known.sum() < min_pre_days or not post.any():
            mean = y[:start][known].mean() if known.any() else np.nan
            return out.assign(yhat=mean, lower=np.nan, upper=np.nan, used_fallback=True)
        weekday = np.array([d.weekday() for d in pdf["date"]])
        x = np.column_stack([pdf["temp_c"].to_numpy(float) - pdf["temp_c"].mean(), *((weekday == k).astype(float) for k in np.unique(weekday)[:-1])])
        (pred,), (var,), _, _ = level_model(y, x, start, period, likeliest(y[:start], x[:start], start, period)[None])
        half = z * np.sqrt(np.maximum(var, 0))
        return out.assign(yhat=pred, lower=pred - half, upper=pred + half, used_fallback=False)

    kinds = dict(rows.dtypes)
    columns = rows.select("asset_id", "date", "policy_date", "temp_c", F.col(metric).cast("double").alias(metric))
    return columns.groupBy("asset_id").applyInPandas(run, f"asset_id {kinds['asset_id']}, date date, y double, post boolean, yhat double, lower double, upper double, used_fallback boolean")


def effect_summary(fitted: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Average and cumulative effect after the policy, with a two-sided p from the bands' variances."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    rows = fitted.filter("post AND NOT isnan(coalesce(y, double('NaN')))")
    var = F.pow((F.col("upper") - F.col("lower")) / (2 * z), 2)
    out = rows.groupBy("asset_id").agg(F.avg(F.col("y") - F.col("yhat")).alias("avg_effect"), F.sum(F.col("y") - F.col("yhat")).alias("cum_effect"), F.sum(var).alias("variance"), F.max("used_fallback").alias("used_fallback"))
    score = F.abs(F.col("cum_effect")) / F.sqrt("variance")
    # Two-sided normal tail by Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7.
    x = score / F.lit(2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    tail = (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return out.withColumn("p_value", F.when((F.col("variance") > 0) & ~F.isnan("variance"), tail)).drop("variance")


def design(series: DataFrame, dates: DataFrame, metric: str = "energy_kwh") -> DataFrame:
    """Columns y, one, temp, weekend, policy for the regression."""
    rows = filled(series, ["temp_c"]).join(dates, "asset_id")
    return rows.select("asset_id", "date", F.col(metric).alias("y"), F.lit(1.0).alias("one"), F.col("temp_c").alias("temp"), F.col("is_weekend").cast("double").alias("weekend"), (F.col("date") >= F.col("policy_date")).cast("double").alias("policy"))


TERMS = ("one", "temp", "weekend", "policy")


def normal_sums(rows: DataFrame) -> DataFrame:
    """X'X, X'y, y'y and n by asset: all that the regression needs, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(TERMS) for b in TERMS[i:]]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs] + [F.sum(F.col(a) * F.col("y")).alias(f"{a}_y") for a in TERMS]
    return rows.filter("y IS NOT NULL").groupBy("asset_id").agg(*sums, F.sum(F.col("y") * F.col("y")).alias("y_y"), F.count("*").alias("n"))


def regression(sums: DataFrame) -> DataFrame:
    """(asset_id, beta, inverse, sigma2): the least-squares fit of each asset; a singular X'X gets its pseudo-inverse."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                x = np.array([[r[f"{a}_{b}"] if f"{a}_{b}" in r else r[f"{b}_{a}"] for b in TERMS] for a in TERMS], float)
                xy = np.array([r[f"{a}_y"] for a in TERMS], float)
                inverse = np.linalg.pinv(x, hermitian=True)
                beta = inverse @ xy
                rss = max(0.0, r["y_y"] - beta @ xy)
                out.append((r["asset_id"], beta.tolist(), inverse.ravel().tolist(), rss / max(1, r["n"] - len(TERMS))))
            yield pd.DataFrame(out, columns=["asset_id", "beta", "inverse", "sigma2"])

    return sums.mapInPandas(run, f"asset_id {dict(sums.dtypes)['asset_id']}, beta array<double>, inverse array<double>, sigma2 double")


def what_if(rows: DataFrame, fits: DataFrame, policy: int = 0, scale: float = 1.0, factor: float = FACTOR, alpha: float = 0.05) -> DataFrame:
    """Fit and counterfactual by day, with the policy set to 0 or 1 and its coefficient scaled; bands by leverage."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    both = rows.join(fits, "asset_id")
    b = lambda i: F.element_at("beta", i + 1)
    common = b(0) + b(1) * F.col("temp") + b(2) * F.col("weekend")
    x = [F.lit(1.0), F.col("temp"), F.col("weekend"), F.lit(float(policy))]
    leverage = sum((x[i] * x[j] * F.element_at("inverse", 4 * i + j + 1) for i in range(4) for j in range(4)), F.lit(0.0))
    half = z * F.sqrt(F.greatest(F.col("sigma2") * (1 + leverage), F.lit(0.0)))
    fit, other = common + b(3) * F.col("policy"), common + b(3) * scale * policy
    return both.select("asset_id", "date", "y", fit.alias("fit"), other.alias("counterfactual"), (other - half).alias("lower"), (other + half).alias("upper"), (fit - other).alias("effect"), ((fit - other) * factor).alias("effect_co2"))


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
