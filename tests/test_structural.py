"""The structural model against dense Gaussian algebra, and variances of simulated series."""

import numpy as np

from orrery.operators import series
from orrery.plans import registry
from orrery.plans import series as plans


def simulated(n, level, season, seed, period=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 1))
    mu, places = 20.0, list(rng.normal(size=period - 1))
    y = np.zeros(n)
    for i in range(n):
        y[i] = mu + places[0] + 1.5 * x[i, 0] + rng.normal()
        mu += rng.normal() * level**0.5
        places = [-sum(places) + rng.normal() * season**0.5, *places[:-1]]
    return y, x


def dense(y, x, start, period, ratios):
    """Forecasts and their variances by one covariance matrix of all days, and the likelihood of the days before."""
    n, m = len(y), period + x.shape[1]
    t = np.eye(m)
    t[1:period, 1:period] = 0
    t[1, 1:period] = -1
    for k in range(2, period):
        t[k, 1:period] = 0
        t[k, k - 1] = 1
    z = np.column_stack([np.ones(n), np.ones(n), np.zeros((n, period - 2)), x])
    q = np.zeros((m, m))
    q[0, 0], q[1, 1] = ratios
    states, cov = np.eye(m) * 1e6, np.zeros((n, n))
    for i in range(n):
        back = states.copy()
        for j in range(i, n):
            cov[i, j] = cov[j, i] = z[i] @ back @ z[j]
            back = back @ t.T
        states = t @ states @ t.T + q
    cov += np.eye(n)
    known = np.nonzero(np.isfinite(y[:start]))[0]
    rest = np.arange(start, n)
    inner = np.linalg.inv(cov[np.ix_(known, known)])
    pred = cov[np.ix_(rest, known)] @ inner @ y[known]
    var = np.diag(cov[np.ix_(rest, rest)] - cov[np.ix_(rest, known)] @ inner @ cov[np.ix_(known, rest)])
    return pred, var


def test_forecasts_are_the_dense_ones():
    y, x = simulated(50, 0.3, 0.02, 1)
    y[7] = np.nan
    for ratios in ((0.3, 0.02), (1e-4, 1e-3), (2.0, 1.0)):
        pred, var, _, sigma = series.level_model(y, x, 36, 7, np.array([ratios]))
        want, spread = dense(y, x, 36, 7, ratios)
        assert np.allclose(pred[0, 36:], want, atol=1e-3) and np.allclose(var[0, 36:] / sigma[0], spread, rtol=2e-2)  # the dense variances cancel from 10^6


def test_likeliest_beats_others():
    rng = np.random.default_rng(4)
    for seed in range(4):
        y, x = simulated(90, 10.0 ** rng.uniform(-3, 0), 10.0 ** rng.uniform(-4, -1), seed)
        found = series.likeliest(y, x, 90, 7)
        others = 10.0 ** np.column_stack([rng.uniform(-6, 2, 300), rng.uniform(-6, 2, 300)])
        likelihood = lambda r: series.level_model(y, x, 90, 7, r)[2]  # noqa: E731, B023
        assert likelihood(found[None])[0] > likelihood(others).max() - 0.02


def test_simulated_variances_come_back():
    for level, season in ((0.5, 0.05), (0.05, 0.2)):
        fits = []
        for seed in range(5):
            y, x = simulated(700, level, season, seed)
            fits.append([*series.likeliest(y, x, 700, 7), series.level_model(y, x, 700, 7, series.likeliest(y, x, 700, 7)[None])[3][0]])
        got = np.median(fits, axis=0)
        assert level / 1.6 < got[0] < level * 1.6 and season / 1.6 < got[1] < season * 1.6 and 0.8 < got[2] < 1.25


def test_whole_query(spark, data):
    """effect_structural from the same daily rows, by dense algebra at each asset's likeliest ratios."""
    daily = plans.daily(spark, data).join(plans.fixed_dates(spark, data), "asset_id").toPandas().sort_values(["asset_id", "date"])
    got = {r.asset_id: r for r in registry.QUERIES["effect_structural"](spark, data).collect()}
    assert set(got) == set(daily.asset_id)
    seen = 0
    for asset, rows in list(daily.groupby("asset_id"))[:4]:
        y, post = rows.energy_kwh.to_numpy(float), (rows.date >= rows.policy_date).to_numpy()
        start = int((~post).sum())
        temp = rows.temp_c.ffill().bfill().fillna(0).to_numpy(float)
        weekday = np.array([d.weekday() for d in rows.date])
        x = np.column_stack([temp - temp.mean(), *((weekday == k).astype(float) for k in np.unique(weekday)[:-1])])
        if start < 7:
            continue
        want, _ = dense(y, x, start, 7, series.likeliest(y[:start], x[:start], start, 7))
        assert abs(got[asset].cum_effect - (y[start:] - want).sum()) < 1e-2 * max(1, abs(got[asset].cum_effect))
        seen += 1
    assert seen
