"""Send limits against a plain fold, with channels that have several limits."""

import random

import pytest

from orrery.operators import alerts

SCHEMA = "pos int, sub_pos int, route_pos int, channel_pos int, route_id string, channel_id string, channel_type string, channel_limit int"


def brute(rows, most):
    used, every, out = {}, 0, []
    for r in sorted(rows):
        *_, route, channel, kind, limit = r
        if route is None:
            out.append("no_route")
        elif most is not None and every >= most:
            out.append("global_rate_limited")
        elif kind in alerts.KNOWN_TYPES and limit is not None and used.get(channel, 0) >= limit:
            out.append("channel_rate_limited")
        elif kind not in alerts.KNOWN_TYPES:
            out.append("unknown_channel_type")
        else:
            out.append("sent")
            every += 1
            used[channel] = used.get(channel, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_limits(spark, monkeypatch, seed):
    rng = random.Random(seed)
    limits = [("a", "webhook", 5), ("a", "webhook", 40), ("a", "webhook", None), ("b", "email", 7), ("b", "email", 0), ("c", "email", None), ("d", "pigeon", 3), ("e", "webhook", 1000)]
    rows = [(pos, 0, k, 0, "r", *rng.choice(limits)) if rng.random() < 0.9 else (pos, 0, 0, 0, None, None, None, None) for pos in range(150) for k in range(rng.randint(1, 3))]
    rows = list({r[:4]: r for r in rows}.values())
    monkeypatch.setattr(alerts, "SLAB", 10)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for most in ((None, 60), (0, 1), (10_000, 3))[seed]:
        got = [r.status for r in sorted(alerts.limit(df, most).collect(), key=lambda r: r[:4])]
        assert got == brute(rows, most)
