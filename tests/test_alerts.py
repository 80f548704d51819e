"""The recorded results of the six-event sample, and sequential models of what depends on order."""

import random
from dataclasses import replace

import pytest

from orrery.config import ROUTES, SUBSCRIPTIONS, Channel, Dedupe, Flap, PublicPolicy, Route, Subscription
from orrery.operators import alerts, portals

EVENTS = "pos int, id string, ts string, topic string, asset_id string, aoi_id string, rule_type string, severity string, acknowledged boolean, delta map<string,double>"
SAMPLE = [
    (0, "e1", "2025-08-25T09:05:00Z", "policy.enforcement", "asset_1", None, "emissions_exceedance", "high", False, None),
    (1, "e2", "2025-08-25T09:06:00Z", "policy.enforcement", "asset_2", None, "water_breach", "medium", False, None),
    (2, "e3", "2025-08-25T09:07:00Z", "sat.change", "asset_3", "aoi_2", None, "medium", None, {"ndvi": 0.27}),
    (3, "e4", "2025-08-25T09:08:00Z", "sat.change", "asset_4", "aoi_9", None, "low", None, {"ndvi": 0.1}),
    (4, "e5", "2025-08-25T09:09:00Z", "zk.verify", "asset_1", None, None, "low", None, None),
    (5, "e6", "2025-08-25T09:10:00Z", "policy.enforcement", "asset_1", None, "emissions_exceedance", "high", True, None),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(SAMPLE, EVENTS)


def test_sample(events):
    matched = alerts.match(events, SUBSCRIPTIONS)
    assert sorted(r.id for r in matched.collect()) == ["e1", "e3", "e5"]
    assert alerts.unmatched(events, SUBSCRIPTIONS).count() == 3
    kept = alerts.dedupe(matched).filter("status = 'kept'").drop("status")
    assert kept.count() == 3
    sent = alerts.limit(alerts.route(kept, ROUTES), 1000)
    assert [r.status for r in sent.collect()] == ["sent"] * 4
    assert {r.n for r in alerts.match_metrics(events, SUBSCRIPTIONS).filter("subscription_id = 'unmatched'").collect()} == {3}


def test_edges_of_matching(spark):
    rows = [
        (0, "null topic", None, None, None, None, None, None, None, None),
        (1, "odd severity", None, "t", "a", None, None, "unheard", None, {"x": None}),
        (2, "nan", None, "t", "a", None, None, "low", None, {"x": float("nan")}),
        (3, "absent", None, "t", None, None, None, "low", None, {"y": 1.0}),
    ]
    df = spark.createDataFrame(rows, EVENTS)
    ids = lambda s: {r.id for r in alerts.match(df, [s]).collect()}
    assert ids(Subscription("all")) == {r[1] for r in rows}
    assert ids(Subscription("t", topics=("t",))) == {"odd severity", "nan", "absent"}
    assert ids(Subscription("s", severity_at_least="low")) == {"nan", "absent"}
    assert ids(Subscription("s", severity_at_least="unheard")) == {r[1] for r in rows}
    assert ids(Subscription("d", min_delta={"x": 0.5})) == {"nan"}
    assert ids(Subscription("d", min_delta={"x": 0.0})) == {"null topic", "nan", "absent"}
    assert ids(Subscription("n", suppress_if={"acknowledged": None})) == set()
    assert ids(Subscription("w", assets=("b", "*"))) == {r[1] for r in rows}
    assert ids(Subscription("w", assets=("a",))) == {"odd severity", "nan"}


def sequential(rows, c):
    """The decision loop of the definition, on one shared state."""
    keys, out = {}, []
    for key, flap_key, value, at in rows:
        entry = keys.get(key, {})
        last = entry.get("sent")
        age = None if last is None else at - last
        if age is not None and (age < c.min_interval_seconds or age < c.ttl_seconds):
            entry.setdefault("history", []).append((at, value))
            keys[key] = entry
            out.append("cooldown" if age < c.min_interval_seconds else "duplicate")
            continue
        flap = keys.get(flap_key, {})
        history = flap.setdefault("history", [])
        recent = [v for t, v in history if t >= at - c.flap.window_seconds]
        changes = sum(a != b for a, b in zip(recent, recent[1:] + [value]))
        history.append((at, value))
        keys[flap_key] = flap
        if changes > c.flap.max_changes:
            out.append("flapping")
            continue
        entry["sent"] = at
        keys[key] = entry
        out.append("kept")
    return out


@pytest.mark.parametrize("seed", range(8))
def test_dedupe_is_the_loop(spark, seed):
    rng = random.Random(seed)
    same = seed % 2 == 0
    fields = ("subscription_id", "asset_id") if same else ("subscription_id", "topic", "asset_id")
    c = Dedupe(rng.choice([0, 60, 600]), rng.choice([0, 30]), fields, Flap(True, ("subscription_id", "asset_id"), "severity", 900, 1))
    rows = [(k, f"e{k}", rng.randrange(4000), rng.choice("st"), rng.choice("ab"), rng.choice(["low", "high"])) for k in range(200)]
    df = spark.createDataFrame([(k, i, f"2025-01-01T{t // 3600:02}:{t % 3600 // 60:02}:{t % 60:02}Z", topic, a, s, "sub", 0) for k, i, t, topic, a, s in rows], "pos int, id string, ts string, topic string, asset_id string, severity string, subscription_id string, sub_pos int")
    got = {r.pos: r.status for r in alerts.dedupe(df, c).collect()}
    key = lambda r, fs: "|".join({"subscription_id": "sub", "topic": r[3], "asset_id": r[4]}[f] for f in fs)
    want = sequential([(key(r, fields), key(r, c.flap.key_fields), r[5], r[2]) for r in rows], c)
    assert [got[k] for k in range(len(rows))] == want


@pytest.mark.parametrize("seed", range(6))
def test_limiter_is_the_loop(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(alerts, "SLAB", rng.choice([3, 10, 1000]))
    channels = [Channel("a", "webhook", 3), Channel("b", "email", None), Channel("c", "pager", 2)]
    routes = [Route("r0", tuple(rng.sample(channels, 2)), topics=("x",)), Route("r1", tuple(rng.sample(channels, 1)), topics=("x", "y"))]
    topics = [rng.choice("xyz") for _ in range(40)]
    total = rng.choice([0, 5, 30, None])
    df = spark.createDataFrame([(k, 0, "s", f"e{k}", t, "high") for k, t in enumerate(topics)], "pos int, sub_pos int, subscription_id string, id string, topic string, severity string")
    got = sorted((r.pos, -1 if r.route_pos is None else r.route_pos, r.channel_pos or 0, r.status) for r in alerts.limit(alerts.route(df, routes), total).collect())
    want, sent, by = [], 0, {}
    for k, t in enumerate(topics):
        hits = [(i, r) for i, r in enumerate(routes) if t in r.topics]
        if not hits:
            want.append((k, -1, 0, "no_route"))
        for i, r in hits:
            for n, c in enumerate(r.channels):
                if total is not None and sent >= total:
                    status = "global_rate_limited"
                elif c.max_per_run is not None and by.get(c.id, 0) >= c.max_per_run:
                    status = "channel_rate_limited"
                elif c.type not in alerts.KNOWN_TYPES:
                    status = "unknown_channel_type"
                else:
                    status, sent, by[c.id] = "sent", sent + 1, by.get(c.id, 0) + 1
                want.append((k, i, n, status))
    assert got == sorted(want)


def test_public_view_without_ts_keeps_input_order(events):
    matched = alerts.match(events, SUBSCRIPTIONS)
    shown = portals.public_items(matched, PublicPolicy(min_severity="info", visible_fields=("topic", "severity")))
    assert [r.topic for r in shown.collect()] == ["policy.enforcement", "sat.change", "zk.verify"]
    assert {(r.region, r.severity) for r in portals.public_scores(shown).collect()} == {("Unknown", "high"), ("Unknown", "medium"), ("Unknown", "low")}


def test_flapping_needs_many_topics_by_default(spark):
    assert replace(Dedupe()).flap.window_seconds < Dedupe().ttl_seconds
