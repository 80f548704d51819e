"""Configurations: subscriptions, routes, dedupe, public policy, rules' constants. JSON objects become dataclasses."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Subscription:
    id: str
    topics: tuple[str, ...] = ()
    severity_at_least: str | None = None
    assets: tuple[str, ...] = ()
    rule_types: tuple[str, ...] = ()
    aoi_ids: tuple[str, ...] = ()
    min_delta: dict[str, float] = field(default_factory=dict)
    suppress_if: dict[str, object] = field(default_factory=dict)

    @staticmethod
    def of(x: dict) -> Subscription:
        lists = {k: tuple(x.get(k) or ()) for k in ("topics", "assets", "rule_types", "aoi_ids")}
        return Subscription(str(x["id"]), severity_at_least=x.get("severity_at_least"), min_delta=x.get("min_delta") or {}, suppress_if=x.get("suppress_if") or {}, **lists)


@dataclass(frozen=True)
class Channel:
    id: str
    type: str
    max_per_run: int | None = None
    options: dict[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Route:
    id: str
    channels: tuple[Channel, ...]
    subscription_ids: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    severity_at_least: str | None = None

    @staticmethod
    def of(x: dict) -> Route:
        own = ("id", "type", "max_per_run")
        channels = tuple(Channel(str(c["id"]), str(c["type"]), c.get("max_per_run"), {k: v for k, v in c.items() if k not in own}) for c in x.get("channels") or ())
        match = x.get("match") or {}
        return Route(str(x["id"]), channels, tuple(match.get("subscription_ids") or ()), tuple(match.get("topics") or ()), match.get("severity_at_least"))


@dataclass(frozen=True)
class Flap:
    enabled: bool = True
    key_fields: tuple[str, ...] = ("subscription_id", "asset_id", "rule_type")
    value_field: str = "severity"
    window_seconds: int = 1800
    max_changes: int = 3


@dataclass(frozen=True)
class Dedupe:
    ttl_seconds: int = 3600
    min_interval_seconds: int = 300
    key_fields: tuple[str, ...] = ("subscription_id", "topic", "asset_id", "rule_type")
    flap: Flap = Flap()


@dataclass(frozen=True)
class PublicPolicy:
    min_severity: str = "medium"
    max_items: int = 200
    visible_fields: tuple[str, ...] = ("ts", "topic", "severity", "aoi_id", "region")
    include_asset_id_field: bool = False
    anonymize_asset_id: bool = True
    pseudonym_prefix: str = "asset_"
    aoi_to_region: dict[str, str] = field(default_factory=lambda: {"aoi_1": "Region A", "aoi_2": "Region B"})
    fallback_region: str = "Unknown"


# The shipped subscriptions and routes.
SUBSCRIPTIONS = (
    Subscription(
        "policy_high_plus",
        topics=("policy.enforcement",),
        severity_at_least="high",
        assets=("*",),
        rule_types=("emissions_exceedance", "water_breach", "waste_violation"),
        suppress_if={"acknowledged": True},
    ),
    Subscription("sat_ndvi_drop", topics=("sat.change",), severity_at_least="medium", aoi_ids=("aoi_1", "aoi_2"), min_delta={"ndvi": 0.2}),
    Subscription("zk_attest_issues", topics=("zk.issue", "zk.verify"), severity_at_least="low", assets=("*",)),
)
ROUTES = (
    Route("route_policy_to_webhook", (Channel("wh_policy", "webhook", 100),), subscription_ids=("policy_high_plus",), severity_at_least="high"),
    Route("route_sat_to_email", (Channel("email_sat_ops", "email", 100),), subscription_ids=("sat_ndvi_drop",)),
    Route("route_zk_to_both", (Channel("wh_zk", "webhook", 100), Channel("email_zk", "email", 100)), topics=("zk.issue", "zk.verify")),
)
GLOBAL_LIMIT = 1000
TOPICS = {
    "DocumentIngested": "doc.ingested",
    "TileFetched": "sat.tile.fetched",
    "PolicyUpdated": "policy.updated",
    "ViolationFlagged": "violation.flagged",
    "ProofIssued": "proof.issued",
    "AlertRaised": "alert.raised",
}


def subscriptions(path: str) -> tuple[Subscription, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(Subscription.of(x) for x in json.load(f).get("subscriptions") or ())


def routes(path: str) -> tuple[tuple[Route, ...], int | None]:
    """Routes and the limit of all sends of a run."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return tuple(Route.of(x) for x in found.get("routes") or ()), (found.get("rate_limit") or {}).get("max_per_run")
