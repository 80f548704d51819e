"""Command line: python -m orrery.cli COMMAND ... reads JSON or Parquet and writes to a folder."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from orrery import config
from orrery.functions import security
from orrery.operators import alerts, bus, documents, evaluation, portals, proof, raster, rules, series
from orrery.session import session
from orrery.sources import readers, sinks

# Which commands a role may use.
ROLES = {"reg-build": "regulator", "inv-build": "investor", "pub-build": "public"}


def _events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else readers.json_array(spark, path)


def _matched(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    subs = config.subscriptions(a.config) if a.config else config.SUBSCRIPTIONS
    return alerts.match(_events(spark, a.input), subs)


def _kept(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return alerts.dedupe(_matched(spark, a)).filter("status = 'kept'").drop("status")


def _channels(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    routes, most = config.routes(a.routes) if a.routes else (config.ROUTES, config.GLOBAL_LIMIT)
    return alerts.limit(alerts.route(_kept(spark, a), routes), most)


def _enforced(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    found = rules.load(a.config)
    if bad := [f"{r.get('meta', {}).get('id')}: {e}" for r, _ in found for e in rules.validate(r)]:
        raise SystemExit("\n".join(bad))
    events = spark.read.text(a.input).withColumnRenamed("value", "event").selectExpr("event", "get_json_object(event, '$.asset_id') AS asset_id")
    return rules.enforce(events, [rules.compiled(*r) for r in found], proposed=a.proposed)


COMMANDS = {
    "filters": _matched,
    "dedupe": lambda s, a: alerts.dedupe(_matched(s, a)),
    "channels": _channels,
    "feed": lambda s, a: alerts.feed(_kept(s, a), a.limit),
    "reg-build": lambda s, a: portals.heatmap(_kept(s, a)),
    "inv-build": lambda s, a: portals.trajectory(portals.risk_daily(_kept(s, a))),
    "pub-build": lambda s, a: portals.public_items(_kept(s, a)),
    "enforce": _enforced,
    "validate": lambda s, a: s.read.text(a.input).select("value", bus.errors().alias("errors")),
    "replay": lambda s, a: bus.replay(s.read.json(a.input), a.start, a.end, tuple(a.topic or ()), a.limit),
    "chunk": lambda s, a: documents.chunk(s.read.parquet(a.input), a.least, a.most),
    "clauses": lambda s, a: documents.clauses(s.read.parquet(a.input)),
    "series": lambda s, a: series.daily(series.normalised(s.read.option("header", True).csv(a.input))),
    "change": lambda s, a: raster.masked(raster.difference(raster.ndvi(raster.scaled(readers.pixels_csv(s, a.input)))), a.percentile),
    "commit": lambda s, a: proof.commitments(s.read.parquet(a.input)),
    "issue": lambda s, a: proof.issue(s.read.parquet(a.input), a.secret),
    "verify": lambda s, a: proof.verify(s.read.parquet(a.input), a.secret),
    "eval-rag": lambda s, a: evaluation.citation_metrics(s.read.json(a.input)),
    "eval-change": lambda s, a: evaluation.precision_at(s.read.json(a.input), (1, 5, 10, 20), (0.1, 0.2)),
    "eval-causal": lambda s, a: evaluation.causal_metrics(s.read.json(a.input)),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orrery", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--config", help="subscriptions (JSON) or a folder of rules (YAML)")
    p.add_argument("--routes", help="routes (JSON)")
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--least", type=int, default=400)
    p.add_argument("--most", type=int, default=800)
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--topic", action="append")
    p.add_argument("--percentile", type=float, default=95.0)
    p.add_argument("--secret", default="")
    p.add_argument("--proposed", action="store_true")
    p.add_argument("--token", default="", help="token of a role, for the portals")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if a.command in ROLES:
        claims = security.verify_token(a.token, a.secret.encode(), "orrery")
        if not claims or claims.get("role") != ROLES[a.command]:
            print(json.dumps({"error": f"{a.command} needs a token of the role {ROLES[a.command]}"}), file=sys.stderr)
            return 1
    sinks.json_rows(COMMANDS[a.command](spark or session(), a), a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
