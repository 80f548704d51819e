"""Policy rules: a declarative document is checked, compiled to a column, and evaluated on events.

Values are compared as JSON values: numbers with numbers, text with text, booleans as 0
and 1. Every test is true or false, never null. A missing value differs from anything, so
`neq` holds for it; orderings need numbers on both sides.
"""

from __future__ import annotations

import hashlib
import json
import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a rule may say.
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "regex", "exists")
STATUSES = ("proposed", "active", "deprecated")
SEVERITIES = ("low", "medium", "high", "critical")
AGGREGATORS = ("all", "any")
ACTIONS = ("flag", "notify", "open_case", "block", "require_proof")
TRIGGERS = ("event", "schedule")


def validate(rule: dict) -> list[str]:
    """What is wrong with a rule; empty if nothing is."""
    out = []
    meta = rule.get("meta") or {}
    for key in ("id", "version", "status"):
        if key not in meta:
            out.append(f"meta.{key} is missing")
    if meta.get("status") not in STATUSES:
        out.append("meta.status is unknown")
    if rule.get("severity") not in SEVERITIES:
        out.append("severity is unknown")
    if (rule.get("trigger") or {}).get("type") not in TRIGGERS:
        out.append("trigger.type is unknown")
    conditions = rule.get("conditions") or {}
    if conditions.get("aggregator", "all") not in AGGREGATORS:
        out.append("conditions.aggregator is unknown")
    for k, c in enumerate(conditions.get("clauses") or ()):
        op, value = c.get("op"), c.get("value")
        if not c.get("path"):
            out.append(f"clause {k} has no path")
        if op not in OPERATORS:
            out.append(f"clause {k} has an unknown op")
        elif op in ("gt", "gte", "lt", "lte") and (isinstance(value, bool) or not isinstance(value, (int, float))):
            out.append(f"clause {k} needs a number")
        elif op == "in" and not isinstance(value, list):
            out.append(f"clause {k} needs a list")
        elif op == "regex" and not isinstance(value, str):
            out.append(f"clause {k} needs a pattern")
    out += [f"action {a.get('type')} is unknown" for a in rule.get("actions") or () if a.get("type") not in ACTIONS]
    return out


def compiled(rule: dict, source: str = "") -> dict:
    """The manifest entry of a rule: paths as tokens, and a checksum of its text."""
    meta, conditions = rule["meta"], rule.get("conditions") or {}
    return {
        "id": meta["id"],
        "version": meta["version"],
        "status": meta["status"],
        "severity": rule["severity"],
        "enabled": meta["status"] != "deprecated",
        "scope": rule.get("scope") or {},
        "trigger": rule.get("trigger") or {},
        "aggregator": conditions.get("aggregator", "all"),
        "clauses": [{"tokens": c["path"].split("."), "op": c["op"], "value": c.get("value")} for c in conditions.get("clauses") or ()],
        "actions": rule.get("actions") or [],
        "checksum": hashlib.sha256((source or json.dumps(rule, sort_keys=True)).encode()).hexdigest(),
    }


def load(folder: str) -> list[tuple[dict, str]]:
    """(rule, text) of the YAML files of a folder, not of folders within."""
    import pathlib

    import yaml

    out = []
    for p in sorted(pathlib.Path(folder).glob("*.y*ml")):
        text = p.read_text(encoding="utf-8")
        if not isinstance(rule := yaml.safe_load(text), dict):
            raise ValueError(f"{p.name} is no mapping")
        out.append((rule, text))
    return out


def register(registry: DataFrame, manifest: Sequence[dict]) -> DataFrame:
    """The entries of the manifest that the registry lacks, by id, version and checksum."""
    spark = registry.sparkSession
    rows = spark.createDataFrame([(m["id"], int(m["version"]), m["checksum"]) for m in manifest], "id string, version int, checksum string")
    return rows.join(registry, ["id", "version", "checksum"], "left_anti")


class Compiler:
    """Rules to columns over an event column of JSON text and, optionally, one of graph facts."""

    def __init__(self, event: str = "event", kg: str | None = None):
        self.sources = {"event": event} | ({"kg": kg} if kg else {})
        self.parsed: dict[str, Column] = {c: F.try_parse_json(F.col(c)) for c in self.sources.values()}
        self.known: dict[tuple[str, ...], Column] = {}

    def prepared(self, rows: DataFrame, rules: Sequence[dict]) -> tuple[DataFrame, list[str]]:
        """rows with each source parsed once and each path of the rules looked up once, in columns of their own, and those columns' names."""
        prefix = next(f"rules_{'_' * k}" for k in range(len(rows.columns) + 1) if not any(c.startswith(f"rules_{'_' * k}") for c in rows.columns))
        names = {c: f"{prefix}{k}" for k, c in enumerate(self.parsed)}
        rows = rows.withColumns({n: self.parsed[c] for c, n in names.items()})
        self.parsed = {c: F.col(n) for c, n in names.items()}
        paths = {tuple(k.split(".")) for r in rules if r["trigger"].get("type") == "event" for k in r["trigger"].get("match") or {}} | {tuple(c["tokens"]) for r in rules for c in r["clauses"]}
        found = {t: f"{prefix}path_{k}" for k, t in enumerate(sorted(paths))}
        if found:
            rows = rows.withColumns({n: self.value(t) for t, n in found.items()})
        self.known = {t: F.col(n) for t, n in found.items()}
        return rows, [*names.values(), *found.values()]

    def value(self, tokens: Sequence[str]) -> Column:
        """A path's JSON value as text with its quotes, or null: as named, else below event, else below kg."""
        if tuple(tokens) in self.known:
            return self.known[tuple(tokens)]
        tries = []
        if tokens[0] in self.sources:
            tries.append((self.sources[tokens[0]], tokens[1:]))
        tries += [(c, tokens) for c in self.sources.values()]
        found = [F.try_variant_get(self.parsed[c], "$" + "".join(f"['{t}']" for t in path), "variant") for c, path in tries if path]
        text = [F.to_json(v) for v in found]
        return F.nullif(F.coalesce(*text), F.lit("null"))

    def same(self, got: Column, want) -> Column:
        """JSON equality; null-safe."""
        if want is None:
            return got.isNull()
        if isinstance(want, (bool, int, float)):
            number = F.when(got == "true", F.lit(1.0)).when(got == "false", F.lit(0.0)).when(~got.startswith('"'), got.try_cast("double"))
            return F.coalesce(number == F.lit(float(want)), F.lit(False))
        return F.coalesce(got == F.lit(json.dumps(want, ensure_ascii=False, separators=(",", ":"))), F.lit(False))

    def test(self, tokens: Sequence[str], op: str, want) -> Column:
        got = self.value(tokens)
        if op == "exists":
            return got.isNotNull()
        if op == "eq":
            return self.same(got, want)
        if op == "neq":
            return ~self.same(got, want)
        if op == "in":
            return reduce(operator.or_, (self.same(got, w) for w in want), F.lit(False))
        if op == "regex":
            text = F.when(got.startswith('"'), F.from_json(F.concat(F.lit("["), got, F.lit("]")), "array<string>")[0])
            return F.coalesce(text.rlike(want), F.lit(False))
        number = F.when(got == "true", F.lit(1.0)).when(got == "false", F.lit(0.0)).when(~got.startswith('"'), got.try_cast("double"))
        compare = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}[op]
        return F.coalesce(compare(number, F.lit(float(want))), F.lit(False))

    def triggered(self, trigger: dict) -> Column:
        if trigger.get("type") == "schedule":
            return F.lit(True)
        if trigger.get("type") != "event":
            return F.lit(False)
        tests = [self.test(k.split("."), "eq", v) for k, v in (trigger.get("match") or {}).items()]
        return reduce(operator.and_, tests, F.lit(True))

    def in_scope(self, scope: dict, asset: str = "asset_id") -> Column:
        """Assets of the scope; only exactly ["*"], or none, means all."""
        assets = scope.get("assets") or []
        return F.lit(True) if assets in ([], ["*"]) else F.coalesce(F.col(asset).isin(assets), F.lit(False))

    def violation(self, rule: dict, asset: str = "asset_id") -> Column:
        """A struct if an event breaks the rule, else null; evidence says what each clause saw."""
        tests = [(c, self.test(c["tokens"], c["op"], c["value"])) for c in rule["clauses"]]
        join, start = (operator.and_, F.lit(True)) if rule["aggregator"] == "all" else (operator.or_, F.lit(False))
        broken = reduce(join, (t for _, t in tests), start)
        seen = [F.struct(F.lit(".".join(c["tokens"])).alias("path"), F.lit(c["op"]).alias("op"), F.lit(json.dumps(c["value"])).alias("value"), self.value(c["tokens"]).alias("resolved"), t.alias("ok")) for c, t in tests]
        evidence = F.array(*seen).cast("array<struct<path:string,op:string,value:string,resolved:string,ok:boolean>>")
        what = F.struct(F.lit(rule["id"]).alias("rule_id"), F.lit(int(rule["version"])).alias("rule_version"), F.lit(rule["severity"]).alias("severity"), evidence.alias("evidence"))
        return F.when(self.in_scope(rule["scope"], asset) & self.triggered(rule["trigger"]) & broken, what)


def enforce(events: DataFrame, manifest: Sequence[dict], event: str = "event", kg: str | None = None, asset: str = "asset_id", ids: Sequence[str] | None = None, proposed: bool = False) -> DataFrame:
    """events with one row per rule that they break. All rules are columns of one projection.

    As in the rules' definition, a deprecated rule still fires; proposed ones only if asked.
    """
    chosen = [r for r in manifest if (ids is None or r["id"] in ids) and (proposed or r["status"] != "proposed")]
    c = Compiler(event, kg)
    if not chosen:
        return events.limit(0).select("*", F.lit("").alias("rule_id"), F.lit(0).alias("rule_version"), F.lit("").alias("rule_severity"), F.array().cast("array<struct<path:string,op:string,value:string,resolved:string,ok:boolean>>").alias("evidence"))
    rows, own = c.prepared(events, chosen)
    found = rows.withColumn("violation", F.explode(F.array_compact(F.array(*[c.violation(r, asset) for r in chosen])))).drop(*own)
    return found.select("*", "violation.rule_id", "violation.rule_version", F.col("violation.severity").alias("rule_severity"), "violation.evidence").drop("violation")


def propose(text: Column) -> Column:
    """A rule that a sentence suggests, as a struct: id, severity, path, op, value."""
    from orrery.functions.text import kwh_threshold, slug

    low, kwh = F.lower(text), kwh_threshold(text)
    rule = lambda kind, severity, path, op, value: F.struct(F.concat(F.lit(f"rule.{kind}."), slug(text)).alias("id"), severity.alias("severity"), F.lit(path).alias("path"), F.lit(op).alias("op"), value.alias("value"))
    energy = rule("energy", F.when(kwh >= 300, "high").otherwise("medium"), "event.effect.avg", "lt", (-F.coalesce(kwh, F.lit(100.0))).cast("string"))
    permit = rule("permit", F.lit("critical"), "kg.permit.exists", "eq", F.lit("false"))
    other = rule("generic", F.lit("medium"), "event.flag", "eq", F.lit("true"))
    return F.when(low.rlike("energy|kwh|electricity"), energy).when(low.rlike("satellite|ndvi|permit|construction"), permit).otherwise(other)
