"""The command line, the core schema and the gates."""

import json

from test_alerts import SAMPLE

from orrery import cli, schemas, verify
from orrery.functions.security import issue_token
from orrery.operators import core


def test_commands(spark, tmp_path):
    names = ("id", "ts", "topic", "asset_id", "aoi_id", "rule_type", "severity", "acknowledged", "delta")
    events = tmp_path / "events.json"
    events.write_text(json.dumps([{k: v for k, v in zip(names, r[1:]) if v is not None} for r in SAMPLE]))
    out = lambda name: spark.read.json(str(tmp_path / name))
    assert cli.main(["filters", str(events), str(tmp_path / "matched")], spark) == 0
    assert {r.id for r in out("matched").collect()} == {"e1", "e3", "e5"}
    assert cli.main(["channels", str(events), str(tmp_path / "sent")], spark) == 0
    assert [r.status for r in out("sent").collect()] == ["sent"] * 4
    token = issue_token("ann", "regulator", b"k", "orrery", 60)
    assert cli.main(["reg-build", str(events), str(tmp_path / "map"), "--secret", "k", "--token", token], spark) == 0
    assert {r.asset_id for r in out("map").collect()} == {"asset_1", "asset_3"}
    assert cli.main(["pub-build", str(events), str(tmp_path / "no"), "--secret", "k", "--token", token], spark) == 1


def test_core(spark):
    docs = spark.createDataFrame([("d1", "r1", "h", "old", "local"), ("d2", "r2", "g", "p", "web")], "id string, reference_id string, doc_sha256 string, storage_path string, source string")
    permits = spark.createDataFrame([("p1", "r1", None), ("p2", "rx", "d9")], "id string, reference_id string, document_id string")
    assert {r.id: r.document_id for r in core.link_documents(permits, docs).collect()} == {"p1": "d1", "p2": "d9"}
    new = spark.createDataFrame([("d3", "r3", "g", "new"), ("d4", "r4", "k", "n")], "id string, reference_id string, doc_sha256 string, storage_path string")
    assert {(r.id, r.storage_path, r.source) for r in core.replace_source(docs, new, "local").collect()} == {("d2", "new", "web"), ("d4", "n", "local")}
    rows = spark.createDataFrame([("a", 3), ("a", 9)], "rule_code string, severity int")
    assert {r.rule: r.n for r in schemas.broken("rule", rows).collect()} == {"unique rule_code": 2, "severity": 1}
    assert schemas.broken("asset", rows).count() == 0
    for ddl in (*schemas.CORE.values(), *schemas.DOCUMENTS.values()):
        assert spark.createDataFrame([], ddl).count() == 0


def test_gates(spark):
    df = spark.createDataFrame([(1, "done"), (1, "dup")], "k int, outcome string")
    assert verify.has_rows(x=df) == [] and verify.has_rows(x=df.limit(0)) == ["x is empty"]
    assert verify.no_duplicates(df, "k") and not verify.no_duplicates(df, "k", "outcome")
    assert verify.replays_are_duplicates(df) and verify.covers(df.limit(0), df, "k") and not verify.covers(df, df, "k")
    assert verify.services_are_up({"services": {"a": "ok", "b": "down"}}) == ["b is down"]
