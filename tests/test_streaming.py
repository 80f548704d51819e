"""Streams end in what the batch operators give."""

import json

from orrery.config import Dedupe, Flap
from orrery.operators import alerts, bus
from orrery.sources import readers, sinks
from orrery.streaming import bus as streams


def envelope(k, kind="PolicyUpdated", **more):
    return {
        "event_id": f"6f1c1a9e-5b1f-4c68-9a53-0c6c2d1b7e{k:02}", "event_type": kind, "occurred_at": f"2025-01-01T00:00:{k:02}Z", "source": "s", "version": "1.0.0", "schema_ref": "r",
        "content_hash": "a" * 64, "idempotency_key": f"key-{k:06}", "payload": {"policy_id": "p", "name": "n", "version": "1", "effective_at": "t", "actor": "a"},
    } | more


def test_dispatch(spark, tmp_path):
    inbox, root = tmp_path / "inbox", tmp_path / "out"
    inbox.mkdir()
    first = [envelope(1), envelope(2), envelope(2), envelope(3, "Nothing"), envelope(4, version="x")]
    (inbox / "a.json").write_text("\n".join(map(json.dumps, first)) + "\nnot json\n")
    stream = lambda: streams.dispatch(streams.inbox(spark, str(inbox)), str(root), str(tmp_path / "cp")).awaitTermination()
    stream()
    (inbox / "b.json").write_text("\n".join(map(json.dumps, [envelope(1), envelope(5)])) + "\n")
    stream()
    n = lambda x: spark.read.parquet(f"{root}/{x}").count()
    assert (n("done"), n("dup"), n("err")) == (3, 2, 3)
    topics = spark.read.json(f"{root}/topics")
    assert {r.topic for r in topics.collect()} == {"policy.updated"}
    again = bus.replay(topics, "2025-01-01T00:00:02Z", "2025-01-01T00:00:05Z")
    assert [json.loads(r.value)["idempotency_key"] for r in again.collect()] == ["key-000002", "key-000002"]


def test_stateful_dedupe_equals_batch(spark, tmp_path):
    schema = "pos int, sub_pos int, id string, ts string, topic string, asset_id string, rule_type string, severity string, subscription_id string"
    rows = [(k, 0, f"e{k}", f"2025-01-01T00:{k * 7 % 60:02}:00Z", "ab"[k % 2], "xy"[k % 3 % 2], "r", ["low", "high", "medium"][k % 3], "s") for k in range(30)]
    c = Dedupe(60, 30, flap=Flap(window_seconds=1800, max_changes=2))
    for n, part in enumerate((rows[:15], rows[15:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / f"in/{n}"))
    want = {r.id: r.status for r in alerts.dedupe(spark.createDataFrame(rows, schema), c).collect()}
    stream = streams.dedupe(spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).json(str(tmp_path / "in/*")), c)
    stream.writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {r.id: r.status for r in spark.table("decided").collect()} == want


def test_readers_and_sinks(spark, tmp_path):
    p = tmp_path / "events.json"
    p.write_text(json.dumps([{"id": "a", "severity": "low", "delta": {"x": 1}}, 5, {"id": "b", "payload": {"k": [1]}}]))
    found = readers.json_array(spark, str(p)).orderBy("pos").collect()
    assert [(r.pos, r.id) for r in found] == [(0, "a"), (1, "b")]
    (tmp_path / "news.json").write_text(json.dumps([{"body": " x "}, {"title": "T", "summary": "s"}, {"other": 1}, {"text": "y"}]))
    assert [(r.id, r.text) for r in readers.news(spark, str(tmp_path / "news.json")).collect()] == [("news_0", "x"), ("news_1", "T. s"), ("news_3", "y")]
    (tmp_path / "m.txt").write_text("# HELP\na 1.5\nb x\n\nc 2\n")
    metrics = readers.prometheus(spark, str(tmp_path / "m.txt"))
    assert {r.name: r.value for r in metrics.collect()} == {"a": 1.5, "c": 2.0}
    sinks.prometheus(metrics, str(tmp_path / "out"))
    assert {r.name: r.value for r in readers.prometheus(spark, str(tmp_path / "out")).collect()} == {"orrery_a": 1.5, "orrery_c": 2.0}
    assert "| a | 1.5 |" in sinks.card("run", metrics)
    assert readers.optional_csv(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    (tmp_path / "x.pdf").write_bytes(b"one\ftwo")
    pages = readers.binary_pages(spark, str(tmp_path), [lambda b: ["", ""], lambda b: b.decode().split("\f")])
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "one"), (2, "two")]
    names = [f"a_{t}_{b}.tif" for t in ("before", "after") for b in ("B04", "B8")]
    assert readers.resolve_area("d", "a", names)["before_B4"] == "d/a_before_B04.tif"
    assert readers.resolve_area("d", "a", names[:3]) is None
