"""State across runs and batches: any split gives what one run gives, and a break anywhere loses and doubles nothing."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_streaming import envelope

from orrery.config import Dedupe, Flap
from orrery.operators import alerts, evaluation, graph
from orrery.sources.buckets import BucketTable
from orrery.streaming import bus as streams

ROWS = "pos int, sub_pos int, id string, ts string, topic string, asset_id string, rule_type string, severity string, subscription_id string"


def matched(n, seed):
    """Rows with late, unreadable and missing times, in groups of very different size."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        minute = k * 2 + rng.choice([0, 0, 0, -40, -200])
        ts = f"2025-01-{1 + max(minute, 0) // 1440:02}T{max(minute, 0) // 60 % 24:02}:{max(minute, 0) % 60:02}:00Z"
        out.append((k, 0, f"e{k}", rng.choice([ts] * 20 + ["soon", None]), rng.choice("ab"), rng.choice("xxxy"), "r", rng.choice(["low", "high"]), "s"))
    return out


CONFIGS = [Dedupe(600, 120, flap=Flap(window_seconds=3600, max_changes=2)), Dedupe(600, 120, ("topic",), Flap(key_fields=("asset_id",), window_seconds=1800, max_changes=1)), Dedupe(900, 60, ("asset_id",), Flap(key_fields=("asset_id",), max_changes=1)), Dedupe(300, 30, flap=Flap(enabled=False))]


@pytest.mark.parametrize("k", range(len(CONFIGS)))
def test_runs_on_parts_decide_as_one(spark, tmp_path, k):
    rows, c = matched(120, k), CONFIGS[k]
    want = {r.id: r.status for r in alerts.dedupe(spark.createDataFrame(rows, ROWS), c).collect()}
    cuts = [0, *sorted(random.Random(k).sample(range(1, 120), 2)), 120]
    got = {}
    for run, (a, b) in enumerate(zip(cuts, cuts[1:])):
        df = spark.createDataFrame(rows[a:b], ROWS)
        for _ in range(2):  # a run that is done decides nothing again
            got |= {r.id: r.status for r in alerts.dedupe_run(df, f"{tmp_path}/d", run, c, buckets=4).collect()}
    assert got == want and len(set(want.values())) > 1


def test_run_that_breaks_off(spark, tmp_path, monkeypatch):
    rows, c = matched(60, 9), CONFIGS[0]
    want = {r.id: r.status for r in alerts.dedupe(spark.createDataFrame(rows, ROWS), c).collect()}
    one, two = (spark.createDataFrame(x, ROWS) for x in (rows[:30], rows[30:]))
    got = {r.id: r.status for r in alerts.dedupe_run(one, f"{tmp_path}/d", 1, c).collect()}
    put = BucketTable._put
    monkeypatch.setattr(BucketTable, "_put", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        alerts.dedupe_run(two, f"{tmp_path}/d", 2, c)
    monkeypatch.setattr(BucketTable, "_put", put)
    got |= {r.id: r.status for r in alerts.dedupe_run(two, f"{tmp_path}/d", 2, c).collect()}
    assert got == want


@pytest.mark.parametrize("stateful", [True, False])
def test_streams_decide_as_batch(spark, tmp_path, stateful):
    rows, c = matched(80, 5), CONFIGS[1]
    want = {r.id: r.status for r in alerts.dedupe(spark.createDataFrame(rows, ROWS), c).collect()}
    source = tmp_path / "in"
    for n, (a, b) in enumerate([(0, 33), (33, 80)]):
        spark.createDataFrame(rows[a:b], ROWS).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(ROWS).json(str(source))
        if stateful:
            query = streams.dedupe(stream, c).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        else:
            query = streams.dedupe_runs(stream, f"{tmp_path}/d", f"{tmp_path}/cp", c, buckets=4)
        query.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out") if stateful else spark.read.parquet(f"{tmp_path}/d/decided")
    assert {r.id: r.status for r in found.collect()} == want


def test_state_expires():
    c = Dedupe(600, 120, flap=Flap(window_seconds=1800))
    fold = alerts.Fold(c)
    for k in range(1000):
        fold.put(f"k{k}", f"f{k % 7}", "v", k * 60_000_000)
        fold.expire(300)
    assert len(fold.sent) <= 16 and sum(len(h.rows) for h in fold.history.values()) <= 40


def test_bucket_table(spark, tmp_path):
    t = BucketTable(spark, f"{tmp_path}/t", "id int, v string", ["id"], 8)
    graph.upsert_into(t, spark.createDataFrame([(k, "a") for k in range(50)] + [(None, "n")], "id int, v string"), 1)
    before = t.files()
    new = spark.createDataFrame([(3, "b", 1), (3, "c", 2), (99, "d", 1)], "id int, v string, at int")
    graph.upsert_into(t, new, 2, order="at")
    rows = dict(t.read().collect())
    assert rows == {k: "a" for k in range(50)} | {None: "n", 3: "c", 99: "d"}
    touched = t.touched(new)
    assert {b for b in t.files() if t.files()[b] != before.get(b)} <= set(touched) and len(touched) <= 2
    assert all(f"bucket={b}" in f for f in t.read(touched).inputFiles() for b in touched if f"bucket={b}/" in f) and len(t.read(touched).inputFiles()) < len(t.read().inputFiles())
    other = BucketTable(spark, f"{tmp_path}/t", "id int, v string", ["id"], 64)
    assert other.buckets == 8 and other.has(2) and not other.has(3)
    old = t._manifest()
    with pytest.raises(RuntimeError):
        t._put(old)
    t.vacuum(1)
    assert dict(t.read().collect()) == rows


def inbox_of(path, n, events):
    path.mkdir(exist_ok=True)
    (path / f"{n}.json").write_text("\n".join(map(json.dumps, events)) + "\n")


@pytest.mark.parametrize("after", [0, 2, 4, 5])
def test_dispatch_broken_off_after_each_write(spark, tmp_path, monkeypatch, after):
    inbox_of(tmp_path / "in", 1, [envelope(1), envelope(2), envelope(2)])
    run = lambda: streams.dispatch(streams.inbox(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), buckets=4).awaitTermination()
    run()
    inbox_of(tmp_path / "in", 2, [envelope(2), envelope(3), envelope(4, version="x"), envelope(5), envelope(5)])
    put, replace, left = streams._put, BucketTable.replace, [after]

    def breaks(f):
        def step(*a):
            if not left[0]:
                raise OSError("lost")
            left[0] -= 1
            out = f(*a)
            if not left[0]:
                raise OSError("lost")
            return out

        return step

    monkeypatch.setattr(streams, "_put", breaks(put))
    monkeypatch.setattr(BucketTable, "replace", breaks(replace))
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(streams, "_put", put)
    monkeypatch.setattr(BucketTable, "replace", replace)
    run()
    n = lambda x: sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out/{x}").select("idempotency_key").collect())
    assert n("done") == [f"key-{k:06}" for k in (1, 2, 3, 5)] and n("dup") == [f"key-{k:06}" for k in (2, 2, 5)] and n("err") == ["key-000004"]


def test_retry_and_dead_letters(spark, tmp_path):
    clock, down = [1000.0], [("key-000001", "key-000002", "key-000003")]
    accept = lambda df: df.withColumn("accepted", ~F.col("idempotency_key").isin(*down[0]))

    def run(n, *events):
        inbox_of(tmp_path / "in", n, events)
        streams.dispatch(streams.inbox(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), accept=accept, tries=3, base_delay=10, max_delay=15, buckets=4, now=lambda: clock[0]).awaitTermination()
        n = lambda x: sorted(int(r[0][4:]) for r in spark.read.parquet(f"{tmp_path}/out/{x}").select("idempotency_key").collect())
        return n("done"), n("dup"), n("dead")

    assert run(1, *map(envelope, (1, 2, 3, 4))) == ([4], [], [])
    clock[0] += 5
    assert run(2, envelope(1), envelope(5)) == ([4, 5], [1], [])  # 1 waits
    clock[0] += 10
    down[0] = ("key-000002", "key-000003")
    assert run(3, envelope(6)) == ([1, 4, 5, 6], [1], [])
    clock[0] += 20
    down[0] = ("key-000003",)
    assert run(4, envelope(7)) == ([1, 2, 4, 5, 6, 7], [1], [3])
    clock[0] += 100
    down[0] = ("none",)
    assert run(5, envelope(3), envelope(1)) == ([1, 2, 3, 4, 5, 6, 7], [1, 1], [3])


@pytest.mark.parametrize("cuts", [(700,), (100, 350, 360, 700), (3, 255, 256, 700)])
def test_last_requests_of_any_split(spark, tmp_path, cuts):
    rng = random.Random(1)
    rows = [(k, float(rng.randint(1, 500)), rng.random() < 0.8) for k in range(700)]
    rng.shuffle(rows)  # late ones, too
    compute = lambda df: evaluation.service_metrics(df, "at", "ms", 256, "ok")
    schema = "at int, ms double, ok boolean"
    want = compute(spark.createDataFrame(rows, schema)).first()
    start = 0
    for stop in cuts:
        spark.createDataFrame(rows[start:stop], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        streams.service_metrics(spark.readStream.schema(schema).json(f"{tmp_path}/in"), compute, f"{tmp_path}/m", f"{tmp_path}/cp", "at").awaitTermination()
        start = stop
    got = streams.latest_metrics(spark, f"{tmp_path}/m").first()
    assert (got.n, got.p95, got.requests_total) == (want.n, want.p95, 700) and abs(got.avg - want.avg) < 1e-9 and abs(got.pass_rate - want.pass_rate) < 1e-9
