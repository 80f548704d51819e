"""Envelopes are read once."""

from orrery.operators import bus


def test_each_field_is_read_once(spark):
    """A field that several tests ask for is one expression of the plan; payloads of other types are not missed."""
    df = spark.createDataFrame([('{"event_type": "AlertRaised", "payload": {"title": "x", "cloud_cover": 2}}',)], "value string")
    out = df.select(bus.errors().alias("e"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.event_type") == 1 and plan.count("$.event_id") == 1
    found = out.first().e
    assert found[0] == "event_id is missing" and found[-1] == "payload.cloud_cover is out of range"
    assert [x for x in found if x.startswith("payload.") and "missing" in x] == [f"payload.{f} is missing" for f in ("alert_id", "message", "severity", "created_at")]
