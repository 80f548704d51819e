"""The bus and the alert pipeline as streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.config import Dedupe
from orrery.operators import bus
from orrery.operators.alerts import Fold, dedupe_run, keyed
from orrery.sources.buckets import BucketTable
from orrery.sources.tables import dropped, stored


def inbox(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of JSON that arrive in a folder, as text with the file's name."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumn("file", F.col("_metadata.file_name"))


def _put(df: DataFrame, path: str, form: str = "parquet", *by: str) -> None:
    """A batch's part in place of what an earlier try of the batch wrote."""
    df.write.mode("overwrite").partitionBy(*by).format(form).save(path)


def dispatch(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    available_now: bool = True,
    accept: Callable[[DataFrame], DataFrame] | None = None,
    tries: int = 5,
    base_delay: float = 1.0,
    max_delay: float = 60.0,
    buckets: int = 64,
    now: Callable[[], float] = time.time,
):
    """Envelopes to done, dup and err below root, and valid ones to topic folders.

    A key's first arrival wins for ever. Keys that are done lie in a table of buckets, of which
    a batch reads those of its own keys and swaps them last: a batch that broke off anywhere is
    done again and replaces what it wrote, and one that is done is not done again. An unknown
    event type is an error of that event and does not stop the stream.

    accept, if given, hands first arrivals on (a column `accepted` says how it went; an event
    can be handed on twice if a batch breaks off). What was not accepted waits in `retry`, twice
    as long each time (plus up to a fifth by key), and comes again with the first batch after
    that; after so many tries it goes to `dead`, and its key is free again. An arrival of
    a waiting key is a duplicate.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        keys = BucketTable(spark, f"{root}/seen", "idempotency_key string", ["idempotency_key"], buckets)
        if keys.has(number):
            return
        get = lambda p: F.get_json_object("value", p)
        fields = lambda rows: rows.select("value", "file", get("$.idempotency_key").alias("idempotency_key"), get("$.event_type").alias("event_type"), get("$.occurred_at").alias("occurred_at"), bus.errors().alias("errors"), "tries")
        rows, clock, waiting = fields(df.withColumn("tries", F.lit(0))), now(), None
        if accept is not None and keys.run is not None:
            waiting = spark.read.parquet(f"{root}/retry/batch={keys.run}")  # as the last batch that is done left it
            rows = rows.unionByName(fields(waiting.filter(F.col("due") <= clock)))
        rows = rows.withColumn("arrival", F.struct((-F.col("tries")).alias("tries"), "file", "occurred_at", F.xxhash64("value")))
        rows = stored(rows)
        touched = keys.touched(rows)
        seen = keys.read(touched)
        later = waiting.filter(F.col("due") > clock) if waiting is not None else None
        known = seen if later is None else seen.unionByName(later.select("idempotency_key"))
        out = bus.ingest(known, rows, order="arrival", fails=F.size("errors") > 0).withColumn("topic", bus.topic(F.col("event_type"))).drop("arrival")
        if accept is not None:
            tried = accept(out.filter("outcome = 'done'")).withColumn("tries", F.col("tries") + 1)
            how = F.when(F.coalesce("accepted", F.lit(False)), "done").when(F.col("tries") >= tries, "dead").otherwise("retry")
            out = tried.withColumn("outcome", how).select(*out.columns).unionByName(out.filter("outcome != 'done'"))
        out = stored(out)  # handed on once, whatever is read below
        for outcome in ("done", "dup", "err", *(("dead",) if accept else ())):
            _put(out.filter(F.col("outcome") == outcome).drop("outcome", "tries"), f"{root}/{outcome}/batch={number}")
        _put(out.filter("outcome IN ('done', 'dup')").select("value", "topic", "idempotency_key", "occurred_at"), f"{root}/topics/batch={number}", "json", "topic")
        if accept is not None:
            wait = F.least(F.lit(float(max_delay)), F.lit(float(base_delay)) * F.pow(F.lit(2.0), F.col("tries") - 1)) * (1 + F.pmod(F.xxhash64("idempotency_key", "tries"), F.lit(1000)) / 5000)
            again = out.filter("outcome = 'retry'").select("value", "file", "idempotency_key", "tries", (F.lit(clock) + wait).alias("due"))
            _put(again if later is None else again.unionByName(later), f"{root}/retry/batch={number}")
        # The last step: from here on the batch is done.
        keys.replace(seen.unionByName(out.filter("outcome = 'done'").select("idempotency_key")), touched, number)
        dropped(rows, out)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def once(stream: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """The first event of each key, with state that never expires."""
    return stream.dropDuplicates([key])


def dedupe(stream: DataFrame, config: Dedupe = Dedupe(), late_seconds: int | None = None) -> DataFrame:
    """The batch operator's decisions on a stream of matched rows: id, subscription_id, status.

    State is kept by the batch operator's groups. Rows of a batch are taken in the order of
    pos. All state is kept, so a late row is decided as in batch; with late_seconds what
    rows up to so late cannot reach is forgotten, and a key that fell out is a new one.
    """
    import pickle

    import pandas as pd

    def run(key, frames, state):
        fold = Fold(config)
        if state.exists:
            for row in pickle.loads(state.get[0]):  # written by this function only
                entry, k, _, at, value = row
                fold.recall(entry, k, at, value)
        pdf = pd.concat(list(frames)).sort_values(["pos", "sub_pos"])
        pdf["status"] = [fold.put(d, f, v, int(t)) for d, f, v, t in zip(pdf["dedupe_key"], pdf["flap_key"], pdf["flap_value"], pdf["at"])]
        fold.expire(late_seconds)
        state.update((pickle.dumps(fold.rows()),))
        yield pdf[["id", "subscription_id", "status"]]

    rows = keyed(stream, config).select("pos", "sub_pos", "id", "subscription_id", "group_key", "dedupe_key", "flap_key", "flap_value", "at")
    return rows.groupBy("group_key").applyInPandasWithState(run, "id string, subscription_id string, status string", "state binary", "append", "NoTimeout")


def dedupe_runs(stream: DataFrame, path: str, checkpoint: str, config: Dedupe = Dedupe(), **how):
    """alerts.dedupe_run() of each batch, to `decided` below path; batch runs can go on from the state that it leaves."""

    def batch(df: DataFrame, number: int) -> None:
        dedupe_run(stored(df), path, number, config, **how)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def service_metrics(stream: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, order: str, by: Sequence[str] = (), last: int = 256):
    """compute() of the last requests by `order` (ties by the other columns), of each key if `by` names some, whatever batches they came in.

    Each batch adds its rows to the last ones so far, keeps so many, and writes `last` and then
    `metrics` (with requests_total, all requests so far); a batch that breaks off starts from
    what the one before left. latest_metrics() reads the newest. compute() must not depend on
    the order of ties.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        before = max((n for n in _batches(spark, f"{path}/metrics") if n < number), default=None)
        rows, total = df, df.count()
        if before is not None:
            rows = spark.read.schema(df.schema).parquet(f"{path}/last/batch={before}").unionByName(df)
            total += spark.read.parquet(f"{path}/metrics/batch={before}").first()["requests_total"]
        newest = [F.desc(order), *[c for c in df.columns if c != order]]
        if by:
            nth = F.row_number().over(Window.partitionBy(*by).orderBy(*newest))
            rows = rows.withColumn("nth_newest", nth).filter(F.col("nth_newest") <= last).drop("nth_newest")
        else:
            rows = rows.orderBy(*newest).limit(last)
        _put(rows, f"{path}/last/batch={number}")
        kept = spark.read.schema(df.schema).parquet(f"{path}/last/batch={number}")
        _put(compute(kept).withColumn("requests_total", F.lit(total)), f"{path}/metrics/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that were written to their end."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [int(n.getName().removeprefix("batch=")) for n in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]


def latest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """What service_metrics() wrote last."""
    return spark.read.parquet(f"{path}/metrics/batch={max(_batches(spark, f'{path}/metrics'))}")
