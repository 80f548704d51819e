"""Alerts: matching subscriptions, suppressing repeats and flapping, routing, feeds."""

from __future__ import annotations

import operator
from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.config import Dedupe, Route, Subscription
from orrery.functions import severity
from orrery.sources.buckets import BucketTable
from orrery.sources.tables import dropped, stored

EVENT = ("pos", "id", "ts", "topic", "asset_id", "aoi_id", "rule_type", "severity", "acknowledged", "delta")


def _among(column: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.col(column).isin(list(values)), F.lit(False))


def _at_least(least: str | None) -> Column:
    """Rank of the event's severity (missing: info) against the ladder; an unknown threshold accepts all."""
    return severity.rank(F.coalesce(F.col("severity"), F.lit("info"))) >= severity.RANKS.get(least or "info", 0)


def predicate(s: Subscription) -> Column:
    """Whether an event matches; always true or false."""
    tests = [_at_least(s.severity_at_least)]
    for column, values in (("topic", s.topics), ("rule_type", s.rule_types), ("aoi_id", s.aoi_ids)):
        if values:
            tests.append(_among(column, values))
    if s.assets and "*" not in s.assets:
        tests.append(_among("asset_id", s.assets))
    for key, least in s.min_delta.items():
        # A key that is not there counts as 0, one that is null or no number fails.
        absent = F.col("delta").isNull() | ~F.coalesce(F.map_contains_key("delta", F.lit(key)), F.lit(False))
        value = F.when(absent, F.lit(0.0)).otherwise(F.try_element_at("delta", F.lit(key)).cast("string").try_cast("double"))
        tests.append(F.coalesce(value >= F.lit(float(least)), F.lit(False)))
    if s.suppress_if:
        tests.append(~reduce(operator.and_, (F.col(k).eqNullSafe(F.lit(v)) for k, v in s.suppress_if.items())))
    return reduce(operator.and_, tests)


def match(events: DataFrame, subscriptions: Sequence[Subscription]) -> DataFrame:
    """One row per event and matching subscription, with subscription_id and sub_pos.

    The subscriptions become predicates of one projection: no join and no shuffle.
    """
    hits = [F.when(predicate(s), F.struct(F.lit(k).alias("sub_pos"), F.lit(s.id).alias("subscription_id"))) for k, s in enumerate(subscriptions)]
    found = events.withColumn("hit", F.explode(F.array_compact(F.array(*hits)))) if hits else events.limit(0).withColumn("hit", F.struct(F.lit(0).alias("sub_pos"), F.lit("").alias("subscription_id")))
    return found.select("*", "hit.*").drop("hit")


def unmatched(events: DataFrame, subscriptions: Sequence[Subscription]) -> DataFrame:
    return events.filter(~reduce(operator.or_, (predicate(s) for s in subscriptions), F.lit(False)))


def match_metrics(events: DataFrame, subscriptions: Sequence[Subscription]) -> DataFrame:
    """(subscription_id, n): matches of each subscription, zeros kept; `unmatched` and `events` as rows of their own."""
    sums = [F.count_if(predicate(s)).alias(f"n{k}") for k, s in enumerate(subscriptions)]
    none = F.count_if(~reduce(operator.or_, (predicate(s) for s in subscriptions), F.lit(False)))
    rows = [F.struct(F.lit(s.id).alias("subscription_id"), F.col(f"n{k}").alias("n")) for k, s in enumerate(subscriptions)]
    more = [F.struct(F.lit(x).alias("subscription_id"), F.col(x).alias("n")) for x in ("unmatched", "events")]
    one = events.agg(*sums, none.alias("unmatched"), F.count("*").alias("events"))
    return one.select(F.explode(F.array(*rows, *more)).alias("r")).select("r.*").groupBy("subscription_id").agg(F.sum("n").alias("n"))


def key_text(fields: Sequence[str]) -> Column:
    """Fields joined by |, as text: null is None, booleans are capitalised."""
    return F.concat_ws("|", *[F.coalesce(F.when(F.col(f).cast("string").isin("true", "false"), F.initcap(F.col(f).cast("string"))).otherwise(F.col(f).cast("string")), F.lit("None")) for f in fields])


def micros(rows: DataFrame) -> Column:
    """A row's time in microseconds: its `moment`, where rows have one, as `ts` may be cut to seconds; null if it cannot be read."""
    name = "moment" if "moment" in rows.columns else "ts"
    return F.unix_micros(F.col(name).try_cast("timestamp") if dict(rows.dtypes)[name] == "string" else F.col(name).cast("timestamp"))


def keyed(matched: DataFrame, config: Dedupe) -> DataFrame:
    """matched with the texts of its keys, and its time in microseconds (unreadable: the epoch). Rows whose keys share no field form one group."""
    common = [f for f in config.key_fields if f in config.flap.key_fields] if config.flap.enabled else list(config.key_fields)
    return matched.withColumns(
        {
            "group_key": key_text(common) if common else F.lit(""),
            "dedupe_key": key_text(config.key_fields),
            "flap_key": key_text(config.flap.key_fields),
            "flap_value": key_text([config.flap.value_field]),
            "at": F.coalesce(micros(matched), F.lit(0).cast("long")),
        }
    )


def dedupe(matched: DataFrame, config: Dedupe = Dedupe(), order: Sequence[str] = ("pos", "sub_pos")) -> DataFrame:
    """Matched rows with status (kept, cooldown, duplicate, flapping), decided in input order.

    Rows are dealt by the fields that both keys share, so each group's state is its own.
    The fold over a group's rows is a streaming pass over sorted partitions: it holds the
    state of one group's keys, never its rows. Input order is the order of processing; a
    late row has a negative age and counts as cooldown.
    """
    rows = keyed(matched, config)
    names = [*matched.columns, "status"]
    at = {c: rows.columns.index(c) for c in ("group_key", "dedupe_key", "flap_key", "flap_value", "at")}
    keep = [rows.columns.index(c) for c in matched.columns]

    def run(batches):
        import pyarrow as pa

        group, state = None, None
        for batch in batches:
            statuses = []
            for g, d, f, v, t in zip(*(batch.column(at[c]).to_pylist() for c in at)):
                if g != group:
                    group, state = g, Fold(config)
                statuses.append(state.put(d, f, v, t))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(statuses, pa.string())], names=names)

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*matched.schema.fields, StructField("status", StringType())])
    dealt = rows.repartition("group_key").sortWithinPartitions("group_key", *order)
    return dealt.mapInArrow(run, schema)


#: What is known of a group of keys after its rows: when each key was last sent, and its values in order of arrival.
PAST = "group_key string, entry string, key string, nth long, at long, value string"


def dedupe_on(matched: DataFrame, past: DataFrame, config: Dedupe = Dedupe(), order: Sequence[str] = ("pos", "sub_pos"), late_seconds: int | None = None) -> DataFrame:
    """dedupe() of rows that follow a past: decided rows, and rows of PAST (status null) that a later call takes.

    A past goes through the same sorted pass, ahead of its group's rows. It is kept whole, so
    that calls on parts decide as one call on all, however late a row is. With late_seconds
    only what rows up to so late can reach is kept, and a key that fell out is a new one.
    """
    every = keyed(matched, config)
    own = [f for f in every.schema.fields if f.name in matched.columns]
    fields = ("group_key", "dedupe_key", "flap_key", "flap_value", "at", "entry", "nth")
    lacks = lambda kind: F.lit(None).cast(kind)
    rows = every.select(F.struct(*[F.col(f.name) for f in own]).alias("row"), *fields[:5], lacks("string").alias("entry"), lacks("long").alias("nth"))
    old = past.select(lacks(rows.schema["row"].dataType).alias("row"), "group_key", F.col("key").alias("dedupe_key"), F.col("key").alias("flap_key"), F.col("value").alias("flap_value"), "at", "entry", "nth")
    dealt = rows.unionByName(old).repartition("group_key").sortWithinPartitions("group_key", F.col("entry").isNull(), "nth", *[F.col(f"row.{c}") for c in order])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    text = lambda c: StructField(c, StringType())
    schema = StructType([StructField("row", rows.schema["row"].dataType), text("status"), text("group_key"), text("entry"), text("key"), StructField("nth", LongType()), StructField("at", LongType()), text("value")])

    def run(batches):
        import pyarrow as pa

        row_type, group, state = None, None, None

        def told(group, state):
            state.expire(late_seconds)
            made = state.rows()
            column = lambda k, kind: pa.array([m[k] for m in made], kind)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(made), row_type), pa.nulls(len(made), pa.string()), pa.array([group] * len(made), pa.string()), column(0, pa.string()), column(1, pa.string()), column(2, pa.int64()), column(3, pa.int64()), column(4, pa.string())], names=schema.names
            )

        for batch in batches:
            row_type = batch.column(0).type
            statuses, told_now = [], []
            for g, d, f, v, t, entry in zip(*(batch.column(k).to_pylist() for k in range(1, 7))):
                if g != group:
                    if state is not None:
                        told_now.append(told(group, state))
                    group, state = g, Fold(config)
                statuses.append(state.put(d, f, v, t) if entry is None else state.recall(entry, d, t, v))
            decided = pa.array([x is not None for x in statuses])
            n = sum(x is not None for x in statuses)
            none = lambda kind: pa.nulls(n, kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(decided), pa.array([x for x in statuses if x is not None], pa.string()), none(pa.string()), none(pa.string()), none(pa.string()), none(pa.int64()), none(pa.int64()), none(pa.string())], names=schema.names)
            yield from told_now
        if state is not None:
            yield told(group, state)

    return dealt.mapInArrow(run, schema)


def dedupe_run(matched: DataFrame, path: str, run: int, config: Dedupe = Dedupe(), order: Sequence[str] = ("pos", "sub_pos"), late_seconds: int | None = None, buckets: int = 64) -> DataFrame:
    """dedupe() after all earlier runs on the same path; runs are numbered upwards.

    The state is read for the keys of these rows only, and decisions count once the state is
    swapped: a run that broke off is done again, one that is done gives what it decided.
    Streams do the same by batch.
    """
    spark = matched.sparkSession
    table = BucketTable(spark, f"{path}/state", PAST, ["group_key"], buckets)
    decided = f"{path}/decided/run={run}"
    if not table.has(run):
        touched = table.touched(keyed(matched, config))
        out = stored(dedupe_on(matched, table.read(touched), config, order, late_seconds))
        out.filter("status IS NOT NULL").select("row.*", "status").write.mode("overwrite").parquet(decided)
        table.replace(out.filter("status IS NULL").select("group_key", "entry", "key", "nth", "at", "value"), touched, run)
        dropped(out)
    return spark.read.parquet(decided)


class History:
    """Values of one key in order of arrival, and how often they changed since a time.

    Where arrivals are in order of time a question costs a binary search; rows are only
    looked at again from the first that a late one can concern.
    """

    def __init__(self, rows=()):
        self.rows, self.latest, self.changes, self.late = [], [], [], -1
        for at, value in rows:
            self.add(at, value)

    def add(self, at: int, value: str) -> None:
        rows, latest, changes = self.rows, self.latest, self.changes
        if rows and at < latest[-1]:
            self.late = len(rows)
        changes.append(changes[-1] + (rows[-1][1] != value) if rows else 0)
        latest.append(max(at, latest[-1]) if rows else at)
        rows.append((at, value))

    def changed(self, least: int, value: str) -> int:
        """Changes among values not older than `least`, followed by one more value."""
        start = bisect_left(self.latest, least)
        if start == len(self.rows):
            return 0
        if start > self.late:
            return self.changes[-1] - self.changes[start] + (self.rows[-1][1] != value)
        recent = [v for t, v in self.rows[start:] if t >= least]
        return sum(a != b for a, b in zip(recent, [*recent[1:], value]))


class Fold:
    """The dedupe and flapping state of one group of keys, row by row."""

    def __init__(self, config: Dedupe):
        self.c, self.sent, self.history = config, {}, {}

    def put(self, key: str, flap_key: str, value: str, at: int | None) -> str:
        c, at = self.c, at or 0
        last = self.sent.get(key)
        if last is not None and (age := (at - last) / 1e6) < max(c.min_interval_seconds, c.ttl_seconds):
            if c.flap.enabled:
                self.history.setdefault(key, History()).add(at, value)
            return "cooldown" if age < c.min_interval_seconds else "duplicate"
        if c.flap.enabled:
            past = self.history.setdefault(flap_key, History())
            changes = past.changed(at - c.flap.window_seconds * 1_000_000, value)
            past.add(at, value)
            if changes > c.flap.max_changes:
                return "flapping"
        if flap_key == key and c.flap.enabled and key not in self.sent:
            self.history.pop(key, None)  # with equal keys the entry that is kept first replaces the history
        self.sent[key] = at
        return "kept"

    def recall(self, entry: str, key: str, at: int, value: str | None) -> None:
        """Takes in a row of an earlier fold."""
        if entry == "sent":
            self.sent[key] = at
        else:
            self.history.setdefault(key, History()).add(at, value)

    def rows(self) -> list[tuple]:
        """(entry, key, nth, at, value) of all that is known, values in order of arrival."""
        return [("sent", k, -1, at, None) for k, at in self.sent.items()] + [("seen", k, n, at, v) for k, h in self.history.items() for n, (at, v) in enumerate(h.rows)]

    def expire(self, late_seconds: int | None) -> None:
        """Forgets what no row can reach that is at most so late; nothing if that is None."""
        times = [*self.sent.values(), *(h.latest[-1] for h in self.history.values() if h.rows)]
        if late_seconds is None or not times:
            return
        least = lambda seconds: max(times) - (late_seconds + seconds) * 1_000_000
        sent, seen = least(max(self.c.ttl_seconds, self.c.min_interval_seconds)), least(self.c.flap.window_seconds)
        self.sent = {k: at for k, at in self.sent.items() if at > sent}
        self.history = {k: h for k, old in self.history.items() if (h := History(x for x in old.rows if x[0] >= seen)).rows}


def dedupe_metrics(decided: DataFrame) -> DataFrame:
    return decided.agg(F.count("*").alias("input"), F.count_if(F.col("status") == "kept").alias("kept"), F.count_if(F.col("status") != "kept").alias("suppressed"))


def flap_changes(events: DataFrame, key: Sequence[str], value: str, seconds: int) -> DataFrame:
    """events with `changes`: how often the value changed within the trailing window, the row's own change included.

    Values follow each other by the time itself, the window counts times rounded to seconds.
    """
    by = Window.partitionBy(*key).orderBy("at_us", "pos")
    changed = F.when(F.lag(value).over(by).isNotNull() & ~F.lag(value).over(by).eqNullSafe(F.col(value)), 1).otherwise(0)
    timed = events.withColumn("at_us", micros(events)).withColumn("at_s", F.rint(F.col("at_us") / 1e6).cast("long")).withColumn("changed", changed)
    span = Window.partitionBy(*key).orderBy("at_s").rangeBetween(-seconds, 0)
    return timed.withColumn("changes", F.sum("changed").over(span)).drop("at_us", "at_s", "changed")


def _route_predicate(r: Route) -> Column:
    tests = [_at_least(r.severity_at_least)]
    if r.subscription_ids:
        tests.append(_among("subscription_id", r.subscription_ids))
    if r.topics:
        tests.append(_among("topic", r.topics))
    return reduce(operator.and_, tests)


def route(matched: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """One row per matched row, route and channel: route_pos, route_id, channel_pos, channel_id, channel_type, channel_limit.

    A row that no route matches stays once, with null route and channel.
    """
    parts = []
    for k, r in enumerate(routes):
        structs = [
            F.struct(
                F.lit(k).alias("route_pos"), F.lit(r.id).alias("route_id"), F.lit(n).alias("channel_pos"), F.lit(c.id).alias("channel_id"), F.lit(c.type).alias("channel_type"), F.lit(c.max_per_run).cast("int").alias("channel_limit")
            )
            for n, c in enumerate(r.channels)
        ]
        kind = "array<struct<route_pos:int,route_id:string,channel_pos:int,channel_id:string,channel_type:string,channel_limit:int>>"
        parts.append(F.when(_route_predicate(r), F.array(*structs).cast(kind)).otherwise(F.array().cast(kind)))
    return matched.withColumn("sent_to", F.explode_outer(F.concat(*parts))).select("*", "sent_to.*").drop("sent_to")


KNOWN_TYPES = ("webhook", "email")


def limit(attempts: DataFrame, most: int | None, order: Sequence[str] = ("pos", "sub_pos", "route_pos", "channel_pos")) -> DataFrame:
    """attempts with status: sent, or why not (no_route, global_rate_limited, channel_rate_limited, unknown_channel_type).

    Sends in order; only successful ones use up a budget. A limit is reached at one place of
    the order and never left again, so all that rows need is those places: one for each
    limit that a channel has (routes may give a channel different ones, which share its
    count), and one for all. They are found among few rows: counts by SLAB positions tell
    which of them can still be within a limit. Attempts themselves are neither sorted nor dealt.
    """
    key = F.struct(*order)
    known = F.coalesce(F.col("channel_type").isin(*KNOWN_TYPES), F.lit(False))
    slim = stored(attempts.filter(F.col("route_id").isNotNull() & known).select(*order, "channel_id", F.col("channel_limit").alias("most"), F.floor(F.col(order[0]) / SLAB).alias("slab")))
    ends = limit_ends(slim, order)
    left = F.broadcast(ends)  # a row for each limit of a channel that is reached: no more than routes have channels
    placed = lambda rows, limit: rows.join(left, F.col("channel_id").eqNullSafe(F.col("of")) & (F.col(limit) == F.col("reached")), "left")
    within = lambda limit: F.col(limit).isNull() | ((F.col(limit) > 0) & (F.col("end").isNull() | (key <= F.col("end"))))
    last = None
    if most is not None and most > 0:
        sent = placed(slim, "most").filter(within("most"))
        sums = sent.groupBy("slab").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each SLAB positions
        at = sums.filter((F.col("before") < most) & (F.col("before") + F.col("n") >= most)).first()
        if at is not None:
            nth = F.row_number().over(Window.partitionBy("slab").orderBy(*order))
            last = sent.filter(F.col("slab") == at["slab"]).withColumn("nth", nth).filter(F.col("nth") == most - at["before"]).select(*order).first()
    over = F.lit(most == 0)
    if last is not None:
        kinds = dict(attempts.dtypes)
        over = key > F.struct(*[F.lit(last[c]).cast(kinds[c]).alias(c) for c in order])
    status = F.when(over, "global_rate_limited").when(known & ~within("channel_limit"), "channel_rate_limited").when(~known, "unknown_channel_type").otherwise("sent")
    routed = attempts.filter("route_id IS NOT NULL")
    done = placed(routed, "channel_limit").withColumn("status", status).drop("of", "reached", "end")
    return done.unionByName(attempts.filter("route_id IS NULL").withColumn("status", F.lit("no_route")))


def limit_ends(slim: DataFrame, order: Sequence[str]) -> DataFrame:
    """(of, reached, end): of each channel and limit that it reaches the place of the send that does.

    As no more than the largest limit of a channel counts, only so many first rows of each of its
    limits are put in order.
    """
    top = slim.groupBy("channel_id").agg(F.max("most").alias("top")).filter("top > 0").select(F.col("channel_id").alias("c"), "top")
    per = slim.groupBy("channel_id", "most", "slab").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("channel_id", "most").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    early = per.withColumn("before", before).join(F.broadcast(top), F.col("channel_id").eqNullSafe(F.col("c"))).filter("before < top").select("c", F.col("most").alias("m"), F.col("slab").alias("s"), "top")
    rows = slim.join(early, F.col("channel_id").eqNullSafe(F.col("c")) & F.col("most").eqNullSafe(F.col("m")) & (F.col("slab") == F.col("s")))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("channel_id", "most").orderBy(*order))).filter("nth <= top")
    kinds = dict(slim.dtypes)

    def fold(pdf):
        import pandas as pd

        used, out = 0, []
        limits = set(pdf["most"].dropna())
        for r in pdf.sort_values(list(order)).itertuples(index=False):
            if pd.isna(r.most) or used < r.most:
                used += 1
                if used in limits:
                    out.append((r.channel_id, used, *(getattr(r, c) for c in order)))
        return pd.DataFrame(out, columns=["of", "reached", *order])

    found = first.select("channel_id", "most", *order).groupBy("channel_id").applyInPandas(fold, f"of {kinds['channel_id']}, reached int, " + ", ".join(f"{c} {kinds[c]}" for c in order))
    return stored(found.select("of", "reached", F.struct(*order).alias("end")))


#: Positions of the order that one running sum covers.
SLAB = 100_000


def channel_counts(attempts: DataFrame) -> DataFrame:
    """Sent and skipped attempts by channel; rows without a route are charged to none."""
    return attempts.filter("channel_id IS NOT NULL").groupBy("channel_id").agg(F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") != "sent").alias("skipped"))


def safe_id(prefix: str = "ev_") -> Column:
    return F.coalesce(F.nullif(F.col("id"), F.lit("")), F.concat(F.lit(prefix), F.col("pos")))


def title() -> Column:
    """[SEV] topic / rule @ asset or area (subscription)."""
    text = lambda c: F.coalesce(F.col(c), F.lit("None"))
    where = F.coalesce(F.nullif(F.col("asset_id"), F.lit("")), F.nullif(F.col("aoi_id"), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("["), F.upper(F.coalesce(F.col("severity"), F.lit("info"))), F.lit("] "), text("topic"), F.lit(" / "), text("rule_type"), F.lit(" @ "), where, F.lit(" ("), F.col("subscription_id"), F.lit(")"))


def iso(ts: Column) -> Column:
    """ISO text with Z as +00:00."""
    return F.regexp_replace(ts, "Z$", "+00:00")


def feed(matched: DataFrame, most: int = 100) -> DataFrame:
    """Newest first by the ISO text, then input order; most <= 0: all."""
    rows = matched.select(
        safe_id().alias("id"), iso(F.col("ts")).alias("ts"), "subscription_id", "topic", F.coalesce("severity", F.lit("info")).alias("severity"), severity.rank(F.col("severity")).alias("severity_rank"),
        "asset_id", "aoi_id", "rule_type", title().alias("title"), "pos", "sub_pos",
    )
    rows = rows.orderBy(F.desc("ts"), "pos", "sub_pos")
    return (rows.limit(most) if most > 0 else rows).drop("pos", "sub_pos")


def outbox(attempts: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """(channel_id, path, payload): what sent attempts would write; of equal paths the last stays."""
    folder = F.create_map(*[F.lit(x) for r in routes for c in r.channels for x in (c.id, str(c.options.get("outbox_dir", f"outbox/{c.type}/{c.id}")))])
    rows = attempts.filter(F.col("status") == "sent").select(
        "channel_id",
        F.concat(F.try_element_at(folder, F.col("channel_id")), F.lit("/"), safe_id("v_"), F.lit("__"), F.col("subscription_id"), F.lit(".json")).alias("path"),
        F.to_json(F.struct("subscription_id", F.struct(*[c for c in EVENT if c in attempts.columns]).alias("event"))).alias("payload"),
        F.struct("pos", "sub_pos", "route_pos", "channel_pos").alias("at"),
    )
    return rows.groupBy("channel_id", "path").agg(F.max_by("payload", "at").alias("payload"))
