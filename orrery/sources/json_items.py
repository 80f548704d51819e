"""Items of large JSON arrays, read by several tasks a file.

A file is read as pieces that end with a brace, which lets Spark split it anywhere. Whether a
piece starts inside a string, and how deep, follows from all text before it, so there are two
passes. The first walks each split for both cases (inside a string or not) and tells how it
ends, how much deeper it got and how many separators it met at each depth. Those few numbers
are put one after another by file, so that each split knows its true start. The second pass
cuts the splits at the array's own separators; only what hangs over a split's end, two
fragments a split, is joined with what follows.

An item is held whole, as is a stretch without a closing brace (an array of plain values is
one such stretch a split).
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.sources.tables import stored

#: Splits up to which their starts are sent to all executors; beyond, pieces are dealt by split.
MOST_SENT = 100_000

_MARK = re.compile(r'\\.|["\[\]{},\\]', re.DOTALL)
_SPLIT = "file string, start long"
_ENDS = f"{_SPLIT}, head string, case boolean, inside boolean, deeper int, separators map<string,long>"


def _walk(text: str, inside: bool, met) -> bool:
    """Calls met(mark, place) for each bracket, brace and comma outside of strings; whether the text ends inside one."""
    for m in _MARK.finditer(text):
        mark = m.group()
        if mark == '"':
            inside = not inside
        elif not inside and len(mark) == 1 and mark != "\\":
            met(mark, m.start())
    return inside


class _Depth:
    """How deep a walk is, and its separators: the array's bracket at depth 0, and commas and the last bracket at depth 1."""

    def __init__(self, depth: int = 0):
        self.depth, self.counts = depth, Counter()

    def met(self, mark: str, _place: int) -> bool:
        if mark in "[{":
            if mark == "[":
                self.counts[self.depth] += 1  # at the depth that it starts from
                self.depth += 1
                return self.depth == 1
            self.depth += 1
            return False
        if mark == ",":
            self.counts[self.depth - 1] += 1
            return self.depth == 1
        if mark == "]":
            self.counts[self.depth - 1] += 1
        self.depth -= 1
        return mark == "]" and self.depth == 0


def _splits(batches, columns: int):
    """(key, texts) of each split, where rows of a split follow one another."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(columns))))
    for key, own in groupby(rows, key=lambda r: r[1:]):
        yield key, (r[0] for r in own)


def _with_braces(texts, last: bool):
    """Pieces with the brace that ended each; the last one of a file, and one whose brace is not yet asked for, has none."""
    before = None
    for t in texts:
        if before is not None:
            yield before + "}"
        before = t
    yield before if last else before + "}"


def pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _first(batches):
    import pyarrow as pa

    kind = pa.schema([("file", pa.string()), ("start", pa.int64()), ("head", pa.string()), ("case", pa.bool_()), ("inside", pa.bool_()), ("deeper", pa.int32()), ("separators", pa.map_(pa.string(), pa.int64()))])
    for (file, start), texts in _splits(batches, 3):
        head, walks = "", {case: [case, _Depth()] for case in (False, True)}
        for text in _with_braces(texts, True):
            head = head or text.lstrip()[:1]
            for walk in walks.values():
                walk[0] = _walk(text, walk[0], walk[1].met)
        rows = [{"file": file, "start": start, "head": head, "case": case, "inside": inside, "deeper": d.depth, "separators": [(str(k), n) for k, n in d.counts.items()]} for case, (inside, d) in walks.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=kind)


def _starts(key, ends):
    """Of a file's splits in order: how each starts, and how many separators are before it."""
    import pyarrow as pa

    of = {}
    for r in ends.to_pylist():
        of.setdefault(r["start"], {})[r["case"]] = r
    inside, depth, before, out = False, 0, 0, []
    for k, start in enumerate(sorted(of)):
        out.append({"file": key[0].as_py(), "start": start, "inside": inside, "depth": depth, "before": before, "last": k == len(of) - 1})
        r = of[start][inside]
        # A bracket counts at the depth it starts from, commas and closing brackets one above their own: all at depth 0.
        before += sum(n for d, n in r["separators"] if depth + int(d) == 0)
        inside, depth = r["inside"], depth + r["deeper"] - (not r["inside"])  # the brace after the split's last piece
    return pa.Table.from_pylist(out, schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int32()), ("before", pa.int64()), ("last", pa.bool_())]))


def _second(batches):
    """Texts between separators, with the number of separators before each; whole: between two separators of the split."""
    import pyarrow as pa

    kind = pa.schema([("file", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("whole", pa.bool_()), ("item", pa.string())])
    for (file, start, inside, depth, before, last), texts in _splits(batches, 7):
        walk, at, held, first, rows, size = _Depth(depth), before, [], True, [], 0
        for text in _with_braces(texts, last):
            cuts = []
            inside = _walk(text, inside, lambda mark, place, cuts=cuts: cuts.append(place) if walk.met(mark, place) else None)  # noqa: B023
            begin = 0
            for c in cuts:
                item = "".join([*held, text[begin:c]])
                rows.append((file, start, at - 1, not first, item))
                size += len(item)
                held, begin, first, at = [], c + 1, False, at + 1
            held.append(text[begin:])
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=kind)
                rows, size = [], 0
        rows.append((file, start, at - 1, False, "".join(held)))
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=kind)


def items(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, item): the texts of a JSON array's items, numbered from 0 in each file."""
    text = pieces(spark, path)
    ends = text.mapInArrow(_first, _ENDS).persist()
    try:
        if ends.filter("start = 0 AND head != '['").limit(1).count():
            raise ValueError(f"{path} is no JSON array")
        starts = stored(ends.groupBy("file").applyInArrow(_starts, f"{_SPLIT}, inside boolean, depth int, before long, last boolean"))
    finally:
        ends.unpersist()
    if starts.count() <= MOST_SENT:
        told = text.join(F.broadcast(starts), ["file", "start"])  # keeps the order of pieces
    else:
        told = text.withColumn("at", F.monotonically_increasing_id()).join(starts, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "at")
    cut = told.select("value", "file", "start", "inside", "depth", "before", "last").mapInArrow(_second, f"{_SPLIT}, nth long, whole boolean, item string")
    part = cut.filter("NOT whole").groupBy("file", "nth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "item"))), lambda x: x["item"]), "").alias("item"))
    every = cut.filter("whole").select("file", "nth", "item").unionByName(part)
    return every.withColumn("item", F.regexp_replace("item", r"^[\x20\x09\x0A\x0D]+|[\x20\x09\x0A\x0D]+$", "")).filter("item != '' AND nth >= 0")


def objects(spark: SparkSession, path: str, run: int = 10_000) -> DataFrame:
    """(file, pos, item): items that are objects, numbered from 0 among themselves; runs of items are counted, then numbered each for itself."""
    rows = items(spark, path).filter("startswith(item, '{')").withColumn("run", F.floor(F.col("nth") / run))
    counts = rows.groupBy("file", "run").agg(F.count("*").alias("n"))
    earlier = counts.select("file", "run", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    nth = F.row_number().over(Window.partitionBy("file", "run").orderBy("nth")) - 1
    return rows.withColumn("own", nth).join(earlier, ["file", "run"]).select("file", (F.col("earlier") + F.col("own")).cast("int").alias("pos"), "item")
