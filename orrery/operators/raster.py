"""Raster change on pixel tables (aoi_id, band, timing, row, col, value); masks as images are in tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import severity
from orrery.sources.tables import dropped, stored

# Grey weights of red, green and blue.
GREY = (0.2989, 0.5870, 0.1140)


def scaled(pixels: DataFrame) -> DataFrame:
    """Values to 0..1: above 1.5 they count as ten thousandths, then by the largest value if it is above 1.001."""
    # One row per image, as a table: Spark sees its size and need not deal the pixels for the join.
    top = stored(pixels.groupBy("aoi_id", "band", "timing").agg(F.max("value").alias("top")))
    first = F.when(F.col("top") > 1.5, F.col("value") / 10_000).otherwise(F.col("value"))
    top2 = F.when(F.col("top") > 1.5, F.col("top") / 10_000).otherwise(F.col("top"))
    return pixels.join(top, ["aoi_id", "band", "timing"]).withColumn("value", F.when(top2 > 1.001, first / top2).otherwise(first)).drop("top")


def grey(pixels: DataFrame, bands: tuple[str, str, str] = ("R", "G", "B")) -> DataFrame:
    """(aoi_id, timing, row, col, value) of weighted colours."""
    weight = sum((F.when(F.col("band") == b, F.lit(w)).otherwise(F.lit(0.0)) for b, w in zip(bands, GREY)), F.lit(0.0))
    return pixels.groupBy("aoi_id", "timing", "row", "col").agg(F.sum(F.col("value") * weight).alias("value"))


def ndvi(pixels: DataFrame, red: str = "B4", nir: str = "B8") -> DataFrame:
    """(aoi_id, timing, row, col, value) = (nir - red) / max(nir + red, 1e-6)."""
    r, n = (F.max(F.when(F.col("band") == b, F.col("value"))) for b in (red, nir))
    out = pixels.filter(F.col("band").isin(red, nir)).groupBy("aoi_id", "timing", "row", "col").agg(r.alias("r"), n.alias("n"))
    return out.select("aoi_id", "timing", "row", "col", ((F.col("n") - F.col("r")) / F.greatest(F.col("n") + F.col("r"), F.lit(1e-6))).alias("value"))


def difference(index: DataFrame, mode: str = "abs") -> DataFrame:
    """(aoi_id, row, col, diff, score) after minus before; neg and pos are clipped to 0..1. One shuffle serves both dates."""
    b, a = (F.max(F.when(F.col("timing") == t, F.col("value"))) for t in ("before", "after"))
    return _scored(index.groupBy("aoi_id", "row", "col").agg(b.alias("b"), a.alias("a")), mode)


def ndvi_difference(pixels: DataFrame, mode: str = "abs", red: str = "B4", nir: str = "B8") -> DataFrame:
    """difference of ndvi. One shuffle serves both bands, too: a pixel's values are together before it."""
    held = [F.max(F.when((F.col("band") == band) & (F.col("timing") == t), F.col("value"))).alias(name) for t, band, name in (("before", red, "r0"), ("before", nir, "n0"), ("after", red, "r1"), ("after", nir, "n1"))]
    index = lambda r, n: (F.col(n) - F.col(r)) / F.greatest(F.col(n) + F.col(r), F.lit(1e-6))
    out = pixels.filter(F.col("band").isin(red, nir)).groupBy("aoi_id", "row", "col").agg(*held)
    return _scored(out.select("aoi_id", "row", "col", index("r0", "n0").alias("b"), index("r1", "n1").alias("a")), mode)


def _scored(both: DataFrame, mode: str) -> DataFrame:
    """Indexes before (b) and after (a) as their difference and its score."""
    d = F.col("a") - F.col("b")
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    score = {"abs": F.abs(d), "neg": clip(-d), "pos": clip(d)}[mode]
    return both.filter("a IS NOT NULL AND b IS NOT NULL").select("aoi_id", "row", "col", d.alias("diff"), score.alias("score"))


#: Buckets that a pass counts for an image.
BUCKETS = 1 << 14


def thresholds(scores: DataFrame, percentile: float = 95.0, buckets: int = BUCKETS) -> DataFrame:
    """(aoi_id, threshold): the interpolated percentile of each area's finite scores, exactly.

    The two scores around it are found by refining histograms: a pass counts what lies in each
    of so many equal parts of the range that is left, and keeps the part that holds the
    rank, with its least and largest score. A part that holds one value is done, and each
    pass has fewer values than the one before, so it ends; scores of some decimal places
    take about four passes. A task holds buckets, never the values of an image.
    """
    fine = stored(_finite(scores))
    out = _ranked(fine, percentile, buckets)
    dropped(fine)
    return out


def _finite(scores: DataFrame) -> DataFrame:
    return scores.select("aoi_id", F.col("score").cast("double").alias("score")).filter(~F.isnan("score") & (F.abs("score") < float("inf")))


def _ranked(fine: DataFrame, percentile: float, buckets: int = BUCKETS) -> DataFrame:
    """thresholds of a table's finite scores."""
    base = fine.groupBy("aoi_id").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).withColumn("at", (F.col("n") - 1) * F.lit(percentile / 100))
    ends = F.array(F.struct(F.lit(0).alias("end"), F.floor("at").alias("nth")), F.struct(F.lit(1).alias("end"), F.ceil("at").alias("nth")))
    ranks = stored(base.select("aoi_id", "at", "lo", "hi", F.explode(ends).alias("x")).select("aoi_id", "at", "lo", "hi", "x.end", F.col("x.nth").cast("long").alias("nth")))
    while not ranks.filter("lo < hi").isEmpty():
        left = ranks.filter("lo < hi").withColumnRenamed("aoi_id", "area")
        rows = fine.join(left, F.col("aoi_id").eqNullSafe(F.col("area")) & F.col("score").between(F.col("lo"), F.col("hi")))
        half = F.when(F.col("hi") - F.col("lo") < float("inf"), 1.0).otherwise(0.5)  # the range itself may be no double
        part = (F.col("score") * half - F.col("lo") * half) / (F.col("hi") * half - F.col("lo") * half)
        held = rows.groupBy("aoi_id", "at", "end", "nth", F.least(F.floor(part * buckets), F.lit(buckets - 1)).alias("bucket")).agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("aoi_id", "end").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = held.withColumn("before", before).filter("nth >= before AND nth < before + n").withColumn("nth", F.col("nth") - F.col("before"))
        later = stored(ranks.filter("lo >= hi").unionByName(found.select(*ranks.columns)))
        dropped(ranks)
        ranks = later
    one = lambda k: F.max(F.when(F.col("end") == k, F.col("lo")))
    both = ranks.groupBy("aoi_id", "at").agg(one(0).alias("a"), one(1).alias("b"))
    gap, t = F.col("b") - F.col("a"), F.col("at") - F.floor("at")
    return both.select("aoi_id", F.when(t >= 0.5, F.col("b") - gap * (1 - t)).otherwise(F.col("a") + gap * t).alias("threshold"))


def masked(scores: DataFrame, percentile: float = 95.0) -> DataFrame:
    """scores with mask: at least the interpolated percentile of the area's finite scores; what is no number is not set."""
    scores = stored(scores)  # read by each pass and by the mask
    cut = _ranked(_finite(scores), percentile).withColumnRenamed("aoi_id", "area")
    return scores.join(cut, F.col("aoi_id").eqNullSafe(F.col("area")), "left").drop("area").withColumn("mask", F.coalesce((F.col("score") >= F.col("threshold")) & ~F.isnan("score"), F.lit(False)).cast("int"))


def erode(m: np.ndarray, outside: bool = False) -> np.ndarray:
    p = np.pad(m, 1, constant_values=outside)
    return p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]


def dilate(m: np.ndarray) -> np.ndarray:
    p = np.pad(m, 1)
    return p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]


def fill_holes(m: np.ndarray) -> np.ndarray:
    """What the background does not reach from the edge becomes part of the mask."""
    found = label(~m)
    edge = np.unique(np.concatenate([found[0], found[-1], found[:, 0], found[:, -1]]))
    return m | ~np.isin(found, edge[edge > 0]) & (found > 0)


def label(m: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """Components numbered from 1 in the order of their first pixel, rows first: runs of pixels are joined, then painted."""
    h, w = m.shape
    out = np.zeros((h, w), np.int64)
    step = np.diff(np.pad(m, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    if not len(row):
        return out
    # Places with a gap between rows; a run meets those runs of the next row that it overlaps, or touches at a corner.
    begin, end, down = row * (w + 2) + start, row * (w + 2) + stop, w + 2
    low = np.searchsorted(end, begin + down, "left" if connectivity == 8 else "right")
    high = np.searchsorted(begin, end + down, "right" if connectivity == 8 else "left")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(row))
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root != root[root]).any():
            root = root[root]
    out[m] = np.repeat(np.unique(root, return_inverse=True)[1] + 1, stop - start)
    return out


def boxes(labelled: DataFrame, min_area: int = 1) -> DataFrame:
    """Bounding boxes (stops exclusive) and pixel counts of components of at least min_area."""
    out = labelled.groupBy("aoi_id", "label").agg(F.min("row").alias("r0"), F.min("col").alias("c0"), (F.max("row") + 1).alias("r1"), (F.max("col") + 1).alias("c1"), F.count("*").alias("pixels"))
    return out.filter(F.col("pixels") >= min_area)


def change_metrics(masks: DataFrame) -> DataFrame:
    """Changed and all pixels of each area and their ratio."""
    return masks.groupBy("aoi_id").agg(F.sum("mask").cast("long").alias("changed"), F.count("*").alias("total"), F.avg("mask").alias("changed_frac"))


def change_events(metrics: DataFrame, occurred_at: str, threshold: str = "p95") -> DataFrame:
    """An event for each area; its id follows from area, time and threshold, so reruns do not add others."""
    when = F.lit(occurred_at if "T" in occurred_at else f"{occurred_at}T00:00:00Z")
    return metrics.select(F.sha2(F.concat_ws("|", "aoi_id", when, F.lit(threshold)), 256).alias("event_id"), "aoi_id", when.alias("occurred_at"), F.col("changed_frac").alias("score"), severity.of_change(F.col("changed_frac")).alias("severity"))
