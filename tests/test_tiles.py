"""Tiled masks equal whole images, however they are cut; exact percentiles equal numpy's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import linked, raster, tiles

SPOT = "aoi_id string, row int, col int, mask int"


def whole(m, open_iters, close_iters, min_area):
    for steps, first, then in ((open_iters, raster.erode, raster.dilate), (close_iters, raster.dilate, raster.erode)):
        for f in (first, then):
            for _ in range(steps):
                m = f(m)
    m = raster.fill_holes(m)
    found = raster.label(m)
    return m & (np.bincount(found.ravel())[found] >= min_area) if min_area > 1 else m


def images():
    rng = np.random.default_rng(3)
    spiral = np.zeros((33, 33), bool)
    for k in range(0, 16, 4):
        spiral[k, k : 33 - k] = spiral[32 - k, k : 33 - k] = spiral[k : 33 - k, k] = spiral[k : 33 - k, 32 - k] = True
    spiral[16, 0] = False
    smooth = rng.random((40, 21))
    for _ in range(2):
        smooth = (smooth + np.roll(smooth, 1, 0) + np.roll(smooth, 1, 1)) / 3
    return {"noise": (rng.random((30, 37)) < 0.55, 5, -9), "blobs": (smooth > 0.5, -17, 100), "spiral": (spiral, 0, 0), "dot": (np.ones((1, 1), bool), 7, 7), None: (rng.random((20, 20)) < 0.6, 0, 0), "clear": (np.zeros((9, 17), bool), 0, 0)}


def rows_of(found):
    return [(name, int(r + top), int(c + left), int(m[r, c])) for name, (m, top, left) in found.items() for r in range(m.shape[0]) for c in range(m.shape[1])]


@pytest.mark.parametrize("side", [8, 64])
def test_cleaned(spark, side):
    found = images()
    df = spark.createDataFrame(rows_of(found), SPOT).repartition(5)
    for how in ((1, 1, 6), (0, 3, 30)) if side == 8 else ((1, 1, 6),):
        got = {(r.aoi_id, r.row, r.col): r["mask"] for r in tiles.cleaned(df, *how, side=side).collect()}
        want = {(name, r + top, c + left): int(v) for name, (m, top, left) in found.items() for (r, c), v in np.ndenumerate(whole(m, *how))}
        assert got == want


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components(spark, connectivity):
    found = images()
    df = spark.createDataFrame(rows_of(found), SPOT).repartition(5)
    got = {(r.aoi_id, r.row, r.col): r.label for r in tiles.components(df, connectivity, side=8).collect()}
    want = {(name, r + top, c + left): int(v) for name, (m, top, left) in found.items() for (r, c), v in np.ndenumerate(raster.label(m, connectivity)) if v}
    assert got == want


def test_long_halo_and_sparse_pixels(spark):
    """More steps than a tile is wide, and an image of which most pixels are missing."""
    rows = [("a", r, c, 1) for r, c in ((0, 0), (0, 39), (20, 20), (39, 5), (39, 39))] + [("a", 20, 20, 0), ("a", None, 3, 1), ("a", 12, 12, None)]
    df = spark.createDataFrame(rows, SPOT)
    m = np.zeros((40, 40), bool)
    for _, r, c, v in rows[:5]:
        m[r, c] = v
    want = whole(m, 0, 11, 0)
    got = {(r.row, r.col): r["mask"] for r in tiles.cleaned(df, 0, 11, side=8).collect()}
    assert got == {(r, c): int(want[r, c]) for r, c in ((0, 0), (0, 39), (20, 20), (39, 5), (39, 39), (12, 12))}
    assert tiles.cleaned(df.limit(0), 1, 1, 5).collect() == [] and tiles.components(df.limit(0)).collect() == []


def test_roots_of_long_paths(spark):
    path = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1002), (1000, 1002), (7, 7)] + [(2000, k) for k in range(2001, 2100)]
    got = dict(linked.roots(spark.createDataFrame(path, "a int, b int")).collect())
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in (1000, 1001, 1002)} | {k: 2000 for k in range(2000, 2100)}
    assert linked.roots(spark.createDataFrame([], "a int, b int")).collect() == []


def test_thresholds_are_numpys(spark):
    rng = np.random.default_rng(5)
    areas = {
        "uniform": rng.random(3000), "ties": rng.integers(0, 5, 500) / 4, "one": np.array([0.25]), "two": np.array([1.0, 2.0]), "wide": rng.normal(size=400) * 10.0 ** rng.integers(-12, 12, 400),
        "ends": np.array([-1.7e308, 1.7e308, 1e307]), "same": np.full(50, 0.1),
    }
    rows = [(k, float(v)) for k, vs in areas.items() for v in vs] + [("uniform", float("nan")), ("uniform", float("inf")), ("none", float("nan")), ("none", None), (None, 3.5)]
    df = spark.createDataFrame(rows, "aoi_id string, score double").repartition(4)
    for p in (97.0, 33.3):
        got = dict(raster.thresholds(df, p, buckets=1024).collect())
        with np.errstate(over="ignore", invalid="ignore"):
            want = {k: float(np.percentile(v, p)) for k, v in areas.items()} | {None: 3.5}
        assert {k: v for k, v in got.items() if k != "ends"} == {k: v for k, v in want.items() if k != "ends"}
        assert "none" not in got and "ends" in got
    out = raster.masked(df, 97.0).filter("aoi_id = 'uniform'").agg(F.sum("mask"), F.count("*")).first()
    assert tuple(out) == ((areas["uniform"] >= np.percentile(areas["uniform"], 97.0)).sum() + 1, 3002)  # infinity is set, NaN is not


@pytest.mark.parametrize("span", [8, 16])
def test_parts_of_many_blocks(spark, monkeypatch, span):
    """Blocks of one tile and of four: parts pass from block to block, and halos do."""
    monkeypatch.setattr(tiles, "SPAN", span)
    found = images()
    df = spark.createDataFrame(rows_of(found), SPOT).repartition(5)
    got = {(r.aoi_id, r.row, r.col): r["mask"] for r in tiles.cleaned(df, 1, 3, 6, side=8).collect()}
    assert got == {(name, r + top, c + left): int(v) for name, (m, top, left) in found.items() for (r, c), v in np.ndenumerate(whole(m, 1, 3, 6))}
    for connectivity in (4, 8):
        got = {(r.aoi_id, r.row, r.col): r.label for r in tiles.components(df, connectivity, side=8).collect()}
        assert got == {(name, r + top, c + left): int(v) for name, (m, top, left) in found.items() for (r, c), v in np.ndenumerate(raster.label(m, connectivity)) if v}


def test_roots_in_one_task_or_by_steps(spark, monkeypatch):
    """A few edges are joined at once, whatever their nodes are; more of them step by step, with the same roots."""
    rows = [((None, k), (None, k + 1)) for k in range(60)] + [(("a", k), ("a", k + 2)) for k in range(40)] + [(("b", 1), ("b", 1)), (("a", 3), None)]
    df = spark.createDataFrame(rows, "a struct<area: string, first: int>, b struct<area: string, first: int>").repartition(3)
    by_steps = dict(linked.roots(df, few=0).collect())
    tables, stored = [], linked.stored
    monkeypatch.setattr(linked, "stored", lambda df: tables.append(df) or stored(df))
    assert dict(linked.roots(df).collect()) == by_steps and len(tables) == 1
    assert by_steps == {(None, k): (None, 0) for k in range(61)} | {("a", k): ("a", k % 2) for k in range(42)}
    assert linked.roots(df.filter("a.area = 'b'"), few=0).collect() == linked.roots(df.filter("a.area = 'b'")).collect() == []


def counted(df, seen):
    """df, and how many of its rows were made."""

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_pixels_are_made_once(spark):
    """What a mask and its tiles come from may be costly."""
    scores = spark.range(4000).selectExpr("'a' aoi_id", "cast(id div 50 AS int) row", "cast(id % 50 AS int) col", "cast(id * 7919 % 4001 AS double) score")
    seen = spark.sparkContext.accumulator(0)
    out = raster.masked(counted(scores, seen), 40.0)
    assert out.agg(F.sum("mask")).first()[0] == 2400 and seen.value == 4000
    seen = spark.sparkContext.accumulator(0)
    assert tiles.cleaned(counted(out.select("aoi_id", "row", "col", "mask"), seen), side=8).count() == 4000 and seen.value == 4000


def test_one_shuffle_for_both_bands_and_dates(spark):
    rng = np.random.default_rng(9)
    rows = [(name, band, timing, r, c, float(rng.random())) for name in ("a", None) for band in ("B4", "B8", "B2") for timing in ("before", "after", "later") for r in range(5) for c in range(4) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "aoi_id string, band string, timing string, row int, col int, value double")
    for mode in ("abs", "neg", "pos"):
        want, got = raster.difference(raster.ndvi(df), mode), raster.ndvi_difference(df, mode)
        assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    assert raster.ndvi_difference(df)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
