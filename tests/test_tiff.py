"""Strips that are written are read back, by several tasks."""

import struct

import numpy as np
import pytest

from orrery.operators import raster
from orrery.sources import tiff


def write(path, image, rows, order="<", **other):
    """An image (height, width, samples) as plain strips of so many rows."""
    h, w, s = image.shape
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    data = image.astype(image.dtype.newbyteorder(order))
    strips = [data[k : k + rows].tobytes() for k in range(0, h, rows)]
    offsets = np.cumsum([8, *map(len, strips)])
    tags = {256: [w], 257: [h], 258: [image.dtype.itemsize * 8] * s, 259: [1], 273: [int(x) for x in offsets[:-1]], 277: [s], 278: [rows], 279: [len(x) for x in strips], 339: [kind] * s} | {int(k[1:]): v for k, v in other.items()}
    at = int(offsets[-1])
    more_at, more, entries = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, values in sorted(tags.items()):
        packed = struct.pack(f"{order}{len(values)}I", *values)
        if len(packed) > 4:
            where = struct.pack(order + "I", more_at + len(more))
            more += packed
        else:
            where = packed
        entries += struct.pack(order + "HHI", tag, 4, len(values)) + where
    path.write_bytes({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at) + b"".join(strips) + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + more)


@pytest.mark.parametrize(("kind", "order", "samples", "rows"), [("u1", "<", 3, 4), ("u2", ">", 1, 7), ("i2", "<", 1, 50), ("f4", ">", 2, 1), ("f8", "<", 1, 16)])
def test_round_trip(spark, tmp_path, kind, order, samples, rows):
    image = (np.random.default_rng(rows).normal(size=(33, 21, samples)) * 90).astype(kind)
    write(tmp_path / "x.tif", image, rows, order)
    df = tiff.pixels(spark, str(tmp_path), 800)
    got = np.zeros(image.shape)
    found = df.collect()
    for r in found:
        got[r.row, r.col, r.sample] = r.value
    assert len(found) == image.size and (got == image.astype(float)).all()
    assert df.rdd.getNumPartitions() > 1 or rows > 33


def test_areas_to_scores(spark, tmp_path):
    rng = np.random.default_rng(2)
    bands = {(t, b): rng.integers(1000, 9000, (9, 8, 1)).astype("u2") for t in ("before", "after") for b in ("B4", "B8")}
    (tmp_path / "north").mkdir()
    for (t, b), image in bands.items():
        write(tmp_path / "north" / f"{t}_{b}.tif", image, 3)
        write(tmp_path / f"south_{t}_{b.replace('B', 'B0')}.TIF", image[::-1], 4)
    write(tmp_path / "other.tif", bands["before", "B4"], 3)
    scores = raster.difference(raster.ndvi(raster.scaled(tiff.areas(spark, str(tmp_path)))), "abs")
    got = {(r.aoi_id, r.row, r.col): r["diff"] for r in scores.collect()}
    ndvi = lambda t: (bands[t, "B8"] / 1e4 - bands[t, "B4"] / 1e4) / (bands[t, "B8"] / 1e4 + bands[t, "B4"] / 1e4)
    want = (ndvi("after") - ndvi("before"))[:, :, 0]
    assert len(got) == 2 * 72
    assert all(abs(got["north", r, c] - v) < 1e-12 and abs(got["south", 8 - r, c] - v) < 1e-12 for (r, c), v in np.ndenumerate(want))


def test_what_it_does_not_read(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert tiff.pixels(spark, str(tmp_path / "none")).count() == 0
    write(tmp_path / "packed.tif", np.zeros((4, 4, 1), "u1"), 2, _259=[5])
    with pytest.raises(Exception, match="plain strips"):
        tiff.pixels(spark, str(tmp_path)).count()
    (tmp_path / "packed.tif").write_bytes(b"not one")
    with pytest.raises(Exception, match="no TIFF"):
        tiff.pixels(spark, str(tmp_path)).count()
