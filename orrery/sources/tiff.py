"""Uncompressed TIFF images as pixel tables, with a task for each few strips.

A file's head says where its strips are; those are dealt over tasks, which read nothing else,
so an image of any size takes no more memory than BYTES of strips and one strip more. Files
are reached by path or by any address that Arrow's file systems know (file, hdfs, s3, gs).

Defined results: samples of a pixel are numbered from 0 in the file's order; only the first
image of a file is read; no data is null and not-a-number stays what it is. Compressed, tiled or
planar images and samples that are not whole bytes are an error that names the file.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of strips that a task reads at least.
BYTES = 8_000_000

# Numbers of tags and kinds of fields in TIFF 6.0.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, TILES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 322, 339
KINDS = {1: "B", 3: "H", 4: "I"}
FORMATS = {1: "u", 2: "i", 3: "f"}


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system, inner


@dataclass(frozen=True)
class Head:
    """What the first directory of a file tells."""

    width: int
    height: int
    samples: int
    rows: int
    dtype: str
    strips: tuple[tuple[int, int], ...]


def head(stream, path: str) -> Head:
    """The head of an open file."""
    order = {b"II": "<", b"MM": ">"}.get(stream.read(2))
    if order is None or struct.unpack(order + "H", stream.read(2))[0] != 42:
        raise ValueError(f"{path} is no TIFF")
    stream.seek(struct.unpack(order + "I", stream.read(4))[0])
    (n,) = struct.unpack(order + "H", stream.read(2))
    entries = [struct.unpack(order + "HHI4s", stream.read(12)) for _ in range(n)]
    tags = {}
    for tag, kind, count, inline in entries:
        if kind not in KINDS:
            continue
        size = struct.calcsize(KINDS[kind]) * count
        if size > 4:
            stream.seek(struct.unpack(order + "I", inline)[0])
            inline = stream.read(size)
        tags[tag] = struct.unpack(f"{order}{count}{KINDS[kind]}", inline[:size])
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    bits, samples = tags.get(BITS, (1,)), one(SAMPLES, 1)
    if WIDTH not in tags or HEIGHT not in tags or OFFSETS not in tags or TILES in tags or one(COMPRESSION, 1) != 1 or (samples > 1 and one(PLANAR, 1) != 1):
        raise ValueError(f"{path} is not stored as plain strips of pixels")
    if len(set(bits)) > 1 or bits[0] not in (8, 16, 32, 64) or one(FORMAT, 1) not in FORMATS or (one(FORMAT, 1) == 3 and bits[0] == 8):
        raise ValueError(f"{path} has samples of {bits[0]} bits")
    rows = min(one(ROWS, one(HEIGHT)), one(HEIGHT))
    line = one(WIDTH) * samples * bits[0] // 8
    sizes = tags.get(COUNTS) or tuple(line * min(rows, one(HEIGHT) - k * rows) for k in range(len(tags[OFFSETS])))
    return Head(one(WIDTH), one(HEIGHT), samples, rows, f"{order}{FORMATS[one(FORMAT, 1)]}{bits[0] // 8}", tuple(zip(tags[OFFSETS], sizes)))


@dataclass
class Strips(InputPartition):
    path: str
    head: Head
    first: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, least: int = BYTES):
        self.path, self.least = path, least

    def partitions(self):
        """Files whose names end in .tif or .tiff at the path or below; only their heads are read here."""
        from pyarrow import fs

        system, inner = _open(self.path)
        info = system.get_file_info(inner)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type != fs.FileType.File or not f.path.lower().endswith((".tif", ".tiff")):
                continue
            with system.open_input_file(f.path) as stream:
                found = head(stream, f.path)
            first = held = 0
            for k, (_, size) in enumerate(found.strips):
                held += size
                if held >= self.least or k == len(found.strips) - 1:
                    out.append(Strips(f.path, found, first, k + 1))
                    first, held = k + 1, 0
        return out

    def read(self, part):
        import numpy as np
        import pyarrow as pa

        if part is None:  # a path without images
            return
        system, _ = _open(self.path)
        h = part.head
        with system.open_input_file(part.path) as stream:
            for k in range(part.first, part.stop):
                offset, size = h.strips[k]
                stream.seek(offset)
                rows = min(h.rows, h.height - k * h.rows)
                values = np.frombuffer(stream.read(size), h.dtype, rows * h.width * h.samples).astype(np.float64)
                at = np.arange(len(values))
                row, col = at // (h.width * h.samples) + k * h.rows, at // h.samples % h.width
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(at)), pa.array((at % h.samples).astype(np.int32)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(values)], names=["path", "sample", "row", "col", "value"])


class TiffPixels(DataSource):
    """spark.read.format("tiff_pixels").load(path); option bytes: of strips that a task reads at least."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pixels"

    def schema(self) -> str:
        return "path string, sample int, row int, col int, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("bytes", BYTES)))


def pixels(spark: SparkSession, path: str, least: int = BYTES) -> DataFrame:
    """(path, sample, row, col, value) of all images at the path or below."""
    spark.dataSource.register(TiffPixels)
    return spark.read.format(TiffPixels.name()).option("bytes", least).load(path)


def areas(spark: SparkSession, path: str) -> DataFrame:
    """(aoi_id, band, timing, row, col, value) of files named like `area_before_B4.tif`, or `before_B4.tif` in the area's folder; `rgb` has bands R, G and B."""
    name = r"([^/]+)/(?:([^/]*)_)?(before|after)_(B0?4|B0?8|rgb)\.[^./]+$"
    rows = pixels(spark, path).filter(F.col("path").rlike(name))
    get = lambda k: F.regexp_extract("path", name, k)
    area = F.when(get(2) != "", get(2)).otherwise(get(1))
    band = F.when(get(4) == "rgb", F.get(F.array(F.lit("R"), F.lit("G"), F.lit("B")), F.col("sample"))).otherwise(F.replace(get(4), F.lit("0"), F.lit("")))
    return rows.select(area.alias("aoi_id"), band.alias("band"), get(3).alias("timing"), "row", "col", "value").filter("band IS NOT NULL")
