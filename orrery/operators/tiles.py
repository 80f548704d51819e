"""Masks of images of any size: cut into tiles, cleaned with halos, labelled through a graph of tiles.

A tile is a row with the bits of SIDE x SIDE pixels, so no group of any step is larger than
a block of SPAN x SPAN pixels with its halo, whatever the image. Morphology reaches as far as
its steps: each block gets that many pixels from its neighbours, and then works alone.
Components are labelled in the tiles of a block at once; a part of one is named by the first
of its pixels, and only pixels along the blocks' borders are joined to tell which parts touch.
The graph of those parts is contracted, and a component's root is its first pixel in the
image. Holes are parts of the background whose component does not reach the image's edge.

Images are rectangles around their pixels; pixels that a table lacks are not set. Rows without
a place are left out, and a null area is an area. A pixel given twice is set if one of its
rows is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import linked
from orrery.operators.raster import dilate, erode, label
from orrery.sources.tables import dropped, stored

SIDE = 256
#: Pixels along a block of whole tiles; a tile that is as large is a block.
SPAN = 1024
_KEY = "aoi_id string, tr int, tc int"
_AREA = "top int, left int, bottom int, right int"
_TILE = f"{_KEY}, {_AREA}, have binary, mask binary"
#: Parts of components in a block: the first pixel as row and column in one number, pixels, and whether it touches the image's edge; or a part's pixel on the block's border, where kind is given.
_PART = "aoi_id string, br int, bc int, first long, n long, edge boolean, kind int, cross int, place int"
#: Pixels of a tile's row in one number.
_WORD = 32
#: A place (row, column) relative to the image's corner as one number, in the order of rows.
_COLUMNS = 1 << 31


def _pack(m: np.ndarray) -> bytes:
    return np.packbits(m).tobytes()


def _bits(data: bytes | None, shape: tuple[int, int]) -> np.ndarray:
    if data is None:
        return np.zeros(shape, bool)
    return np.unpackbits(np.frombuffer(data, np.uint8), count=shape[0] * shape[1]).reshape(shape).astype(bool)


def _inside(t: dict, row: int, col: int, shape: tuple[int, int]) -> np.ndarray:
    """Which pixels of a rectangle that begins at row and col belong to the image of a tile."""
    rows, cols = row + np.arange(shape[0]), col + np.arange(shape[1])
    return ((rows >= t["top"]) & (rows < t["bottom"]))[:, None] & ((cols >= t["left"]) & (cols < t["right"]))[None, :]


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _out(rows: list[dict], ddl: str):
    """Rows as an Arrow batch; ddl: names and plain types."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(","))]))


def cut(masks: DataFrame, side: int = SIDE) -> DataFrame:
    """(aoi_id, row, col, mask) as tiles: all of an image's rectangle, those without pixels too."""
    rows = masks.select(F.col("aoi_id").cast("string").alias("aoi_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "mask").filter("row IS NOT NULL AND col IS NOT NULL")
    tile = lambda c: F.floor(F.col(c) / side).cast("int")
    dealt = rows.withColumns({"tr": tile("row"), "tc": tile("col")}).repartition("aoi_id", "tr", "tc")
    # A row of a tile as words of bits, so that Python sees a row for _WORD pixels.
    place = F.col("col") - F.col("tc") * side
    bit = F.expr(f"shiftleft(1L, (col - tc * {side}) % {_WORD})")
    words = dealt.groupBy("aoi_id", "tr", "tc", (F.col("row") - F.col("tr") * side).alias("r"), F.floor(place / _WORD).cast("int").alias("w")).agg(F.bit_or(bit).alias("have"), F.bit_or(F.when(F.col("mask").cast("int") > 0, bit).otherwise(F.lit(0).cast("long"))).alias("mask"))

    def packed(key, t):  # a tile's pixels, and for a while the rectangle around them
        import pyarrow as pa

        tr, tc = key[1].as_py(), key[2].as_py()
        have, mask = (np.zeros((side, -(-side // _WORD), _WORD), bool) for _ in range(2))
        for m, name in ((have, "have"), (mask, "mask")):
            m[t.column("r").to_numpy(), t.column("w").to_numpy()] = t.column(name).to_numpy()[:, None] >> np.arange(_WORD) & 1
        have, mask = (m.reshape(side, -1)[:, :side] for m in (have, mask))
        r, c = np.nonzero(have.any(1))[0] + tr * side, np.nonzero(have.any(0))[0] + tc * side
        ends = {"top": int(r[0]), "left": int(c[0]), "bottom": int(r[-1]) + 1, "right": int(c[-1]) + 1}
        return pa.Table.from_batches([_out([{"aoi_id": key[0].as_py(), "tr": tr, "tc": tc, "have": _pack(have), "mask": _pack(mask)} | ends], _TILE)])

    full = stored(words.groupBy("aoi_id", "tr", "tc").applyInArrow(packed, _TILE))
    area = full.groupBy("aoi_id").agg(F.min("top").alias("top"), F.min("left").alias("left"), F.max("bottom").alias("bottom"), F.max("right").alias("right"))
    along = lambda a, b: F.explode(F.sequence(tile(a), F.floor((F.col(b) - 1) / side).cast("int")))
    grid = area.withColumn("tr", along("top", "bottom")).withColumn("tc", along("left", "right"))
    none, lacks = F.lit(None).cast("binary"), F.lit(None).cast("int")
    both = grid.select("aoi_id", "tr", "tc", "top", "left", "bottom", "right", none.alias("have"), none.alias("mask")).unionByName(full.select("aoi_id", "tr", "tc", *[lacks.alias(c) for c in ("top", "left", "bottom", "right")], "have", "mask"))
    # A tile's row of the grid and its pixels, if any; null areas are grouped, too.
    return both.groupBy("aoi_id", "tr", "tc").agg(*[F.max(c).alias(c) for c in ("top", "left", "bottom", "right", "have", "mask")])


def pixels(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles as (aoi_id, row, col, mask) of the pixels that were given."""

    def run(batches):
        import pyarrow as pa

        for t in _rows(batches):
            r, c = np.nonzero(_bits(t["have"], (side, side)))
            on = _bits(t["mask"], (side, side))[r, c].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([t["aoi_id"]] * len(r), pa.string()), pa.array((r + t["tr"] * side).astype(np.int32)), pa.array((c + t["tc"] * side).astype(np.int32)), pa.array(on)], names=["aoi_id", "row", "col", "mask"])

    return tiles.mapInArrow(run, "aoi_id string, row int, col int, mask int")


def morphed(tiles: DataFrame, steps: str, side: int = SIDE) -> DataFrame:
    """Tiles after steps of erosion (E) and dilation (D) with a cross; outside of the image nothing is set.

    A round does up to a tile's side of steps, in blocks with a halo of as many pixels.
    """
    for start in range(0, len(steps), side):
        tiles = _round(tiles, steps[start : start + side], side)
    return tiles


def _round(tiles: DataFrame, steps: str, side: int) -> DataFrame:
    n, per = len(steps), _per(side)
    ends, begin = {-1: slice(0, n), 0: slice(None), 1: slice(side - n, side)}, {-1: 0, 0: 0, 1: side - n}
    sent = f"{_TILE}, br int, bc int, row int, col int, high int, wide int"

    def told(batches):  # tiles by their blocks, and what neighbouring blocks see of them: strips that begin at row and col
        out = []
        for t in _rows(batches):
            br, bc = t["tr"] // per, t["tc"] // per
            out.append(t | {"br": br, "bc": bc})
            near = {
                ((t["tr"] + dr) // per - br, (t["tc"] + dc) // per - bc)
                for dr in (-1, 0, 1)
                for dc in (-1, 0, 1)
                if t["top"] < (t["tr"] + dr + 1) * side and (t["tr"] + dr) * side < t["bottom"] and t["left"] < (t["tc"] + dc + 1) * side and (t["tc"] + dc) * side < t["right"]
            }
            for dr, dc in near - {(0, 0)}:
                strip = _bits(t["mask"], (side, side))[ends[dr], ends[dc]]
                if strip.any():
                    out.append({"aoi_id": t["aoi_id"], "mask": _pack(strip), "br": br + dr, "bc": bc + dc, "row": t["tr"] * side + begin[dr], "col": t["tc"] * side + begin[dc], "high": strip.shape[0], "wide": strip.shape[1]})
            if len(out) > 200:
                yield _out(out, sent)
                out = []
        yield _out(out, sent)

    def met(key, t):
        import pyarrow as pa

        rows = t.to_pylist()
        own = [x for x in rows if x["row"] is None]
        row, col, high, wide = _around(own, side)
        m = np.zeros((high + 2 * n, wide + 2 * n), bool)
        for x in rows:
            r, c, h, w = (x["tr"] * side, x["tc"] * side, side, side) if x["row"] is None else (x["row"], x["col"], x["high"], x["wide"])
            m[r - row + n : r - row + n + h, c - col + n : c - col + n + w] = _bits(x["mask"], (h, w))
        inside = _inside(own[0], row - n, col - n, m.shape)
        for step in steps:
            m = (erode(m) if step == "E" else dilate(m)) & inside
        m = m[n : n + high, n : n + wide]
        return pa.Table.from_batches([_out([x | {"mask": _pack(m[_spot(x, side, row, col)])} for x in own], _TILE)])

    return tiles.mapInArrow(told, sent).groupBy("aoi_id", "br", "bc").applyInArrow(met, _TILE)


def _per(side: int) -> int:
    """Tiles along a block."""
    return max(1, SPAN // side)


def _around(tiles: list[dict], side: int) -> tuple[int, int, int, int]:
    """First row and column, height and width of a block's tiles."""
    rows, cols = [t["tr"] for t in tiles], [t["tc"] for t in tiles]
    return min(rows) * side, min(cols) * side, (max(rows) - min(rows) + 1) * side, (max(cols) - min(cols) + 1) * side


def _spot(t: dict, side: int, row: int, col: int) -> tuple[slice, slice]:
    """Where a tile is in its block, which begins at row and col."""
    r, c = t["tr"] * side - row, t["tc"] * side - col
    return slice(r, r + side), slice(c, c + side)


def _dealt(tiles: DataFrame, side: int):
    """Tiles by their blocks."""
    block = lambda c: F.floor(F.col(c) / _per(side)).cast("int")
    return tiles.withColumns({"br": block("tr"), "bc": block("tc")}).groupBy("aoi_id", "br", "bc")


def _labels(tiles: list[dict], side: int, background: bool, connectivity: int):
    """A block's parts: its labels, by label the number of the first pixel in the image, and the block's first row and column."""
    row, col, high, wide = _around(tiles, side)
    m = np.zeros((high, wide), bool)
    for t in tiles:
        m[_spot(t, side, row, col)] = _bits(t["mask"], (side, side))
    if background:
        m = _inside(tiles[0], row, col, m.shape) & ~m
    found = label(m, connectivity)
    at, first = np.unique(found.ravel(), return_index=True)
    r, c = np.divmod(first[at > 0], wide)
    return found, np.append(-1, (r + row - tiles[0]["top"]) * _COLUMNS + (c + col - tiles[0]["left"])), row, col


def parts(tiles: DataFrame, background: bool = False, connectivity: int = 4, side: int = SIDE) -> DataFrame:
    """(aoi_id, br, bc, first, n, edge, root) of all parts of components of a mask or of its background in blocks; root: the component's first pixel."""

    def run(key, t):
        import pyarrow as pa

        rows = t.to_pylist()
        found, first, row, col = _labels(rows, side, background, connectivity)
        top, left, bottom, right = (rows[0][k] for k in ("top", "left", "bottom", "right"))
        k, (height, width) = len(first), found.shape
        inner = np.zeros_like(found, bool)
        inner[max(0, top + 1 - row) : max(0, bottom - 1 - row), max(0, left + 1 - col) : max(0, right - 1 - col)] = True
        edge = np.zeros(k, bool)
        edge[found[~inner]] = True
        names = [x.split()[0] for x in _PART.split(", ")]
        own = [*(pa.array([x.as_py()] * (k - 1), kind) for x, kind in zip(key, (pa.string(), pa.int32(), pa.int32()))), pa.array(first[1:]), pa.array(np.bincount(found.ravel(), minlength=k)[1:].astype(np.int64)), pa.array(edge[1:])]
        out = [pa.Table.from_arrays([*own, *[pa.nulls(k - 1, pa.int32())] * 3], names=names)]
        # Pixels along those sides that have a neighbour; kind 0 and 1: above and below a border, 2 and 3: left and right of one.
        for kind, line, cross, begin, has in ((1, found[0], row, col, row > top), (0, found[-1], row + height, col, row + height < bottom), (3, found[:, 0], col, row, col > left), (2, found[:, -1], col + width, row, col + width < right)):
            if has:
                on = np.nonzero(line)[0]
                same = [pa.array([x.as_py()] * len(on), type_) for x, type_ in zip(key, (pa.string(), pa.int32(), pa.int32()))]
                spots = [pa.array(np.broadcast_to(np.int32(kind), len(on))), pa.array(np.broadcast_to(np.int32(cross), len(on))), pa.array((on + begin).astype(np.int32))]
                out.append(pa.Table.from_arrays([*same, pa.array(first[line[on]]), pa.nulls(len(on), pa.int64()), pa.nulls(len(on), pa.bool_()), *spots], names=names))
        return pa.concat_tables(out)

    every = stored(_dealt(tiles, side).applyInArrow(run, _PART))
    found, ends = every.filter("kind IS NULL").drop("kind", "cross", "place"), every.filter("kind IS NOT NULL")
    name = F.struct(F.col("aoi_id").alias("aoi_id"), F.col("first").alias("first"))
    before = ends.filter(F.col("kind").isin(0, 2)).select("aoi_id", (F.col("kind") / 2).cast("int").alias("way"), "cross", "place", name.alias("a"))
    if connectivity == 8:
        before = before.withColumn("place", F.explode(F.sequence(F.col("place") - 1, F.col("place") + 1)))
    after = ends.filter(F.col("kind").isin(1, 3)).select(F.col("aoi_id").alias("area"), ((F.col("kind") - 1) / 2).cast("int").alias("way"), "cross", "place", name.alias("b"))
    met = before.join(after, [before.aoi_id.eqNullSafe(after.area), before.way == after.way, before.cross == after.cross, before.place == after.place]).select("a", "b").distinct()
    root = linked.roots(met).select("node.aoi_id", "node.first", F.col("root.first").alias("root"))
    return found.join(root.withColumnsRenamed({"aoi_id": "area", "first": "own"}), F.col("aoi_id").eqNullSafe(F.col("area")) & (F.col("first") == F.col("own")), "left").select("aoi_id", "br", "bc", "first", "n", "edge", F.coalesce("root", "first").alias("root"))


def painted(tiles: DataFrame, chosen: DataFrame, on: bool, background: bool = False, connectivity: int = 4, side: int = SIDE) -> DataFrame:
    """Tiles with the pixels of chosen parts (aoi_id, br, bc, first) set or cleared."""

    def run(key, t, own):
        import pyarrow as pa

        rows = t.to_pylist()
        if rows and own.num_rows:
            found, first, row, col = _labels(rows, side, background, connectivity)
            hit = np.isin(first, own.column("first").to_numpy())[found]
            for x in rows:
                m, there = _bits(x["mask"], (side, side)), hit[_spot(x, side, row, col)]
                x["mask"] = _pack(m | there if on else m & ~there)
        return pa.Table.from_batches([_out(rows, _TILE)])

    return _dealt(tiles, side).cogroup(chosen.select("aoi_id", "br", "bc", "first").groupBy("aoi_id", "br", "bc")).applyInArrow(run, _TILE)


def filled(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """What the background does not reach from the image's edge, by rows and columns, becomes part of the mask."""
    every = stored(parts(tiles, background=True, side=side))
    open_ = every.groupBy("aoi_id", "root").agg(F.max("edge").alias("open")).filter("NOT open").select(F.col("aoi_id").alias("area"), F.col("root").alias("hole"))
    holes = every.join(open_, F.col("aoi_id").eqNullSafe(F.col("area")) & (F.col("root") == F.col("hole")), "left_semi")
    return painted(tiles, holes, True, background=True, side=side)


def without_small(tiles: DataFrame, min_area: int, side: int = SIDE) -> DataFrame:
    """Tiles without components (by rows and columns) of fewer pixels. Only parts that are small themselves are looked up."""
    every = stored(parts(tiles, side=side))
    small = every.groupBy("aoi_id", "root").agg(F.sum("n").alias("area_px")).filter(F.col("area_px") < min_area).select(F.col("aoi_id").alias("area"), F.col("root").alias("gone"))
    chosen = every.filter(F.col("n") < min_area).join(small, F.col("aoi_id").eqNullSafe(F.col("area")) & (F.col("root") == F.col("gone")), "left_semi")
    return painted(tiles, chosen, False, side=side)


def cleaned_tiles(masks: DataFrame, open_iters: int = 0, close_iters: int = 0, min_area: int = 0, side: int = SIDE) -> DataFrame:
    """(aoi_id, row, col, mask) as tiles after opening, closing, filling holes and dropping small components."""
    steps = "E" * open_iters + "D" * open_iters + "D" * close_iters + "E" * close_iters
    tiles = stored(morphed(cut(masks, side), steps, side))
    whole = stored(filled(tiles, side))
    dropped(tiles)
    return without_small(whole, min_area, side) if min_area > 1 else whole


def cleaned(masks: DataFrame, open_iters: int = 0, close_iters: int = 0, min_area: int = 0, side: int = SIDE) -> DataFrame:
    """(aoi_id, row, col, mask) after opening, closing, filling holes and dropping small components."""
    return pixels(cleaned_tiles(masks, open_iters, close_iters, min_area, side), side)


def numbered(every: DataFrame, side: int = SIDE) -> DataFrame:
    """(aoi_id, root, label): an image's roots numbered from 1 in their order, band of rows by band of rows, so no task sees all."""
    root = every.select("aoi_id", "root", F.floor(F.col("root") / (_COLUMNS * side)).alias("band")).distinct()
    sums = root.groupBy("aoi_id", "band").agg(F.count("*").alias("n"))
    earlier = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("aoi_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = root.withColumn("nth", F.row_number().over(Window.partitionBy("aoi_id", "band").orderBy("root")))
    bands = earlier.select(F.col("aoi_id").alias("area"), F.col("band").alias("of"), "before")
    return own.join(bands, F.col("aoi_id").eqNullSafe(F.col("area")) & (F.col("band") == F.col("of"))).select("aoi_id", "root", (F.col("before") + F.col("nth")).cast("int").alias("label"))


def components(masks: DataFrame, connectivity: int = 4, side: int = SIDE) -> DataFrame:
    """(aoi_id, row, col, label) of the pixels that are set; labels count from 1 by their first pixel, rows first."""
    return labelled(cut(masks, side), connectivity, side)


def labelled(tiles: DataFrame, connectivity: int = 4, side: int = SIDE) -> DataFrame:
    """components of tiles."""
    tiles = stored(tiles)
    every = stored(parts(tiles, connectivity=connectivity, side=side))
    names = numbered(every, side).select(F.col("aoi_id").alias("area"), F.col("root").alias("of"), "label")
    own = every.join(names, F.col("aoi_id").eqNullSafe(F.col("area")) & (F.col("root") == F.col("of"))).select("aoi_id", "br", "bc", "first", "label")

    def run(key, t, own):
        import pyarrow as pa

        out = {"aoi_id": pa.string(), "row": pa.int32(), "col": pa.int32(), "label": pa.int32()}
        if not t.num_rows or not own.num_rows:
            return pa.table({k: pa.array([], v) for k, v in out.items()})
        found, first, row, col = _labels(t.to_pylist(), side, False, connectivity)
        order = np.argsort(first)
        names = np.zeros(len(first), np.int32)
        names[order[np.searchsorted(first, own.column("first").to_numpy(), sorter=order)]] = own.column("label").to_numpy()
        r, c = np.nonzero(found)
        values = [[key[0].as_py()] * len(r), (r + row).astype(np.int32), (c + col).astype(np.int32), names[found[r, c]]]
        return pa.table({k: pa.array(v, kind) for (k, kind), v in zip(out.items(), values)})

    return _dealt(tiles, side).cogroup(own.groupBy("aoi_id", "br", "bc")).applyInArrow(run, "aoi_id string, row int, col int, label int")
