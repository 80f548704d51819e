"""Geometry on plain columns: WGS 84 longitudes and latitudes, rings as arrays of [lon, lat]."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6_378_137.0
KM_PER_DEGREE = 111.32


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS, RADIUS * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def buffer(lon: Column, lat: Column, metres: float = 250.0, points: int = 32) -> Column:
    """A ring around a point at a distance in Web Mercator metres, as a polygon of so many corners."""
    x, y = to_mercator(lon, lat)

    def corner(k):
        angle = k * (2 * math.pi / points)
        return F.array(*from_mercator(x + metres * F.cos(angle), y + metres * F.sin(angle)))

    ring = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), corner)
    return F.concat(ring, F.slice(ring, 1, 1))


def _crosses(ring: Column) -> Column:
    ends = F.slice(ring, F.lit(2), F.size(ring) - 1)
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"), (a[0] * b[1] - b[0] * a[1]).alias("c")))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def area(ring: Column) -> Column:
    """Signed area of a closed ring in square degrees."""
    return _total(F.transform(_crosses(ring), lambda s: s["c"])) / 2


def centroid(ring: Column) -> Column:
    """Area-weighted centroid [lon, lat]; of a ring without area the mean of its corners."""
    cs, a = _crosses(ring), area(ring)
    corners = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))

    def weighted(k: int) -> Column:
        return _total(F.transform(cs, lambda s: (s["a"][k] + s["b"][k]) * s["c"])) / (6 * a)

    def mean(k: int) -> Column:
        return _total(F.transform(corners, lambda p: p[k])) / F.size(corners)

    return F.when(F.abs(a) > 1e-15, F.array(weighted(0), weighted(1))).otherwise(F.array(mean(0), mean(1)))


def is_valid(ring: Column) -> Column:
    """Closed, at least four corners, within bounds. Rings that cross themselves are not found."""
    inside = F.forall(ring, lambda p: (F.abs(p[0]) <= 180) & (F.abs(p[1]) <= 90))
    return F.coalesce((F.size(ring) >= 4) & (ring[0] == F.element_at(ring, -1)) & inside, F.lit(False))


def pixel_ring(r0: Column, c0: Column, r1: Column, c1: Column, rows: Column, cols: Column, bbox: Column) -> Column:
    """The ring of a pixel box in an image with north up; bbox is [min lon, min lat, max lon, max lat]."""
    clamp = lambda v, a, b: F.least(F.greatest(v, a), b)
    lon = lambda c: clamp(bbox[0] + (bbox[2] - bbox[0]) * c / cols, bbox[0], bbox[2])
    lat = lambda r: clamp(bbox[3] - (bbox[3] - bbox[1]) * r / rows, bbox[1], bbox[3])
    corner = lambda c, r: F.array(lon(c), lat(r))
    return F.array(corner(c0, r0), corner(c1, r0), corner(c1, r1), corner(c0, r1), corner(c0, r0))


def area_km2(bbox: Column) -> Column:
    """Approximate area of a box."""
    middle = F.radians((bbox[1] + bbox[3]) / 2)
    return F.abs(bbox[2] - bbox[0]) * KM_PER_DEGREE * F.cos(middle) * F.abs(bbox[3] - bbox[1]) * KM_PER_DEGREE


def wkt_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def point_of(geojson: Column) -> tuple[Column, Column]:
    """(lon, lat) of a GeoJSON point feature: numeric lat and lon properties, else the point's coordinates."""
    number = lambda p: F.get_json_object(geojson, p).try_cast("double")
    point = F.get_json_object(geojson, "$.geometry.type") == "Point"
    return tuple(F.coalesce(number(f"$.properties.{name}"), F.when(point, number(f"$.geometry.coordinates[{k}]"))) for k, name in enumerate(("lon", "lat")))


def features(df: DataFrame, ring: str | None = None, lon: str | None = None, lat: str | None = None) -> DataFrame:
    """(feature): a GeoJSON feature as text for each row; all other columns are properties."""
    rest = [c for c in df.columns if c not in (ring, lon, lat)]
    if ring:
        shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.col(ring)).alias("coordinates"))
    else:
        shape = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*rest).alias("properties"))).alias("feature"))


def overlay(found: DataFrame, areas: DataFrame, min_area: int = 1) -> DataFrame:
    """Features of change boxes: rows of boxes() joined to (aoi_id, rows, cols, bbox), numbered within the area."""
    from pyspark.sql import Window

    kept = found.filter(F.col("pixels") >= min_area).join(areas.filter("bbox IS NOT NULL"), "aoi_id")
    kept = kept.withColumn("component_id", F.row_number().over(Window.partitionBy("aoi_id").orderBy("label")))
    kept = kept.withColumn("ring", pixel_ring(*(F.col(c) for c in ("r0", "c0", "r1", "c1", "rows", "cols")), F.col("bbox")))
    return features(kept.select("aoi_id", "component_id", "pixels", "ring"), ring="ring")
