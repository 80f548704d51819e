"""Functions that no query reaches: sources, sinks and small helpers."""

import json
import math

from pyspark.sql import functions as F

from orrery.operators import core, geo, graph, retrieval, series
from orrery.sources import readers, sinks


def test_core(spark):
    names = spark.createDataFrame([("Acme", "ae"), (" acme", "AE"), ("Acme", "sa"), ("Bolt", None)], "name string, country_code string")
    found = {(r.name.strip().lower(), r.country_code) for r in core.organisation_ids(names).collect()}
    assert found == {("acme", "AE"), ("acme", "SA"), ("bolt", None)}
    lines = spark.createDataFrame([(k, "word " * k) for k in range(8)], "k int, text string")
    assert [r.k for r in core.index_sample(lines, 6, "k", words=4).orderBy("k").collect()] == [4, 5]
    assert core.without_empty(lines).count() == 7
    both = core.union_sources({"b": lines.select("k"), "a": lines.select("text")})
    assert both.count() == 16 and {r.source for r in both.filter("k IS NULL").collect()} == {"a"}


def test_vectors_and_lists(spark):
    df = spark.createDataFrame([("The cat, the hat", '["a","b"]'), ("", "plain"), ("x", None)], "text string, items string")
    rows = df.select(retrieval.hashed_embedding(F.col("text"), 8).alias("v"), retrieval.as_list(F.col("items")).alias("items")).collect()
    assert [sum(r.v) for r in rows] == [4.0, 0.0, 1.0] and max(rows[0].v) >= 2.0
    assert [r["items"] for r in rows] == [["a", "b"], ["plain"], None]
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (2.0,), (None,)], "x double")
    assert [r.x for r in odd.select(series.finite(F.col("x")).alias("x")).collect()] == [None, None, None, 2.0, None]


def test_features(spark, tmp_path):
    points = spark.createDataFrame([("a", 54.5, 24.5), ("b", 55.0, 25.0)], "name string, lon double, lat double")
    path = str(tmp_path / "points.geojson")
    sinks.feature_collection(geo.features(points, lon="lon", lat="lat"), path)
    whole = json.load(open(path, encoding="utf-8"))
    assert whole["type"] == "FeatureCollection" and len(whole["features"]) == 2
    read = sorted((json.loads(r.feature) for r in readers.geojson_features(spark, f"file://{path}").collect()), key=lambda x: x["properties"]["name"])
    assert [x["geometry"]["coordinates"] for x in read] == [[54.5, 24.5], [55.0, 25.0]]

    boxes = spark.createDataFrame([("p", 1, 0, 0, 2, 2, 4), ("p", 2, 4, 4, 5, 5, 1), ("p", 3, 6, 6, 8, 8, 4), ("q", 1, 0, 0, 2, 2, 4)], "aoi_id string, label int, r0 int, c0 int, r1 int, c1 int, pixels long")
    areas = spark.createDataFrame([("p", 8, 8, [54.0, 24.0, 55.0, 25.0]), ("q", 8, 8, None)], "aoi_id string, rows int, cols int, bbox array<double>")
    found = [json.loads(r.feature) for r in geo.overlay(boxes, areas, 2).collect()]
    assert sorted((x["properties"]["aoi_id"], x["properties"]["component_id"]) for x in found) == [("p", 1), ("p", 2)]


def test_graph_document_and_catalog(spark, tmp_path):
    import xml.etree.ElementTree as tree

    vertices = spark.createDataFrame([("asset:1", "asset", "A & B"), ("document:2", "document", None)], "node string, entity string, name string")
    links = spark.createDataFrame([("asset:1", "document:2", "about")], "src string, dst string, rel string")
    root = tree.fromstring(graph.graphml(vertices, links))
    assert [e.text for e in root.iter() if e.text and e.text.strip()] == ["asset", "A & B", "document", "about"]
    sinks.document({"b": [1], "a": "é"}, str(tmp_path / "x.json"))
    assert json.load(open(tmp_path / "x.json", encoding="utf-8")) == {"a": "é", "b": [1]}
    links.createOrReplaceTempView("rest_links")
    try:
        assert {(r.table_name, r.column_name) for r in readers.catalog(spark).collect()} >= {("rest_links", "src"), ("rest_links", "rel")}
    finally:
        spark.catalog.dropTempView("rest_links")
