"""Sources: JSON arrays, required columns, news files, metrics text, pixel tables, GeoJSON, manifests."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.functions.text import paired
from orrery.operators.documents import news_text
from orrery.sources import json_items

EVENT_DDL = "id string, ts string, topic string, asset_id string, aoi_id string, rule_type string, severity string, acknowledged boolean, delta map<string,double>, payload variant"


def json_array(spark: SparkSession, path: str, schema: str = EVENT_DDL) -> DataFrame:
    """Objects of JSON arrays with their position in the file as `pos`, which counts objects only; other items are dropped, another top level is an error. Files are read by several tasks."""
    return json_items.objects(spark, path).select("pos", F.from_json("item", schema).alias("x")).select("pos", "x.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that hold an object; bad ones are skipped."""
    ddl = StructType.fromDDL(schema)
    return spark.read.schema(StructType(ddl.fields).add("_bad", "string")).option("columnNameOfCorruptRecord", "_bad").json(path).filter("_bad IS NULL").drop("_bad")


def matched_records(spark: SparkSession, path: str, need_subscription: bool = True) -> DataFrame:
    """(pos, subscription_id, event fields) of records that have an event and, if needed, a subscription."""
    rows = json_array(spark, path, f"subscription_id string, event struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in EVENT_DDL.split(', '))}>")
    test = F.col("event").isNotNull() & (F.col("subscription_id").isNotNull() if need_subscription else F.lit(True))
    return rows.filter(test).select("pos", "subscription_id", "event.*")


def parquet(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """A Parquet table that must have these columns."""
    df = spark.read.parquet(path)
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, or no rows where there is none."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = files.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).option("header", True).csv(path) if there else spark.createDataFrame([], schema)


def news(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, source_path): items of JSON arrays or lines of JSON, told apart by the first character.

    The id counts all items of a file, skipped ones too.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), "value")
    array = F.substring(F.ltrim("value"), 1, 1) == "["
    items = F.when(array, F.from_json("value", "array<string>")).otherwise(F.filter(F.split("value", "\r?\n"), lambda s: F.trim(s) != ""))
    fields = ("body", "text", "content", "description", "title", "snippet", "summary")
    rows = raw.select("source_path", F.posexplode(items).alias("i", "item")).withColumn("x", F.from_json("item", ", ".join(f"{f} string" for f in fields))).select("source_path", "i", "x.*")
    stem = F.regexp_extract("source_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.select(F.concat_ws("_", stem, "i").alias("id"), news_text(list(fields)).alias("text"), "source_path").filter("text != ''")


def prometheus(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of the lines of a metrics text; comments and what is no number are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter("trim(value) != '' AND NOT startswith(trim(value), '#')")
    return rows.select(F.get(parts, 0).alias("name"), F.get(parts, 1).try_cast("double").alias("value")).filter("value IS NOT NULL")


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """(feature): the features of a collection as JSON text; those without geometry are skipped."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("feature")).filter(F.get_json_object("feature", "$.geometry").isNotNull())


def binary_pages(spark: SparkSession, path: str, extractors: Sequence[Callable[[bytes], list[str]]], glob: str = "*.pdf", kind: str = "") -> DataFrame:
    """(path, source, page, text, extractor): pages of files through a chain of extractors.

    Each extractor maps a file to its pages' texts; a page is taken from the first that
    gives it any text. Extractors stand for libraries that are not part of this one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            rows = []
            for where, content in zip(pdf["path"], pdf["content"]):
                pages: dict[int, tuple[str, str]] = {}
                for extract in extractors:
                    try:
                        found = extract(bytes(content))
                    except Exception:  # an extractor may fail on a file; the next one is tried
                        continue
                    for k, text in enumerate(found, 1):
                        if not pages.get(k, ("", ""))[0].strip():
                            pages[k] = (text, getattr(extract, "__name__", "extractor"))
                    if pages and all(t.strip() for t, _ in pages.values()):
                        break
                rows += [(where, kind, k, t, e) for k, (t, e) in sorted(pages.items())]
            yield pd.DataFrame(rows, columns=["path", "source", "page", "text", "extractor"])

    return files.mapInPandas(run, "path string, source string, page int, text string, extractor string")


def pixels_csv(spark: SparkSession, path: str) -> DataFrame:
    """A pixel table from CSV files."""
    return spark.read.schema("aoi_id string, band string, timing string, row int, col int, value double").option("header", True).csv(path)


# Other names of bands and of file endings.
BAND_NAMES = {"B4": ("B4", "B04"), "B8": ("B8", "B08")}
ENDINGS = (".tif", ".tiff")


def resolve_area(folder: str, slug: str, listing: Sequence[str] | None = None) -> dict[str, str] | None:
    """Paths of the four bands before and after of an area, or None if one is missing."""
    have = set(os.listdir(folder) if listing is None else listing)
    out = {}
    for timing in ("before", "after"):
        for band, names in BAND_NAMES.items():
            found = next((f for n in names for e in ENDINGS if (f := f"{slug}_{timing}_{n}{e}") in have), None)
            if not found:
                return None
            out[f"{timing}_{band}"] = f"{folder}/{found}"
    return out


def causal_series(spark: SparkSession, path: str) -> DataFrame:
    """(asset_id, metric, date, y) of series files found at any depth; a later file replaces a series."""
    rows = spark.read.schema("asset_id string, metric string, date array<string>, y array<double>").option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path")).withColumn("v", paired(F.col("date"), F.col("y"))).filter("asset_id IS NOT NULL AND metric IS NOT NULL AND v IS NOT NULL")
    last = rows.groupBy("asset_id", "metric").agg(F.max_by("v", "file").alias("v"))
    return last.select("asset_id", "metric", F.explode("v").alias("x")).select("asset_id", "metric", "x.date", "x.y")


def catalog(spark: SparkSession) -> DataFrame:
    """(table_name, column_name, data_type) of the tables that the catalog lists."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
