"""Sinks: JSON, Parquet with a schema, logs, metrics text, cards, GeoJSON."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Also an empty table keeps its schema."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def csv(df: DataFrame, path: str, first: Sequence[str] = (), mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    """Columns in a stable order: those named first, then the others by name."""
    rest = sorted(c for c in df.columns if c not in first)
    df.select(*[c for c in first if c in df.columns], *rest).write.mode(mode).option("header", True).partitionBy(*partition_by).csv(path)


def logs(df: DataFrame, path: str, ts: str = "ts") -> None:
    """JSON lines in a folder for each UTC day."""
    df.withColumn("day", F.date_format(F.col(ts).cast("timestamp"), "yyyyMMdd")).write.mode("append").partitionBy("day").json(path)


def topics(df: DataFrame, path: str) -> None:
    """Rows in a folder for each topic, for replays."""
    df.write.mode("append").partitionBy("topic").json(path)


def prometheus_lines(metrics: DataFrame, prefix: str = "orrery", help_text: str = "pipeline metric") -> DataFrame:
    """(value): HELP, TYPE and sample lines of (name, value)."""
    name = F.concat(F.lit(f"{prefix}_"), F.regexp_replace("name", "[^a-zA-Z0-9_]", "_"))
    lines = F.array(F.concat(F.lit("# HELP "), name, F.lit(f" {help_text}")), F.concat(F.lit("# TYPE "), name, F.lit(" gauge")), F.format_string("%s %.6f", name, F.col("value").cast("double")))
    return metrics.orderBy("name").select(F.explode(lines).alias("value"))


def prometheus(metrics: DataFrame, path: str, prefix: str = "orrery") -> None:
    prometheus_lines(metrics, prefix).coalesce(1).write.mode("overwrite").text(path)


def card(title: str, metrics: DataFrame, most: int = 200) -> str:
    """A Markdown table of at most so many metrics."""
    rows = metrics.orderBy("name").limit(most).collect()
    return "\n".join([f"# {title}", "", "| metric | value |", "|---|---|", *(f"| {r['name']} | {r['value']:g} |" for r in rows), ""])


def feature_collection(features: DataFrame, path: str) -> None:
    """One GeoJSON file, written feature by feature."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for k, r in enumerate(features.toLocalIterator()):
            f.write("," * bool(k) + r["feature"])
        f.write("]}")


def document(value: object, path: str) -> None:
    """A small value as one readable JSON file."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
