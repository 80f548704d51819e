"""Tables that cut a long lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, kind: str = "files") -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a local one only for a local master."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="orrery-")
    return f"{where.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as a table and read again; a lost executor costs a part of this step at most."""
    path = folder(df.sparkSession, "steps")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*dfs: DataFrame) -> None:
    """Deletes what `stored` wrote for these; nothing may read them any more."""
    for df in dfs:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rpartition("/")[0] for f in df.inputFiles() if "/steps/" in f}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
