"""A keyed table that is rewritten bucket by bucket and swapped by a manifest.

Rows lie in buckets by a hash of their key. A run reads the buckets of its keys only, writes
new files for those, and then puts a manifest that names each bucket's files: until the
manifest is there the run has not happened, and a run that is done is not done again. Files
of other buckets stay as they are. Manifests are numbered and put by a rename that fails if
the number is taken, so of two writers one gives up and can try again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketTable:
    """path: of the table; ddl: its columns; key: those that make the key (nulls are values); buckets: fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, ddl: str, key: tuple[str, ...] | list[str], buckets: int = 64):
        self.spark, self.path, self.ddl, self.key = spark, path.rstrip("/"), ddl, list(key)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = jvm.org.apache.commons.io.IOUtils
        self.buckets = (self._manifest() or {}).get("buckets", buckets)

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _manifest(self) -> dict | None:
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        if not names:
            return None
        stream = self._fs.open(self._path(f"{self.path}/manifests/{names[-1]}"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @property
    def run(self) -> int | None:
        """The last run that is done."""
        return (self._manifest() or {}).get("run")

    def has(self, run: int) -> bool:
        """Runs are numbered upwards: whether this one or a later one is done."""
        last = self.run
        return last is not None and run <= last

    def bucket(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*(key or [F.col(k) for k in self.key])), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, *key: Column) -> list[int]:
        """Buckets of these rows' keys."""
        return sorted(r[0] for r in rows.select(self.bucket(*key)).distinct().collect())  # at most `buckets` rows

    def files(self, touched: list[int] | None = None) -> dict[int, str]:
        """Folders of buckets, of all by default."""
        have = {int(b): f for b, f in (self._manifest() or {}).get("files", {}).items()}
        return {b: f for b, f in have.items() if touched is None or b in set(touched)}

    def read(self, touched: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for f in self.files(touched).values()]
        return self.spark.read.schema(self.ddl).parquet(*paths) if paths else self.spark.createDataFrame([], self.ddl)

    def replace(self, rows: DataFrame, touched: list[int], run: int) -> None:
        """rows in place of all that these buckets hold; rows of other buckets are an error of the caller."""
        now = self._manifest() or {"version": 0, "files": {}}
        folder = f"{now['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        own = self.spark.createDataFrame([], self.ddl).columns
        rows.select(*own, self.bucket().alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        made = {n.removeprefix("bucket=") for n in self._names(f"data/{folder}") if n.startswith("bucket=")}
        files = {b: f for b, f in now["files"].items() if int(b) not in set(touched)} | {b: f"{folder}/bucket={b}" for b in made}
        self._put({"version": now["version"] + 1, "run": run, "buckets": self.buckets, "files": files})

    def _put(self, manifest: dict) -> None:
        to = self._path(f"{self.path}/manifests/{manifest['version']:012d}.json")
        new = self._path(f"{self.path}/manifests/{uuid.uuid4().hex}.new")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(new, to):
            self._fs.delete(new, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} was written by another run")

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last manifests, and data that none of those names."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        used = set()
        for n in names[-keep:]:
            stream = self._fs.open(self._path(f"{self.path}/manifests/{n}"))
            used |= {f.split("/")[0] for f in json.loads(self._text.toString(stream, "UTF-8"))["files"].values()}
            stream.close()
        for n in names[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{n}"), False)
        for n in set(self._names("data")) - used:
            self._fs.delete(self._path(f"{self.path}/data/{n}"), True)
