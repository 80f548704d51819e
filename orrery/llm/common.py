"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of keys is small enough to send to every executor.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalised(text):
    """Each run of white space as one space; single spaces are left alone, which is faster."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set a local one serves a local master; else it is an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("orrery.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("orrery.checkpoint.dir", where)
    return where.rstrip("/")


#: Paths of the tables that this process has written and not dropped.
tables: list[str] = []


def written(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage and survives lost executors.

    drop_shuffles: its shuffle files go when the table is there, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orrery/{uuid.uuid4().hex}"
    tables.append(path)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    if drop_shuffles:
        spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, since: int = 0, *keep: DataFrame) -> None:
    """Deletes the tables written since a length of `tables`, but for those that keep reads.

    Results of operators read such tables until they are written themselves.
    """
    kept = {f for df in keep for f in df.inputFiles()}
    jvm = spark.sparkContext._jvm
    for path in tables[since:]:
        if not any(path.rpartition("/")[2] in f for f in kept):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            tables.remove(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is (then the join shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(df: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in drop. drop is counted; it is broadcast only below BROADCAST_ROWS."""
    return df.join(small(drop.select(key)), key, "left_anti")


def told_by_size(rows: DataFrame, found: DataFrame, on: list[str], size: str, hot_rows: int, names: tuple[str, str] = ("parts", "part"), how: str = "inner") -> DataFrame:
    """rows joined with found, which has each key once and in `size` the number of its rows.

    The rows of a key above hot_rows are dealt over several tasks, among which the key's
    values are repeated; such keys are at most the rows divided by hot_rows. names: of two
    columns that neither side has.
    """
    n, part = names
    parts = F.ceil(F.col(size) / hot_rows).cast("int")
    hot = found.filter(F.col(size) > hot_rows).select(*on, parts.alias(n))
    dealt = rows.join(small(hot), on, "left").withColumn(part, F.coalesce(F.pmod(F.monotonically_increasing_id(), n), F.lit(0).cast("long"))).drop(n)
    return dealt.join(found.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), parts - F.lit(1).cast("long")))), [*on, part], how).drop(part)


#: Rows of a key above which they are dealt over several tasks.
HOT_ROWS = 100_000


def small_or_dealt(rows: DataFrame, found: DataFrame, on: list[str], size: str | None = None, how: str = "inner", hot_rows: int = HOT_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """rows joined with found, which has each key once: sent to all executors if counted small, else dealt by key, hot keys over several tasks.

    size: the column of found with the number of rows of its key (not kept); without it keys
    are counted, so rows should be a table. counted: what found has gathered, if its rows
    can be long. Nulls match nothing.
    """
    if (found if counted is None else counted).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found.drop(size) if size else found), on, how)
    (n,) = renamed(rows.join(found, on), "rows_of_key")
    sized = found.withColumnRenamed(size, n) if size else found.join(rows.groupBy(*on).agg(F.count("*").alias(n)), on)
    return told_by_size(rows, sized, on, n, hot_rows, tuple(renamed(rows.join(sized, on), "parts", "part")), how).drop(n)


def renamed(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        k = n
        while k.lower() in taken:
            k += "_"
        taken.add(k.lower())
        out.append(k)
    return out


#: Bytes of text that a Python worker looks at together.
BLOCK_BYTES = 2_000_000


def blocks(batch, text: int, most: int = BLOCK_BYTES):
    """Slices of an Arrow batch whose texts have about so many bytes together; one row at least."""
    sizes = batch.column(text)
    import pyarrow.compute as pc

    ends = pc.cumulative_sum(pc.fill_null(pc.cast(pc.binary_length(sizes), "int64"), 0)).to_numpy(zero_copy_only=False)
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(ends.searchsorted(base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def released() -> None:
    """Gives free memory back to the system: workers live on after their task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def short_batches(spark: SparkSession) -> None:
    """Sends 1,000 rows instead of 10,000 to Python at a time, unless the session says otherwise:
    rows with whole texts are long, and each task holds a batch on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def with_columns_of_text(df: DataFrame, text_col: str, fields: str, make, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """df with more columns made from a text column in Python, whole texts in blocks.

    fields: DDL of the new columns, named unlike any of df. make() is called once for a
    task and returns a function of a list of texts (null: empty) to a list of columns
    (lists or Arrow arrays); its attribute `done`, if any, is called at the task's end.
    Without keep_text the text does not travel back.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    short_batches(df.sparkSession)
    new = StructType.fromDDL(fields)
    text = df.columns.index(text_col)
    back = [k for k in range(len(df.columns)) if keep_text or k != text]
    kinds, names = [to_arrow_type(f.dataType) for f in new], [*(df.columns[k] for k in back), *new.names]

    def run(batches):
        import pyarrow as pa

        work = make()
        for batch in batches:
            for part in blocks(batch, text, block_bytes) if batch.num_rows else ():
                made = work([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in back), *(c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(made, kinds))], names=names)
        getattr(work, "done", released)()
        del work
        released()

    return df.mapInArrow(run, StructType([*(df.schema.fields[k] for k in back), *new.fields]))


def folded_out(column, mod: int, rest: int):
    """Whether crc32 of the id as text has this remainder; null ids count as the text `null`."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("null")).cast("binary")) % mod == rest
