"""Approximate nearest neighbours (9): cross-polytope hashing with multiprobe tables.

One hash turns a unit vector by a fast pseudo-rotation (three rounds of random signs and a
Walsh-Hadamard transform: d log d additions and no matrix) and takes the signed axis that
is nearest. A table's key joins HASHES such axes of different rotations, so that there are
(2 d) ** HASHES buckets. Every vector is dealt to one bucket in each of TABLES tables; a
query looks into those buckets of each that lose least: the sum over the hashes of the
squared gap between an axis and the nearest one. How many buckets it looks into follows from
a recall that is measured first: MEASURED of the queries are compared with all vectors, which
is one scan, and the least number of buckets counts with which the tables find TARGET of
their nearest. Among n vectors a key joins as many axes as leave about one vector a bucket,
two at least; where these do not reach the target with MOST_PROBES buckets, one fewer.

Tables hold numbers of rows, not vectors. What queries meet is reduced to distinct
candidates first, listed by SPAN blocks of vectors and then by block; then each vector goes to its block once (and
once more for each further QUERIES queries), where candidates are reranked by exact
Euclidean distance on the original vectors in double precision. A block returns k + 1 rows
per query. All candidates are kept; nothing is capped. Only a query that met fewer than k
is compared with all vectors, block by block, as it must get k if there are as many.

Rows of one vector are interchangeable but for their ids, so of each vector only the k + 1
smallest ids are dealt, and queries of one vector ask once: a vector that a third of all
rows repeat costs no more than another one.

Defined results: vectors that are null, zero, of another length than the most frequent
one's, or hold null or non-finite components take no part, neither as queries nor as
candidates; nor do null ids. Ties go to the smaller id. A query with at most k others gets
all of them. An id that has several vectors is a candidate by the nearest and never of its
own query, which asks for all its vectors. Distances that are no double are infinite and
come last. Other columns are not read, whatever their names. An empty table gives an empty
one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import written

#: Tables; hashes of a key at least and at most.
TABLES, HASHES, MOST_HASHES = 96, 2, 4
#: Queries whose nearest are found exactly first, the share of these that the tables have to find, and the buckets of a table that a query looks into at most.
MEASURED, TARGET, MOST_PROBES = 128, 0.95, 64
#: Buckets that a query looks into where there is nothing to measure.
PROBES = 8
#: Vectors of a block, and queries that it meets at once; blocks whose candidates are listed together.
BLOCK, QUERIES, SPAN = 8_192, 4_096, 8
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d)


def rotate(unit: np.ndarray, number: int) -> np.ndarray:
    """A pseudo-random rotation of unit vectors, padded to a power of two; the same in every worker."""
    d = 1 << max(1, unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), d), np.float32)
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng((SEED, number)).integers(0, 2, (3, d)).astype(np.float32) * 2 - 1
    for s in signs:
        x = hadamard(x * s) / np.float32(np.sqrt(d))
    return x


def keys(unit: np.ndarray, table: int, probes: int, hashes: int = HASHES) -> np.ndarray:
    """Of each row the keys of the buckets that lose least, the own one first."""
    n = len(unit)
    found, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.float32)
    for h in range(hashes):
        x = rotate(unit, table * hashes + h)
        both = np.stack((x, -x), axis=2).reshape(n, -1)  # 2i for +, 2i + 1 for -
        gap = (both.max(axis=1, keepdims=True) - both) ** 2
        axes = np.argsort(gap, axis=1, kind="stable")[:, :probes] if probes > 1 else both.argmax(axis=1)[:, None]
        # Both sides are sorted, so the i-th and the j-th together are at best the (i j)-th.
        i, j = np.nonzero(np.outer(np.arange(1, found.shape[1] + 1), np.arange(1, axes.shape[1] + 1)) <= max(1, probes))
        found = found[:, i] * both.shape[1] + axes[:, j]
        loss = loss[:, i] + np.take_along_axis(gap, axes, axis=1)[:, j]
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        found, loss = np.take_along_axis(found, best, axis=1), np.take_along_axis(loss, best, axis=1)
    return found


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def least_probes(x: np.ndarray, q: np.ndarray, y: np.ndarray, tables: int, hashes: int, most: int) -> np.ndarray:
    """Of each pair of a query x[q] and a row of y the buckets a table with which some table finds it; above most: none does."""
    out = np.full(len(y), most + 1)
    for t in range(tables):
        hit = keys(x, t, most, hashes)[q] == keys(y, t, 1, hashes)
        out = np.minimum(out, np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, most + 1))
    return out


def others_nearest(dealt: DataFrame, x: np.ndarray, k: int) -> DataFrame:
    """(q, no): the k nearest vectors of each row of x that do not equal it, by one scan; a task returns k rows a query at most."""

    def run(batches):
        import pyarrow as pa

        own = (x * x).sum(axis=1)[:, None]
        best, who = np.zeros((len(x), 0)), np.zeros((len(x), 0), np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 4_096):
                    part = batch.slice(at, 4_096)
                    v, no = _matrix(part.column(1)), part.column(0).to_numpy(zero_copy_only=False)
                    d = own - 2 * (x @ v.T) + (v * v).sum(axis=1)
                    d[~(d > 1e-9 * own)] = np.inf  # equal ones, and what is no number
                    best, who = np.concatenate((best, d), axis=1), np.concatenate((who, np.broadcast_to(no, d.shape)), axis=1)
                    if best.shape[1] > k:
                        keep = np.argpartition(best, k - 1, axis=1)[:, :k]
                        best, who = np.take_along_axis(best, keep, axis=1), np.take_along_axis(who, keep, axis=1)
        q, c = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(who[q, c]), pa.array(best[q, c])], names=["q", "no", "d"])

    near = dealt.select("no", "v").mapInArrow(run, "q int, no long, d double")
    return near.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("d", "no"))).filter(F.col("nth") <= k).select("q", "no")


def fitted(dealt: DataFrame, posed: DataFrame, n: int, k: int, tables: int) -> tuple[int, int]:
    """(hashes, probes) with which the tables find TARGET of the nearest of MEASURED queries; the driver sees k vectors of each of these."""
    asked = posed.orderBy("same").limit(MEASURED).select("v").collect()
    if not asked:
        return HASHES, PROBES
    x = np.array([r["v"] for r in asked])
    near = dealt.join(F.broadcast(others_nearest(dealt, x, k)), "no").select("q", "v").collect()  # k rows of MEASURED queries at most
    axes = 2 << max(1, x.shape[1] - 1).bit_length()
    first = min(MOST_HASHES, max(HASHES, int(np.log(max(n, 2)) / np.log(axes))))
    if not near:
        return first, PROBES
    q, x, y = np.array([r["q"] for r in near]), units(x), units(np.array([r["v"] for r in near]))
    for hashes in range(first, 0, -1):
        wanted = np.sort(least_probes(x, q, y, tables, hashes, MOST_PROBES))[int(np.ceil(TARGET * len(y))) - 1]
        if wanted <= MOST_PROBES:
            break
    return hashes, int(min(wanted, MOST_PROBES))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the rows that take part, each once."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", fine) & F.exists("v", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0]["d"] if lengths else 0)).distinct()


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as rows of a matrix."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def hashed(rows: DataFrame, probes: int, tables: int, hashes: int) -> DataFrame:
    """(no, v) to (tab, key, no): the buckets that a row is dealt to or probes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                x, no = _matrix(part.column(1)), part.column(0).to_numpy(zero_copy_only=False)
                unit = units(x)
                for t in range(tables):
                    found = keys(unit, t, probes, hashes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(found.size, t, np.int32)), pa.array(found.ravel()), pa.array(np.repeat(no, found.shape[1]))], names=["tab", "key", "no"])

    return rows.select("no", "v").mapInArrow(run, "tab int, key long, no long")


def distances(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows from x; very large or small differences are scaled before they are squared."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = v - x
        out = np.sqrt(np.cumsum(d * d, axis=1)[:, -1])  # added up in order, as SQL does
        if (odd := ~((out > 1e-140) & (out < 1e150))).any():
            half = v[odd] / 2 - x / 2
            most = np.abs(half).max(axis=1, keepdims=True)
            part = half / np.where(most > 0, most, 1.0)
            out[odd] = np.sqrt((part * part).sum(axis=1)) * most[:, 0] * 2
    return out


NEAR = "q long, vec_id long, score double"


def _rerank(k: int):
    """Of a block (vec_id, no, v) and queries (q, v, candidates; null: all) the k nearest ids of each query."""

    def run(asked, vectors):
        import pyarrow as pa

        out = []
        if asked.num_rows and vectors.num_rows:
            v, ids, no = _matrix(vectors["v"]), vectors["vec_id"].to_numpy(), vectors["no"].to_numpy()
            order = np.argsort(no)
            for q, x, met in zip(asked["q"].to_pylist(), _matrix(asked["v"]), asked["candidates"]):
                at = order if not met.is_valid else order[np.searchsorted(no[order], met.values.to_numpy())]
                score = distances(v[at], x)
                best = np.lexsort((ids[at], score))
                _, first = np.unique(ids[at][best], return_index=True)  # an id counts once, by its nearest vector
                best = best[np.sort(first)[:k]]
                out.append((np.full(len(best), q), ids[at][best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, names=["q", "vec_id", "score"])

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, probes: int | None = None, hashes: int = HASHES, id_col: str = "vec_id", vector_col: str = "embedding", report: list | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row where is_query, a condition on vec_id.

    probes: buckets of a table that a query looks into; None: hashes and probes by measured recall.

    report, a list, gets the numbers of vectors dealt, of distinct query vectors and of distinct candidate pairs, then hashes and probes.
    """
    # A key of 16 bytes stands for the vector; -0.0 and 0.0 may make two of one, which costs a row and changes nothing.
    same = F.unhex(F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))
    rows = written(usable(vectors, id_col, vector_col).withColumn("same", same))
    first = Window.partitionBy("same").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    dealt = written(few.select("vec_id", "v", F.monotonically_increasing_id().alias("no")))
    asks = written(rows.filter(is_query).select("vec_id", "same", "v"))
    posed = written(asks.dropDuplicates(["same"]).select("same", "v", F.monotonically_increasing_id().alias("no")))
    n, m = dealt.count(), posed.count()
    if probes is None:
        hashes, probes = fitted(dealt, posed, n, k, tables)
    parts, copies = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))

    block = lambda no: F.pmod(no + F.shiftright(no, 33), F.lit(parts))  # noqa: E731 - numbers run within a partition, whose own begins at bit 33
    span = F.floor(block(F.col("no")) / SPAN)
    # A bucket is met as lists, one for each span that it has vectors in, so a crowded one makes no row for each pair.
    held = hashed(dealt, 1, tables, hashes).groupBy("tab", "key", span.alias("span")).agg(F.collect_list("no").alias("held"))  # at most a span's numbers
    lists = hashed(posed, probes, tables, hashes).withColumnRenamed("no", "q").join(held, ["tab", "key"])
    spans = lists.groupBy("q", "span").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("all"))  # at most tables x a span's numbers
    blocks = F.sequence(F.col("span") * SPAN, F.least(F.col("span") * SPAN + (SPAN - 1), F.lit(parts - 1).cast("long")))
    cut = spans.select("q", "all", F.explode(blocks).alias("block"))
    met = written(cut.select("q", "block", F.filter("all", lambda no: block(no) == F.col("block")).alias("candidates")).filter(F.size("candidates") > 0))
    if report is not None:
        report += [n, m, met.agg(F.coalesce(F.sum(F.size("candidates")), F.lit(0))).first()[0], hashes, probes]

    each = posed.select(F.col("no").alias("q"), "v")
    copied = dealt.select("vec_id", "no", "v", block(F.col("no")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))

    def reranked(lists: DataFrame) -> DataFrame:
        """(q, block, candidates) to the nearest ids by query."""
        asked = lists.join(each, "q").select("q", "v", "candidates", F.col("block").alias("q_block"), F.pmod(F.xxhash64("q"), F.lit(copies)).cast("int").alias("q_copy"))
        near = asked.groupBy("q_block", "q_copy").cogroup(copied.groupBy("block", "copy")).applyInArrow(_rerank(k + 1), NEAR)
        return near.groupBy("q", "vec_id").agg(F.min("score").alias("score"))

    def of_queries(near: DataFrame) -> DataFrame:
        """The distinct vectors' results as results of query ids, without the ids themselves."""
        best = near.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("nth") <= k + 1)
        lists = best.groupBy("q").agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))  # k + 1 at most
        own = asks.select(F.col("vec_id").alias("query_id"), "same").join(posed.select("same", F.col("no").alias("q")), "same").join(lists, "q", "left")
        return own.select("query_id", "q", F.filter(F.coalesce("found", F.expr("array()").cast("array<struct<vec_id:bigint,score:double>>")), lambda x: x["vec_id"] != F.col("query_id")).alias("found"))

    found = written(of_queries(reranked(met)))
    short = written(each.select("q").join(found.filter(F.size("found") >= k).select("q"), "q", "left_anti"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("block")
    again = of_queries(reranked(short.select("q", every, F.lit(None).cast("array<bigint>").alias("candidates"))))
    whole = found.join(short, "q", "left_anti").unionByName(again.join(short, "q", "left_semi"))  # of a query either or
    best = whole.select("query_id", F.explode("found").alias("x")).select("query_id", "x.*").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
