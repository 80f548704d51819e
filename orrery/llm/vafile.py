"""Vector code compression (11): product codes, whose entries are found by VA-file filtering.

A vector's components become integers and are cut into PARTS consecutive parts; each part
has a codebook of up to ENTRIES integer entries, and a vector's code has the number of the
nearest entry of each part. The search is that of a VA-file. Each coordinate of the entries
is quantised to BITS bits, so that an entry is a row of cells. For a queried part a lookup
table has, by coordinate and cell, the least and the largest squared difference that a value
in that cell can have; their sums over an entry's cells bound its distance from below and
above. Only entries whose lower bound does not pass the least upper bound are refined: their
distances are taken in integers, so that ties are exact and go to the lower number.

Codebooks start as the parts of the smallest ids and are refined in rounds: every part goes
to its nearest entry, and an entry becomes the floored mean of its parts. A round is one scan;
a task returns sums by part and entry, which Spark adds up, and a codebook (parts x entries
rows, whatever the number of vectors) goes to the driver and out with the next round's tasks.
Integers are written once as a table before the first round. No row ever meets another one,
so ids, labels or vectors that many rows share make no task larger; sums by label are added
up before they are dealt, and rows of a hot label get them in several tasks.

Defined results. Rows whose vector is null or holds null or non-finite components are
dropped. The length is that of most vectors (the shorter of two, not 0): rows of other lengths
have null code and error and shape no codebook. A length that PARTS does not divide is filled up
with zeros. Integers stop at 2 ** 53 either way; from 2 ** 27 on they are handled as Python's
integers, so nothing wraps round. A sum of errors that no long holds is null. Rows of one id
all count, each with its own code; among the first entries they go by their integers, null
ids last. With fewer rows than ENTRIES there are as many entries as rows. An empty table gives
an empty one. Other columns are kept, except by `report`, and no name clashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import renamed, small_or_dealt, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a cell of an entry's coordinate.
BITS = 3
#: Integers beyond this are cut to it, and those from WIDE on leave 64-bit arithmetic.
MOST, WIDE = 2**53, 2**27
#: Vectors whose bounds a task holds at once.
BLOCK = 4_096


def integers(vectors: DataFrame, vector_col: str, scale: int, to: str) -> DataFrame:
    """Rows whose vector is whole and finite, with its integers (array<long>) as a further column."""
    x = F.col(vector_col).cast("array<double>")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    whole = lambda v: F.floor(F.greatest(F.least(v * F.lit(float(scale)), F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long")
    return vectors.filter(F.col(vector_col).isNotNull() & F.forall(x, fine)).withColumn(to, F.transform(x, whole))


@dataclass(frozen=True)
class Cells:
    """A codebook's approximation: of each coordinate the least value, the width of a cell, and each entry's cell."""

    book: np.ndarray
    low: np.ndarray
    width: np.ndarray
    cell: np.ndarray
    bits: int

    @staticmethod
    def of(book: np.ndarray, bits: int = BITS) -> Cells:
        low = book.min(axis=0)
        width = (book.max(axis=0) - low) // (1 << bits) + 1
        return Cells(book, low, width, ((book - low) // width).astype(np.int64), bits)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each row of x the number of its nearest entry, the squared distance, and how many entries were refined in all."""
        lower, upper = np.zeros((len(x), len(self.book)), x.dtype), np.zeros((len(x), len(self.book)), x.dtype)
        steps = np.arange(1 << self.bits)
        for j in range(x.shape[1]):
            start = self.low[j] + steps * self.width[j]
            before, after = start[None, :] - x[:, j, None], x[:, j, None] - (start + self.width[j] - 1)[None, :]
            least, most = np.maximum(np.maximum(before, after), 0), np.maximum(np.abs(before), np.abs(after))
            lower += (least * least)[:, self.cell[:, j]]
            upper += (most * most)[:, self.cell[:, j]]
        rows, entries = np.nonzero(lower <= upper.min(axis=1)[:, None])
        gap = x[rows] - self.book[entries]
        found = upper + 1  # more than any distance
        found[rows, entries] = (gap * gap).sum(axis=1)
        best = found.argmin(axis=1)
        return best, found[np.arange(len(x)), best], len(rows)


def _exact(x: np.ndarray) -> np.ndarray:
    """Integers in 64 bits, or as Python's own where squares and sums could pass them."""
    return x.astype(object) if x.size and max(abs(int(x.max())), abs(int(x.min()))) >= WIDE else x


def _parts(column, length: int, parts: int):
    """An Arrow column of lists of that length as blocks of (rows, parts, width)."""
    flat = (column.combine_chunks() if hasattr(column, "combine_chunks") else column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    x = flat.reshape(-1, length)
    width = -(-length // parts)
    for at in range(0, len(x), BLOCK):
        block = np.zeros((len(x[at : at + BLOCK]), parts * width), np.int64)
        block[:, :length] = x[at : at + BLOCK]
        yield _exact(block.reshape(-1, parts, width))


def _as(books: list[np.ndarray], x: np.ndarray, bits: int) -> list[Cells]:
    wide = x.dtype == object or any(_exact(b).dtype == object for b in books)
    return [Cells.of(b.astype(object) if wide else b, bits) for b in books]


@dataclass(frozen=True)
class Codebooks:
    """Of each part the entries as rows of integers; of what length vectors are, and what their components are scaled by."""

    books: list[np.ndarray]
    length: int
    scale: int
    bits: int = BITS

    def text(self) -> str:
        """All integers by part, entry and position, comma-joined."""
        return ",".join(str(int(v)) for b in self.books for v in b.ravel())


def _round(rows: DataFrame, books: Codebooks) -> list[np.ndarray]:
    """Each entry as the floored mean of the parts nearest to it; entries of no part stay."""
    parts, width = len(books.books), books.books[0].shape[1]
    length, bits, known = books.length, books.bits, books.books
    sums = ", ".join(f"s{j} decimal(38,0)" for j in range(width))

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        total = np.zeros((parts, max(len(b) for b in known), width), object)
        count = np.zeros(total.shape[:2], np.int64)
        for batch in batches:
            for x in _parts(batch.column(0), length, parts):
                for p, cells in enumerate(_as(known, x, bits)):
                    best = cells.nearest(x[:, p].astype(cells.book.dtype))[0]
                    for e in np.unique(best):
                        own = x[best == e, p]
                        total[p, e] += own.sum(axis=0)
                        count[p, e] += len(own)
        p, e = np.nonzero(count)
        if len(p):
            made = [[Decimal(int(v)) for v in total[p, e, j]] for j in range(width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), *(pa.array(m, pa.decimal128(38, 0)) for m in made)],
                names=["part", "entry", "n", *(f"s{j}" for j in range(width))],
            )

    out = [b.astype(object) for b in known]
    found = rows.mapInArrow(run, f"part int, entry int, n long, {sums}").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])
    for r in found.collect():  # parts x entries rows at most
        out[r.part][r.entry] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    return [b.astype(np.int64) for b in out]


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, bits: int = BITS) -> Codebooks:
    """Codebooks after so many rounds over all vectors."""
    whole = integers(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v", scale, "x").select("id", "x")
    rows = written(whole)
    lengths = rows.filter(F.size("x") > 0).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    length = lengths[0]["d"] if lengths else 0
    own = rows.filter(F.size("x") == length)
    width = -(-length // parts)
    first = own.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect() if length else []
    start = np.zeros((len(first), parts * width), np.int64)
    for k, r in enumerate(first):
        start[k, :length] = r.x
    books = Codebooks([start[:, p * width : (p + 1) * width] for p in range(parts)], length, scale, bits)
    for _ in range(rounds if first else 0):
        books = Codebooks(_round(own.select("x"), books), length, scale, bits)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """Rows with whole vectors, with their code (two hex digits a part) and squared distance to what it stands for."""
    (x,) = renamed(vectors, "integers")
    rows = integers(vectors, vector_col, books.scale, x)
    length, bits, known, parts = books.length, books.bits, books.books, len(books.books)
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            fits = np.diff(column.offsets.to_numpy()) == length if length else np.zeros(batch.num_rows, bool)
            codes, errors = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            made, off = [], []
            for block in _parts(column.filter(pa.array(fits)), length, parts) if fits.any() else ():
                best, gap = zip(*(cells.nearest(block[:, p].astype(cells.book.dtype))[:2] for p, cells in enumerate(_as(known, block, bits))))
                made += [bytes(c).hex() for c in np.stack(best, axis=1).astype(np.uint8)]
                off += [int(e) if abs(int(e)) < 2**63 else None for e in np.sum([g.astype(object) for g in gap], axis=0)]
            codes[fits], errors[fits] = made, off
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(codes.tolist(), pa.string()), pa.array(errors.tolist(), pa.int64())], names=[*batch.schema.names[:-1], code, error])

    return rows.mapInArrow(run, StructType([*vectors.schema.fields, StructField(code, StringType()), StructField(error, LongType())]))


def report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **how) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): each whole vector's code under codebooks fitted to all."""
    import hashlib

    slim = vectors.select(F.col(id_col).alias("vec_id"), F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("null")).alias("label"), F.col(vector_col).alias("v"))
    books = fit(slim, "vec_id", "v", **how)
    rows = written(encode(slim, books, "v").select("vec_id", "label", "code", "error"))
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("rows"))
    fits = F.expr("try_cast(sum AS bigint)")
    out = small_or_dealt(rows, sums.select("label", "rows", fits.alias("label_error")), ["label"], "rows")
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(books.text().encode()).hexdigest()).alias("codebooks_sha256"))
