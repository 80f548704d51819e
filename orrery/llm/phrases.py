"""Phrase collocation mining (12): names of frequent phrases by hierarchical pair naming.

Words get names first, and a phrase of k words is then the pair of the names of its first
and its last k - 1 words: where two frequent (k-1)-grams start at adjacent words, their names
are a pair, pairs are joined over all documents and those of LEAST occurrences get a name
of their own. Whatever is not frequent ends a run, for no phrase that holds it is frequent,
so the higher the level, the less is left of the texts. A pair's two names are its parents:
they lead to the counts of the parts of each cut (left parents to first words, right parents
to last ones), and a phrase is subsumed if it is a parent of one nearly as frequent. That
is enough: a phrase within one of two more words is also within one of one more, which is no
rarer.

Texts become chunks of some CHUNK_BYTES, which keep numbers of words or names instead of the
texts, compressed; a chunk meets Spark as its distinct pairs with their counts. So a phrase
that a third of all texts hold costs a row a chunk. Those rows are dealt by pair and summed
over a window, where the pair's rows also get its name; frequent ones go back to their chunk.
Each level is written as a table, so lost executors cost a part of one level, and older tables
are dropped. The driver gathers nothing. The best of each language are found in two steps,
first by salt and then of what is left, as no task should order a language's all candidates.

Everything is exact: counts are longs, and scores are integer quotients of decimals.

Defined results. A null text is empty; a null language is `und`, as is the language `und`
itself. Only A to Z are lower-cased. White space and delimiters are those of the patterns:
all else, other control characters and spaces included, is part of words. Texts without
words give nothing. A word as long as its text is one word. Rows that repeat, with one id or
several, count each time. Ties go by count, then by phrase in the order of UTF-8. An empty
table gives an empty one. Only text and language are read, so names do not clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import drop_tables, released, small_or_dealt, tables, written

#: Occurrences from which a phrase is frequent; words of a phrase at most; hundredths of its count that make a longer one subsume it.
LEAST, LONGEST, SUBSUMED = 30, 4, 80
#: Bytes of text of a chunk; one text more may be in it.
CHUNK_BYTES = 16_000_000
#: Groups that each language's candidates are ordered in first.
SALTS = 32
#: What a score of equal counts is: twice the share of the phrase among its parts', in millionths.
FULL = 2_000_000

_END = b"\xff"  # between pieces; no byte of UTF-8
_BYTES = bytes(_END[0] if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def _packed(numbers) -> bytes:
    """int32 numbers by planes of bytes, compressed: most of the higher bytes are alike."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int32)


def chunks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, at, local, lang, word, n): a row a chunk with the numbers of its words in order (-1: the end of a piece), and a row a word with number, language and count."""

    def run(batches):
        from collections import defaultdict
        from itertools import count, islice

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0

        def made(ids, known, chunk):
            at = np.concatenate(ids)
            ids.clear()
            n = np.bincount(at, minlength=1)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([_packed(at - 1)], pa.binary()), *(pa.nulls(1, t) for t in (pa.int32(), pa.string(), pa.binary(), pa.int64()))], names=names)
            del at
            for lang, own in known.items():
                rest = (wi for wi in own.items() if wi[1])
                while some := list(islice(rest, 50_000)):
                    local = np.array([i for _, i in some], np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk] * len(some)), pa.nulls(len(some), pa.binary()), pa.array(local - 1), pa.array([lang] * len(some), pa.string()), pa.array([w for w, _ in some], pa.binary()), pa.array(n[local])], names=names
                    )
            known.clear()
            released()

        names = ["chunk", "at", "local", "lang", "word", "n"]

        def fresh():
            number = count(1).__next__

            def own():  # one language's words; numbers are the chunk's
                words = defaultdict(number)
                words[_END] = 0
                return words

            return [], defaultdict(own), 0

        ids, known, held = fresh()
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                b = text.as_buffer()
                b = b.to_pybytes() if b is not None else b""
                words = (b.lower().translate(_BYTES).replace(_END, b" \xff ") + b" \xff").split()
                if len(words) > 1:
                    ids.append(np.fromiter(map(known[lang.as_py()].__getitem__, words), np.int32, len(words)))
                    held += len(b)
                if held >= chunk_bytes:
                    yield from made(ids, known, (part << 24) + k)
                    (ids, known, held), k = fresh(), k + 1
        if ids:
            yield from made(ids, known, (part << 24) + k)

    slim = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("l"))
    return slim.mapInArrow(run, "chunk long, at binary, local int, lang string, word binary, n long").withColumn("word", F.col("word").cast("string"))


def named(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """Rows of keys of at least so many occurrences, with f, their number, and the key's name; first: one row of each key.

    Names are numbers of rows, so this has to be written before it is used twice.
    """
    own = Window.partitionBy(*key)
    frequent = rows.withColumn("f", F.sum("n").over(own)).filter(F.col("f") >= least).drop("n")
    row = frequent.withColumn("row", F.monotonically_increasing_id())
    return row.withColumn("id", F.min("row").over(own)).withColumn("first", F.col("row") == F.col("id")).drop("row")


def rewritten(texts: DataFrame, names: DataFrame, pairs: bool) -> DataFrame:
    """(chunk, ids, at) with each number of `at` as its name (ids: the chunk's names), runs without a name as one -1.

    texts: (chunk, ids, at); with pairs its numbers are pairs of adjacent ones first. names:
    the chunk's rows, (chunk, local, id) or (chunk, left, right, id).
    """
    key = ["left", "right"] if pairs else ["local"]

    def run(text, own):
        import numpy as np
        import pyarrow as pa

        at = _unpacked(text.column("at")[0].as_py())
        ids = own.column("id").to_numpy()
        if pairs:
            old = np.frombuffer(text.column("ids")[0].as_py(), np.int64)
            spot = np.argsort(old)
            at_of = lambda c: spot[np.searchsorted(old, own.column(c).to_numpy(), sorter=spot)].astype(np.int64)
            wanted = at_of("left") * len(old) + at_of("right")
            code = np.where((at[:-1] >= 0) & (at[1:] >= 0), at[:-1].astype(np.int64) * len(old) + at[1:], -1)
        else:
            wanted, code = own.column("local").to_numpy().astype(np.int64), at.astype(np.int64)
        order = np.argsort(wanted)
        wanted, ids = wanted[order], ids[order]
        where = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
        new = np.where(wanted[where] == code, where, -1)
        new = new[(new >= 0) | np.append(True, new[:-1] >= 0)]
        return pa.table({"chunk": text.column("chunk"), "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "at": pa.array([_packed(new)], pa.binary())})

    # Only chunks with names are met, and each has one row of texts.
    both = texts.groupBy("chunk").cogroup(names.select("chunk", *key, "id").groupBy("chunk"))

    def safe(text, own):
        import pyarrow as pa

        if not text.num_rows or not own.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "at": pa.array([], pa.binary())})
        return run(text, own)

    return both.applyInArrow(safe, "chunk long, ids binary, at binary")


def pairs(texts: DataFrame) -> DataFrame:
    """(chunk, left, right, n): each chunk's distinct pairs of adjacent names and their counts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for chunk, ids, at in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids, at = np.frombuffer(ids, np.int64), _unpacked(at)
                code = at[:-1].astype(np.int64) * len(ids) + at[1:]
                code, n = np.unique(code[(at[:-1] >= 0) & (at[1:] >= 0)], return_counts=True)
                for s in range(0, len(code), 200_000):
                    c = code[s : s + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), chunk)), pa.array(ids[c // len(ids)]), pa.array(ids[c % len(ids)]), pa.array(n[s : s + 200_000].astype(np.int64))], names=["chunk", "left", "right", "n"])

    return texts.select("chunk", "ids", "at").mapInArrow(run, "chunk long, left long, right long, n long")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, subsumed: int = SUBSUMED, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a, l, r, score) of all candidates that none subsumes, and (lang, n), the words of each language."""
    spark = docs.sparkSession
    start = len(tables)
    texts = written(chunks(docs, text_col, lang_col, chunk_bytes), True)
    words = texts.filter("local IS NOT NULL").select("chunk", "local", "lang", "word", "n")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), True)
    names = [written(named(words, ["lang", "word"], least), True)]
    level = written(rewritten(texts.filter("local IS NULL").select("chunk", F.lit(None).cast("binary").alias("ids"), "at"), names[0], False), True)
    drop_tables(spark, start, totals, names[0], level)
    for k in range(2, longest + 1):
        names.append(written(named(pairs(level), ["left", "right"], least), True))
        if k < longest:
            level = written(rewritten(level, names[-1], True), True)
            drop_tables(spark, start, totals, *names, level)
    # What is known of each name: its words, its last word, the counts of its first and of its last 1, 2, ... words.
    one = F.array("f")
    known = [names[0].filter("first").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), one.alias("firsts"), one.alias("lasts"))]
    own = [rows.filter("first").select("id", "left", "right", "f") for rows in names[1:]]
    for rows in own:
        less = known[-1]
        left = less.select(F.col("id").alias("left"), "lang", "phrase", "firsts")
        right = less.select(F.col("id").alias("right"), F.col("last").alias("last"), "lasts")
        both = small_or_dealt(small_or_dealt(rows, left, ["left"]), right, ["right"])
        known.append(
            written(both.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("firsts", one).alias("firsts"), F.concat("lasts", one).alias("lasts")))
        )
    found = []
    for k in range(2, longest + 1):
        rows = known[k - 1].withColumn("a", F.element_at("firsts", -1))
        if k < longest:
            above = own[k - 1]
            most = above.select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
            # Each name once on both sides; products in decimals, as counts are longs.
            rows = rows.join(most, "id", "left").filter(F.expr(f"most IS NULL OR 100 * CAST(most AS decimal(20,0)) < {int(subsumed)} * CAST(a AS decimal(20,0))"))
        cut = lambda j: F.struct(F.expr(f"{FULL} * CAST(a AS decimal(20,0)) DIV (CAST(firsts[{j - 1}] AS decimal(20,0)) + lasts[{k - j - 1}])").alias("score"), F.lit(j).alias("cut"), F.expr(f"firsts[{j - 1}]").alias("l"), F.expr(f"lasts[{k - j - 1}]").alias("r"))  # noqa: E731, B023
        least_cut = F.array_min(F.array(*[cut(j) for j in range(1, k)]))
        found.append(rows.select("lang", "phrase", F.lit(k).alias("words"), "a", least_cut.alias("cut")).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score"))
    return reduce(DataFrame.unionByName, found), totals


def collocations(docs: DataFrame, most: int = 2000, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, count and phrase."""
    found, totals = phrases(docs, **how)
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = found.withColumn("salt", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    long = lambda c: F.col(c).cast("long").alias(c)
    return small_or_dealt(best, totals, ["lang"]).select("lang", long("rank"), "phrase", *[long(c) for c in ("a", "l", "r", "n", "score")])
