"""Benchmark decontamination (13): winnowed fingerprints, with DataFrame functions only.

A window is SPAN consecutive words of an item, or all words of an item of fewer. A text's
k-grams of words are hashed, and each run of w = SPAN - k + 1 of them keeps its least hash:
texts that share SPAN words have a run in common and so keep the same fingerprint there. The
fingerprints of documents are joined with the items', and each hit is extended: windows that
may have kept this hash (those that start at most w - 1 words after the first one that did)
are spelled out and joined with the items' windows word by word. So no shared window is
missed, and nothing counts that hashes alone have in common. Items of fewer than SPAN words
have runs of their own for each of their lengths.

A document meets the join by its distinct fingerprints (about 2 in w + 1 words), not by its
words, and texts do not move: rows have the digest of a text as key, and only documents with a
hit are read again. What goes to all executors is counted first; beyond small numbers rows are
dealt by fingerprint, text or window, and a hot one of them goes to several tasks.

Defined results. A null text has no words. Words are runs of digits, of a to z and of
anything beyond ASCII; only A to Z are lower-cased. A text of any length is one row. An item
without words has no windows. Rows of one item_id are one item, and those without an id are
one called `null`. Windows that several items share count for each of them. Documents that
repeat, by id or text, get a row each. Without items, documents are clean. An empty table
gives an empty one. Only ids and texts are read, so names do not clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import BROADCAST_ROWS, HOT_ROWS, renamed, small, small_or_dealt, told_by_size, written

#: Words of a window, and of a k-gram at most.
SPAN, GRAM = 10, 5


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def lowered(text: Column) -> Column:
    """A to Z in lower case; lower() does the same, and faster, where all is ASCII."""
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, up, up.lower()))


def words(text: Column) -> Column:
    """A text's words in order; null: none."""
    cut = F.split(lowered(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(cut, "")


def upto(n: Column) -> Column:
    """0, 1, ... n - 1; none if n is below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def fingerprints(w: Column, span: int, gram: int = GRAM) -> Column:
    """Of words those least hashes of runs, with the first window that keeps each: array of (span, hash, at).

    A hash is told again where it still is the least a run's length later, so that every
    window starts less than a run's length after one that tells its hash.
    """
    k = min(gram, span)
    run = span - k + 1
    at = lambda a, i: F.get(a, i)
    told = lambda m: F.transform(
        F.filter(upto(F.size(m)), lambda i: (i == 0) | (at(m, i) != at(m, i - 1)) | ((i >= run) & (at(m, i) == at(m, i - run)))),
        lambda i: F.struct(F.lit(span).alias("span"), at(m, i).alias("hash"), i.alias("at")),
    )
    least = lambda g: F.transform(upto(F.size(g) - (run - 1)), lambda i: F.least(*[at(g, i + j) for j in range(run)]) if run > 1 else at(g, i))
    grams = lambda h: F.transform(upto(F.size(h) - (k - 1)), lambda i: F.xxhash64(*[at(h, i + j) for j in range(k)]))
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(grams(h), lambda g: let(least(g), told)))


def spelled(w: Column, starts: Column, span: Column) -> Column:
    """The windows of so many words at those starts, as (at, window, span)."""
    return let(w, lambda ws: F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(ws, i + 1, span), " ").alias("window"), span.alias("span"))))


def windows(items: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """(item, span, window) of all items, each once. span: its words."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    own = rows.withColumn("span", F.least(F.size("w"), F.lit(span)))
    cut = own.select("item", "span", F.explode(spelled(F.col("w"), upto(F.size("w") - F.col("span") + 1), F.col("span"))).alias("x"))
    return cut.select("item", "span", "x.window").distinct()


def found(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_words) of all documents, and (key, copies, n_hit, items) of the texts that hold windows.

    key: the text's digest; items: the distinct ids of their items as sorted strings.
    """
    of_items = written(windows(items, item_id, item_text, span))
    spans = sorted(r.span for r in of_items.select("span").distinct().collect())  # at most `span` rows
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    none = F.array().cast("array<struct<span:int,hash:bigint,at:int>>")
    prints = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.concat(none, *[fingerprints(w, s, gram) for s in spans]).alias("prints"))
    slim = written(docs.select(F.col(id_col).alias("doc_id"), digest.alias("key"), let(words(F.col(text_col)), prints).alias("x")).select("doc_id", "key", "x.*"))
    every = slim.select("doc_id", "key", "n_words")
    copies = slim.groupBy("key").agg(F.count("*").alias("copies"))

    # A window keeps one hash.
    known = of_items.select("span", "window").distinct()
    kept = [known.filter(F.col("span") == s).select(F.explode(fingerprints(F.split("window", " "), s, gram)).alias("x")).select("x.span", "x.hash") for s in spans]
    hashes = reduce(DataFrame.unionByName, kept, known.limit(0).select("span", F.lit(0).cast("long").alias("hash"))).distinct()
    rows = slim.select("key", F.explode("prints").alias("x")).select("key", "x.*")
    hits = written(small_or_dealt(rows, hashes, ["span", "hash"]).select("key", "span", "at").distinct())

    # Extended: of the texts with a hit, the windows that may have kept the hash.
    spots = hits.groupBy("key").agg(F.collect_list(F.struct("span", "at")).alias("spots"))
    texts = docs.select(digest.alias("key"), F.col(text_col).alias("text"))
    keys = hits.select("key").distinct()
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(keys), "key", "left_semi")
    met = told_by_size(texts, spots.join(copies, "key"), ["key"], "copies", HOT_ROWS)
    run = lambda s: s - min(gram, s) + 1
    near = lambda s: F.flatten(F.transform(F.filter("spots", lambda x: x["span"] == s), lambda x: F.sequence(x["at"], x["at"] + run(s) - 1)))
    starts = lambda w, s: F.array_distinct(F.filter(near(s), lambda i: i + s <= F.size(w)))
    spelt = lambda w: F.concat(*[spelled(w, starts(w, s), F.lit(s)) for s in spans])
    nowhere = F.array().cast("array<struct<at:int,window:string,span:int>>")
    tried = written(met.select("key", F.explode(let(words(F.col("text")), spelt) if spans else nowhere).alias("x")).select("key", "x.*").distinct())

    # Words under the union of a text's windows, from left to right; items by what they share.
    ends = F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("span")).alias("end"))))
    more = lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(a["end"], x["at"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
    true = small_or_dealt(tried, known, ["span", "window"])
    covered = true.groupBy("key").agg(F.aggregate(ends, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), more)["n"].alias("n_hit"))
    shared = of_items.groupBy("span", "window").agg(F.collect_list("item").alias("items"))
    pairs = small_or_dealt(tried.select("key", "span", "window").distinct(), shared, ["span", "window"], counted=of_items).select("key", F.explode("items").alias("item")).distinct()
    listed = pairs.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return every, copies.join(covered, "key").join(listed, "key")


def report(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of all documents."""
    every, texts = found(docs, items, **how)
    told = written(texts.select("key", "copies", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    out = small_or_dealt(every, told, ["key"], "copies", "left")
    nothing = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", nothing).alias("n_hit"), F.coalesce("n_items", nothing).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", nothing) > 0).alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those in whose text a window occurs. Columns as in docs."""
    _, texts = found(docs, items, id_col, text_col, **how)
    (key,) = renamed(docs, "key")
    told = written(texts.select(F.col("key").alias(key)))
    return docs.withColumn(key, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).join(small(told), key, "left_anti").select(*docs.columns)
