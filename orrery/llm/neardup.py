"""MinHash near-dedup (5): BagMinHash signatures, bands, exact multiset overlap.

Texts whose words are equal are one node from the start. Nodes that share the key of a
band are candidates. Buckets never become pairs: each bucket ties its nodes to its least
one, and the ties' connected components are the groups in which all links must lie.
Only the texts of such groups are read again. A group is checked in one task by its
inverted index: the overlap with all texts not yet in the class comes from the postings
of one text, exactly, and what joins a class is not looked at again.

A group that exceeds GROUP nodes or GROUP_BYTES of shingles is not checked as a whole, as
chains of weak candidates may tie any number of texts, but bucket by bucket (of buckets
with equal members one). Only a bucket that exceeds these bounds itself is cut into blocks,
of which every two are checked together. So memory is bounded, nothing is left out, and
tasks stay even.

Classes are connected by similarity of at least the threshold (weighted Jaccard of bags
of five-word runs, 0.8); only links of classes, never pairs, leave a task.

Defined results: a null text is empty; texts without words form one class; texts of fewer
than five words are alike only if their words are equal; the class id is the least id of
the class (null where no row of it has one: a null counts as larger than any id); repeated
rows are in one class; rows that repeat an id with other texts, or have none, are classified
and kept or dropped each by its own text; of a pair at exactly the threshold both are in one
class; a text of any length is one bag. Ids are whole numbers. Columns of the input may have
any names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import bagminhash as bag
from orrery.llm.common import blocks, released, renamed, small, with_columns_of_text, without, written
from orrery.llm.components import components

THRESHOLD = 0.8
#: Nodes, and bytes of their shingles, that are checked together.
GROUP, GROUP_BYTES = 4_096, 16_000_000
#: Bytes of text that are hashed together: the arrays take about forty times as many.
BLOCK_BYTES = 1_000_000


def _digests(texts: list[str]) -> list[bytes]:
    words, bounds = bag.word_hashes(texts)
    return [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])]


def row_key(id_col: str, text_col: str):
    """16 bytes that tell rows by id and text; ids may repeat or be null."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, digest of the words, number of shingles, keys of the bands; no keys without words)."""

    def make():
        def work(texts):
            bags = bag.bags(texts)
            keys = bag.band_keys(bag.signatures(bags)).view(np.int64)
            return [_digests(texts), [int(c.sum()) for _, c in bags], [k if len(s) else [] for k, (s, _) in zip(keys, bags)]]

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return with_columns_of_text(rows, "text", "digest binary, shingles bigint, keys array<bigint>", make, BLOCK_BYTES, keep_text=False)


def tokens(s: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A bag as a set: the k-th occurrence of a shingle is a token of its own, the first the shingle itself in every bag."""
    if not len(s) or count.max() == 1:
        return s
    again = np.repeat(s, count)
    number = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
    later = bag.mixed(again + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.sort(np.where(number == 0, again, later))


def classes(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """The class of each set, numbered by its first member: connected by Jaccard similarity of at least the threshold."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    out = np.full(n, -1)
    if n == 1:
        return np.zeros(1, int)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(ids, np.cumsum(sizes)[:-1])
    owner = np.repeat(np.arange(n), sizes)

    def index(keep: np.ndarray):
        k = keep[owner]
        order = np.argsort(ids[k], kind="stable")
        return owner[k][order], np.searchsorted(ids[k][order], np.arange(ids.max() + 2 if len(ids) else 1))

    free = np.ones(n, bool)
    posted, starts = index(free)
    built = n
    for first in range(n):
        if not free[first]:
            continue
        free[first], out[first] = False, first
        queue = deque([first])
        while queue and free.any():
            x = queue.popleft()
            if 2 * free.sum() < built:  # what has a class leaves the index
                posted, starts, built = *index(free), int(free.sum())
            a, b = starts[own[x]], starts[own[x] + 1]
            length = b - a
            at = np.repeat(a - (np.cumsum(length) - length), length) + np.arange(length.sum())
            both = np.bincount(posted[at], minlength=n)
            near = np.flatnonzero(free & (both >= threshold * (sizes[x] + sizes - both) - 1e-9) & (both > 0))
            free[near], out[near] = False, first
            queue.extend(near.tolist())
    return out


def _bags():
    def work(texts):
        found = bag.bags(texts)
        return [_digests(texts), [tokens(s, c).tobytes() for s, c in found]]

    return work


def _linked(threshold: float):
    """Rows sorted by (comp, i, j) to (comp, node, root); a group's rows may come in several batches."""

    def run(batches):
        import pyarrow as pa

        held, key = [], None

        def links():
            if not held:
                return None
            unique = {}
            for node, data in held:
                unique.setdefault(node, data)
            nodes = sorted(unique)
            out = classes([np.frombuffer(unique[x], np.uint64) for x in nodes], threshold)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([nodes[k] for k in out], pa.binary())], names=["node", "root"])

        for batch in batches:
            for part in blocks(batch, 4) if batch.num_rows else ():
                for comp, i, j, node, data in zip(*(c.to_pylist() for c in part.columns)):
                    if key != (comp, i, j):
                        if (done := links()) is not None:
                            yield done
                        held, key = [], (comp, i, j)
                    held.append((node, data))
        if (done := links()) is not None:
            yield done
        held, done = [], None
        released()

    return run


def _cuts():
    """Blocks that the nodes of a group make."""
    return F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("shingles") * 8 / GROUP_BYTES), F.lit(1)).cast("int").alias("cuts")


def units(nodes: DataFrame) -> tuple[DataFrame, bool]:
    """(digest, row_key, parts: the units in which a node is checked, with their cuts), and whether a node may be in several."""
    keyed = nodes.select("digest", "shingles", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("digest").alias("b"), F.count("*").alias("n")).filter("n > 1")
    tied = written(keyed.join(shared.select("key", "b"), "key"))
    groups = written(components(written(tied.filter("digest != b").select(F.col("digest").alias("a"), "b").distinct())))
    sized = groups.join(nodes.select("digest", "shingles", "row_key"), F.col("node") == F.col("digest"))
    cut = written(sized.groupBy("root").agg(_cuts()))
    big = cut.filter("cuts > 1").limit(1).count() > 0
    found = sized.join(cut, "root").select("digest", "row_key", F.col("root").alias("unit"), "cuts")
    if big:
        inside = tied.join(found.filter("cuts > 1").select("digest", "row_key"), "digest")
        same = F.sum(F.xxhash64("digest").cast("decimal(38,0)"))
        buckets = inside.groupBy("key").agg(_cuts(), F.count("*").alias("n"), F.min("digest").alias("least"), same.alias("same"))
        once = buckets.groupBy("n", "least", "same").agg(F.min("key").alias("key"), F.first("cuts").alias("cuts")).select("key", "cuts")
        found = found.filter("cuts = 1").unionByName(inside.join(once, "key").select("digest", "row_key", F.unhex(F.hex("key")).alias("unit"), "cuts"))
    return found.groupBy("digest", "row_key").agg(F.collect_list(F.struct("unit", "cuts")).alias("parts")), big  # one for each band at most


def classified(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, row_key, digest, root (the class, also where ids repeat), class_id, class_size, text_class."""
    seen = written(sketches(docs, id_col, text_col))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("first_id")
    nodes = written(seen.groupBy("digest").agg(least, F.min("row_key").alias("row_key"), F.count("*").alias("n_rows"), F.first("shingles").alias("shingles"), F.first("keys").alias("keys")))
    todo, big = units(nodes)
    todo = small(written(todo.withColumnRenamed("digest", "node")))
    rows = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text")).join(todo, "row_key")
    bags = with_columns_of_text(rows, "text", "found binary, data binary", _bags, BLOCK_BYTES, keep_text=False).filter("found = node")
    bags = bags.withColumn("part", F.explode("parts")).select("node", "data", "part.unit", "part.cuts")
    # A unit without cuts goes to one task; else block p meets every block q: (p, q) in order, or alone where there is one.
    bags = bags.withColumn("p", F.expr("cast(pmod(xxhash64(node), cuts) AS int)")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    bags = bags.filter("cuts = 1 OR p != q").select(F.col("unit").alias("comp"), F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "node", "data")
    linked = bags.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_linked(threshold), "node binary, root binary")
    linked = written(linked)
    if big:
        linked = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # Every node of a group with its root; all other nodes are their own.
    of = nodes.join(linked.select("node", "root"), F.col("digest") == F.col("node"), "left").select("digest", "first_id", "n_rows", F.coalesce("root", "digest").alias("root"))
    heads = of.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("n_rows").alias("class_size"))
    named = of.join(heads, "root").select("digest", F.col("first_id.id").alias("text_class"), "root", F.col("class_id.id").alias("class_id"), "class_size")
    return seen.select("doc_id", "row_key", "digest").join(written(named), "digest")


def link(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size (rows), text_class (of those with equal words)."""
    return classified(docs, threshold, id_col, text_col).select("doc_id", "text_class", "class_id", "class_size")


def dedup(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, the one with the least id, then the least digest. Columns as in docs.

    Rows are told by id and text: documents that share an id, or have none, are decided each for its own class.
    """
    found = written(classified(docs, threshold, id_col, text_col).filter("class_size > 1").select("doc_id", "row_key", "digest", "root"))
    (key,) = renamed(docs, "own_id")
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "row_key")).alias("k")).select("k.row_key")
    drop = without(found.select("row_key").distinct(), kept, "row_key").select(F.col("row_key").alias(key))
    left = without(docs.withColumn(key, row_key(id_col, text_col)), written(drop), key)
    if found.groupBy("row_key").count().filter("count > 1").limit(1).count():
        left = left.dropDuplicates([key])
    return left.select(*docs.columns)
