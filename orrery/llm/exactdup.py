"""Exact dedup (7): a minimal perfect hash over historical distinct digests.

History is reduced to distinct digests, each with the smallest id of its rows (the
winner) and the number of its rows. Digests are dealt to shards by their first bytes;
each shard gets a minimal perfect hash: levels of bit arrays whose ranks number the
digests 0..n-1. Slot i holds the full 32-byte digest, the winner and the row count.
New rows come as distinct digests, too: a lookup finds the slot, compares all 32 bytes
and so tells members, which join the slot's group, from nonmembers, which form groups of
their own. A member's group is known from its slot alone.

A table without an earlier one is deduplicated in two parts, dealt by a hash of the id:
one is the history of the other, and of a text that both have the smaller id wins.

Only digests and ids are shuffled, texts only where more rows go than can be sent to all
tasks. Copies are summed before the shuffle, so a text that a third of all rows repeat
costs one row per task there; where rows get their group's values, the rows of a large
group are dealt over several tasks.

Defined results: ids are whole numbers; a null text counts as empty; empty texts are
copies of each other; a text of any length is one digest. Rows that repeat both id and
text are one document: all of them carry kept = true in the report, and `dedup` leaves
one of them. A null id loses against any id. An empty table gives an empty table. Further
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import normalised, renamed, small, told_by_size, written

#: Digests of a shard: its slots take 49 bytes each.
SHARD_DIGESTS = 40_000
#: Bits of a level for each digest that is still without a slot.
GAMMA = 1.6
#: Rows of one text that get their group's values in one task.
HOT_ROWS = 50_000

INDEX_SCHEMA = "shard int, n long, sizes array<int>, bits binary, digests binary, none binary, winners binary, counts binary"
FOUND_SCHEMA = "digest binary, member boolean, none boolean, winner long, group_size long"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digests.reshape(-1, 32).view("<u8").reshape(-1, 4)
    return words[:, 1].copy(), words[:, 2].copy() | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """Another 64-bit number for each level, mixed and reduced to the size."""
    with np.errstate(over="ignore"):
        x = a + np.uint64(level + 1) * b
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
    return ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def build_mph(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, all bits, and the slot of each of the distinct digests (n x 32 bytes)."""
    a, b = _halves(digests)
    slot = np.zeros(len(a), np.int64)
    left, sizes, bits, ranked = np.arange(len(a)), [], [], 0
    while len(left):
        size = max(8, int(GAMMA * len(left)) + 1)
        at = _place(a[left], b[left], len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        ok = alone[at]
        slot[left[ok]] = ranked + (np.cumsum(alone) - 1)[at[ok]]
        ranked += int(alone.sum())
        sizes.append(size)
        bits.append(alone)
        left = left[~ok]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), slot


def find_slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot that each digest would have; -1 where no level has a bit for it."""
    a, b = _halves(digests)
    slot = np.full(len(a), -1, np.int64)
    rank = np.cumsum(bits) - 1
    left, start = np.arange(len(a)), 0
    for level, size in enumerate(sizes):
        at = _place(a[left], b[left], level, size).astype(np.int64) + start
        hit = bits[at]
        slot[left[hit]] = rank[at[hit]]
        left = left[~hit]
        start += size
    return slot


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    digests = np.frombuffer(b"".join(pdf["digest"]), np.uint8)
    sizes, bits, slot = build_mph(digests)
    n = len(pdf)
    slots = np.empty((n, 32), np.uint8)
    slots[slot] = digests.reshape(n, 32)

    def dealt(values: pd.Series, kind) -> bytes:
        out = np.empty(n, kind)
        out[slot] = values.to_numpy()
        return out.tobytes()

    row = [key[0], n, sizes, np.packbits(bits).tobytes(), slots.tobytes(), dealt(pdf["none"], bool), dealt(pdf["winner"], np.int64), dealt(pdf["rows"], np.int64)]
    return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])


def _merge(smaller: bool):
    """A shard's new digests and its index to groups.

    smaller: both are parts of one table, so of a member's two winners the smaller id
    stands, and groups that only the index has are told, too. Else history's winner stands.
    """

    def run(pdf: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        new = pd.DataFrame({"digest": pdf["digest"], "member": False, "none": pdf["none"].astype(bool), "winner": pdf["winner"].astype(np.int64), "group_size": pdf["rows"].astype(np.int64)})
        if not len(index):
            return new
        x = index.iloc[0]
        sizes = [int(s) for s in x["sizes"]]
        bits = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=sum(sizes)).astype(bool)
        held = np.frombuffer(x["digests"], np.uint8).reshape(-1, 32)
        none, winner, counts = (np.frombuffer(x[c], kind).copy() for c, kind in (("none", bool), ("winners", np.int64), ("counts", np.int64)))
        mine = np.frombuffer(b"".join(pdf["digest"]), np.uint8)
        slot = find_slots(mine, sizes, bits)
        member = slot >= 0
        member[member] = (held[slot[member]] == mine.reshape(-1, 32)[member]).all(axis=1)  # every byte decides
        at, hit = slot[member], new[member]
        counts[at] += hit["group_size"].to_numpy()
        if smaller:
            better = (none[at] & ~hit["none"].to_numpy()) | ((none[at] == hit["none"].to_numpy()) & (hit["winner"].to_numpy() < winner[at]))
            none[at[better]], winner[at[better]] = hit["none"].to_numpy()[better], hit["winner"].to_numpy()[better]
            told = np.arange(len(held))
        else:
            told = at
        rows = held[told].tobytes()
        groups = pd.DataFrame({"digest": [rows[k : k + 32] for k in range(0, len(rows), 32)], "member": True, "none": none[told], "winner": winner[told], "group_size": counts[told]})
        return pd.concat([groups, new[~member]], ignore_index=True)

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest) of each row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"))


def distinct_digests(rows: DataFrame, *more: str) -> DataFrame:
    """(doc_id, digest) to (digest, none, winner, rows), by more columns if any; a null id is the largest. Summed before the shuffle."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("winner")))
    return rows.groupBy("digest", *more).agg(least.alias("least"), F.count("*").alias("rows")).select("digest", *more, "least.*", "rows")


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """One row for each shard. A shard's digests are distinct and evenly spread, so no shard is hot."""
    return distinct.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build, INDEX_SCHEMA)


def lookup(distinct: DataFrame, index: DataFrame, shards: int, smaller: bool = False) -> DataFrame:
    """The groups of new distinct digests, of members as their slots say (see _merge)."""
    mine = distinct.withColumn("shard", _shard(shards))
    return mine.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_merge(smaller), FOUND_SCHEMA)


def shards_for(distinct: DataFrame) -> int:
    return max(1, -(-distinct.count() // SHARD_DIGESTS))


def groups(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Each distinct digest of rows (doc_id, digest) with (member, none, winner, group_size).

    history: earlier rows of the same kind, whose winners stand. Without it a part of the
    rows, dealt by a hash of the id, is the history of the others.
    """
    if history is not None:
        past, new = written(distinct_digests(history)), distinct_digests(rows)
    else:
        both = written(distinct_digests(rows.withColumn("past", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), "past"))
        past, new = both.filter("past").drop("past"), both.filter("NOT past").drop("past")
    shards = shards_for(past)
    index = written(build_index(past, shards))
    return written(lookup(new, index, shards, smaller=history is None))


def _told(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with what is known of their digests."""
    return told_by_size(rows, found, ["digest"], "group_size", HOT_ROWS)


def _kept(history: DataFrame | None) -> Column:
    wins = (F.col("doc_id").isNull() == F.col("none")) & (F.coalesce("doc_id", F.lit(0)) == F.col("winner"))
    return wins if history is None else wins & ~F.col("member")


def report(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size (rows here and in history), kept, text_sha256, member (of the history)."""
    rows = written(keyed(docs, id_col, text_col))
    found = groups(rows, None if history is None else keyed(history, id_col, text_col))
    return _told(rows, found).select("doc_id", F.when(~F.col("none"), F.col("winner")).alias("keep_id"), "group_size", _kept(history).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "member")


def dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each normalised text, none of a text that history has. Columns as in docs."""
    rows = written(keyed(docs, id_col, text_col))
    found = groups(rows, None if history is None else keyed(history, id_col, text_col))
    d, n, i, twice = renamed(docs, "digest", "no_id", "own_id", "twice")
    name = [F.col("digest").alias(d), F.col("doc_id").isNull().alias(n), F.coalesce("doc_id", F.lit(0)).alias(i)]
    # Rows are told by digest and id, and documents meet only the keys of rows that go, or that are there more than once.
    copies = written(_told(rows, found.filter("group_size > 1")).select(*name, _kept(history).alias("kept")))
    goes = written(copies.filter("NOT kept").select(d, n, i).distinct())
    own = F.col(id_col).cast("long")
    tagged = docs.withColumns({d: digest(F.col(text_col)), n: own.isNull(), i: F.coalesce(own, F.lit(0))})
    left = tagged.join(small(goes), [d, n, i], "left_anti")
    again = written(copies.filter("kept").groupBy(d, n, i).count().filter("count > 1").select(d, n, i, F.lit(True).alias(twice)))
    if again.limit(1).count():
        left = left.join(small(again), [d, n, i], "left")
        left = left.filter(F.col(twice).isNull()).unionByName(left.filter(twice).dropDuplicates([d, n, i]))
    return left.select(*docs.columns)
