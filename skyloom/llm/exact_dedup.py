"""Exact dedup by a minimal perfect hash over historical distinct digests.

The history's distinct digests are dealt to shards of bounded size. Each shard becomes one index row: the
bit levels of a minimal perfect hash, and slots that hold the full digest, the winner's locator and its
count. New digests are grouped first (a hot text becomes one row before anything moves), looked up in
their shard's index and compared byte by byte with the slot; members join the slot's group,
nonmembers form groups of their own, and slots that nothing hit are the groups of the history alone. So the index
gives all groups; rows then take the winner of a group of several, rows of a text of its own are their own winners.

Nulls: a null text counts as empty; a null doc_id sorts after all others. Repeated rows (same id and text)
are told apart by a row number, so exactly one row of a group stays. An empty table gives an empty result. Extra columns of any
name aren't read, and the stage returns them as they are.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Distinct digests of a shard, on average.
SHARD_ROWS = 8192
#: Bits for each key that is left at a level; more bits, fewer levels.
GAMMA = 1.5
LEVELS = 40

INDEX_SCHEMA = "shard int, n long, sizes string, bits binary, digests binary, ids binary, nulls binary, rows binary, counts binary"
GROUPS_SCHEMA = "digest binary, keep_id long, keep_row long, group_size long, known boolean"


def normalised(text: Column) -> Column:
    """Each run of white space ``[\\x20\\x09-\\x0D]+`` as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, row, digest, ...): SHA-256 of the normalised UTF-8 text; row numbers the input rows."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(normalised(common.text_of(text_col)).cast("binary"), 256)).alias("digest"),
        *extra,
    )


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, doc_id, row, n): the winner's locator and the size of each group of equal digests."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    return rows.groupBy("digest").agg(first.alias("w"), F.count("*").alias("n")).select("digest", "w.doc_id", "w.row", "n")


# ---------------------------------------------------------------- the perfect hash


def _keys(digests: np.ndarray) -> np.ndarray:
    """Two 64-bit words of each digest."""
    return np.ascontiguousarray(digests[:, :16]).view("<u8").reshape(-1, 2)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level) * np.uint64(0xD1B54A32D192ED03))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def build(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(level sizes, bits of all levels, slot of each digest). Slots are 0..n-1, each used once."""
    keys, left = _keys(digests), np.arange(len(digests))
    slot, sizes, bits, used = np.full(len(digests), -1, np.int64), [], [], 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(8, int(GAMMA * len(left)))
        at = _places(keys[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        hit = alone[at]
        slot[left[hit]] = used + (np.cumsum(alone) - 1)[at[hit]]
        used += int(alone.sum())
        sizes.append(size)
        bits.append(alone)
        left = left[~hit]
    slot[left] = used + np.arange(len(left))  # digests with equal first 16 bytes: searched one by one
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), slot


def find(sizes: list[int], bits: np.ndarray, slots: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The slot that holds each digest, or -1. Every answer is checked against the slot's full digest."""
    keys, left = _keys(digests), np.arange(len(digests))
    out, start, rank = np.full(len(digests), -1, np.int64), 0, np.cumsum(bits) - 1
    for level, size in enumerate(sizes):
        at = _places(keys[left], level, size) + start
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + size
    hashed = int(bits.sum())
    if len(slots) > hashed:
        rest = {bytes(d): hashed + i for i, d in enumerate(slots[hashed:])}
        for i in left:
            out[i] = rest.get(bytes(digests[i]), -1)
    found = np.flatnonzero(out >= 0)
    out[found[~(slots[out[found]] == digests[found]).all(axis=1)]] = -1
    return out


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(-1, 32)


def _index_row(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    d = _matrix(pdf["digest"])
    sizes, bits, slot = build(d)
    order = np.argsort(slot)
    none = pdf["doc_id"].isna().to_numpy()
    ids = pdf["doc_id"].astype("Int64").fillna(0).to_numpy("<i8")
    ids, rows, counts = (x[order].astype("<i8").tobytes() for x in (ids, pdf["row"].to_numpy(), pdf["n"].to_numpy()))
    return pd.DataFrame([[key[0], len(d), json.dumps(sizes), np.packbits(bits).tobytes(), d[order].tobytes(), ids, none[order].tobytes(), rows, counts]], columns=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])


def _shard(shards: int) -> Column:
    """By the digest's last 8 bytes; the hash inside a shard uses the first 16."""
    return F.pmod(F.xxhash64(F.substring("digest", 25, 8)), F.lit(shards)).cast("int").alias("shard")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One index row a shard, from rows (digest, doc_id, row, n) with distinct digests."""
    return history.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_index_row, INDEX_SCHEMA)


def _look(key: tuple, index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """All groups of a shard: its slots, with what hits them, and the new digests that are no members."""
    digests, none = _matrix(new["digest"]), new["doc_id"].isna().to_numpy()
    ids, rows, counts = new["doc_id"].astype("Int64").fillna(0).to_numpy("i8"), new["row"].to_numpy("i8"), new["n"].to_numpy("i8")
    known = np.zeros(len(new), bool)
    if len(index):
        x = index.iloc[0]
        sizes = json.loads(x["sizes"])
        bits = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=sum(sizes)).astype(bool)
        slots = np.frombuffer(x["digests"], np.uint8).reshape(-1, 32)
        old = {c: np.frombuffer(x[c], "<i8").copy() for c in ("ids", "rows", "counts")}
        old_none = np.frombuffer(x["nulls"], bool).copy()
        at = find(sizes, bits, slots, digests)
        hit, slot = np.flatnonzero(at >= 0), at[at >= 0]
        old["counts"][slot] += counts[hit]
        # the smaller id wins, null last, then the smaller row
        a, b = (none[hit], old_none[slot]), (ids[hit], old["ids"][slot])
        first = (~a[0] & a[1]) | ((a[0] == a[1]) & ((b[0] < b[1]) | ((b[0] == b[1]) & (rows[hit] < old["rows"][slot]))))
        old["ids"][slot[first]], old["rows"][slot[first]], old_none[slot[first]] = ids[hit[first]], rows[hit[first]], none[hit[first]]
        left = at < 0
        digests, none = np.concatenate([slots, digests[left]]), np.concatenate([old_none, none[left]])
        ids, rows, counts = (np.concatenate([o, x[left]]) for o, x in ((old["ids"], ids), (old["rows"], rows), (old["counts"], counts)))
        known = np.concatenate([np.ones(len(slots), bool), known[left]])
    keep = pd.array(ids, "Int64")
    keep[none] = pd.NA
    return pd.DataFrame({"digest": [d.tobytes() for d in digests], "keep_id": keep, "keep_row": rows, "group_size": counts, "known": known})


def look_up(index: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """All groups (digest, keep_id, keep_row, group_size, known) of an index and rows (digest, doc_id, row, n) with distinct digests; known: the history has it."""
    left, right = index.groupBy("shard"), new.withColumn("shard", _shard(shards)).groupBy("shard")
    return left.cogroup(right).applyInPandas(_look, GROUPS_SCHEMA)


def exact_dedup(history: DataFrame, new: DataFrame, total: int | None = None) -> DataFrame:
    """The rows of both tables (doc_id, row, digest, ...) with keep_id, keep_row, group_size and kept.

    The winner is the smallest doc_id of history and new rows together.
    """
    shards = common.buckets(total if total is not None else history.count() + new.count(), SHARD_ROWS)
    index = build_index(grouped(history), shards)
    several = common.store(look_up(index, grouped(new), shards).filter("group_size > 1").drop("known"), "dedup-groups")
    rows = common.spread_join(history.unionByName(new), several, "digest", "group_size")
    alone = F.col("group_size").isNull()
    own = {"keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), "keep_row": F.coalesce("keep_row", "row"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))}
    return rows.withColumns(own).withColumn("kept", F.col("row") == F.col("keep_row"))


def dedup_rows(rows: DataFrame) -> DataFrame:
    """:func:`exact_dedup` of one table (doc_id, row, digest): the lower half of its ids is the history, the rest is new."""
    span = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    cut = (span[0] + span[1]) // 2 if span[0] is not None else 0
    old = F.coalesce(F.col("doc_id") <= cut, F.lit(False))
    return exact_dedup(rows.filter(old), rows.filter(~old), span[2])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_rows(common.store(digests(common.documents(spark, sf_dir)), "dedup-digests"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each text."""
    key = common.row_key(docs).alias("th")
    found = common.store(digests(docs, extra=(key,)), "dedup-digests")
    return common.kept_rows(docs, dedup_rows(found).select("doc_id", "th", "kept"))


#: Groups and sizes come from plain grouping; the hash only decides where a digest is looked up.
SQL9 = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
