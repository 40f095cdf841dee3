"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A key descends region, rack and shard. At every level each child draws an exponential with its subtree's
weight as rate, from a hash of the key and the child's name; the smallest draw wins. A child's draw never
depends on its siblings, so when a subtree's weight changes only keys that enter or leave that subtree
move, and inside an untouched subtree nothing moves.

Growth appends shards to regions of their own (:func:`layout`), so the key law holds strictly: one more
shard takes keys only into itself.

Nulls: a null key hashes as a value of its own and lands in one shard; a null text has size 1 and the
CRC of the empty text. Repeated rows get different slots and are numbered in several tasks if they are many. An empty table gives
an empty result; extra columns of any name aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 16
#: Rows of a numbering bucket, on average.
BUCKET_ROWS = 100_000


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, first: int = SHARDS, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """``first`` shards in regions of ``racks`` racks; every later shard opens a region of its own."""
    per_region = racks * per_rack
    base = [Leaf(s // per_region, s % per_region // per_rack, s) for s in range(min(first, shards))]
    opened = -(-first // per_region)
    return base + [Leaf(opened + s - first, 0, s) for s in range(first, shards)]


def _descend(key: Column, leaves: list[Leaf], level: int = 0, path: str = "") -> Column:
    """The shard below ``path``; ``level`` 0 draws regions, 1 racks, 2 shards."""
    name = ("region", "rack", "shard")[level]
    children: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        children.setdefault(getattr(leaf, name), []).append(leaf)
    # draws and their winner: one pass a level, as structs ordered by draw
    below = {c: F.lit(x[0].shard) if level == 2 else _descend(key, x, level + 1, f"{path}/{c}") for c, x in children.items()}
    if len(children) == 1:
        return next(iter(below.values()))
    draws = [F.struct((-F.log(common.uniform(key, F.lit(f"{path}/{name}{c}"))) / F.lit(float(sum(x.weight for x in own)))).alias("draw"), F.lit(c).alias("child")) for c, own in children.items()]
    won = F.least(*draws)["child"]
    out = None
    for c, shard in below.items():
        out = F.when(won == F.lit(c), shard) if out is None else out.when(won == F.lit(c), shard)
    return out


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key; leaves without weight take nothing."""
    return _descend(key, [x for x in leaves if x.weight > 0]).cast("int")


def numbered(rows: DataFrame, by: str, order: list[str], total: int) -> DataFrame:
    """``slot``: gapless from 0 within each value of ``by``.

    Rows are dealt to hash buckets; a bucket's offset is the count of the buckets before it. No task
    gets more than a bucket of one group, so a group may hold any share of the rows.
    """
    n = common.buckets(total, BUCKET_ROWS, 8)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(n)).cast("int"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(by, "_bucket").count().select(by, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(by, "_bucket").orderBy(*order)
    placed = rows.withColumn("_at", F.row_number().over(inside))
    return placed.join(starts, [by, "_bucket"]).withColumn("slot", F.col("_start") + F.col("_at") - 1).drop("_bucket", "_start", "_at")


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = common.text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(id_col), layout(shards)).alias("shard"),
        shard_of(F.col(id_col), layout(shards + 1)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = common.store(rows, "sharding")
    out = numbered(rows, "shard", ["doc_id", "text_crc32", "size", "row"], rows.count())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(common.documents(spark, sf_dir))
