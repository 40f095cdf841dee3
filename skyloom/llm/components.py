"""Connected components of an edge list by alternating large and small stars.

Every round rewires edges to smaller neighbours by grouping and joining. A hub's edges share the key of a join, whose other side has one row for it;
adaptive execution splits such keys. The rounds grow with the logarithm of the component size, not with its diameter. Each round is written, the last one's edges go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(least, "u")
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is its component's smallest node."""
    first = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = common.store(first, "edges")
    seen = _signature(now)
    while seen[0]:
        after = common.store(_small(_large(now)), "edges")
        common.drop(now)
        now, last, seen = after, seen, _signature(after)
        if seen == last:
            break
    own = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return common.store(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(own), "labels")
