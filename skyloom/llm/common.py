"""Helpers that the training-data operators share: written tables, tables to read, sizes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import drop, shared_dir
from ..sources.tables import written as store

__all__ = ["NO_ID", "buckets", "documents", "drop", "kept_rows", "lots", "named", "row_key", "shared_dir", "small", "small_batches", "spread_join", "store", "text_of", "uniform"]

#: Rows of a few numbers each that every task may hold.
SMALL_ROWS = 300_000


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has at most ``SMALL_ROWS`` rows; larger ones are shuffled. The result is the same."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


#: A key of more rows than this is not sent to one task by :func:`spread_join`.
HOT_ROWS = 10_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row for a ``key`` and in ``count`` how many of ``rows`` have it at least.

    A small table is sent to every task. Of a larger one only the keys of very many rows are: as the counts add up to their sum, fewer than
    ``SMALL_ROWS`` keys can have more than the sum's part of that, however large the table is. So no task gets all rows of a hot key.
    Both inputs are read more than once and should be written tables. Null keys match nothing and stay, with nulls.
    """
    n, total = table.agg(F.count("*"), F.sum(count)).first()
    if n <= SMALL_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    most = max(HOT_ROWS, math.ceil(total / SMALL_ROWS))
    hot = F.broadcast(table.filter(F.col(count) > most))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.filter(F.col(count) <= most), key, "left")
    return rest.unionByName(rows.join(hot, key))


#: Rows and bytes of texts that a worker takes from an Arrow batch at a time.
LOT_ROWS, LOT_BYTES = 1024, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Asks for Arrow batches of few texts, where the session has no batch size of its own.

    Queries and stages call this, operators don't. A batch of ten thousand texts, as by default, takes memory on both sides of the pipe, and
    Spark has no setting by call; a session that names a batch size, the default's included, keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(LOT_ROWS))


def lots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that few texts and results are held at once whatever the session's batch size is."""
    for b in it:
        n = max(1, min(LOT_ROWS, b.num_rows * LOT_BYTES // max(1, b.nbytes)))
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def buckets(rows: int, per_bucket: int, least: int = 1) -> int:
    """How many buckets hold ``rows`` at about ``per_bucket`` each: grows with the data."""
    return max(least, math.ceil(rows / per_bucket))


#: Stands for a null id in keys.
NO_ID = -(2**63)


def named(name: str) -> Column:
    """A column by its whole name, dots included; Spark refuses names with backticks."""
    return F.col(f"`{name}`")


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row; together with the id it tells rows apart that differ in any column."""
    plain = lambda f: F.to_json(F.struct(named(f.name))) if re.search(r"map<|variant", f.dataType.simpleString()) else named(f.name)
    return F.xxhash64(*[plain(f) for f in docs.schema])


def kept_rows(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that stay, with all their columns whatever their names.

    judged: (doc_id, th, kept) for every row, th being its :func:`row_key`. Rows are found by id and key, so what
    moves is the keys of the rows that go; of rows that are equal in every column as many stay as are kept.
    """
    own = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)).alias("id0")
    counts = judged.groupBy(own("doc_id"), "th").agg(F.count("*").alias("rows"), F.count_if("kept").alias("kept"))
    keys = store(counts.filter("kept < rows"), "gone")
    keyed = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("d"), own("doc_id"), row_key(docs).alias("th"))
    others = keyed.join(small(keys.select("id0", "th")), ["id0", "th"], "left_anti").select("d.*")
    repeated = keyed.join(small(keys.filter("kept > 0")), ["id0", "th"]).groupBy("id0", "th").agg(F.first("d").alias("d"), F.first("kept").alias("n"))
    return others.unionByName(repeated.select(F.explode(F.array_repeat("d", F.col("n").cast("int"))).alias("d")).select("d.*"))


def uniform(*cols: Column | str) -> Column:
    """A draw in (0, 1) that depends on the columns only."""
    return ((F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
