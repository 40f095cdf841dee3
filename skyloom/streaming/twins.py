"""Structured Streaming forms of the batch operators that have one: windows, sessions, snapshots, new files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    """A stream of the files that arrive in a folder; with a checkpoint each is read once."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def tumbling_counts(points: DataFrame, ts: str = "ts", width: str = "15 minutes", late: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """Points and flights by window, aligned to the epoch. The distinct count is approximate, as state must stay bounded."""
    g = points.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
    return g.agg(F.count("*").alias("n"), F.approx_count_distinct("id").alias("flights")).select(F.col("window.start").alias("window_start"), *keys, "n", "flights")


def gap_sessions(points: DataFrame, ts: str = "ts", gap: str = "5 hours", late: str = "6 hours") -> DataFrame:
    """Sessions of each id: a gap longer than ``gap`` ends one."""
    s = points.withWatermark(ts, late).groupBy("id", F.session_window(ts, gap))
    return s.agg(F.count("*").alias("n"), F.min(ts).alias("from_ts"), F.max(ts).alias("to_ts")).drop("session_window")


def minute_snapshots(points: DataFrame, ts: str = "ts", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """The last row of each id in each minute."""
    rest = [c for c in points.columns if c not in ("id", ts)]
    g = points.withWatermark(ts, late).groupBy("id", F.window(ts, width))
    return g.agg(F.max_by(F.struct(ts, *rest), ts).alias("r")).select("id", "r.*")


def sliding_files(files: DataFrame, ts: str = "ts", width: str = "5 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Ids with the sorted hours in which they occur, over a window of five hours that moves by one."""
    g = files.withWatermark(ts, late).groupBy("id", F.window(ts, width, step))
    return g.agg(F.array_sort(F.collect_set(F.date_trunc("hour", ts))).alias("hours")).select("id", F.col("window.start").alias("window_start"), "hours")


class _Gathered(StatefulProcessor):
    """Holds the rows of an id until its batch of files is over, then gives them with the batch's first file."""

    def __init__(self, width: int, step: int, most: int):
        self.width, self.step, self.most = width, step, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "event_id long", "file long")
        self.due = handle.getValueState("due", "at long")

    def _ask(self, first: int) -> None:
        """A timer at the end of the batch that begins with ``first``; an earlier start moves it."""
        at = (first + self.width * self.step) * 1000
        if self.due.exists():
            old = self.due.get()[0]
            if old == at:
                return
            self.handle.deleteTimer(old)
        self.due.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            self.rows.updateValue((r.event_id,), (r.file,))  # a file that comes again changes nothing
        self._ask(min(v[0] for v in self.rows.values()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.due.clear()
        held = sorted((v[0], k[0]) for k, v in self.rows.iterator())
        # the watermark may have passed the end of more than one batch
        while held and (held[0][0] + self.width * self.step) * 1000 <= timerValues.getCurrentWatermarkInMs():
            first = held[0][0]
            batch = [(f, e) for f, e in held if f < first + self.width * self.step]
            home = first if len({f for f, _ in batch}) <= self.most else None
            for f, e in batch:
                self.rows.removeKey((e,))
                yield Row(id=key[0], event_id=e, file=f if home is None else home)
            held = held[len(batch) :]
        if held:
            self._ask(held[0][0])


def gathered_files(points: DataFrame, ts: str = "ts", width: int = 5, step: int = 3600, late: str = "1 hour", most: int = 5) -> DataFrame:
    """(id, event_id, file) of a stream (id, event_id, file, ts): rows of an id move to the first file of its batch of ``width`` files, ``step`` seconds apart.

    A batch begins with the first file after the batch before; files beyond it begin the next one. A batch of more than ``most`` files stays where it is. Files may come late
    by less than ``late`` and more than once. What a batch holds is kept in state and leaves it when the watermark passes the batch's end. Needs the RocksDB state store.
    """
    rows = points.select(F.col("id").cast("string").alias("id"), F.col("event_id").cast("long").alias("event_id"), F.col("file").cast("long").alias("file"), ts).withWatermark(ts, late)
    return rows.groupBy("id").transformWithState(_Gathered(width, step, most), "id string, event_id long, file long", "append", "eventtime")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there, once, and ends; a rerun goes on where this one ended."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
