"""The message data source, the SQL table function and the stateful stream against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from skyloom.functions import sql_tables
from skyloom.operators import trajectory
from skyloom.sources import grids
from skyloom.streaming import twins


def grid(spark):
    rows = [(n, lv, h, 40.0 + i, -5.0 + j, float(i * j + lv + h) if (i + j) % 5 else None) for n in ("u", "v") for lv in (250, 500) for h in (0, 3600, 7200) for i in range(3) for j in range(4)]
    return rows, spark.createDataFrame(rows, grids.SCHEMA)


def test_grid_messages_are_written_and_read_pruned(spark, tmp_path):
    key, path = "spark.sql.python.filterPushdown.enabled", str(tmp_path / "grid")
    rows, df = grid(spark)
    grids.write_grid(df, path)
    assert sorted(map(tuple, grids.read_grid(spark, path).collect()), key=str) == sorted(rows, key=str)
    assert len(list(grids.headers(path))) == 12
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        some = grids.read_grid(spark, path).filter("name = 'u' and level in (250) and hour >= 3600 and value > 260")
        assert some.rdd.getNumPartitions() == 2  # of 12 messages
        want = [r for r in rows if r[0] == "u" and r[1] == 250 and r[2] >= 3600 and r[5] is not None and r[5] > 260]
        assert sorted(map(tuple, some.collect())) == sorted(want)
        # tests that were pushed are gone from the plan, the one on values stays
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "> 260" in plan and "= u)" not in plan and ">= 3600" not in plan and "250" not in plan.replace("> 250", "")
        assert grids.read_grid(spark, path).filter("name = 'nothing'").collect() == []
    finally:
        spark.conf.set(key, before)
    grids.write_grid(df.filter("name = 'v'"), path)
    assert grids.read_grid(spark, path).count() == 72
    grids.write_grid(df.filter("name = 'u'"), path, mode="append")
    assert grids.read_grid(spark, path).count() == 144


def test_grid_reader_takes_only_its_own_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull, LessThanOrEqual

    reader = grids.PruningReader("nowhere")
    rest = list(reader.pushFilters([EqualTo(("name",), "u"), GreaterThan(("value",), 3.0), LessThanOrEqual(("hour",), 7200), IsNull(("name",))]))
    assert rest == [GreaterThan(("value",), 3.0), IsNull(("name",))]
    assert reader.wanted({"name": "u", "hour": 0, "level": None}) and not reader.wanted({"name": None, "hour": 0}) and not reader.wanted({"name": "u", "hour": 9999})


def flight(rng, i, n):
    rows, lat, lon, hdg = [], 45.0, 5.0, 90.0
    for k in range(n):
        hdg += rng.choice([0.0] * 9 + [40.0])
        lat, lon = lat + rng.random() * 0.1, lon + rng.random() * 0.1
        rows.append((i * 1000 + k, i, 60.0 * k, lat, lon, hdg % 360, min(9000.0, 300.0 * k)))
    return rows


def test_change_points_from_sql(spark):
    rng = random.Random(3)
    rows = [r for i in range(4) for r in flight(rng, i, 60)] + [(9000, 9, 0.0, 1.0, 1.0, 0.0, None)]
    points = spark.createDataFrame(rows, "event_id long, id int, t double, lat double, lon double, hdg double, alt double")
    want = set()
    turns = trajectory.turns_and_rises(points)
    for kind in ("tp", "dp"):
        want |= {(int(r.id), kind, r.k, r.waypoint_time, r.waypoint_lat) for r in trajectory.waypoints(turns, kind).collect()}
    sql_tables.register(spark)
    trajectory.drift_heading(points.dropna()).withColumn("more", F.lit("x")).createOrReplaceTempView("flown")
    got = spark.sql("SELECT * FROM change_points(TABLE(flown) PARTITION BY id ORDER BY (t, event_id))")
    assert dict(got.dtypes)["id"] == "int"
    assert {(r.id, r.kind, r.k, r.time, r.lat) for r in got.collect()} == want
    with pytest.raises(Exception, match="misses hdg_comp"):
        spark.sql("SELECT * FROM change_points(TABLE(SELECT 1 AS id, 1.0 AS t, 1.0 AS lat, 1.0 AS lon, 1.0 AS alt, 1.0 AS vel) PARTITION BY id)")


def greedy(rows, width=5, step=3600, most=5):
    """Batches of files of each id: the first file and those within its width."""
    out, by = set(), {}
    for i, e, f in set(rows):
        by.setdefault(i, []).append((f, e))
    for i, held in by.items():
        held.sort()
        while held:
            first = held[0][0]
            batch = [x for x in held if x[0] < first + width * step]
            home = first if len({f for f, _ in batch}) <= most else None
            out |= {(i, e, f if home is None else home) for f, e in batch}
            held = held[len(batch) :]
    return out


@pytest.mark.parametrize("most", [5, 3])
def test_stream_of_files_gathers_rows_in_the_first_file(spark, tmp_path, most):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng = random.Random(1)
        step, rows = 3600, []
        for e in range(200):
            rows.append((f"f{rng.randrange(12)}", e, (480_000 + rng.randrange(14)) * step))
        hours = sorted({f for *_, f in rows})
        order = hours[:]
        order[3], order[4] = order[4], order[3]  # one comes late
        src = tmp_path / "in"
        schema = "id string, event_id long, file long, ts timestamp"
        for k, h in enumerate([*order[:5], order[2], *order[5:], 480_040 * step]):  # one comes again, a far one closes the rest
            own = [r for r in rows if r[2] == h] or [("close", 9999, h)]
            df = spark.createDataFrame([(i, e, f) for i, e, f in own], "id string, event_id long, file long").withColumn("ts", F.timestamp_seconds("file"))
            df.coalesce(1).write.mode("append").parquet(str(src / f"{k:02d}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src / "*"))
        q = twins.gathered_files(stream, late="2 hours", most=most).writeStream.format("memory").queryName(f"gathered{most}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        got = [tuple(r) for r in spark.table(f"gathered{most}").collect()]
        assert set(got) == greedy(rows, most=most) and len(got) == len(set(got))
    finally:
        spark.conf.set(provider, before)
