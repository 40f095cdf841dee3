"""Readers, sinks and streams of files."""

import gzip

import pytest
from pyspark.sql import functions as F

from skyloom.functions import scalars
from skyloom.operators import flows, linkage, scenario, stitch
from skyloom.sources import tables
from skyloom.streaming import twins


def test_plain_gzip_and_left_out_files(spark, tmp_path):
    line = "1.5,a1,50.0,4.0,90.0,CALL1,1000.0"
    for name in ("1700000000.csv", "1700003600.csv", "other.csv", "._hidden.csv"):
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / name).write_text(f"{line}\n")
    with gzip.open(tmp_path / "d" / "1700007200.csv.gz", "wt") as f:
        f.write(f"{line}\n{line}\n")
    rows = tables.read_headerless(spark, str(tmp_path), without=["other.csv"])
    assert sorted(r[0] for r in rows.select(tables.file_stamp()).collect()) == [1700000000, 1700003600, 1700007200, 1700007200]
    assert rows.first().icao24 == "a1" and rows.first().geoaltitude == 1000.0


def test_headers_renamed_or_not(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Country,Region,Code,ICAO,Name,Lat,Lon\nFR,Paris,CDG,LFPG,De Gaulle,49.0,2.5\n")
    r = tables.read_renamed(spark, str(tmp_path / "a.csv"), tables.AIRPORTS).first()
    assert (r.iata, r.icao, r.latitude) == ("CDG", "LFPG", 49.0)
    assert tables.read_header(spark, str(tmp_path / "a.csv")).columns[2] == "Code"
    assert tables.read_header(spark, str(tmp_path / "a.csv"), tables.AIRPORTS).count() == 1


def test_segments_and_turns_come_back(spark, tmp_path):
    seg = spark.createDataFrame([("f", 0.0, 60.0, "x")], "id string, from_time double, to_time double, other string")
    seg.write.parquet(str(tmp_path / "s" / "day"))
    got = tables.read_segments(spark, str(tmp_path / "s"))
    assert got.columns == tables.SEGMENTS.names and (got.first().to_time, got.first().from_alt) == (60.0, None)
    turns = spark.createDataFrame([("f", True, [(0.0, 1.0, 2.0, 3.0, 4.0)], [])], tables.TURN_AND_RISE)
    turns.write.parquet(str(tmp_path / "t"))
    assert tables.read_turns(spark, str(tmp_path / "t")).first().tp[0].alt == 3.0
    turns.limit(0).write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no flights"):
        tables.read_turns(spark, str(tmp_path / "none"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(" Ab1", "2024-01-01", 'a,"b"'), ("ab1 ", "2024-01-01", "c"), ("cd", "2024-01-02", None)], "id string, day string, x string")
    tables.write_id_lists(df, str(tmp_path / "ids"), "day")
    assert sorted(map(tuple, spark.read.text(str(tmp_path / "ids")).select("value", F.col("day").cast("string")).collect())) == [("ab1", "2024-01-01"), ("cd", "2024-01-02")]
    tables.write_plain_csv(df.select("x").filter("x is not null").coalesce(1), str(tmp_path / "plain"))
    text = "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "plain")).collect())
    assert "x\n" in text and 'a' in text and text.count("\n") == 3
    tables.write_lines(spark.range(50).orderBy("id").select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("line")).coalesce(1), str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == [f"l{k}" for k in range(50)]


def test_labels_as_yaml_come_back(spark, tmp_path):
    rows = [(7, None), (3, "north"), (5, "it is: odd # x")]
    lines = tables.label_yaml(spark.createDataFrame(rows, "segment long, label string"))
    text = "\n".join(r.value for r in lines.collect())
    assert text.splitlines()[:4] == ["admitted_indices:", "- 3", "- 5", "- 7"]
    got = {r.segment: r.label for r in tables.read_labels(spark, text.replace(" # x", "")).collect()}
    assert got == {3: "north", 5: "it is: odd", 7: None}


def test_folders_windows_and_lengths(spark):
    df = spark.createDataFrame([(0,), (86_399,), (86_400,), (1_717_200_000,), (-1,)], "s long")
    got = df.select("s", tables.day_folder(F.col("s")).alias("d")).withColumn("back", tables.folder_start(F.col("d"))).collect()
    assert [r.d for r in got] == ["1970-01-01", "1970-01-01", "1970-01-02", "2024-06-01", "1969-12-31"]
    assert all(r.back <= r.s < r.back + 86_400 for r in got)
    a, b = scalars.window_range(F.lit(3), 900.0, 100.0)
    assert spark.range(1).select(a, b).first()[:] == (2800.0, 3700.0)
    line = spark.createDataFrame([("x", 0, 0.0, 0.0), ("x", 1, 3.0, 4.0), ("x", 2, 3.0, 5.0), ("y", 0, 9.0, 9.0)], "line string, k int, lon double, lat double")
    assert [r.along for r in flows.along(line, ["line"], "k").orderBy("line", "k").collect()] == [0.0, 5.0, 6.0, 0.0]


def test_samples_by_file(spark):
    df = spark.createDataFrame([(f, f"i{k % 9}") for f in (1, 2) for k in range(30)] + [(3, "only"), (3, None)], "file int, id string")
    got = stitch.sample_per_file(df, 4).collect()
    assert {f: sum(r.file == f for r in got) for f in (1, 2, 3)} == {1: 4, 2: 4, 3: 2}
    assert sorted(map(str, got)) == sorted(map(str, stitch.sample_per_file(df.repartition(7), 4).collect()))


def streamed(spark, tmp_path, rows, twin):
    """Rows (id, second) one by one, then a far one that closes what is open; gives what the stream wrote."""
    schema = "id string, ts timestamp"
    for k, (i, t) in enumerate([*rows, ("close", 10_000_000)]):
        spark.createDataFrame([(i, t)], "id string, t long").select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    twins.run_available(twin(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(200)
    # a second run takes up nothing and closes what the first one's watermark allows
    return spark.read.parquet(str(tmp_path / "out"))


def test_streamed_sessions_are_the_batch_ones(spark, tmp_path):
    rows = [("a", 0), ("a", 3000), ("b", 100), ("a", 30_000), ("b", 12_000), ("a", 31_000)]
    got = streamed(spark, tmp_path, rows, lambda s: twins.gap_sessions(s, gap="2 hours", late="1 hour"))
    base = 1_700_000_000
    assert sorted((r.id, r.n, int(r.from_ts.timestamp()) - base, int(r.to_ts.timestamp()) - base) for r in got.collect()) == [("a", 2, 0, 3000), ("a", 2, 30_000, 31_000), ("b", 1, 100, 100), ("b", 1, 12_000, 12_000)]


def test_streamed_snapshots_keep_the_last_row_of_a_minute(spark, tmp_path):
    rows = [("a", 40), ("a", 45), ("b", 41), ("a", 105), ("a", 43)]
    got = streamed(spark, tmp_path, rows, lambda s: twins.minute_snapshots(s, late="10 minutes"))
    base = 1_700_000_000
    assert sorted((r.id, int(r.ts.timestamp()) - base) for r in got.collect()) == [("a", 45), ("a", 105), ("b", 41)]


def test_streamed_files_name_their_hours(spark, tmp_path):
    rows = [("a", 0), ("a", 3600), ("b", 7200)]
    got = streamed(spark, tmp_path, rows, lambda s: twins.sliding_files(s))
    assert max(len(r.hours) for r in got.filter("id = 'a'").collect()) == 2 and all(len(r.hours) == 1 for r in got.filter("id = 'b'").collect())


def test_csv_with_header_and_label_lines(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 0), ("s2", None), (None, 2)], "segment string, label int")
    tables.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(str, spark.read.csv(str(tmp_path / "csv"), header=True, schema="segment string, label int").collect())) == sorted(map(str, rows.collect()))
    tables.write_csv(rows.limit(0), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), schema="segment string, label int", header=True).count() == 0
    assert sorted(r.value for r in tables.label_json(rows).collect()) == ['{"label":2}', '{"segment":"s1","label":0}', '{"segment":"s2"}']


def test_ranges_of_days_and_hours(spark):
    span = spark.sql("SELECT date '2024-01-30' AS a, date '2024-02-14' AS b, 0 AS low, 9000 AS high")
    got = span.select(F.size(stitch.day_range(F.col("a"), F.col("b"))).alias("days"), stitch.day_range(F.col("a"), F.col("b"), 7).alias("weeks"), stitch.hour_range(F.col("low"), F.col("high")).alias("hours")).first()
    assert got.days == 16 and [str(d) for d in got.weeks] == ["2024-01-30", "2024-02-06", "2024-02-13"] and got.hours == [0, 3600, 7200, 9000]


def test_commands_of_short_flights_and_small_negative_degrees(spark):
    schema = "id string, callsign string, t double, event_id long, lat double, lon double, alt double, hdg double, speed double"
    points = spark.createDataFrame([("b", " B1 ", 0.0, 1, 1.5, -0.25, 100.0, 90.0, 0.1), ("a", "A1", 5.0, 3, 2.0, 3.0, 50.0, 10.0, 0.2), ("a", "other", 9.0, 4, -1.5, -0.25, 60.0, 11.0, 0.3), ("a", None, 9.0, 5, 1.0, 1.0, 70.0, 12.0, None)], schema)
    lines = lambda rows: [r.line.split(">", 1)[1] for r in rows.orderBy("id", "k", "j").collect()]
    got = lines(scenario.commands(points))
    assert got[3:] == ["A1 ADDWPT -1'30'0,0'15'0, 60.0", "A1 AT -1'30'0,0'15'0 STACK A1 VNAV ON", "A1 ADDWPT 1'0'0,1'0'0, 70.0", "CRE B1,A320,1.5,-0.25,100.0,90.0,194.38", "SPD B1 194", "ALT B1 100.0"]
    assert "A1 ADDWPT -1'30'0,-0'15'0, 60.0" in lines(scenario.commands(points, keep_sign=True))
    assert [r.line for r in scenario.scenario_lines(points.limit(0)).collect()] == ["00:00:00.00>ASAS OFF"]


def test_connection_times_of_linked_and_single_arrivals(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 1800.0), (3, None), (None, 5.0)], "a_key long, a_t double")
    d = spark.createDataFrame([(7, 7200.0), (8, 9000.0), (9, 1.0)], "d_key long, d_t double")
    pairs = spark.createDataFrame([(1, 8), (3, 7), (5, 9)], "a_key long, d_key long")
    got = {r.a_key: (r.d_key, r.connection_time) for r in linkage.connection_times(a, pairs, d).collect()}
    assert got == {1: (8, 2.5), 2: (None, None), 3: (7, None), None: (None, None)}
