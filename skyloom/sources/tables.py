"""Readers and writers: typed scans, provenance from paths, idempotent and chunked sinks, written intermediates."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _S = T.DoubleType(), T.StringType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STATE_VECTORS = _schema(time=_D, icao24=_S, lat=_D, lon=_D, heading=_D, callsign=_S, geoaltitude=_D)
TRAJECTORY = _schema(time=_D, icao24=_S, lat=_D, lon=_D, heading=_D, callsign=_S, geoaltitude=_D, id=_S)
SEGMENTS = _schema(id=_S, **{f"{e}_{c}": _D for c in ("time", "lat", "lon", "alt", "speed") for e in ("from", "to")})
AIRPORTS = _schema(country_code=_S, region_name=_S, iata=_S, icao=_S, airport=_S, latitude=_D, longitude=_D)
AIRLINES = _schema(Name=_S, IATA=_S, ICAO=_S, Callsign=_S, Country=_S, Active=_S)
WEATHER = _schema(ts=T.LongType(), latitude=_D, longitude=_D, cape=_D, cin=_D, u_wind=_D, v_wind=_D)

_END = "struct<iataCode:string,terminal:string,gate:string,delay:int,scheduledTime:string,actualTime:string>"
FLIGHT_JSON = f"type string, status string, airline struct<name:string,iataCode:string>, flight struct<number:string,iataNumber:string>, codeshared struct<airline:struct<name:string,iataCode:string>>, departure {_END}, arrival {_END}"
ROUTE_PLAN_JSON = "fromICAO string, toICAO string, fromName string, toName string, distance double, maxAltitude double, waypoints int, route struct<nodes:array<struct<type:string,ident:string,lat:double,lon:double,alt:double>>>, _corrupt_record string"


POINT = "struct<time:double,lat:double,lon:double,alt:double,vel:double>"
TURN_AND_RISE = f"id string, landed boolean, tp array<{POINT}>, dp array<{POINT}>"


def _files(spark: SparkSession, **options: str):
    return spark.read.options(recursiveFileLookup="true", **options)


def read_headerless(spark: SparkSession, path: str, schema: T.StructType = STATE_VECTORS, glob: str = "*.csv*", without: list[str] | None = None) -> DataFrame:
    """Typed CSV without a header, at any depth, gzip or plain; hidden files are skipped, and so are files of the names ``without``."""
    rows = _files(spark, pathGlobFilter=glob).schema(schema).csv(path, header=False)
    return rows.filter(~F.col("_metadata.file_name").isin(without)) if without else rows


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of Parquet files at any depth; columns that are missing are null, others stay away."""
    return _files(spark).schema(SEGMENTS).parquet(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns and rises, a row a flight, as ``trajectory.turns_and_rises`` gives them; raises if there are none."""
    rows = _files(spark).schema(TURN_AND_RISE).parquet(path)
    if rows.isEmpty():
        raise ValueError(f"no flights below {path}")
    return rows


def read_renamed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header whose names are replaced."""
    return _files(spark).schema(schema).csv(path, header=True, enforceSchema=True)


def read_header(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = _files(spark)
    return (r.schema(schema) if schema else r).csv(path, header=True)


def read_detecting_header(spark: SparkSession, path: str, schema: T.StructType, need: str = "time") -> DataFrame:
    """With a header if the first line names the expected column, else without."""
    first = _files(spark).text(path).limit(1).collect()
    has = bool(first) and need in first[0][0].replace('"', "").split(",")
    return _files(spark).schema(schema).csv(path, header=has)


def file_stamp(path: Column | None = None) -> Column:
    """The hour stamp in a file's name."""
    return F.regexp_extract(F.col("_metadata.file_path") if path is None else path, r"(\d+)\.csv(\.gz)?$", 1).cast("long")


def file_day(path: Column | None = None) -> Column:
    """The date folder of a file."""
    return F.to_date(F.regexp_extract(F.col("_metadata.file_path") if path is None else path, r"/(\d{4}-\d{2}-\d{2})/[^/]+$", 1))


def day_folder(stamp: Column) -> Column:
    """The date folder of a Unix time, in UTC whatever the session's zone is."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(stamp / 86_400).cast("int")), "yyyy-MM-dd")


def folder_start(folder: Column) -> Column:
    """The Unix time at which the day of a date folder begins, in UTC."""
    return F.datediff(F.to_date(folder), F.lit("1970-01-01").cast("date")).cast("long") * 86_400


def paired_files(flows: DataFrame, segments: DataFrame) -> DataFrame:
    """(prefix, flow, segment) of file names; fails if a flow has no or several segment files of its prefix."""
    key = lambda df, c: df.select(F.substring_index("name", "_", 2).alias("prefix"), F.col("name").alias(c))
    found = key(flows, "flow").join(key(segments, "segment").groupBy("prefix").agg(F.collect_set("segment").alias("s")), "prefix", "left")
    one = F.when(F.size(F.coalesce("s", F.array())) == 1, F.get("s", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not exactly one segment file for "), F.col("flow"))).cast("string"))
    return found.select("prefix", "flow", one.alias("segment"))


def flat_flights(flights: DataFrame, *keep: str) -> DataFrame:
    """Schedule rows of flight JSON: codes in upper case, times parsed, absent parts null; ``keep``: other columns that stay."""
    t = lambda c: F.expr(f"try_to_timestamp(upper({c}))").cast("timestamp_ntz")
    up = lambda c: F.upper(F.col(c))
    return flights.select(
        *keep, "type", "status", up("flight.iataNumber").alias("iata_number"), up("airline.iataCode").alias("airline_iata"), up("codeshared.airline.iataCode").alias("codeshare_iata"),
        up("departure.iataCode").alias("departure_airport"), t("departure.scheduledTime").alias("scheduled_departure"), t("departure.actualTime").alias("actual_departure"),
        up("arrival.iataCode").alias("arrival_airport"), t("arrival.scheduledTime").alias("scheduled_arrival"), t("arrival.actualTime").alias("actual_arrival"),
    )


def read_flights(spark: SparkSession, path: str) -> DataFrame:
    """Flight JSON files, one object or a list each."""
    return flat_flights(spark.read.schema(FLIGHT_JSON).json(path, multiLine=True))


def route_nodes(plans: DataFrame) -> DataFrame:
    """One row a node of each plan; coordinates to 8 decimals, halves to even."""
    rows = plans.select("fromICAO", "toICAO", F.posexplode("route.nodes").alias("k", "n"))
    return rows.select("fromICAO", "toICAO", "k", "n.type", "n.ident", *[F.bround(f"n.{c}", 8).alias(c) for c in ("lat", "lon", "alt")])


def route_metadata(plans: DataFrame) -> DataFrame:
    return plans.select("fromICAO", "toICAO", "fromName", "toName", "distance", "maxAltitude", "waypoints")


def read_route_plans(spark: SparkSession, path: str) -> DataFrame:
    """The first plan of each file; files that can't be parsed are left out and stay where they are."""
    rows = spark.read.schema(ROUTE_PLAN_JSON).json(path, multiLine=True, mode="PERMISSIVE").withColumn("_file", F.col("_metadata.file_path"))
    first = rows.withColumn("_k", F.monotonically_increasing_id()).filter("_corrupt_record is null and fromICAO is not null")
    return first.groupBy("_file").agg(F.min_by(F.struct(*[c for c in rows.columns if not c.startswith("_")]), "_k").alias("p")).select("p.*")


def read_lines(spark: SparkSession, text: str) -> DataFrame:
    """Polylines as text, one a line: lists of (lon, lat)."""
    import ast

    rows = [(i, [(float(x), float(y)) for x, y in ast.literal_eval(line)]) for i, line in enumerate(x for x in text.splitlines() if x.strip())]
    return spark.createDataFrame(rows, "flow_id int, line array<struct<lon:double,lat:double>>")


def parse_config(text: str) -> dict:
    """The simple YAML of configurations and labels: ``key: value`` and lists of scalars."""
    out: dict = {}
    key = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip():
            continue
        if line.lstrip().startswith("- ") and key is not None:
            out.setdefault(key, [])
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(_scalar(line.lstrip()[2:]))
        elif ":" in line:
            key, _, value = line.partition(":")
            key = key.strip().strip("'\"")
            out[key] = _scalar(value.strip()) if value.strip() else []
    return out


def _scalar(x: str):
    x = x.strip()
    if x[:1] in "'\"":
        return x[1:-1]
    try:
        return json.loads(x)
    except ValueError:
        return x


def read_labels(spark: SparkSession, text: str) -> DataFrame:
    """(segment, label) of a label file; admitted segments without a label have null."""
    c = parse_config(text)
    named = dict(zip(c.get("labelled_indices", []), c.get("label", []), strict=False))
    rows = [(int(i), named.get(i)) for i in dict.fromkeys([*c.get("admitted_indices", []), *named])]
    return spark.createDataFrame([(i, None if x is None else str(x)) for i, x in rows], "segment long, label string")


# ---------------------------------------------------------------- sinks


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_plain_csv(df: DataFrame, path: str) -> None:
    """Without quotes, commas escaped."""
    df.write.mode("overwrite").option("quote", "\u0000").option("escape", "\\").csv(path, header=True)


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    """Only the partitions that ``df`` holds are replaced, so a rerun changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What earlier runs haven't written."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def dense_ranks(df: DataFrame, col: str) -> DataFrame:
    """(value, rank): every distinct value of ``col`` and its place in their order, from 0, nulls first; no task sorts more than its range.

    Ranges of values are numbered where they lie; what comes before a range is a sum over a row for each range.
    """
    ordered = df.select(F.col(col).alias("value")).distinct().repartitionByRange("value").sortWithinPartitions("value")
    own = written(ordered.select("value", F.monotonically_increasing_id().alias("m")), "ranks")
    part, place = F.shiftrightunsigned("m", 33), F.col("m").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for p, n in sorted(own.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, before))
        before += n
    base = df.sparkSession.createDataFrame(offsets, "p long, base long")
    return own.withColumn("p", part).join(F.broadcast(base), "p").select("value", (F.col("base") + place).alias("rank"))


def chunked(df: DataFrame, ids: int, id_col: str = "id") -> DataFrame:
    """Adds ``chunk``: exactly ``ids`` whole ids each in the order of ids, the last one the rest."""
    rank = dense_ranks(df, id_col).select(F.col("value").alias("_id"), F.floor(F.col("rank") / ids).alias("chunk"))
    return df.join(rank, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")


def write_id_lists(df: DataFrame, path: str, by: str, id_col: str = "id") -> None:
    """A text file of ids, trimmed and in lower case, for each value of ``by``."""
    df.select(by, F.lower(F.trim(id_col)).alias("value")).distinct().write.mode("overwrite").partitionBy(by).text(path)


def write_lines(df: DataFrame, path: str, line: str = "line") -> None:
    """Ordered lines as text files, in the order of ``df``."""
    df.select(line).write.mode("overwrite").text(path)


def label_yaml(df: DataFrame) -> DataFrame:
    """(value): label rows (segment, label) as the lines of a label file, in order: all segments, then the labelled ones, then their labels; numbers are plain."""
    part = lambda no, title: df.sparkSession.createDataFrame([(no, None, 0, f"{title}:")], "part int, segment long, k int, value string")
    line = lambda no, value, rows: rows.select(F.lit(no).alias("part"), F.col("segment").cast("long"), F.lit(1).alias("k"), F.concat(F.lit("- "), value).alias("value"))
    named = df.filter("label is not null")
    quoted = F.concat(F.lit("'"), F.col("label"), F.lit("'"))
    lines = part(0, "admitted_indices").unionByName(line(0, F.col("segment").cast("string"), df))
    lines = lines.unionByName(part(1, "labelled_indices")).unionByName(line(1, F.col("segment").cast("string"), named))
    lines = lines.unionByName(part(2, "label")).unionByName(line(2, quoted, named))
    return lines.orderBy("part", "k", "segment").select("value")


def label_json(df: DataFrame) -> DataFrame:
    """Label rows (segment, label) as one JSON line each."""
    return df.select(F.to_json(F.struct("segment", "label")).alias("value"))


# ---------------------------------------------------------------- written intermediates

#: Folder of this session's written tables, by session.
_FOLDERS: weakref.WeakKeyDictionary[SparkSession, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session under ``spark.checkpoint.dir``, removed at exit.

    Where that is unset, a cluster gets a folder in the warehouse (shared as well) and local mode,
    as in tests, a temporary one.
    """
    if spark not in _FOLDERS:
        get = lambda k: spark.conf.get(k, None) or spark.sparkContext.getConf().get(k, None)
        top = get("spark.checkpoint.dir")
        if not top and (get("spark.master") or "").startswith("local["):
            top = tempfile.mkdtemp(prefix="skyloom-")
        elif not top:
            top = f"{get('spark.sql.warehouse.dir')}/_tables"
        _FOLDERS[spark] = f"{top.rstrip('/')}/skyloom-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[spark])
    return _FOLDERS[spark]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # at exit the JVM may be gone already
        return


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skyloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables made by :func:`written` that nothing lazy reads any more."""
    for t in tables:
        if path := getattr(t, "_skyloom_path", None):
            _remove(t.sparkSession, path)
