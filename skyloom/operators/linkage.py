"""Schedule linkage: schedules, haul types, codeshares, connection scores, assignment, tail numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, scalars
from ..sources.tables import written
from . import kernels

#: What an arrival without a departure costs, and the longest connection in hours.
SLACK, LONGEST_H = 2000.0, 8
#: Tasks over which the parts of an assignment by time are spread.
PART_TASKS = 128
#: Keys over which rows that match nothing are spread.
NULL_KEYS = 4096


def union_schedule(arrivals: DataFrame, departures: DataFrame) -> DataFrame:
    """Both movements in one table with their time and airport, and the codeshare's airline filled with the operating one."""
    rows = arrivals.withColumn("type", F.lit("arrival")).unionByName(departures.withColumn("type", F.lit("departure")))
    arrival = F.col("type") == "arrival"
    rows = rows.withColumn("codeshare_iata", F.coalesce("codeshare_iata", "airline_iata"))
    return rows.withColumn("time", F.when(arrival, F.col("scheduled_arrival")).otherwise(F.col("scheduled_departure"))).withColumn("airport", F.when(arrival, F.col("arrival_airport")).otherwise(F.col("departure_airport")))


def with_haul(schedule: DataFrame, airports: DataFrame, order: str | None = None) -> DataFrame:
    """distance and haul_type from airports (iata, lat, lon); an unknown airport gives -1 and short haul, unknown coordinates null and long haul.

    Of an airport's rows the first by ``order`` counts, in a file's order where it names none.
    The lookup is a plain left join: Catalyst broadcasts it where the dimension's size allows.
    """
    key = F.upper(F.trim("iata"))
    no = F.monotonically_increasing_id() if order is None else F.col(order)
    dim = airports.select(key.alias("k"), "lat", "lon", no.alias("_no")).groupBy("k").agg(F.min_by(F.struct("lat", "lon"), "_no").alias("at"))
    end = lambda p: dim.select(F.col("k").alias(f"{p}_airport"), F.col("at").alias(f"_{p}"))
    rows = schedule.join(end("departure"), "departure_airport", "left").join(end("arrival"), "arrival_airport", "left")
    km = geo.haversine(F.col("_departure.lat"), F.col("_departure.lon"), F.col("_arrival.lat"), F.col("_arrival.lon"))
    km = F.when(F.col("_departure").isNull() | F.col("_arrival").isNull(), -1.0).otherwise(km)
    return rows.withColumn("distance", km).withColumn("haul_type", scalars.haul_type(F.col("distance"))).drop("_departure", "_arrival")


def airline_codes(schedule: DataFrame, airlines: DataFrame, order: str) -> DataFrame:
    """airline_icao and callsign of flights (airline_iata in lower case, iata_number) from airlines (iata, icao).

    Airlines without either code don't count; of an airline code's rows the last by ``order`` does. The callsign is the ICAO code and
    the flight number without its first two characters; both are null for an unknown airline.
    """
    sound = airlines.filter(F.col("iata").isNotNull() & F.col("icao").isNotNull())
    dim = sound.groupBy(F.lower("iata").alias("airline_iata")).agg(F.max_by("icao", order).alias("airline_icao"))
    rows = schedule.join(dim, "airline_iata", "left")
    return rows.withColumn("callsign", F.concat("airline_icao", F.expr("substring(iata_number, 3)")))


def ordered_schedule(rows: DataFrame) -> DataFrame:
    """By time, airport and flight number, nulls last: a range-partitioned sort."""
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in ("time", "airport", "iata_number")])


def schedule_hours(rows: DataFrame, tail_h: int = 5) -> DataFrame:
    """(hour): the hour stamps from the first movement's hour to ``tail_h`` hours after the last one's."""
    hour = lambda t: F.date_trunc("hour", t)
    ends = rows.agg(F.min("time").alias("a"), F.max("time").alias("b")).filter("a is not null")
    seconds = lambda t: F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))
    return ends.select(F.explode(F.sequence(seconds(hour(F.col("a"))), seconds(hour(F.col("b"))) + tail_h * 3600, F.lit(3600).cast("long"))).alias("hour"))


def codes_in_use(schedule: DataFrame) -> DataFrame:
    """(code): every airport that flights leave or reach, once."""
    return schedule.select(F.col("departure_airport").alias("code")).union(schedule.select("arrival_airport")).distinct()


def codeshare_key(code: Column, dep: Column, arr: Column, sched_dep: Column, sched_arr: Column) -> Column:
    """The concatenated key: null if a code or airport is null, ``nan`` for a missing time."""
    text = lambda t: F.coalesce(t.cast("string"), F.lit("nan"))
    return F.concat(code, F.lit("_"), dep, F.lit("_"), arr, F.lit("_"), text(sched_dep), F.lit("_"), text(sched_arr))


def collapse_codeshares(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key by the columns ``order``; all rows without a key are one group, of which tasks send one row each."""
    names = rows.columns
    first = rows.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*names), F.struct(*order)).alias("r"))
    return first.select("r.*")


def connection_candidates(arrivals: DataFrame, departures: DataFrame, keys: list[str], longest_h: int = LONGEST_H) -> DataFrame:
    """Pairs (a_key, d_key) of equal keys whose departure is 1 to ``longest_h``-1 whole hours after the arrival.

    The hour joins the keys: a departure is looked for in the hour buckets that can hold it, so a hot
    airport costs the pairs that are near in time, not all of them.
    """
    span = longest_h * 3600
    a = arrivals.withColumn("_b", F.explode(F.array(F.floor(F.col("a_t") / span), F.floor(F.col("a_t") / span) + 1)))
    d = departures.withColumn("_b", F.floor(F.col("d_t") / span))
    h = F.floor((F.col("d_t") - F.col("a_t")) / 3600.0)
    return a.join(d, [*keys, "_b"]).withColumn("hours", h).filter((F.col("hours") > 0) & (F.col("hours") < longest_h)).drop("_b")


def connection_scores(candidates: DataFrame) -> DataFrame:
    """Adds score, the log of prior times density of the whole hours; pairs with density 0 are infeasible and go."""
    score = scalars.connection_log_score(F.col("hours").cast("double"), F.col("a_long"), F.col("d_long"))
    return candidates.withColumn("score", score).filter(F.col("score").isNotNull())


def likeliest(scores: DataFrame) -> DataFrame:
    """(a_key, d_key): each arrival's departure of the highest score, of equal ones the smallest.

    Whole hours give few scores, so tasks keep a departure for each score of an arrival, and pairs are neither shuffled nor sorted.
    """
    each = scores.groupBy("a_key", "score").agg(F.min("d_key").alias("d_key"))
    return each.groupBy("a_key").agg(F.max_by("d_key", "score").alias("d_key"))


def assign(scores: DataFrame, keys: list[str], slack: float = SLACK) -> DataFrame:
    """The best one-to-one assignment (a_key, d_key) of each group: as many as feasible, then the highest scores.

    Rows that share an arrival or a departure are connected; connected parts are labelled on Spark, and each is solved by itself, so a
    group spreads over as many tasks as it has parts. A part holds its pairs, never a matrix. Of repeated pairs the best score counts.
    """
    from .graph import components

    cols = [*keys, "a_key", "d_key", "score"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scores.select(*cols).schema)
    node = lambda side: F.xxhash64(*keys, F.lit(side), f"{side}_key")
    pairs = written(scores.filter(F.col("score").isNotNull() & (F.col("score") + slack > 0)).select(*cols, node("a").alias("_a"), node("d").alias("_d")), "scores")
    part = components(pairs.select(F.col("_a").alias("a"), F.col("_d").alias("b")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # nodes are hashes: should two groups share one, each is solved for itself
        out = []
        for _, own in pdf.groupby(keys, dropna=False, sort=False):
            a, rows = np.unique(own["a_key"], return_inverse=True)
            d, columns = np.unique(own["d_key"], return_inverse=True)
            value = own["score"].to_numpy()
            found = kernels.sparse_matching(rows, columns, value + slack)
            out.append(pd.DataFrame({"a_key": a[rows[found]], "d_key": d[columns[found]], "score": value[found], **{k: own[k].iloc[0] for k in keys}})[cols])
        return pd.concat(out)

    labelled = pairs.join(part, F.col("_a") == F.col("node")).select("label", *cols)
    return labelled.groupBy("label").applyInPandas(lambda pdf: run(pdf), schema)


def assign_by_time(arrivals: DataFrame, departures: DataFrame, keys: list[str], slack: float = SLACK, longest_h: int = LONGEST_H) -> DataFrame:
    """:func:`assign` of the scored candidates of arrivals (a_key, a_t, a_long) and departures (d_key, d_t, d_long), without making their pairs.

    A group is cut where no connection spans a moment, and each part is solved in a task on its rows: a score depends on whole hours and kinds alone, so the
    pairs of an arrival are a stretch of the departures by time. Should a key come at several times in its group, all pairs are made instead.
    """
    side = lambda df, p: df.select(*keys, F.lit(p).alias("side"), F.col(f"{p}_key").alias("key"), F.col(f"{p}_t").cast("double").alias("t"), F.col(f"{p}_long").alias("long"))
    moves = side(arrivals, "a").union(side(departures, "d"))
    for c in moves.columns:
        moves = moves.filter(F.col(c).isNotNull())
    moves = written(moves.filter(~F.isnan("t")).distinct(), "movements")
    if moves.groupBy(*keys, "side", "key").count().filter("count > 1").limit(1).count():
        return assign(connection_scores(connection_candidates(arrivals, departures, keys, longest_h)), keys, slack)

    waits, hours = scalars.WAITS, range(longest_h)
    worth = np.array([[[slack + scalars.log_wait_of(h, waits[a, d]) if h else np.nan for h in hours] for d in (False, True)] for a in (False, True)])
    own = [moves.schema[k] for k in keys]
    key = moves.schema["key"].dataType.simpleString()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), f"a_key {key}, d_key {key}, a_long boolean, d_long boolean, hours long"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, d = (pdf[pdf["side"] == p].reset_index(drop=True) for p in ("a", "d"))
        x, y = kernels.timed_matching(*(z.to_numpy() for t in (a, d) for z in (t["t"], t["long"].astype(bool))), worth)
        a, d = a.iloc[x], d.iloc[y].set_index(a.index[x])
        whole = np.floor((d["t"] - a["t"]) / 3600.0).astype("int64")
        return pd.DataFrame({**{k: a[k] for k in keys}, "a_key": a["key"], "d_key": d["key"], "a_long": a["long"], "d_long": d["long"], "hours": whole})

    # a second more than the longest connection, so that rounding never parts what may connect
    w = Window.partitionBy(*keys).orderBy("t")
    until = F.max(F.when(F.col("side") == "a", F.col("t") + longest_h * 3600 + 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = moves.withColumn("_new", F.when(F.col("t") <= until, 0).otherwise(1))
    parts = cut.withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")
    found = parts.repartition(PART_TASKS, *keys, "_part").groupBy(*keys, "_part").applyInPandas(lambda pdf: run(pdf), schema)
    types = arrivals.schema["a_key"].dataType, departures.schema["d_key"].dataType
    return connection_scores(found).select(*keys, F.col("a_key").cast(types[0]).alias("a_key"), F.col("d_key").cast(types[1]).alias("d_key"), "score")


def connection_times(arrivals: DataFrame, pairs: DataFrame, departures: DataFrame) -> DataFrame:
    """Arrivals with the exact hours to their assigned departure; null if none."""
    linked = pairs.select("a_key", "d_key").join(departures.select("d_key", "d_t"), "d_key")
    return arrivals.join(linked, "a_key", "left").withColumn("connection_time", (F.col("d_t") - F.col("a_t")) / 3600.0)


def tails(sightings: DataFrame, wanted: DataFrame) -> DataFrame:
    """callsign -> address: inside a file the first sighting counts, of several files the last.

    sightings: callsign, icao24, file, row; wanted: callsign. Call signs compare trimmed, in lower case.
    """
    key = F.lower(F.trim("callsign"))
    want = wanted.select(key.alias("callsign")).distinct()
    seen = sightings.withColumn("callsign", key).join(want, "callsign", "left_semi")
    per_file = seen.groupBy("callsign", "file").agg(F.min_by("icao24", "row").alias("icao24"))
    return per_file.groupBy("callsign").agg(F.max_by("icao24", "file").alias("icao24"))


def with_tails(schedule: DataFrame, airlines: DataFrame, sightings: DataFrame, order: str) -> DataFrame:
    """Flights with airline_icao, callsign and the address that was seen under it, from airlines and sightings in one call; null where a step finds nothing.

    schedule: airline_iata in any case, iata_number; the other tables as in :func:`airline_codes` and :func:`tails`.
    """
    coded = airline_codes(schedule.withColumn("airline_iata", F.lower(F.trim("airline_iata"))), airlines, order)
    seen = tails(sightings, coded.select("callsign").filter("callsign is not null")).select(F.col("callsign").alias("_key"), "icao24")
    # flights without a call sign would all meet in one task: they get keys with a blank in front, which no trimmed call sign has
    apart = F.concat(F.lit(" "), F.monotonically_increasing_id() % NULL_KEYS)
    return coded.withColumn("_key", F.coalesce(F.lower(F.trim("callsign")), apart)).join(seen, "_key", "left").drop("_key")


def od_pairs(rows: DataFrame, dep: str, arr: str, dim: DataFrame) -> DataFrame:
    """Distinct origin-destination pairs in the dimension's second code (code, name); unknown codes are null."""
    look = lambda p, c: dim.select(F.lower(F.trim("code")).alias(f"_{p}"), F.col("name").alias(c))
    keyed = rows.withColumn("_d", F.lower(F.trim(dep))).withColumn("_a", F.lower(F.trim(arr)))
    pairs = keyed.select("_d", "_a").distinct()
    return pairs.join(look("d", "from_name"), "_d", "left").join(look("a", "to_name"), "_a", "left").select("from_name", "to_name").distinct()


def hour_histogram(rows: DataFrame, ts: Column, bins: int = 24) -> DataFrame:
    """Counts by hour of day, or finer."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return rows.groupBy(F.floor(minute * bins / 1440).cast("int").alias("bin")).agg(F.count("*").alias("n"))
