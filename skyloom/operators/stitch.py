"""Stitching hourly or daily files into whole flights: snapshots, catalogues, continuity, gathering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_snapshot(points: DataFrame, bucket_s: float = 60.0, keys: list[str] | None = None) -> DataFrame:
    """Rows at the largest time of their time bucket (and keys, if any): a grouped maximum joined back, so one bucket may hold any share of the rows."""
    b = points.withColumn("_b", F.floor(F.col("t") / bucket_s))
    by = ["_b", *(keys or [])]
    top = b.groupBy(*by).agg(F.max("t").alias("t"))
    return b.join(top, [*by, "t"], "left_semi").drop("_b")


def fresh_in_box(points: DataFrame, lat: tuple[float, float] = (30.0, 72.0), lon: tuple[float, float] = (-15.0, 40.0), max_age_s: float | None = None) -> DataFrame:
    """Rows in a box, and seen not longer ago than ``max_age_s`` (needs ``lastcontact``)."""
    cond = F.col("lat").between(*lat) & F.col("lon").between(*lon)
    if max_age_s is not None:
        cond &= F.col("t") - F.col("lastcontact") <= max_age_s
    return points.filter(cond)


def catalogue(points: DataFrame, file: Column) -> DataFrame:
    """(id, files): the sorted distinct files of each id. A flight has few files."""
    return points.select("id", file.alias("file")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("file")).alias("files"))


def session_files(points: DataFrame, file: Column, gap_s: int, separator: str = "|") -> DataFrame:
    """(instance, from_file, to_file, files): an id's files cut where more than ``gap_s`` lies between two; those of one file count as well."""
    days = points.select("id", file.alias("file")).distinct()
    w = Window.partitionBy("id").orderBy("file")
    cut = days.withColumn("_new", F.coalesce(F.col("file") - F.lag("file").over(w) > gap_s, F.lit(False)).cast("int"))
    cut = cut.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = cut.groupBy("id", "_k").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return out.select(F.concat(F.col("id").cast("string"), F.lit(separator), F.get("files", F.lit(0)).cast("string")).alias("instance"), F.get("files", F.lit(0)).alias("from_file"), F.element_at("files", -1).alias("to_file"), "files")


def day_flights(points: DataFrame, file: Column, step: int, first: int, last: int) -> DataFrame:
    """The points of the flights of a day's files, in one pass: catalogue, unbroken ids, ids that touch the day, their rows, sorted by id and time.

    A flight belongs to the day of its first file; its rows of later files come along.
    """
    placed = points.withColumn("file", file)
    cat = consecutive_only(catalogue(placed, F.col("file")), step)
    own = cat.filter(F.get("files", F.lit(0)).between(first, last))
    return by_flight(gathered(placed, own).drop("file"))


def by_flight(points: DataFrame) -> DataFrame:
    """Points dealt by flight and sorted by flight and time inside each part, as a flight's steps need them; no global sort."""
    return points.repartition("id").sortWithinPartitions("id", "t")


def first_files(cat: DataFrame, k: int = 5) -> DataFrame:
    return cat.withColumn("files", F.slice("files", 1, k))


def inverted(cat: DataFrame) -> DataFrame:
    """(file, id) from (id, files)."""
    return cat.select(F.explode("files").alias("file"), "id")


def listed(files: Column, file: Column) -> Column:
    return F.array_contains(files, file)


def consecutive_only(cat: DataFrame, step: int = 3600, at_most: bool = False) -> DataFrame:
    """Ids whose files follow one another at exactly ``step``, or at no more than it."""
    gaps = F.zip_with(F.slice("files", 2, F.greatest(F.size("files") - 1, F.lit(0))), F.slice("files", 1, F.greatest(F.size("files") - 1, F.lit(0))), lambda a, b: a - b)
    return cat.filter(F.forall(gaps, lambda g: g <= step if at_most else g == step))


def truncated(cat: DataFrame, gap: int = 4000, least: int = 2) -> DataFrame:
    """Files up to the first gap larger than ``gap``; ids with fewer than ``least`` files left are dropped."""

    def step(acc: Column, f: Column) -> Column:
        last = F.try_element_at(acc["out"], F.lit(-1))
        open_ = acc["open"] & (last.isNull() | (f - last <= gap))
        return F.struct(F.when(open_, F.concat(acc["out"], F.array(f))).otherwise(acc["out"]).alias("out"), open_.alias("open"))

    kind = cat.schema["files"].dataType.simpleString()
    zero = F.struct(F.expr(f"cast(array() as {kind})").alias("out"), F.lit(True).alias("open"))
    cut = cat.withColumn("files", F.aggregate("files", zero, step, lambda a: a["out"]))
    return cut.filter(F.size("files") >= least)


def across_days(cat: DataFrame, day_s: int = 86_400) -> DataFrame:
    """Joins the files of an id on day d with those on day d+1 if it is in the last file slot of d and the first of d+1. cat: id, day, files, last, first."""
    nxt = cat.filter("starts").select("id", (F.col("day") - day_s).alias("day"), F.col("files").alias("more"))
    joined = cat.filter("ends").join(nxt, ["id", "day"])
    return cat.join(joined.select("id", "day", "more"), ["id", "day"], "left").withColumn("files", F.when(F.col("more").isNotNull(), F.concat("files", "more")).otherwise(F.col("files"))).drop("more")


def day_catalogue(points: DataFrame, slot_s: int = 3600, day_s: int = 86_400) -> DataFrame:
    """(id, day, files, starts, ends): the sorted files of each id and day; whether they hold the first and the last file that the day has at all."""
    stamp = lambda w: (F.floor(F.col("t") / w) * w).cast("long")
    placed = points.select("id", stamp(day_s).alias("day"), stamp(slot_s).alias("file")).distinct()
    bounds = placed.groupBy("day").agg(F.min("file").alias("_first"), F.max("file").alias("_last"))
    cat = placed.groupBy("id", "day").agg(F.array_sort(F.collect_list("file")).alias("files"))
    marked = cat.join(bounds, "day").withColumns({"starts": F.array_contains("files", F.col("_first")), "ends": F.array_contains("files", F.col("_last"))})
    return marked.select("id", "day", "files", "starts", "ends")


def full_days(points: DataFrame, slot_s: int = 3600, day_s: int = 86_400, gap: int = 4000, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """The flights of each day in one pass, those that go on past midnight included: their catalogue (id, day, files), and their points with the day.

    A day's files of an id are joined with the next day's where it is in the last file of the one and the first of the other, cut at the first gap larger than
    ``gap``, and dropped if fewer than ``least`` are left. Points come dealt and sorted by flight.
    """
    cat = truncated(across_days(day_catalogue(points, slot_s, day_s), day_s), gap, least).select("id", "day", "files")
    placed = points.withColumn("file", (F.floor(F.col("t") / slot_s) * slot_s).cast("long"))
    rows = placed.join(cat.select("id", "day", F.explode("files").alias("file")), ["id", "file"])
    return cat, rows.repartition("id").sortWithinPartitions("id", "day", "t")


def gathered(points: DataFrame, cat: DataFrame) -> DataFrame:
    """Points (id, file, ...) of the files that the catalogue lists for their id."""
    return points.join(cat.select("id", F.explode("files").alias("file")), ["id", "file"], "left_semi")


def remapped(points: DataFrame, instances: DataFrame) -> DataFrame:
    """Points get the instance id of (base_id, file) from instances (instance, base_id, files)."""
    flat = instances.select("instance", F.col("base_id").alias("id"), F.explode("files").alias("file"))
    return points.join(flat, ["id", "file"])


def relocated(points: DataFrame, cat: DataFrame, most: int = 5) -> DataFrame:
    """All rows of an id move to its first file, if it has no more than ``most`` files."""
    home = cat.filter(F.size("files") <= most).select("id", F.array_min("files").alias("_home"))
    return points.join(home, "id", "left").withColumn("file", F.coalesce("_home", "file")).drop("_home")


def split_by_files(cat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids with one file, ids with several."""
    return cat.filter(F.size("files") == 1), cat.filter(F.size("files") > 1)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def sample_ids(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """``n`` ids, the same for the same seed."""
    return df.select(id_col).distinct().orderBy(_draw([id_col], seed), id_col).limit(n)


def sample_per_file(df: DataFrame, n: int, file: str = "file", seed: int = 42, id_col: str = "id") -> DataFrame:
    """(file, id): ``n`` ids of each file, or all it has; the same for the same seed."""
    w = Window.partitionBy(file).orderBy(_draw([file, id_col], seed), id_col)
    return df.select(file, id_col).distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def _draw(keys: list[str], seed: int) -> Column:
    """A draw of the keys' values, as hexadecimal digits; null is a value of its own."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys], F.lit(str(seed))).cast("binary"))


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """``n`` rows by a hash of their keys: the same for the same seed."""
    return df.orderBy(_draw(keys, seed), *keys).limit(n)


def bernoulli(df: DataFrame, share: float, keys: list[str], seed: int = 42) -> DataFrame:
    """Each row with a probability, by a hash of its keys."""
    return df.filter(F.conv(F.substring(_draw(keys, seed), 1, 8), 16, 10).cast("long") < int(share * 2**32))


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bag_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left bag without a match on the right; repeats stay."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of values in [low, high] by even bins, the last one closed."""
    inside = df.filter(F.col(col).between(low, high))
    b = F.least(F.floor((F.col(col) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return inside.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """Every combination of the given lists, one column each."""
    out = spark.range(1).select()
    for name, xs in values.items():
        out = out.select("*", F.explode(F.array(*[F.lit(x) for x in xs])).alias(name))
    return out


def hour_range(low: Column | int, high: Column | int, step: int = 3600) -> Column:
    """Stamps from low to high, high included even where the steps miss it."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    low, high = low.cast("long"), high.cast("long")
    return F.array_distinct(F.concat(F.sequence(low, high, F.lit(step).cast("long")), F.array(high)))


def day_range(low: Column, high: Column, days: int = 1) -> Column:
    """Days from low to high, both included; every seventh with ``days=7``."""
    return F.sequence(low, high, F.expr(f"interval {days} day"))


def gap_audit(stamps: DataFrame, step: int, keys: list[str]) -> DataFrame:
    """Consecutive stamps (ts) of a series that aren't ``step`` apart."""
    w = Window.partitionBy(*keys).orderBy("ts")
    return stamps.withColumn("prev", F.lag("ts").over(w)).withColumn("gap", F.col("ts") - F.col("prev")).filter(F.col("gap") != step)
