"""Traffic counts in space-time-altitude cells: fractional occupancy, peak concurrency, re-aggregation.

Legs are clipped natively: a leg is exploded to its windows, its crossings of grid lines become a sorted
array of positions along the leg, and consecutive positions become pieces whose midpoint names the cell.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Altitude bands in metres, lower bound included.
TRENCHES = ((7315.2, 8839.2), (8839.2, 10668.0), (10668.0, 21243.0))


@dataclass(frozen=True)
class Grid:
    lat: tuple[float, float] = (30.0, 72.0)
    lon: tuple[float, float] = (-15.0, 40.0)
    cell: float = 0.25
    window: float = 900.0
    trenches: tuple[tuple[float, float], ...] = TRENCHES


def _lines(a: str, b: str, low: float, high: float, cell: float) -> Column:
    """Positions along a leg at which a coordinate crosses lattice lines strictly between its ends."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    # lattice lines low + k*cell up to the first that reaches high
    last = int(-(-(high + cell - low) // cell)) - 1
    k0 = F.greatest(F.floor((lo - low) / cell), F.lit(0)).cast("int")
    k1 = F.least(F.ceil((hi - low) / cell), F.lit(last)).cast("int")
    at = lambda k: F.lit(low) + k * F.lit(cell)
    inside = F.filter(F.sequence(k0, k1), lambda k: (lo < at(k)) & (at(k) < hi))
    cross = F.transform(inside, lambda k: (at(k) - F.col(a)) / (F.col(b) - F.col(a)))
    return F.when((F.col(a) != F.col(b)) & (k1 >= k0), cross).otherwise(F.expr("cast(array() as array<double>)"))


def _bands(a: str, b: str, trenches: tuple) -> Column:
    bounds = F.array(*[F.lit(float(x)) for t in trenches for x in t])
    inside = F.filter(bounds, lambda x: (x - F.col(a)) * (x - F.col(b)) < 0)
    return F.when(F.col(a) != F.col(b), F.transform(inside, lambda x: (x - F.col(a)) / (F.col(b) - F.col(a)))).otherwise(F.expr("cast(array() as array<double>)"))


def _along(c: str, share: Column) -> Column:
    """A coordinate at a share of the leg."""
    return F.col(f"from_{c}") + share * (F.col(f"to_{c}") - F.col(f"from_{c}"))


def _meets_bands(a: Column, b: Column, trenches: tuple) -> Column:
    """Whether altitudes between a and b may lie in a band; the margin is more than any rounding between them."""
    margin = (F.abs(a) + F.abs(b)) * 1e-9 + 1e-6
    low, high = F.least(a, b) - margin, F.greatest(a, b) + margin
    return reduce(lambda x, y: x | y, [(low < hi) & (high >= lo) for lo, hi in trenches])


def pieces(legs: DataFrame, grid: Grid = Grid()) -> DataFrame:  # noqa: B008
    """(id, window_start, trench, lat_idx, lon_idx, t0, t1): the parts of legs inside one cell and window."""
    w = F.lit(grid.window)
    # most legs fly below the bands: they and their windows go before they are cut into pieces
    legs = legs.filter((F.col("to_time") > F.col("from_time")) & _meets_bands(F.col("from_alt"), F.col("to_alt"), grid.trenches))
    dur = F.col("to_time") - F.col("from_time")
    first, last = F.floor(F.col("from_time") / w), F.ceil(F.col("to_time") / w) - 1
    cross = F.concat(_lines("from_lat", "to_lat", *grid.lat, grid.cell), _lines("from_lon", "to_lon", *grid.lon, grid.cell), _bands("from_alt", "to_alt", grid.trenches))
    rows = legs.select("*", dur.alias("dur"), cross.alias("cross"), F.explode(F.sequence(first, F.greatest(first, last))).alias("k"))
    start = F.col("k") * w
    rows = rows.withColumns({"window_start": start.cast("long"), "a": (F.greatest("from_time", start) - F.col("from_time")) / F.col("dur"), "b": (F.least(F.col("to_time"), start + w) - F.col("from_time")) / F.col("dur")}).filter("b > a")
    rows = rows.filter(_meets_bands(_along("alt", F.col("a")), _along("alt", F.col("b")), grid.trenches))
    taus = F.array_sort(F.array_distinct(F.concat(F.array("a", "b"), F.filter("cross", lambda x: (F.col("a") < x) & (x < F.col("b"))))))
    rows = rows.withColumn("taus", taus).withColumn("p", F.explode(F.zip_with(F.slice("taus", 1, F.size("taus") - 1), F.slice("taus", 2, F.size("taus") - 1), lambda x, y: F.struct(x.alias("a"), y.alias("b")))))
    mid = (F.col("p.a") + F.col("p.b")) / 2.0
    rows = rows.select("id", "window_start", "from_time", "dur", "p", *[_along(c, mid).alias(c) for c in ("lat", "lon", "alt")])
    trench = None
    for i, (lo, hi) in enumerate(grid.trenches):
        cond = (F.col("alt") >= lo) & (F.col("alt") < hi)
        trench = F.when(cond, i) if trench is None else trench.when(cond, i)
    rows = rows.filter(F.col("lat").between(*grid.lat) & F.col("lon").between(*grid.lon)).withColumn("trench", trench).filter("trench is not null")
    idx = lambda c, low: F.floor((F.col(c) - F.lit(low)) / F.lit(grid.cell)).cast("int")
    return rows.select("id", "window_start", "trench", idx("lat", grid.lat[0]).alias("lat_idx"), idx("lon", grid.lon[0]).alias("lon_idx"), (F.col("from_time") + F.col("p.a") * F.col("dur")).alias("t0"), (F.col("from_time") + F.col("p.b") * F.col("dur")).alias("t1"))


CELL = ["window_start", "trench", "lat_idx", "lon_idx"]


def fractional(legs: DataFrame, grid: Grid = Grid()) -> DataFrame:  # noqa: B008
    """Seconds in each cell over the window's length."""
    return pieces(legs, grid).groupBy(*CELL).agg((F.sum(F.col("t1") - F.col("t0")) / grid.window).alias("weight"))


def union_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of touching intervals (t0, t1) of each key."""
    w = Window.partitionBy(*keys).orderBy("t0", "t1")
    reach = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("t0") > reach).cast("int"), F.lit(1))
    rows = df.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "_g").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("_g")


def peak(legs: DataFrame, grid: Grid = Grid()) -> DataFrame:  # noqa: B008
    """The largest number of flights at one time in each cell; one that leaves as another enters doesn't count with it."""
    each = union_intervals(pieces(legs, grid), [*CELL, "id"])
    events = each.select(*CELL, F.explode(F.array(F.struct(F.col("t0").alias("t"), F.lit(1).alias("d")), F.struct(F.col("t1").alias("t"), F.lit(-1).alias("d")))).alias("e")).select(*CELL, "e.t", "e.d")
    w = Window.partitionBy(*CELL).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("n", F.sum("d").over(w)).groupBy(*CELL).agg(F.max("n").alias("max_count"))


def reaggregate(counts: DataFrame, window: float, cell: float, fine: Grid = Grid()) -> DataFrame:  # noqa: B008
    """Sums cells inside the same fine window, then takes the largest fine window of each coarse one."""
    idx = lambda c: F.floor((F.col(c) + 0.5) * fine.cell / F.lit(float(cell))).cast("int").alias(c)
    coarse = (F.floor(F.col("window_start") / F.lit(float(window))) * F.lit(float(window))).cast("long")
    rows = counts.select(coarse.alias("coarse"), "window_start", "trench", idx("lat_idx"), idx("lon_idx"), "max_count")
    sums = rows.groupBy("coarse", "window_start", "trench", "lat_idx", "lon_idx").agg(F.sum("max_count").alias("s"))
    return sums.groupBy(F.col("coarse").alias("window_start"), "trench", "lat_idx", "lon_idx").agg(F.max("s").alias("max_count"))


def _meets(start: Column, end: Column) -> Column:
    f, t = F.col("from_time"), F.col("to_time")
    return ((f >= start) & (f < end)) | ((t > start) & (t <= end)) | ((f < start) & (t > end))


def in_window(legs: DataFrame, start: float, end: float) -> DataFrame:
    """Legs that start in, end in or span a window."""
    return legs.filter(_meets(F.lit(start), F.lit(end)))


def window_flights(legs: DataFrame, width: int, first: int, count: int) -> DataFrame:
    """(window_start, flights, n) of ``count`` windows from ``first``: each leg goes to the windows it touches, so they meet without a range join."""
    number = lambda t: F.floor((F.col(t) - first) / width)
    rows = legs.withColumn("_k", F.explode(F.sequence(number("from_time"), number("to_time")))).filter(F.col("_k").between(0, count - 1))
    start = F.col("_k") * width + first
    return rows.filter(_meets(start, start + width)).groupBy(start.alias("window_start")).agg(F.countDistinct("id").alias("flights"), F.count("*").alias("n"))


def dense_grid(counts: DataFrame, window_start: int, trench: int, grid: Grid = Grid()) -> DataFrame:  # noqa: B008
    """All cells of one window and trench, zero where nothing was counted."""
    spark = counts.sparkSession
    n = lambda lo, hi: int(-(-(hi - lo) // grid.cell))
    cells = spark.range(n(*grid.lat)).select(F.col("id").cast("int").alias("lat_idx")).crossJoin(spark.range(n(*grid.lon)).select(F.col("id").cast("int").alias("lon_idx")))
    one = counts.filter((F.col("window_start") == window_start) & (F.col("trench") == trench)).select("lat_idx", "lon_idx", "max_count")
    return cells.join(one, ["lat_idx", "lon_idx"], "left").withColumn("max_count", F.coalesce("max_count", F.lit(0)))
