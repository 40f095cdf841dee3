"""Geodesy and plane geometry as native columns; degrees in, unless a name says otherwise."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean earth radius: of the leg and haul formulas, of the speed cleaner, and in metres.
R_KM, R_CLEAN_KM, R_M = 6371.0, 6371.0088, 6371000.0
#: Great-circle step over which the drift of a constant course is taken.
DRIFT_STEP_KM = 10.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = R_KM) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(1.0) - a, F.lit(0.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course from the first point to the second, in [0, 360)."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of a reference point (equirectangular)."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * R_M, F.radians(lat - lat0) * R_M


def wrap180(deg: Column) -> Column:
    """An angle in [-180, 180)."""
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def drift_rate(lat: Column, lon: Column, course: Column) -> Column:
    """Degrees by which the course along a great circle turns, a kilometre: closed form over a 10 km step."""
    d, p, c = DRIFT_STEP_KM / R_KM, F.radians(lat), F.radians(course)
    later = F.atan2(F.sin(c) * F.cos(p), math.cos(d) * F.cos(c) * F.cos(p) - math.sin(d) * F.sin(p))
    return wrap180(F.degrees(later) - course) / DRIFT_STEP_KM


@dataclass(frozen=True)
class Vec:
    """Three columns as a vector."""

    x: Column
    y: Column
    z: Column

    def __sub__(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))


def unit(lat: Column, lon: Column) -> Vec:
    """The point on the unit sphere."""
    p, q = F.radians(lat), F.radians(lon)
    return Vec(F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))


#: What each segment contributes to a comparison, worked out once a segment: ends in radians and as unit vectors, plane normal, lengths.
FEATURES = ("la0", "lo0", "la1", "lo1", "x0", "y0", "z0", "x1", "y1", "z1", "nx", "ny", "nz", "normal", "chord", "length")


def with_features(segments: DataFrame, p: str = "") -> DataFrame:
    """Adds :data:`FEATURES` of segments (from_lat, from_lon, to_lat, to_lon with prefix p) as columns ``<p>_<feature>``."""
    c = lambda n: F.col(f"{p}_{n}")
    df = segments.withColumns({f"{p}_{k}{e}": F.radians(F.col(f"{p}{end}_{n}")) for e, end in enumerate(("from", "to")) for k, n in (("la", "lat"), ("lo", "lon"))})
    df = df.withColumns({f"{p}_{k}{e}": v for e in (0, 1) for k, v in (("x", F.cos(c(f"la{e}")) * F.cos(c(f"lo{e}"))), ("y", F.cos(c(f"la{e}")) * F.sin(c(f"lo{e}"))), ("z", F.sin(c(f"la{e}"))))})
    a, b = (Vec(c(f"x{e}"), c(f"y{e}"), c(f"z{e}")) for e in (0, 1))
    n = a.cross(b)
    df = df.withColumns({f"{p}_nx": n.x, f"{p}_ny": n.y, f"{p}_nz": n.z, f"{p}_chord": (b - a).norm(), f"{p}_length": F.sqrt(F.pow(c("la0") - c("la1"), 2) + F.pow(c("lo0") - c("lo1"), 2))})
    return df.withColumn(f"{p}_normal", Vec(c("nx"), c("ny"), c("nz")).norm())


def _dot(v: list[np.ndarray], w: list[np.ndarray]) -> np.ndarray:
    return v[0] * w[0] + v[1] * w[1] + v[2] * w[2]


def _left(px, py, qx, qy, rx, ry) -> np.ndarray:
    return (qx - px) * (ry - py) - (qy - py) * (rx - px) > 0


Features = dict[str, np.ndarray]


def cosines(s: Features, t: Features) -> np.ndarray:
    """Cosine between the great-circle planes of first and second segments; nan where there is none."""
    with np.errstate(all="ignore"):
        lengths = s["normal"] * t["normal"]
        return np.where(lengths == 0, np.nan, _dot(*([g[n] for n in ("nx", "ny", "nz")] for g in (s, t))) / lengths)


def places(s: Features, t: Features) -> tuple[np.ndarray, np.ndarray]:
    """Overlap and separation of first and second segments; nan where there is none."""
    f = (s, t)
    at = [[[g[f"{x}{e}"] for x in "xyz"] for e in (0, 1)] for g in f]
    minus = lambda v, w: [x - y for x, y in zip(v, w, strict=True)]
    own = minus(at[0][1], at[0][0])
    between = [minus(at[1][j], at[0][i]) for i in (0, 1) for j in (0, 1)]
    vectors = [own, *between, minus(at[1][1], at[1][0])]
    sizes = [s["chord"], *(np.sqrt(_dot(v, v)) for v in between), t["chord"]]
    with np.errstate(all="ignore"):
        # of equally long chords the first counts, as with the first maximum of a distance table
        longest = reduce(np.maximum, sizes)
        projected = np.select([n == longest for n in sizes], [np.abs(_dot(v, own)) for v in vectors], np.nan)
        projected = np.where(s["chord"] == 0, np.nan, projected / s["chord"])
        both = s["chord"] + t["chord"]
        overlap = np.where(both == 0, np.nan, projected / both)
        # where on a segment the other's ends fall
        near = []
        for p, q in ((t, s), (s, t)):
            dx, dy = p["la1"] - p["la0"], p["lo1"] - p["lo0"]
            size = dx * dx + dy * dy
            for e in (0, 1):
                ex, ey = q[f"la{e}"] - p["la0"], q[f"lo{e}"] - p["lo0"]
                u = np.minimum(np.maximum(np.where(size == 0, 0.0, (ex * dx + ey * dy) / size), 0.0), 1.0)
                x, y = ex - u * dx, ey - u * dy
                near.append(x * x + y * y)
        (ax, ay, bx, by), (cx, cy, dx, dy) = ([g[n] for n in ("la0", "lo0", "la1", "lo1")] for g in f)
        cross = (_left(ax, ay, cx, cy, dx, dy) != _left(bx, by, cx, cy, dx, dy)) & (_left(ax, ay, bx, by, cx, cy) != _left(ax, ay, bx, by, dx, dy))
        separation = np.where(cross, 0.0, np.sqrt(reduce(np.minimum, near)))
    return overlap, separation


def _terms(*columns: pd.Series) -> pd.DataFrame:
    """cosine, overlap and separation of the features of first and then of second segments; nan where there is none."""
    s, t = (dict(zip(FEATURES, (x.to_numpy(float) for x in columns[k : k + len(FEATURES)]), strict=True)) for k in (0, len(FEATURES)))
    overlap, separation = places(s, t)
    return pd.DataFrame({"cosine": cosines(s, t), "overlap": overlap, "separation": separation})


def with_terms(pairs: DataFrame, s: str, t: str) -> DataFrame:
    """Adds cosine, overlap and separation of segments with features under the prefixes s and t.

    cosine: between the great-circle planes, its sign telling whether they flow the same way. overlap: length of the longest chord between
    the four ends, projected on the first segment, over both chord lengths. separation: least plane distance in radians of (lat, lon); 0 if they cross.
    The steps are worked out on Arrow batches. The function counts as not deterministic, as a filter on a
    term would else work it out twice.
    """
    kinds = "cosine double, overlap double, separation double"
    terms = F.pandas_udf(_terms, kinds).asNondeterministic()(*[F.col(f"{p}_{n}").cast("double") for p in (s, t) for n in FEATURES])
    kept = pairs.columns
    return pairs.withColumn("_terms", terms).select(*kept, "_terms.cosine", "_terms.overlap", "_terms.separation")


def chord(p: str = "") -> Column:
    return (unit(F.col(f"{p}to_lat"), F.col(f"{p}to_lon")) - unit(F.col(f"{p}from_lat"), F.col(f"{p}from_lon"))).norm()


def _c_track(lat1: float, lon1: float, lat2: float, lon2: float) -> tuple[float, float, float]:
    """Course, length in metres and cosine of the first latitude, by the C library's functions."""
    p1, p2, d = (v * (math.pi / 180.0) for v in (lat1, lat2, lon2 - lon1))
    near, far = math.cos(p1), math.cos(p2)
    course = math.atan2(math.sin(d) * far, near * math.sin(p2) - math.sin(p1) * far * math.cos(d)) * (180.0 / math.pi)
    a = math.pow(math.sin((p2 - p1) / 2), 2.0) + near * far * math.pow(math.sin(d / 2), 2.0)
    length = 2.0 * R_M * math.atan2(math.sqrt(a), math.sqrt(max(1.0 - a, 0.0)))
    return math.fmod(math.fmod(course, 360.0) + 360.0, 360.0), length, near


def _c_tracks(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
    rows = zip(*(c.astype(float).tolist() for c in (lat1, lon1, lat2, lon2)), strict=True)
    sound = [_c_track(*r) if all(map(math.isfinite, r)) else (None, None, None) for r in rows]
    return pd.DataFrame(sound, columns=["course", "length", "cosine"], dtype=float)


def c_track(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Course, length in metres and cosine of the first latitude of a track, as a struct; null where an end has no place.

    The JVM's sines differ from the C library's in the last bit. Routes are ranked by sums of scores, many of which are equal but for that bit, so
    what is worked out once a leg and once an edge comes from the C library, and the order is that of engines that use it.
    """
    return F.pandas_udf(_c_tracks, "course double, length double, cosine double")(lat1, lon1, lat2, lon2)


def leg_features(legs: DataFrame) -> DataFrame:
    """Adds what a leg contributes to its fitness to any edge: course and length in metres."""
    df = legs.withColumn("_track", c_track(*[F.col(f"{e}_{x}") for e in ("from", "to") for x in ("lat", "lon")]))
    return df.withColumns({"_course": F.col("_track.course"), "_own": F.col("_track.length")}).drop("_track")


def edge_features(edges: DataFrame) -> DataFrame:
    """Adds what an edge contributes: course, length in metres and direction from its start, the cosine of the latitude there."""
    e = [F.col(f"e{e}_{x}") for e in ("from", "to") for x in ("lat", "lon")]
    df = edges.withColumn("_track", c_track(*e))
    df = df.withColumns({"_ecourse": F.col("_track.course"), "_ecos": F.col("_track.cosine"), "_ey": F.radians(e[2] - e[0]) * R_M})
    df = df.withColumn("_ex", F.radians(e[3] - e[1]) * F.col("_ecos") * R_M).drop("_track")
    return df.withColumn("_len", F.sqrt(F.col("_ex") * F.col("_ex") + F.col("_ey") * F.col("_ey")))


def with_fitness(pairs: DataFrame) -> DataFrame:
    """Adds ``first`` and ``rest``: how well a leg (from_/to_ columns) follows an edge (efrom_/eto_ columns), in [0, 1].

    Both weigh orientation and overlap, ``first`` for the leg that begins a route. Features of legs and edges come from
    :func:`leg_features` and :func:`edge_features`, before the pairs are made, or are added here.
    """
    df = pairs if "_course" in pairs.columns else leg_features(pairs)
    df = df if "_ecourse" in df.columns else edge_features(df)
    c = F.col
    x = lambda p: F.radians(c(f"{p}_lon") - c("efrom_lon")) * c("_ecos") * R_M
    y = lambda p: F.radians(c(f"{p}_lat") - c("efrom_lat")) * R_M
    along = lambda p: F.try_divide(x(p) * c("_ex") + y(p) * c("_ey"), c("_len"))
    df = df.withColumns({"_s": along("from"), "_t": along("to"), "_turn": F.abs(c("_course") - c("_ecourse"))})
    covered = F.greatest(F.lit(0.0), F.least(c("_len"), F.greatest("_s", "_t")) - F.greatest(F.lit(0.0), F.least("_s", "_t")))
    df = df.withColumns({"_orient": F.greatest(F.lit(0.0), 1.0 - F.least(c("_turn"), 360.0 - c("_turn")) / 90.0), "_share": F.least(covered / (c("_own") + 1e-6), F.lit(1.0))})
    score = lambda w, v: F.when(c("_len") == 0, 0.0).otherwise(w * c("_orient") + v * c("_share"))
    kept = [k for k in pairs.columns if k not in ("_course", "_own", "_ecourse", "_ex", "_ey", "_ecos", "_len")]
    return df.withColumns({"first": score(0.8, 0.2), "rest": score(0.5, 0.5)}).select(*kept, "first", "rest")


def inside(ring: list[tuple[float, float]], lon: Column, lat: Column) -> Column:
    """Whether a point lies strictly inside a closed ring of (lon, lat), by ray casting; the ring's box is tested first."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys))
    crossings = None
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        hit = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1)
        crossings = hit.cast("int") if crossings is None else crossings + hit.cast("int")
    return F.coalesce(box & (crossings % 2 == 1), F.lit(False))
