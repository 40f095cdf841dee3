"""Scalar functions: identifiers, attenuation, waiting-time densities, formats."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KMS_TO_KNOTS = 1943.844
SHORT_KM, LONG_KM = 1500.0, 4000.0


def haul_type(km: Column) -> Column:
    """Haul by distance; a negative distance means that an airport is unknown."""
    return F.when(km < SHORT_KM, "short_haul").when(km < LONG_KM, "medium_haul").otherwise("long_haul")


@dataclass(frozen=True)
class Tail:
    """Threshold, decay and plateau of an attenuation."""

    tau: float = 0.1
    alpha: float = 15.0
    x0: float = 1.0


def tdf(x: Column, p: Tail = Tail()) -> Column:  # noqa: B008
    """Threshold decay: the plateau up to tau, then exponential decay."""
    return F.when(x <= p.tau, p.x0).otherwise(p.x0 * F.exp(-p.alpha * (x - p.tau)))


def dsa(x: Column, threshold: float, slow: float, fast: float) -> Column:
    """Double-slope attenuation: one rate of decay up to the threshold, another beyond, without a jump."""
    return F.when(x <= threshold, F.exp(-slow * x)).otherwise(math.exp(-slow * threshold) * F.exp(-fast * (x - threshold)))


@dataclass(frozen=True)
class Wait:
    """Shifted gamma density of a connection time in hours, with the prior weight of its kind."""

    shape: float
    scale: float
    loc: float
    weight: float


# By (arrival is long haul, departure is long haul).
WAITS = {
    (False, False): Wait(1.96, 0.17857142857142858, 0.65, 0.8),
    (False, True): Wait(2.56, 0.15625, 1.85, 0.2),
    (True, False): Wait(4.45679012345679, 0.10657894736842105, 1.25, 0.4),
    (True, True): Wait(4.0, 0.25, 2.25, 0.6),
}


def gamma_params(low: Column, high: Column, loc: Column) -> tuple[Column, Column]:
    """Shape and scale of a shifted gamma whose mean is midway between ``low`` and ``high``, each one standard deviation off."""
    mean, dev = (low + high) / 2 - loc, (high - low) / 2
    return mean * mean / (dev * dev), dev * dev / mean


def log_wait(hours: Column, w: Wait) -> Column:
    """Log of weight times density; null where the density is 0."""
    z = (hours - w.loc) / w.scale
    fixed = math.log(w.weight) - math.lgamma(w.shape) - math.log(w.scale)
    return F.when(z > 0, fixed + (w.shape - 1) * F.ln(z) - z)


def log_wait_of(hours: float, w: Wait) -> float:
    """:func:`log_wait` of a number; nan where the density is 0."""
    z = (hours - w.loc) / w.scale
    return math.log(w.weight) - math.lgamma(w.shape) - math.log(w.scale) + (w.shape - 1) * math.log(z) - z if z > 0 else math.nan


def connection_log_score(hours: Column, arrival_long: Column, departure_long: Column) -> Column:
    out = None
    for (a, d), w in WAITS.items():
        cond = (arrival_long == a) & (departure_long == d)
        out = F.when(cond, log_wait(hours, w)) if out is None else out.when(cond, log_wait(hours, w))
    return out


def dms(deg: Column, keep_sign: bool = False) -> Column:
    """Degrees'minutes'seconds. Seconds round half to even; a sign in front of 0 degrees is lost unless kept."""
    a = F.abs(deg)
    d = F.floor(a)
    minutes = (a - d) * 60
    m = F.floor(minutes)
    s = F.bround((minutes - m) * 60, 0).cast("int")
    m2 = m + (s >= 60).cast("int")
    d2 = (d + (m2 >= 60).cast("int")).cast("int")
    m2, s = F.when(m2 >= 60, m2 - 60).otherwise(m2).cast("int"), F.when(s >= 60, s - 60).otherwise(s)
    whole = F.when((deg < 0) & (d2 == 0), F.lit("-0" if keep_sign else "0")).otherwise(F.when(deg < 0, -d2).otherwise(d2).cast("string"))
    return F.concat_ws("'", whole, m2, s)


def fixed2(x: Column) -> Column:
    """Two decimals, without grouping."""
    return F.format_string("%.2f", x)


def window_start(t: Column, width: float) -> Column:
    return F.floor(t / width) * F.lit(float(width))


def flight_id(icao24: Column, callsign: Column, form: str = "clean") -> Column:
    """A flight's id of aircraft and callsign; null if either is null.

    ``clean``: both in upper case, the callsign trimmed. ``craft_first`` and ``call_first`` join them as they are,
    ``underscored`` puts the callsign first with an underscore.
    """
    forms = {"clean": (F.upper(icao24), F.upper(F.trim(callsign))), "craft_first": (icao24, callsign), "call_first": (callsign, icao24), "underscored": (callsign, F.lit("_"), icao24)}
    return F.concat(*forms[form])


def window_range(no: Column, width: float, first: float = 0.0) -> tuple[Column, Column]:
    """Start and end of the window of a number, from ``first``."""
    start = no * F.lit(float(width)) + F.lit(float(first))
    return start, start + F.lit(float(width))


def stable_id(*parts: Column, length: int = 10) -> Column:
    """A short id that depends on its parts only, so a task that runs again gives it again."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, length)


def rounded(x: Column, digits: int) -> Column:
    """``x`` to ``digits`` decimals as C and SQL engines round doubles: its product with the power of ten, halves away from zero.

    Spark's own ``round`` goes by the shortest decimal text of a double, so a value just under a half goes up.
    """
    scale = F.lit(10.0**digits)
    y = F.abs(x) * scale
    whole = F.rint(y)
    return F.signum(x) * (whole + F.when(y - whole == 0.5, 1.0).otherwise(0.0)) / scale + F.lit(0.0)
