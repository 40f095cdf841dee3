"""Table functions for SQL: change points of each flight of any table, as ``FROM change_points(TABLE(t) PARTITION BY id ORDER BY (t, event_id))``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import kernels
from ..operators.trajectory import AIRBORNE_M

#: Columns that the table brings; hdg_comp and vel as ``trajectory.drift_heading`` adds them.
NEEDS = ("id", "t", "lat", "lon", "alt", "vel", "hdg_comp")


class ChangePoints:
    """(id, kind, k, time, lat, lon, alt, vel): turning points (``tp``) and altitude change points (``dp``) of a flight, from 0.

    The id has the type that the table gives it. Rows come in the order that the call names; one flight is held at a time. Rows with a null
    count nothing; a flight without rows gives none.
    """

    @staticmethod
    def analyze(points: AnalyzeArgument) -> AnalyzeResult:
        if not points.isTable:
            raise ValueError("change_points takes a table")
        have = {f.name: f.dataType for f in points.dataType}
        if missing := [c for c in NEEDS if c not in have]:
            raise ValueError(f"change_points misses {', '.join(missing)}")
        out = T.StructType([T.StructField("id", have["id"]), T.StructField("kind", T.StringType()), T.StructField("k", T.IntegerType())])
        for c in ("time", "lat", "lon", "alt", "vel"):
            out = out.add(c, T.DoubleType())
        return AnalyzeResult(out)

    def __init__(self) -> None:
        self.id, self.rows = None, []

    def eval(self, row: Row) -> None:
        values = [row[c] for c in NEEDS]
        if all(v is not None for v in values):
            self.id = values[0]
            self.rows.append([float(v) for v in values[1:]])

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        m = np.array(self.rows)
        turns, _ = kernels.turning_points(m[:, :5], m[:, 5], AIRBORNE_M)
        for kind, points in (("tp", turns), ("dp", kernels.altitude_points(m[:, :5]))):
            for k, p in enumerate(points):
                yield (self.id, kind, k, *p)


def register(spark: SparkSession) -> None:
    """Makes ``change_points`` known to the session's SQL."""
    spark.udtf.register("change_points", udtf(ChangePoints))
