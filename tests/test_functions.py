"""Scalar and geometric functions against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import geo, scalars


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


CASES = {  # ends of both segments: cosine, overlap, separation
    "identical east": ((0, 0, 0, 10), (0, 0, 0, 10), 1, 0.5, 0),
    "identical north": ((0, 0, 10, 0), (0, 0, 10, 0), 1, 0.5, 0),
    "perpendicular": ((0, 0, 0, 10), (0, 0, 1, 0), 0, 0.908918, 0),
    "adjacent": ((0, 0, 0, 10), (0, 10, 0, 20), 1, 0.992404, 0),
    "separated": ((0, 0, 0, 10), (0, 20, 0, 30), 1, 1.462250, 0.174533),
}


@pytest.mark.parametrize("name", CASES)
def test_segment_features(spark, name):
    a, b, cosine, overlap, apart = CASES[name]
    names = ("from_lat", "from_lon", "to_lat", "to_lon")
    df = spark.createDataFrame([tuple(map(float, a + b))], [f"{p}{n}" for p in ("a_", "b_") for n in names])
    row = geo.with_terms(geo.with_features(geo.with_features(df, "a_"), "b_"), "a_", "b_").first()
    assert row.cosine == pytest.approx(cosine, abs=1e-6)
    assert row.overlap == pytest.approx(overlap, abs=1e-5)
    assert row.separation == pytest.approx(apart, abs=1e-6)


def test_drift_rate(spark):
    assert one(spark, geo.drift_rate(*lit(37.7749, -122.4194, 45)))[0] == pytest.approx(0.0049359872, abs=1e-9)


def test_haversine_and_bearing(spark):
    d, b = one(spark, geo.haversine(*lit(0, 0, 0, 90)), geo.bearing(*lit(0, 0, 0, -10)))
    assert d == pytest.approx(6371 * math.pi / 2) and b == pytest.approx(270)


def test_projection_fitness(spark):
    names = ("from_lat", "from_lon", "to_lat", "to_lon")
    df = spark.createDataFrame([(50.0, 0.0, 50.0, 1.0, 50.0, 0.0, 50.0, 1.0), (50.0, 0.0, 50.0, 1.0, 50.0, 0.0, 50.0, 0.0)], [*names, *(f"e{n}" for n in names)])
    same, none = [r[0] for r in geo.with_fitness(df).select("first").collect()]
    assert same == pytest.approx(1, abs=1e-3) and none == 0


def test_connection_scores(spark):
    # log of prior times density by whole hours 1 to 7
    want = {
        (False, False): [0.202041, -4.102030, -9.169891, -14.429528, -19.778761, -25.180117, -30.615613],
        (False, True): [None, -1.104569, -4.327033, -9.750932, -15.555114, -21.525013, -27.588227],
        (True, False): [None, -1.363570, -7.817356, -15.637654, -23.948230, -32.513799, -41.236077],
        (True, True): [None, None, -0.620454, -2.078560, -4.722605, -7.792140, -11.082974],
    }
    for (a, d), values in want.items():
        df = spark.range(1, 8).select(scalars.connection_log_score(F.col("id").cast("double"), F.lit(a), F.lit(d)).alias("s"))
        for got, w in zip([r.s for r in df.collect()], values, strict=True):
            assert got == (None if w is None else pytest.approx(w, abs=1e-5))


def test_dms(spark):
    a, b, c, d = one(spark, scalars.dms(F.lit(46.17704772949219)), scalars.dms(F.lit(-0.5)), scalars.dms(F.lit(-0.5), True), scalars.dms(F.lit(9.9999)))
    assert (a, b, c, d) == ("46'10'37", "0'30'0", "-0'30'0", "10'0'0")


def test_inside_ring(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0)]
    got = one(spark, *[geo.inside(ring, *lit(x, y)) for x, y in ((5, 2), (5, 6), (1, 8), (11, 1))], geo.inside(ring, F.lit(None).cast("double"), F.lit(1.0)))
    assert list(got) == [True, False, True, False, False]


def test_attenuation(spark):
    low, high = one(spark, scalars.tdf(F.lit(0.1)), scalars.tdf(F.lit(0.2)))
    assert low == 1 and high == pytest.approx(math.exp(-1.5))
    below, above = one(spark, scalars.dsa(F.lit(0.4 - 1e-9), 0.4, 1.0, 5.0), scalars.dsa(F.lit(0.4 + 1e-9), 0.4, 1.0, 5.0))
    assert below == pytest.approx(above, abs=1e-6)


def test_gamma_parameters(spark):
    shape, scale = one(spark, *scalars.gamma_params(*lit(0.75, 1.25, 0.65)))
    assert shape == pytest.approx(1.96) and scale == pytest.approx(5 / 28)
    assert shape * scale == pytest.approx(0.35) and np.sqrt(shape) * scale == pytest.approx(0.25)


def test_flight_id(spark):
    assert one(spark, scalars.flight_id(F.lit("ab1"), F.lit(" ba12 ")))[0] == "AB1BA12"
    assert one(spark, scalars.flight_id(F.lit(None).cast("string"), F.lit("x")))[0] is None


def test_rounding_goes_by_the_product_as_sql_does(spark):
    import duckdb

    x = [-4.1859375, 1.005, 2.5, -2.5, 0.1234565, -0.0, None, 8.3e17, 484418.0921875]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select(*[scalars.rounded(F.col("x"), n).alias(f"r{n}") for n in (0, 2, 6)]).collect()
    for v, r in zip(x, rows, strict=True):
        assert tuple(r) == duckdb.execute("SELECT round(?::DOUBLE, 0), round(?::DOUBLE, 2), round(?::DOUBLE, 6)", [v] * 3).fetchall()[0]
