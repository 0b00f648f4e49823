import math

import pytest
from pyspark.sql import functions as F

from latewise import functions as L


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_processing_bins_are_right_closed(spark):
    got = column(spark, [-5, -1, 0, 1, 2, 3, 6, 7, None], "int", L.processing_bin)
    assert got == [None, None, "0_days", "1_2_days", "1_2_days", "3_4_days", "5_6_days", "7_plus_days", None]


def test_price_ranges(spark):
    assert column(spark, [0.0, 50.0, 50.01, 500.01], "double", L.price_range) == [None, "Very_Low", "Low", "Very_High"]


def test_days_are_floored(spark):
    df = spark.sql("SELECT timestamp_ntz'2020-01-02 12:00:00' a, timestamp_ntz'2020-01-02 00:00:00' b")
    row = df.select(L.whole_days_between(F.col("a"), F.col("b")), L.whole_days_between(F.col("b"), F.col("a"))).first()
    assert tuple(row) == (-1, 0)


def test_guarded_ratio(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -1.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(L.guarded_ratio(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0, 0.0]


def distances(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double, c double, d double")
    ends = [F.col(c) for c in "abcd"]
    return df.select("i", L.geodesic_km(*ends).alias("g"), L.haversine_km(*ends).alias("h")).orderBy("i").collect()


def vincenty(lat1, lon1, lat2, lon2):
    """Iterative inverse solution on the same ellipsoid, for comparison."""
    a, f = 6378.137, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    big_l = lam = math.radians(lon2 - lon1)
    for _ in range(200):
        sin_s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        s = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        cos2_a = 1 - sin_a**2
        c2m = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2_a if cos2_a else 0
        c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
        new = big_l + (1 - c) * f * sin_a * (s + c * sin_s * (c2m + c * cos_s * (2 * c2m**2 - 1)))
        if abs(new - lam) < 1e-13:
            break
        lam = new
    u_2 = cos2_a * (a**2 - b**2) / b**2
    big_a = 1 + u_2 / 16384 * (4096 + u_2 * (-768 + u_2 * (320 - 175 * u_2)))
    big_b = u_2 / 1024 * (256 + u_2 * (-128 + u_2 * (74 - 47 * u_2)))
    ds = big_b * sin_s * (c2m + big_b / 4 * (cos_s * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * sin_s**2 - 3) * (4 * c2m**2 - 3)))
    return b * big_a * (s - ds)


def test_geodesic_against_iterative_solution(spark):
    pairs = [(10.0, 20.0, 30.0, 60.0), (-33.9, 18.4, 51.5, -0.1), (0.0, 0.0, 0.0, 80.0), (45.0, 170.0, 44.0, -170.0)]
    for pair, row in zip(pairs, distances(spark, pairs)):
        assert row["g"] == pytest.approx(vincenty(*pair), abs=0.05)
        assert row["h"] == pytest.approx(row["g"], rel=0.006)


def test_distance_edges(spark):
    rows = distances(spark, [
        (12.5, 7.0, 12.5, 7.0), (90.0, 0.0, -90.0, 0.0), (0.0, 0.0, 0.0, 180.0), (None, 0.0, 1.0, 1.0), (91.0, 0.0, 1.0, 1.0),
    ])
    assert rows[0]["g"] == 0 and rows[0]["h"] == 0
    assert rows[1]["g"] == pytest.approx(20003.93, abs=0.1)
    assert rows[2]["g"] > 19_900
    assert [r["g"] for r in rows[3:]] == [None, None] and [r["h"] for r in rows[3:]] == [None, None]


def test_softmax_argmax_normalize(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "z array<double>")
    row = df.select(L.softmax(F.col("z")).alias("p"), L.argmax(F.col("z")).alias("k")).first()
    assert sum(row["p"]) == pytest.approx(1) and row["k"] == 1
    df = spark.createDataFrame([([0.25],), ([1.0, 1.0],)], "p array<double>")
    got = [r[0] for r in df.select(L.normalize_probs(F.col("p"))).collect()]
    assert got[0] == pytest.approx([0.75, 0.25]) and got[1] == pytest.approx([0.5, 0.5])
    kept = spark.createDataFrame([([1.0, 2.0, 1.0],)], "p array<double>").select(L.normalize_probs(F.col("p"), [0, 2])).first()[0]
    assert kept == pytest.approx([0.25, 0.25])


def test_tail_of_the_f_distribution(spark):
    from latewise.functions.stats import f_tail, log_gamma

    # Tabled critical values, and closed forms: (1 + f d1 / d2) ** (-d2 / 2) for d1 = 2.
    rows = [(4.9646, 1.0, 10.0, 0.05), (3.4928, 2.0, 20.0, 0.05), (3.6990, 5.0, 30.0, 0.01), (1.0, 7.0, 7.0, 0.5),
            (0.0, 1.0, 5.0, 1.0), (math.inf, 1.0, 5.0, 0.0), (3.8415, 1.0, 1e6, 0.05), (1e4, 1.0, 50_000.0, 0.0)]
    rows += [(f, 2.0, d, (1 + 2 * f / d) ** (-d / 2)) for f in (0.01, 0.5, 2.0, 30.0) for d in (1.0, 5.0, 400.0, 60_000.0)]
    df = spark.createDataFrame(rows, "f double, a double, b double, p double")
    for r in df.select("p", f_tail(F.col("f"), F.col("a"), F.col("b")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-5)
    odd = spark.createDataFrame([(math.nan, 1.0, 5.0), (1.0, 0.0, 5.0), (1.0, 1.0, 0.0)], "f double, a double, b double")
    got = [r[0] for r in odd.select(f_tail(F.col("f"), F.col("a"), F.col("b"))).collect()]
    assert math.isnan(got[0]) and got[1:] == [None, None]
    xs = [0.5, 1.0, 3.7, 250.0, 30_000.5]
    gammas = spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x"))).collect()
    assert [g[0] for g in gammas] == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12)
