import datetime as dt
import random
import time

from pyspark.sql import functions as F

from helpers import column, distance
from newsweft import session
from newsweft.functions import geo, grading, times
from newsweft.operators import geojoin


def test_dates(spark):
    base = dt.datetime(2026, 9, 18, 6, 16, 34)
    cases = {
        "Fri, 18 Sep 2026 06:16:34 GMT": base,
        "20260918T061634Z": base,
        "2026-09-18T06:16:34+00:00": base,
        "Fri, 18 Sep 2026 06:16:34 EST": base + dt.timedelta(hours=5),
        "Fri, 18 Sep 2026 06:16:34 PDT": base + dt.timedelta(hours=7),
        "Fri, 18 Sep 2026 06:16:34 +0200": base - dt.timedelta(hours=2),
        "18 Sep 2026 06:16:34": base,
        "Fri, 18 Sep 2026 06:16:34": base,
        "2026-09-18 06:16:34": base,
        "2026-09-18T06:16:34": base,
        "2026-09-18T08:16:34+02:00": base,
        "Fri, 18 Sep 2026 06:16:34 XYZ": base,
        "": None,
        "soon": None,
        "2026-13-40 06:16:34": None,
    }
    assert column(spark, list(cases), times.parse_date) == list(cases.values())


def test_first_date_reads_only_the_first_non_blank_field(spark):
    df = spark.createDataFrame([(" ", "2026-09-18 06:16:34"), ("soon", "2026-09-18 06:16:34")], "a string, b string")
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    got = [r[0] for r in df.select(times.first_date(now, F.col("a"), F.col("b"))).collect()]
    assert got == [dt.datetime(2026, 9, 18, 6, 16, 34), dt.datetime(2030, 1, 1)]


def test_ago_and_stale(spark, now):
    ages = [dt.timedelta(seconds=5), dt.timedelta(minutes=7), dt.timedelta(hours=3), dt.timedelta(days=2), dt.timedelta(seconds=-9)]
    n = F.lit(now)
    assert column(spark, [now - a for a in ages], lambda c: times.ago(n, c), "timestamp") == ["5s", "7m", "3h", "2d", "now"]
    edge = [now - dt.timedelta(hours=1440), now - dt.timedelta(hours=1440, seconds=1)]
    assert column(spark, edge, lambda c: times.is_stale(c, n), "timestamp") == [False, True]


def test_zones(spark):
    cases = {
        (49.0, 32.0): "Europe", (31.42, 34.36): "Middle East", (15.5, 32.53): "Africa", (35.86, 104.2): "Asia", (39.83, -98.58): "Americas",
        (-25.27, 133.78): "Oceania", (-0.79, 113.92): "Asia", (12.88, 121.77): "Asia", (-82.0, 20.0): "Other", (39.0, 35.24): "Middle East",
        (41.01, 28.98): "Europe", (58.0, 60.0): "Asia", (26.82, 30.8): "Africa", (20.8, -156.33): "Americas", (-21.18, -175.2): "Oceania",
        (0.0, -160.0): "Americas",
    }
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "lat double, lon double, want string")
    assert df.filter(geo.zone_of(F.col("lat"), F.col("lon")) != F.col("want")).count() == 0


def test_distance_and_windows(spark):
    pairs = [(0.0, 0.0, 0.0, 90.0), (50.45, 30.52, 49.99, 36.23), (-35.0, -71.0, 36.0, 138.0), (10.0, 10.0, 10.0, 10.0)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    for r in df.select("*", geo.distance_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("km")).collect():
        assert abs(r["km"] - distance((r["a"], r["b"]), (r["c"], r["d"]))) < 1e-6
    p = spark.createDataFrame([(80.0, 175.0, 6.5), (0.0, 0.0, 0.1), (0.0, 0.0, 99.0)], "lat double, lon double, r double")
    got = [r[0] for r in p.select(geo.view_window(F.struct("lat", "lon"), F.col("r"))).collect()]
    assert got == [[141.0, 180.0, 46.0, 85.0], [-12.0, 12.0, -12.0, 12.0], [-75.0, 75.0, -75.0, 75.0]]


def test_grid_cells_stay_inside(spark):
    df = spark.createDataFrame([(90.0, -180.0), (-90.0, 180.0), (0.0, 0.0)], "lat double, lon double")
    got = [tuple(r[0]) for r in df.select(geo.grid_cell(F.col("lat"), F.col("lon"), 36, 18)).collect()]
    assert got == [(0, 0), (35, 17), (18, 9)]


def test_grades(spark):
    df = spark.createDataFrame([(7.0, False), (4.0, True), (6.5, False), (5.0, False), (4.9, False)], "m double, t boolean")
    assert [r[0] for r in df.select(grading.severity_from_magnitude(F.col("m"), F.col("t"))).collect()] == [4, 4, 3, 2, 1]
    assert column(spark, ["Red", "orange", "GREEN", "blue"], grading.severity_from_alert_level) == [4, 3, 1, 0]
    assert column(spark, ["EQ", "TC", "??"], grading.hazard_label) == ["earthquake", "tropical cyclone", "hazard"]
    assert column(spark, [15.0, 14.0, 3.5, 1.5, 1.0], grading.heat_band, "double") == [4, 3, 2, 1, 0]
    words = {"Couple rescued after deadline passes": 3, "Massacre reported": 4, "Drone seen": 2, "Nothing much": 0}
    assert column(spark, list(words), lambda c: grading.severity_from_text(c, F.lit("Other"))) == list(words.values())
    assert column(spark, ["ArmedConflict", "Health", "Economy"], lambda c: grading.severity_from_text(F.lit("x"), c)) == [2, 1, 0]


def brute_markers(points, markers, reach):
    best = {}
    for i, lat, lon in points:
        if lat is None or lon is None:
            continue
        for m, a, o in markers:
            if a is not None and o is not None:
                d2 = (o - lon) ** 2 + ((a - lat) * 2) ** 2
                if d2 <= reach * reach:
                    best[i] = min(best.get(i, (9e9, 0)), (d2, m))
    return best


def test_nearest_marker_equals_brute_force(spark):
    """Crowds, lone markers, copies at one position, ties, repeated and null ids, points without a marker."""
    rnd = random.Random(3)
    near = lambda lat, lon, by: (round(lat + rnd.uniform(-by, by), 3), round(lon + rnd.uniform(-by, by), 3))
    markers = [(i, *near(10, 20, 0.3)) for i in range(300)] + [(900 - i, *near(-5, -5, 9)) for i in range(60)]
    markers += [(2000, 50.0, 50.0), (1999, 50.0, 50.0), (2001, 50.0, 52.0), (2002, None, 1.0), (2003, 88.0, 179.5)]
    points = [(i, *near(10, 20, 4)) for i in range(150)] + [(200 + i % 90, *near(-5, -5, 12)) for i in range(150)]
    points += [(400, 50.0, 51.0), (401, 51.9, 50.1), (402, -80.0, 0.0), (403, None, 5.0), (None, 50.0, 50.5), (None, 50.0, 53.9), (404, 50.0, 56.0)]
    frame = spark.createDataFrame(points, "id long, lat double, lon double")
    got = geojoin.nearest_marker(frame, spark.createDataFrame(markers, "marker_id long, lat double, lon double"), 4.0).collect()
    want = brute_markers(points, markers, 4.0)
    assert len(got) == len(want) and {r["id"]: (r["d2"], r["marker_id"]) for r in got} == want


def test_nearest_marker_does_not_grow_with_the_square(spark):
    """40,000 points and 40,000 markers in one cell of the widest kind."""
    place = lambda k: [(F.pmod(F.col("id") * p, F.lit(40_009)) / 20_005.0).alias(n) for p, n in ((k, "lat"), (k * 7 + 3, "lon"))]
    started = time.time()
    found = geojoin.nearest_marker(spark.range(40_000).select("id", *place(911)), spark.range(40_000).select(F.col("id").alias("marker_id"), *place(577)), 4.0)
    assert found.count() == 40_000 and time.time() - started < 60


def test_splits_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_SPLIT", 100)
    few = spark.range(0, 2_000, 1, 1)
    assert session.spread(few, "id").rdd.getNumPartitions() == 20
    assert session.spread(spark.range(0, 300, 1, 1), "id").rdd.getNumPartitions() == session.FEW_SPLITS
    assert session.spread(spark.range(0, 2_000, 1, 30), "id").rdd.getNumPartitions() == 30
