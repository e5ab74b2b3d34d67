"""Zone files, map coordinates, holidays and places along lines."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.functions.calendar import easter, is_holiday
from tramline.functions.geometry import along
from tramline.functions.projection import lon_lat
from tramline.operators import analytics, demand
from tramline.sources import tables, zones


def forward(lon, lat, zone, south=False):
    """The map by its own series, from a text book's form with the conformal latitude; checked on the central meridian by summing up the arc."""
    a, f = 6378137.0, 1 / 298.257223563
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    p, m = math.radians(lat), math.radians(lon - (6 * zone - 183))
    t = math.sinh(math.atanh(math.sin(p)) - e * math.atanh(e * math.sin(p)))
    xi, eta = math.atan2(t, math.cos(m)), math.asinh(math.sin(m) / math.hypot(t, math.cos(m)))
    x = 500000 + 0.9996 * radius * (eta + sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(alpha, 1)))
    y = 0.9996 * radius * (xi + sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(alpha, 1)))
    return x, y + (10_000_000 if south else 0)


def arc(lat):
    f = 1 / 298.257223563
    e2 = f * (2 - f)
    p = np.linspace(0, math.radians(lat), 200_001)
    v = 6378137.0 * (1 - e2) / (1 - e2 * np.sin(p) ** 2) ** 1.5
    return float(((v[1:] + v[:-1]) / 2 * np.diff(p)).sum())


def degrees(spark, places, code):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i int, x double, y double")
    return [(r["lon"], r["lat"]) for r in df.select("i", *(c.alias(n) for n, c in zip(("lon", "lat"), lon_lat(F.col("x"), F.col("y"), code), strict=True))).orderBy("i").collect()]


def test_map_coordinates(spark):
    places = [(2.6, 39.57), (3.0, 0.0), (5.9, 60.0), (-0.4, 41.2), (0.1, 84.0)]
    for got, want in zip(degrees(spark, [forward(*p, 31) for p in places], 25831), places, strict=True):
        assert abs(got[0] - want[0]) < 1e-8 and abs(got[1] - want[1]) < 1e-8
    south = [(-58.4, -34.6), (-60.9, -0.5)]
    for got, want in zip(degrees(spark, [forward(*p, 21, True) for p in south], 32721), south, strict=True):
        assert abs(got[0] - want[0]) < 1e-8 and abs(got[1] - want[1]) < 1e-8
    on_meridian = degrees(spark, [(500000.0, 0.9996 * arc(lat)) for lat in (10.0, 45.0, 70.0)], 32633)
    for got, lat in zip(on_meridian, (10.0, 45.0, 70.0), strict=True):
        assert abs(got[0] - 15.0) < 1e-9 and abs(got[1] - lat) < 1e-8
    tower = degrees(spark, [(448251.8, 5411932.7)], 32631)[0]  # as published, to the metre
    assert abs(tower[0] - 2.2945) < 1e-4 and abs(tower[1] - 48.8582) < 1e-4
    with pytest.raises(ValueError, match="EPSG:3857"):
        lon_lat(F.lit(0.0), F.lit(0.0), 3857)


def square(x, y, s):
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


def feature(props, kind, coordinates):
    return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coordinates} if kind else None}


SHAPES = [
    feature({"ID": "ring", "pop": 5}, "Polygon", [square(0, 0, 10), square(4, 4, 2)[::-1]]),
    feature({"ID": "two"}, "MultiPolygon", [[square(20, 0, 2)], [square(24, 0, 4), square(25, 1, 1)]]),
    feature({"ID": "line"}, "LineString", [[0, 0], [1, 1]]),
    feature({"ID": "none"}, None, None),
]


def test_zones_of_a_collection_and_of_lines(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": SHAPES}, indent=1))
    (tmp_path / "b.geojson").write_text("\n".join(json.dumps(f) for f in SHAPES) + "\n")
    (tmp_path / "c.geojson").write_text(json.dumps(SHAPES[0], indent=2))
    both = [zones.zone_file(spark, str(tmp_path / n)) for n in ("a.geojson", "b.geojson")]
    a, b = ({r["zone_id"]: (r["rings"], r["signs"]) for r in z.collect()} for z in both)
    assert a == b and a.keys() == {"ring", "two"} and a["two"][1] == [1, 1, -1]
    assert [r["zone_id"] for r in zones.zone_file(spark, str(tmp_path / "c.geojson")).collect()] == ["ring"]
    pts = [(i, x + 0.25, y + 0.3) for i, (x, y) in enumerate((x, y) for x in range(-1, 30) for y in range(-1, 11))]
    p = spark.createDataFrame(pts, "i long, lon double, lat double")

    def want(x, y):
        box = lambda x0, y0, s: x0 < x < x0 + s and y0 < y < y0 + s
        if box(0, 0, 10) and not box(4, 4, 2):
            return "ring"
        return "two" if box(20, 0, 2) or box(24, 0, 4) and not box(25, 1, 1) else None

    for cell in (0.7, 50.0):
        got = {r["i"]: r["zone_id"] for r in zones.within(p, both[0], cell).collect()}
        assert got == {i: w for i, x, y in pts if (w := want(x, y))}


def test_centres_and_the_zones_of_a_city(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": SHAPES}))
    (tmp_path / "city.geojson").write_text(json.dumps(feature({"name": "town"}, "Polygon", [square(-1, -1, 12)])))
    z, city = zones.zone_file(spark, str(tmp_path / "a.geojson")), zones.zone_file(spark, str(tmp_path / "city.geojson"), "name")
    got = {r["zone_id"]: (r["x"], r["y"]) for r in z.select("zone_id", *(c.alias(n) for n, c in zip("xy", zones.centre(F.col("rings"), F.col("signs")), strict=True))).collect()}
    assert np.allclose(got["ring"], ((100 * 5 - 4 * 5) / 96, (100 * 5 - 4 * 5) / 96)) and np.allclose(got["two"], ((4 * 21 + 16 * 26 - 25.5) / 19, (4 * 1 + 16 * 2 - 1.5) / 19))
    assert [r["zone_id"] for r in zones.zones_of_city(z, city).collect()] == ["ring"]


def test_projected_zone_files(spark, tmp_path):
    corners = [(2.5, 39.5), (2.8, 39.5), (2.8, 39.7), (2.5, 39.7), (2.5, 39.5)]
    shape = feature({"codzona": "07040"}, "Polygon", [[list(forward(*c, 31)) for c in corners]])
    whole = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::25831"}}, "features": [shape]}
    (tmp_path / "a.geojson").write_text(json.dumps(whole))
    (tmp_path / "b.geojson").write_text(json.dumps(shape))
    for z in (zones.zone_file(spark, str(tmp_path / "a.geojson")), zones.zone_file(spark, str(tmp_path / "b.geojson"), crs=25831)):
        r = z.first()
        assert r["zone_id"] == "07040" and np.allclose([(p["lon"], p["lat"]) for p in r["rings"][0]], corners, atol=1e-6, rtol=0)
    assert zones.epsg("urn:ogc:def:crs:OGC:1.3:CRS84") == 4326 and zones.epsg("EPSG:32630") == 32630
    with pytest.raises(ValueError, match="no EPSG code"):
        zones.epsg("some map")


def test_easter_and_holidays(spark):
    known = {1818: (3, 22), 1943: (4, 25), 1961: (4, 2), 1992: (4, 19), 1995: (4, 16), 2000: (4, 23), 2008: (3, 23), 2019: (4, 21), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25)}
    got = {r["y"]: r["e"] for r in spark.createDataFrame([(y,) for y in known], "y int").select("y", easter(F.col("y")).alias("e")).collect()}
    assert got == {y: dt.date(y, *md) for y, md in known.items()}
    days = {"2024-03-29": "ES DE PT", "2024-04-01": "DE FR IT", "2024-05-09": "DE FR", "2024-05-30": "PT", "2024-10-12": "ES", "2024-02-29": "", "2023-12-25": "ES DE FR IT PT"}
    df = spark.createDataFrame([(k,) for k in days], "d string").select(F.col("d"), F.to_date("d").alias("day"))
    for country in ("ES", "DE", "FR", "IT", "PT"):
        got = {r["d"] for r in df.where(is_holiday(F.col("day"), country)).collect()}
        assert got == {k for k, v in days.items() if country in v.split()}
    split = {str(r["day"]): r["day_type"] for r in demand.weekend_split(df, ["2024-02-29"], "ES").collect()}
    assert [k for k, v in split.items() if v == "weekday"] == ["2024-04-01", "2024-05-09", "2024-05-30"]
    with pytest.raises(ValueError, match="no holidays of 'XX'"):
        is_holiday(F.col("day"), "XX")


def test_trip_headers_of_every_name():
    found = tables.picked(["Origen", "DESTINO", "hora", "viajes", "medio", "km"])
    assert found["mode"] == "medio" and found["trip_km"] == "km"


def test_trajectories_and_activities(spark, tmp_path):
    """A line with a bend, one with a point twice, ticks at both ends of a passage; written and read back."""
    line = lambda *p: [{"lon": float(x), "lat": float(y)} for x, y in p]
    lines = spark.createDataFrame([(1, line((0, 0), (0.3, 0), (0.3, 0.1))), (2, line((1, 1), (1, 1), (1, 2)))], "edge_id long, points array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame([(7, 1, 100, 140), (7, 2, 140, 145), (8, 2, 101, 109)], "agent_id long, edge_id long, enter long, exit long")
    got = {(r["agent_id"], r["t"]): (r["edge_id"], r["lon"], r["lat"]) for r in analytics.trajectories(p, lines, 10).collect()}
    assert got.keys() == {(7, 100), (7, 110), (7, 120), (7, 130), (7, 140)}
    assert got[7, 100] == (1, 0.0, 0.0) and got[7, 140] == (2, 1.0, 1.0)
    assert np.allclose(got[7, 110], (1, 0.1, 0), atol=1e-6) and np.allclose(got[7, 130], (1, 0.3, 0), atol=1e-6)
    e = spark.createDataFrame([(1, 10, 11), (2, 11, 12)], "edge_id long, from_node long, to_node long")
    acts = analytics.activities(p, e)
    assert sorted(tuple(r) for r in acts.collect()) == [(7, "activity", 145, 12), (7, "depart", 100, 10), (8, "activity", 109, 12), (8, "depart", 101, 11)]
    tables.save_run({"trajectories": analytics.trajectories(p, lines, 10), "activities": acts}, f"file://{tmp_path}/run")
    assert tables.run_table(spark, f"file://{tmp_path}/run", "trajectories", "agent_id long, t long").count() == 5
    assert tables.run_table(spark, f"file://{tmp_path}/run", "activities", "agent_id long, kind string").count() == 4


def test_along_ends(spark):
    df = spark.createDataFrame([([{"lon": 0.0, "lat": 0.0}, {"lon": 0.0, "lat": 1.0}, {"lon": 0.0, "lat": 4.0}],)], "points array<struct<lon:double,lat:double>>")
    got = [tuple(df.select(along(F.col("points"), F.lit(s)).alias("p")).first()["p"]) for s in (0.0, 0.125, 0.5, 1.0)]
    assert np.allclose(got, [(0, 0), (0, 0.5), (0, 2), (0, 4)], atol=1e-6)
