"""Zone and city polygons of GeoJSON files, with holes and parts, in degrees.

A zone's rings are kept in one list: a point lies within if a ray from it crosses them an odd number of times, whichever of
them are holes and however many parts there are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projection import lon_lat

_FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
#: Properties under which zone files carry a zone's id, the first that there is.
ID_NAMES = ("id", "codzona", "cod_zona", "zona", "id_zona")


def zone_file(spark: SparkSession, path: str, id_property: str | None = None, crs: int | None = None) -> DataFrame:
    """(zone_id, rings, signs, properties) of the polygons and multipolygons in GeoJSON files: collections, single features, or a feature a line.

    rings: array<array<struct<lon, lat>>> in degrees; signs: 1 for an outer ring, -1 for a hole. ``crs``: the EPSG code of the
    coordinates; without it that of the file's crs member, else 4326. ``id_property``: without it the first of ``ID_NAMES``, whatever its
    case, else the first property by name. Other geometries and features without any are left out.
    """
    raw = spark.read.text(path, wholetext=True).select("value")
    # A file is one JSON value, or one a line.
    whole = F.from_json("value", f"struct<type:string,features:array<{_FEATURE}>,crs:struct<properties:struct<name:string>>>")
    lines = raw.where(F.coalesce(whole["type"], F.lit("")) != "FeatureCollection").select(F.explode(F.split("value", r"\r?\n(?=\s*\{)")).alias("value"))
    single = lines.select(F.from_json("value", _FEATURE).alias("f"), F.lit(None).cast("string").alias("crs"))
    many = raw.select(whole.alias("w")).where("w.type = 'FeatureCollection'").select(F.explode("w.features").alias("f"), F.col("w.crs.properties.name").alias("crs"))
    x = many.unionByName(single).where("f.geometry.type IN ('Polygon', 'MultiPolygon')").select("f.*", "crs")
    if crs is None:
        named = [r["crs"] for r in x.select("crs").where("crs IS NOT NULL").distinct().limit(2).collect()]
        if len(named) > 1:
            raise ValueError(f"files of several coordinate systems: {', '.join(named)}")
        crs = epsg(named[0]) if named else 4326
    ring = "array<array<array<double>>>"
    parts = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json("geometry.coordinates", ring))).otherwise(F.from_json("geometry.coordinates", f"array<{ring}>"))
    place = lambda p: (lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat")))(*lon_lat(p[0], p[1], crs))
    x = x.withColumn("parts", parts).select(
        _id(id_property).alias("zone_id"), F.transform(F.flatten("parts"), lambda r: F.transform(r, place)).alias("rings"),
        F.flatten(F.transform("parts", lambda p: F.transform(p, lambda _, i: F.when(i == 0, 1).otherwise(-1)))).alias("signs"), "properties",
    )
    return x.where(F.size("rings") > 0)


def epsg(name: str) -> int:
    """The code in a coordinate system's name; that of longitude and latitude by its own name."""
    if name.upper().endswith("CRS84"):
        return 4326
    code = re.search(r"EPSG:+(?:[0-9.]*:)?(\d+)$", name, re.IGNORECASE)
    if not code:
        raise ValueError(f"no EPSG code in {name!r}")
    return int(code[1])


def _id(name: str | None) -> Column:
    p = F.col("properties")
    if name is not None:
        return F.try_element_at(p, F.lit(name))
    low = F.map_from_entries(F.transform(F.map_entries(p), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return F.coalesce(*(F.try_element_at(low, F.lit(n)) for n in ID_NAMES), F.try_element_at(p, F.array_min(F.map_keys(p))))


def centre(rings: Column, signs: Column) -> tuple[Column, Column]:
    """(lon, lat) of the centre of what lies within the rings: outer rings count, holes are taken off."""
    n = F.size(rings)

    def sums(r: Column) -> Column:
        at = lambda i: F.element_at(r, F.when(i < F.size(r), i + 1).otherwise(1))
        cross = lambda i: F.element_at(r, i)["lon"] * at(i)["lat"] - at(i)["lon"] * F.element_at(r, i)["lat"]
        of = lambda f: F.aggregate(F.sequence(F.lit(1), F.size(r)), F.lit(0.0), lambda a, i: a + f(i))
        moment = lambda c: of(lambda i: (F.element_at(r, i)[c] + at(i)[c]) * cross(i))
        return F.struct(of(cross).alias("a"), moment("lon").alias("x"), moment("lat").alias("y"))

    own = F.transform(rings, sums)
    # A ring may run either way; its area decides the sign, and whether it is a hole.
    total = lambda c: F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + F.element_at(signs, i) * F.signum(F.element_at(own, i)["a"]) * F.element_at(own, i)[c])
    return total("x") / (3 * total("a")), total("y") / (3 * total("a"))


def inside(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd rule over all rings; points on an edge may fall either way."""

    def crossings(r: Column) -> Column:
        def crosses(i: Column) -> Column:
            a, b = F.element_at(r, i), F.element_at(r, F.when(i < F.size(r), i + 1).otherwise(1))
            return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"])

        return F.size(F.filter(F.sequence(F.lit(1), F.size(r)), lambda i: F.coalesce(crosses(i), F.lit(False))))

    return F.aggregate(rings, F.lit(0), lambda n, r: n + crossings(r)) % 2 == 1


def within(points: DataFrame, zones: DataFrame, cell_deg: float) -> DataFrame:
    """(point columns, zone_id): points (lon, lat) by the zones (zone_id, rings) they lie in. Joined by the cells of a zone's box, so a large zone's points are spread."""
    all_ = F.flatten("rings")
    edge = lambda f, c: F.floor(f(F.transform(all_, lambda p: p[c])) / cell_deg)
    z = zones.select("zone_id", "rings", F.sequence(edge(F.array_min, "lon"), edge(F.array_max, "lon")).alias("xs"), F.sequence(edge(F.array_min, "lat"), edge(F.array_max, "lat")).alias("ys"))
    z = z.withColumn("cx", F.explode("xs")).withColumn("cy", F.explode("ys")).drop("xs", "ys")
    p = points.withColumns({"cx": F.floor(F.col("lon") / cell_deg), "cy": F.floor(F.col("lat") / cell_deg)})
    return p.join(z, ["cx", "cy"]).where(inside(F.col("lon"), F.col("lat"), F.col("rings"))).select(*points.columns, "zone_id")


def zones_of_city(zones: DataFrame, city: DataFrame) -> DataFrame:
    """The zones whose centre lies in the city: ``city`` is one row (rings)."""
    lon, lat = centre(F.col("rings"), F.col("signs"))
    x = zones.withColumns({"_lon": lon, "_lat": lat}).crossJoin(F.broadcast(city.limit(1).select(F.col("rings").alias("_city"))))  # one row
    return x.where(inside(F.col("_lon"), F.col("_lat"), F.col("_city"))).drop("_lon", "_lat", "_city")
