"""Files of trips, demand, zones and networks, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OD_SCHEMA = "origin_node long, dest_node long, count int, mode string, depart_start_s double, depart_end_s double"
PERSON_SCHEMA = "person_id long, origin_maz long, dest_maz long, purpose string, depart_period int, trip_mode string"
#: Names under which trip files carry each column.
TRIP_COLUMNS = {
    "origin": ["origen", "origin", "o"],
    "dest": ["destino", "destination", "dest", "d"],
    "period": ["periodo", "period", "hora", "hour"],
    "trips": ["viajes", "trips"],
    "band": ["distancia", "distance"],
    "trip_km": ["viajes_km", "trips_km", "km"],
    "mode": ["modo", "mode", "medio"],
}
OPTIONAL = {"band", "trip_km", "mode"}


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, by position; rows with a field that does not read as its type are left out, whichever columns are used."""
    names = [c.split()[0] for c in schema.split(", ")]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, header=True)
    fits = F.lit(True)
    cast = {}
    for column in schema.split(", "):
        n, kind = column.split()
        cast[n] = F.btrim(F.col(n)).try_cast(kind)
        fits = fits & (F.col(n).isNull() | cast[n].isNotNull())
    return raw.where(fits).select(*(c.alias(n) for n, c in cast.items()))


def od_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an OD file; malformed rows are left out."""
    return typed_csv(spark, path, OD_SCHEMA)


def person_trips_csv(spark: SparkSession, path: str) -> DataFrame:
    return typed_csv(spark, path, PERSON_SCHEMA)


def maz_nodes_csv(spark: SparkSession, path: str) -> DataFrame:
    """(maz_id, node_id): of rows that repeat a zone the largest node counts (files have no order)."""
    x = typed_csv(spark, path, "maz_id long, node_id long")
    return x.groupBy("maz_id").agg(F.max("node_id").alias("node_id"))


def picked(header: list[str]) -> dict[str, str]:
    """Logical column to the name it has in a header, whatever the case; a missing column that is not optional is an error."""
    low = {h.strip().lower(): h for h in header}
    found = {c: low[n] for c, names in TRIP_COLUMNS.items() for n in reversed(names) if n in low}
    missing = TRIP_COLUMNS.keys() - OPTIONAL - found.keys()
    if missing:
        raise ValueError(f"no column for {', '.join(sorted(missing))} in {header}")
    return found


def daily_trips(spark: SparkSession, path: str) -> DataFrame:
    """(day, origin, dest, period, trips, band, trip_km, mode) of trip files, | between columns, packed or not; the day is the
    eight digits in the file's name. Numbers that do not read count as no trips; rows without a period go."""
    raw = spark.read.option("sep", "|").option("header", True).csv(path)
    names = picked(raw.columns)
    get = lambda c: F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("string")
    day = F.try_to_timestamp(F.regexp_extract(F.input_file_name(), r"(\d{8})[^/]*$", 1), F.lit("yyyyMMdd")).cast("date")
    return raw.select(
        day.alias("day"), get("origin").alias("origin"), get("dest").alias("dest"), get("period").try_cast("int").alias("period"), F.coalesce(get("trips").try_cast("double"), F.lit(0.0)).alias("trips"),
        get("band").alias("band"), get("trip_km").try_cast("double").alias("trip_km"), get("mode").alias("mode"),
    ).where("period IS NOT NULL")


def matching_city(cities: DataFrame, name: str) -> DataFrame:
    """The first city (name) that is called so, or else holds the name; with neither, an error that says which names are near."""
    low = name.lower()
    rank = F.when(F.lower("name") == low, 0).when(F.contains(F.lower("name"), F.lit(low)), 1)
    best = cities.withColumn("_r", rank).where("_r IS NOT NULL").orderBy("_r", "name").limit(1).drop("_r")
    if best.limit(1).count() == 0:
        near = [r["name"] for r in cities.orderBy(F.levenshtein(F.lower("name"), F.lit(low)), "name").select("name").limit(5).collect()]
        raise ValueError(f"no city {name!r}; near: {near}")
    return best


def zones_in(zones: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Zones (zone_id, polygon) whose centroid lies in the polygon."""
    from ..functions.geometry import centroid, point_in_polygon

    ring = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in polygon))
    lon, lat = centroid(F.col("polygon"))
    return zones.where(point_in_polygon(lon, lat, ring))


def network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as ``save_network`` wrote them; the row counts must be those of the manifest."""
    nodes, edges = spark.read.parquet(f"{path}/nodes.parquet"), spark.read.parquet(f"{path}/edges.parquet")
    said = spark.read.json(f"{path}/manifest.json").first()
    if (said["nodes"], said["edges"]) != (nodes.count(), edges.count()):
        raise ValueError(f"{path} does not hold what its manifest says")
    return nodes, edges


def save_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes.parquet")
    edges.write.mode("overwrite").parquet(f"{path}/edges.parquet")
    spark = nodes.sparkSession
    counts = spark.createDataFrame([(nodes.count(), edges.count())], "nodes long, edges long")
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/manifest.json")


def save_od(od: DataFrame, path: str) -> None:
    """CSV by day type."""
    od.write.mode("overwrite").partitionBy("day_type").csv(path, header=True)


def geojson(links: DataFrame, *properties: str) -> DataFrame:
    """(value): a GeoJSON feature a row, a line for each link (points array<struct<lon, lat>>); names are escaped."""
    line = F.struct(F.lit("LineString").alias("type"), F.transform("points", lambda p: F.array(F.round(p["lon"], 6), F.round(p["lat"], 6))).alias("coordinates"))
    return links.select(F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def save_geojson(links: DataFrame, path: str, *properties: str) -> None:
    """A feature a line, by the text sink."""
    geojson(links, *properties).write.mode("overwrite").text(path)


def save_parquet(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


#: Sinks by name.
FORMATS = {"geojson": save_geojson, "parquet": save_parquet, "csv": save_csv}


def writer(kind: str):
    """The sink of a name; unknown names are an error."""
    if kind not in FORMATS:
        raise ValueError(f"no writer {kind!r}; there are {', '.join(sorted(FORMATS))}")
    return FORMATS[kind]


def save_run(tables: dict[str, DataFrame], path: str) -> None:
    """A run's tables (trajectories, link_stats, activities) as Parquet, link statistics by their time."""
    for name, df in tables.items():
        save_parquet(df, f"{path}/{name}.parquet", *(["time_bin"] if "time_bin" in df.columns else []))


def run_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table that ``save_run`` wrote; empty if it did not."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}.parquet")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def snapshot_files(spark: SparkSession, path: str, least_bytes: int = 200) -> DataFrame:
    """(time_s, path) of snapshot files, by the number in their name; smaller ones are taken as unfinished."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    at = F.regexp_extract("path", r"(\d+(?:\.\d+)?)[^/\d]*$", 1).try_cast("double")
    return files.where(F.col("length") >= least_bytes).select(at.alias("time_s"), "path").where("time_s IS NOT NULL")


def road_settings(path: str) -> dict[str, dict[str, float]]:
    """Sections of ``name: value`` lines under ``section:`` lines, as tag settings are written; others are passed over."""
    out: dict[str, dict[str, float]] = {}
    section = ""
    with open(path) as f:
        for line in f:
            key, colon, value = line.split("#")[0].rstrip().partition(":")
            if not colon:
                continue
            if not value.strip():
                section = key.strip()
                continue
            try:
                out.setdefault(section if key[:1].isspace() else "", {})[key.strip()] = float(value)
            except ValueError:
                continue
    return out


def log_metrics(lines: DataFrame) -> DataFrame:
    """(name, number) of "name: number" lines of a run's log (value)."""
    x = lines.select(F.btrim(F.regexp_extract("value", r"^(?:\[[^\]]*\]\s*)*([A-Za-z][^:=]*?)\s*[:=]\s*(-?[0-9.]+)", 1)).alias("name"), F.regexp_extract("value", r"[:=]\s*(-?[0-9.]+)", 1).try_cast("double").alias("number"))
    return x.where("name <> '' AND number IS NOT NULL")
