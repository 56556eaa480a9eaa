"""Scans of the source formats. Every reader states its schema; none infers one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrosift.functions import geo, parsing, shapes
from metrosift.operators.checks import CheckFailed, fail_when, require_columns, require_none


def json_matrix(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    """Files holding ``[[header...], [row...], ...]`` as string columns plus the file path.

    A header alone gives no rows; an empty or non-list file stops the job.
    """
    rows = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.from_json("value", "array<array<string>>").alias("m"),
    )
    checked = rows.withColumn("m", fail_when(
        F.coalesce(F.size("m"), F.lit(0)) <= 0,
        F.concat(F.lit("Empty or invalid matrix file: "), F.col("file_path")), F.col("m"),
    ))
    header = F.element_at("m", 1)
    body = checked.select("file_path", header.alias("h"), F.explode(
        F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0)))).alias("r"))
    picked = [
        F.when(F.array_position("h", c) > 0, F.get(F.col("r"), F.array_position("h", c).cast("int") - 1)).alias(c)
        for c in columns
    ]
    return body.select(*picked, "file_path")


def strings(spark: SparkSession, path: str | list[str], required: Sequence[str], label: str,
            optional: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """Delimited text with a header, every column a string, only the wanted columns.

    The header is matched by name after a byte-order mark and blanks are removed.
    """
    table = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    clean = {c: c.lstrip("﻿").strip() for c in table.columns}
    table = table.withColumnsRenamed({a: b for a, b in clean.items() if a != b})
    require_columns(table, list(required), label)
    wanted = [*required, *[c for c in optional if c in table.columns]]
    return table.select(*wanted)


def pipe_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Summary-file table: pipe separated, trimmed GEO_ID, wanted columns only."""
    table = strings(spark, path, ["GEO_ID", *columns], path, sep="|")
    return table.withColumn("GEO_ID", F.trim("GEO_ID"))


STATION_SCHEMA = (
    "id long, station_name string, status_code string, access_code string, fuel_type_code string, "
    "latitude double, longitude double, state string, ev_dc_fast_num string"
)


def charging_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station documents with a ``fuel_stations`` list; a file without one stops the job.

    The port count may be a number or a list, so it is read as text and split.
    """
    docs = spark.read.schema(f"fuel_stations array<struct<{_struct(STATION_SCHEMA)}>>").json(path, multiLine=True)
    rows = docs.select(F.explode(fail_when(
        F.col("fuel_stations").isNull(), "Station file has no fuel_stations list", F.col("fuel_stations")
    )).alias("s")).select("s.*")
    text = F.regexp_replace("ev_dc_fast_num", r'[\[\]"\s]', "")
    return rows.withColumn("ev_dc_fast_num", F.when(text != "", F.split(text, ",")))


def _struct(ddl: str) -> str:
    return ", ".join(f"{part.split()[0]}: {part.split()[1]}" for part in ddl.split(", "))


def station_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Inventory pages (features[].attributes): usable stations and their page."""
    schema = ("features array<struct<attributes: struct<STATION_ID: string, STATION_NAME: string, "
              "STATE: string, LATITUDE: string, LONGITUDE: string>>>")
    pages = spark.read.schema(schema).json(path, multiLine=True)
    rows = pages.select(F.col("_metadata.file_path").alias("page"), F.explode("features").alias("f")).select(
        F.col("f.attributes.STATION_ID").alias("station_id"),
        F.col("f.attributes.STATION_NAME").alias("station_name"),
        F.col("f.attributes.LATITUDE").try_cast("double").alias("lat"),
        F.col("f.attributes.LONGITUDE").try_cast("double").alias("lon"), "page",
    )
    return rows.where(usable_station(F.col("station_id"), F.col("lat"), F.col("lon")))


def usable_station(station_id: Column, lat: Column, lon: Column) -> Column:
    """Full stations (USC, USW) with coordinates in range."""
    return station_id.rlike("^(USC|USW)") & lat.between(-90, 90) & lon.between(-180, 180)


# The tables and columns each source must bring.
REQUIRED = {
    "flows": ["w_geocode", "h_geocode", "S000"],
    "airport_segments": ["ORIGIN", "PASSENGERS"],
    "trajectories": ["Vehicle_ID", "Frame_ID", "Global_Time", "Local_X", "Local_Y", "v_Vel", "v_Acc", "Lane_ID"],
    "motion_tracks": ["scenario_id", "track_id", "timestamp_micros", "object_type", "x", "y", "heading",
                      "velocity_x", "velocity_y"],
    "transit_required": ["stops", "routes"],
    "transit_optional": ["trips", "stop_times", "calendar", "shapes"],
}
# Column names of the published tables (fixed values), compared without case.
LATITUDE_NAMES = ["latitude", "latitude_1", "lat"]
LONGITUDE_NAMES = ["longitude", "longitud", "longitude_1", "lon", "long"]


def flows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Origin-destination flows (gzip is read as is); block ids stay strings."""
    table = strings(spark, path, REQUIRED["flows"], "flows")
    return table.withColumn("S000", F.col("S000").try_cast("long"))


def airport_segments(spark: SparkSession, path: str) -> DataFrame:
    return strings(spark, path, REQUIRED["airport_segments"], "airport segments")


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    return strings(spark, path, REQUIRED["trajectories"], "trajectories")


def motion_tracks(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), REQUIRED["motion_tracks"], "motion tracks").select(
        *REQUIRED["motion_tracks"])


def transit_feed(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Feed tables present in ``names`` as all-string tables; stops and routes are required."""
    missing = set(REQUIRED["transit_required"]) - set(names)
    if missing:
        raise CheckFailed(f"Transit feed lacks {sorted(missing)}")
    return {n: spark.read.csv(f"{folder}/{n}.txt", header=True, inferSchema=False) for n in names}


def located_rows(table: DataFrame) -> DataFrame:
    """Crash or crossing rows with ``lat``/``lon`` from whichever columns hold them."""
    lat = parsing.first_present(table.columns, LATITUDE_NAMES)
    lon = parsing.first_present(table.columns, LONGITUDE_NAMES)
    if lat is None or lon is None:
        raise CheckFailed("No latitude/longitude columns")
    located = table.withColumn("lat", F.col(lat).try_cast("double")).withColumn("lon", F.col(lon).try_cast("double"))
    return located.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def crashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


grade_crossings = crashes


def geojson(spark: SparkSession, path: str, properties: str, geometry: str = "polygon") -> DataFrame:
    """Features of FeatureCollection files: ``properties.*``, ``geometry_type`` and the geometry.

    ``properties`` is a DDL field list. ``geometry`` names what is expected. Polygons of
    one or many parts give ``shape`` (see ``functions.shapes``), lines of one or many parts
    ``lines``, points ``coordinates``. A null geometry stays null; any other type, and
    anything but a collection, stops the job.
    """
    schema = (f"type string, features array<struct<properties: struct<{_struct(properties)}>, "
              f"geometry: struct<type: string, coordinates: string>>>")
    docs = spark.read.schema(schema).json(path, multiLine=True)
    features = fail_when(
        (F.coalesce("type", F.lit("")) != "FeatureCollection") | F.col("features").isNull(),
        "Not a FeatureCollection", F.col("features"),
    )
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    if geometry == "polygon":
        found = shapes.shape_of(kind, text).alias("shape")
    else:
        one, many = {"line": ("LineString", "MultiLineString"), "point": ("Point", None)}[geometry]
        depth = "array<array<double>>" if many else "array<double>"
        read = F.when(kind.isNull() & text.isNull(), F.lit(None)).when(
            kind == one, F.array(F.from_json(text, depth)) if many else F.from_json(text, depth))
        if many:
            read = read.when(kind == many, F.from_json(text, f"array<{depth}>"))
        found = read.otherwise(F.raise_error(F.concat(F.lit(f"Not a {geometry}: "), F.coalesce(kind, F.lit("no type"))))).alias(
            "lines" if many else "coordinates")
    return docs.select(F.explode(features).alias("f")).select("f.properties.*", kind.alias("geometry_type"), found)


def demand_zones(zones: DataFrame, zone_id: str, measures: Sequence[str], expected: int | None = None) -> DataFrame:
    """Checked polygon zones: unique ids, positive finite measures, non-empty geometry."""
    bad = F.lit(False)
    for m in measures:
        v = parsing.finite(F.col(m).cast("double"))
        bad = bad | v.isNull() | (v <= 0)
    empty = F.coalesce(F.size("shape"), F.lit(0)) <= 0
    require_none(zones.where(bad | empty).select(zone_id), "Invalid demand zones")
    require_none(zones.groupBy(zone_id).count().where("count > 1"), "Repeated demand zones")
    if expected is not None and zones.count() != expected:
        raise CheckFailed(f"Expected {expected} demand zones")
    return zones.orderBy(F.col(zone_id).cast("int"))


def clean_layer(features: DataFrame, height_feet: str | None = None, status: str | None = None) -> DataFrame:
    """Layer features without demolished, null or empty ones; heights in metres."""
    parts = next(c for c in ("shape", "lines", "coordinates") if c in features.columns)
    kept = features.where(F.coalesce(F.size(parts), F.lit(0)) > 0)
    if status:
        kept = kept.where(F.lower(F.coalesce(status, F.lit(""))) != "demolished")
    if height_feet:
        feet = parsing.number_or_null(F.col(height_feet).cast("string"))
        kept = kept.withColumn("height_m", geo.feet_to_metres(feet)).drop(height_feet)
    return kept


def release(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """Version table of a stored release; the stored mode must be the one asked for."""
    versions = spark.read.parquet(f"{path}/versions")
    rows = versions.limit(2).collect()
    if len(rows) != 1 or rows[0]["data_mode"] != mode:
        raise CheckFailed(f"Release is not a {mode} release")
    return versions


def reference_release(spark: SparkSession, path: str, operator: str, model: str = "ranking.v2") -> DataFrame:
    """References of a verified release of the model with an enabled market of the operator."""
    version = release(spark, path, "verified").first()
    if version["model_version"] != model:
        raise CheckFailed(f"Release does not use {model}")
    references = spark.read.parquet(f"{path}/references")
    if references.where((F.col("operator") == operator) & F.col("enabled")).isEmpty():
        raise CheckFailed(f"No enabled {operator} market")
    return references


def reuse_if_complete(spark: SparkSession, path: str, key: str, expected: DataFrame) -> DataFrame | None:
    """A stored intermediate, or None unless its key set is exactly the expected one."""
    try:
        stored = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    if key not in stored.columns:
        return None
    have, want = stored.select(key).distinct(), expected.select(key).distinct()
    same = have.exceptAll(want).isEmpty() and want.exceptAll(have).isEmpty()
    return stored if same else None


def newest_complete_file(rows: DataFrame, required: DataFrame, key: str, file: str, stamp: str) -> DataFrame:
    """The newest file whose usable rows cover every required key, as one row or none.

    Counted by semi join and two-step distinct counts instead of one key set per file.
    """
    need = required.select(key).distinct()
    n = need.count()
    covered = rows.select(file, stamp, key).join(need, key, "left_semi").groupBy(file, key).agg(
        F.max(stamp).alias(stamp)
    ).groupBy(file).agg(F.count(F.lit(1)).alias("_n"), F.max(stamp).alias(stamp))
    return covered.where(F.col("_n") == n).drop("_n").orderBy(F.desc(stamp), F.desc(file)).limit(1)


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole HTML files as (file_path, html)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("html"))


def file_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, bytes, sha256) of raw files. Spark gives each task whole files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def union_feeds(frames: Mapping[str, DataFrame], tag: str = "feed") -> DataFrame:
    """Concatenate tables by name with a source tag; absent columns become null."""
    out = None
    for name, frame in frames.items():
        part = frame.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
