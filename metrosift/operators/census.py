"""Census, charging-site and climate-normal aggregates. Ratios are ratios of sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrosift.functions import parsing
from metrosift.operators.checks import require_columns, require_keys, require_none, require_unique
from metrosift.operators.joins import join_lookup

# Midpoints in minutes of the twelve published commute-duration bins.
COMMUTE_MIDPOINTS = (2.5, 7, 12, 17, 22, 27, 32, 37, 42, 52, 74.5, 105)
PER = 100_000


def ratio_of_sums(df: DataFrame, by: Sequence[str], ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Per group: sum(numerator) / sum(denominator), null on a zero denominator."""
    inputs = sorted({c for pair in ratios.values() for c in pair})
    sums = df.groupBy(*by).agg(*[F.sum(c).alias(f"_{c}") for c in inputs])
    return sums.select(
        *by,
        *[(F.col(f"_{n}") / F.nullif(F.col(f"_{d}"), F.lit(0))).alias(name)
          for name, (n, d) in ratios.items()],
    )


def binned_mean(
    df: DataFrame, by: Sequence[str], bins: Mapping[str, float], total: str, name: str,
    strict: bool = True,
) -> DataFrame:
    """Mean over bins by their midpoints. Bins that do not add up to ``total`` stop the
    job, or give null when not strict. One aggregate, no unpivot of the input."""
    sums = df.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in bins], F.sum(total).alias(total)
    )
    parts = sum((F.col(c) for c in bins), F.lit(0))
    weighted = sum((F.col(c) * float(m) for c, m in bins.items()), F.lit(0.0))
    agrees = parts == F.col(total)
    mean = weighted / F.nullif(F.col(total), F.lit(0))
    bad = F.raise_error(F.lit("Bins do not reconcile to their total")) if strict else F.lit(None)
    return sums.select(*by, total, F.when(agrees, mean).otherwise(bad.cast("double")).alias(name))


def merge_duplicates(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per key with ``copies`` and ``conflict`` (duplicates that disagree).

    Rows of a key disagree exactly when their smallest and largest structs differ, so
    two numbers per key cross the shuffle however many copies it has.
    """
    row = F.struct(*fields)
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"), F.min(row).alias("_low"), F.max(row).alias("_high"))
        .select(key, "copies", (~F.col("_low").eqNullSafe(F.col("_high"))).alias("conflict"),
                *[F.col("_low")[f].alias(f) for f in fields])
    )


def require_agreeing(df: DataFrame, key: str, fields: Sequence[str], label: str) -> DataFrame:
    """Distinct rows by key; disagreeing duplicates stop the job."""
    merged = merge_duplicates(df, key, fields)
    require_none(merged.where("conflict").select(key), f"Conflicting records in {label}")
    return merged.drop("copies", "conflict")


def is_qualifying_site(
    status: Column, access: Column, latitude: Column, longitude: Column, ports: Column
) -> Column:
    return (
        (status == "E") & (F.lower(access) == "public")
        & latitude.isNotNull() & longitude.isNotNull() & (ports > 0)
    )


def qualifying_sites(stations: DataFrame) -> DataFrame:
    """Operational public fast-charging sites, one row per id.

    ``ev_dc_fast_num`` is an array of text counts. Duplicates that agree collapse.
    """
    ports = parsing.total_ports(F.col("ev_dc_fast_num"))
    kept = stations.withColumn("dc_fast_ports", ports).where(
        is_qualifying_site(F.col("status_code"), F.col("access_code"), F.col("latitude"),
                           F.col("longitude"), F.col("dc_fast_ports"))
    )
    require_none(kept.where("id IS NULL").select("latitude", "longitude"), "Qualifying site has no id")
    return require_agreeing(kept, "id", ["latitude", "longitude", "dc_fast_ports"], "stations")


def ports_by_area(sites: DataFrame) -> DataFrame:
    """(metro, county, ports); a site without a county counts for its metro only."""
    return sites.where("metro IS NOT NULL").groupBy("metro", "county").agg(
        F.sum("ports").cast("long").alias("ports")
    )


def ports_with_county_map(by_area: DataFrame) -> DataFrame:
    """Per metro: total ports and a map county -> ports (bounded by its member counties)."""
    entry = F.when(F.col("county").isNotNull(), F.struct("county", "ports"))
    return by_area.groupBy("metro").agg(
        F.sum("ports").alias("public_dc_ports"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("county_ports"),
    )


def charging_coverage(
    by_area: DataFrame, counties: DataFrame, metro_population: DataFrame, retrieved: bool = True
) -> DataFrame:
    """Ports per 100,000 residents, and the population share in counties with a port.

    ``counties`` has one row per member county (metro, county, population or null);
    ``metro_population`` has (metro, population). A metro without any site has zero
    ports when the source was retrieved and null when it was not. The share is null
    unless every member county has a population.
    """
    served = by_area.where("county IS NOT NULL AND ports > 0").select(
        "metro", "county", F.lit(True).alias("_served")
    ).distinct()
    joined = counties.join(served, ["metro", "county"], "left")
    shares = joined.groupBy("metro").agg(
        F.sum(F.when(F.col("_served"), F.col("population")).otherwise(0)).alias("_covered"),
        F.sum("population").alias("_all"),
        F.count("population").alias("_known"), F.count(F.lit(1)).alias("_members"),
    )
    ports = by_area.groupBy("metro").agg(F.sum("ports").alias("_ports"))
    known = F.lit(retrieved)
    return (
        metro_population.join(ports, "metro", "left").join(shares, "metro", "left")
        .select(
            "metro", "population",
            F.when(known, F.coalesce("_ports", F.lit(0))).alias("ports"),
            F.when(known, F.coalesce("_ports", F.lit(0)) / F.nullif(F.col("population"), F.lit(0)) * PER)
            .alias("ports_per_100k"),
            F.when(known & (F.col("_known") == F.col("_members")) & (F.col("_all") > 0),
                   F.col("_covered") / F.col("_all")).alias("population_share_with_ports"),
        )
    )


def charging_features(stations: DataFrame, counties: DataFrame, metro_population: DataFrame) -> DataFrame:
    """Strict form: county populations must add up to the metro, ids must be unique and
    every qualifying public station must report a whole port count."""
    require_unique(stations, ["id"], "stations")
    sums = counties.groupBy("metro").agg(F.sum("population").alias("_sum"))
    off = metro_population.join(sums, "metro", "left").where(
        ~F.col("_sum").eqNullSafe(F.col("population")) | (F.col("population") <= 0)
    )
    require_none(off.select("metro"), "County populations must reconcile to the metro")
    public = join_lookup(stations, counties.select("metro", "county"), ["county"], "inner").where(
        "fuel_type_code = 'ELEC' AND access_code = 'public' AND status_code = 'E'"
    )
    count = F.col("ev_dc_fast_num").try_cast("double")
    require_none(
        public.where(count.isNull() | (count < 0) | (count != F.floor(count))).select("id"),
        "Missing or invalid port count",
    )
    by_area = public.groupBy("metro", "county").agg(F.sum(count).cast("long").alias("ports"))
    return charging_coverage(by_area, counties, metro_population)


def read_strict_pairs(
    table: DataFrame, codes: DataFrame, geo_id: str, estimate: str, margin: str
) -> DataFrame:
    """(code, estimate, margin) of the wanted areas. A duplicate, absent, negative or
    non-finite entry stops the job."""
    require_columns(table, [geo_id, estimate, margin], "estimate table")
    code = F.when(F.trim(geo_id).startswith("310M"), F.right(F.trim(geo_id), F.lit(5)))
    rows = join_lookup(table.select(code.alias("code"), estimate, margin).where("code IS NOT NULL"),
                       codes.select("code"), ["code"], "left_semi")
    require_unique(rows, ["code"], estimate)
    require_keys(rows, codes, ["code"], estimate)
    return rows.select(
        "code",
        parsing.number_or_fail(F.col(estimate), estimate).alias(estimate),
        parsing.number_or_fail(F.col(margin), margin).alias(margin),
    )


def commute_ratio(minutes: DataFrame, workers: DataFrame, codes: DataFrame) -> DataFrame:
    """Mean commute = aggregate minutes / workers, both tables mandatory for every code."""
    a = read_strict_pairs(minutes, codes, "GEO_ID", "B08013_E001", "B08013_M001")
    b = read_strict_pairs(workers, codes, "GEO_ID", "B08303_E001", "B08303_M001")
    both = a.join(b, "code")
    ratio = F.when(F.col("B08303_E001") > 0, F.col("B08013_E001") / F.col("B08303_E001"))
    return both.withColumn(
        "mean_commute_minutes",
        F.coalesce(ratio, F.raise_error(F.lit("Commute denominator must be positive")).cast("double")),
    )


def inspect_margins(
    table: DataFrame, code: str, columns: Sequence[str], controlled: Sequence[str] = ()
) -> DataFrame:
    """(code, column, status, value) of estimates and margins; negatives stop the job."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns])
    long = table.select(F.col(code).alias("code"), F.explode(cells).alias("c")).select("code", "c.*")
    may = F.col("column").isin(list(controlled)) if controlled else F.lit(False)
    return long.select("code", "column", parsing.margin_status(F.col("text"), may).alias("s")).select(
        "code", "column", "s.status", "s.value"
    )


def market_estimates(tables: Mapping[str, tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """Inner join of the area-level rows of several tables; rows with any null drop out.

    ``tables`` maps a name to (table with GEO_ID, {output column: source column}).
    """
    joined = None
    for table, columns in tables.values():
        rows = table.select(
            parsing.area_code(F.trim("GEO_ID")).alias("code"),
            *[parsing.number_or_null(F.col(src)).alias(out) for out, src in columns.items()],
        ).where("code IS NOT NULL")
        joined = rows if joined is None else joined.join(rows, "code")
    return joined.dropna()


def merge_tracts(frames: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of tables with unique ``keys``; clashing columns get a suffix.

    One union and one aggregate instead of a chain of full joins: each input is
    shuffled once and rows of a key combine on the map side.
    """
    outputs, parts, seen = [], [], set(keys)
    renamed = {}
    for name, frame in frames.items():
        renamed[name] = {c: (f"{c}_{name}" if c in seen else c) for c in frame.columns if c not in keys}
        seen |= set(renamed[name].values())
        outputs += renamed[name].values()
    for name, frame in frames.items():
        parts.append(frame.select(*keys, *[F.col(c).alias(o) for c, o in renamed[name].items()],
                                  F.lit(name).alias("_source")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    merged = union.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in outputs],
        F.greatest(*[F.count_if(F.col("_source") == n) for n in frames], F.lit(0)).alias("_copies"),
    )
    unique = F.when(
        F.col("_copies") > 1, F.raise_error(F.lit("Repeated key in one of the tables")).cast("boolean")
    ).otherwise(F.lit(True))
    return merged.where(unique).drop("_copies")


def max_relative_margin(df: DataFrame, estimate: str, margin: str) -> DataFrame:
    return df.agg(F.max(F.col(margin) / F.nullif(F.col(estimate), F.lit(0))).alias("max_relative_margin"))


def flag_frequencies(df: DataFrame, measurement_flag: Column, completeness_flag: Column) -> DataFrame:
    blank = F.when(F.trim(measurement_flag) == "", "blank").otherwise(F.trim(measurement_flag))
    return df.groupBy(F.concat_ws("/", blank, F.trim(completeness_flag)).alias("flags")).agg(
        F.count(F.lit(1)).alias("n")
    )


def area_rollup(counties: DataFrame) -> DataFrame:
    """Per metro: land area in km² and the sorted distinct states of its counties."""
    return counties.groupBy("metro").agg(
        (F.sum("land_m2") / 1e6).alias("land_area_km2"),
        F.sort_array(F.collect_set("state")).alias("state_codes"),
        F.count(F.lit(1)).alias("member_counties"),
    )


# The road classes that count, by published class code.
FREEWAY_CLASSES = ("S1100", "S1630")
ARTERIAL_CLASSES = ("S1200",)
LOCAL_CLASSES = ("S1400", "S1640", "S1730")


def road_class(code: Column) -> Column:
    return (
        F.when(code.isin(*FREEWAY_CLASSES), "freeway")
        .when(code.isin(*ARTERIAL_CLASSES), "arterial")
        .when(code.isin(*LOCAL_CLASSES), "local")
    )


def is_road(flag: Column) -> Column:
    return F.upper(flag.cast("string")).isin("Y", "1", "TRUE")


def road_shares(edges: DataFrame, areas: DataFrame) -> DataFrame:
    """Length by class, class shares and density per land km²; all null without roads.

    ``edges`` has (metro, road_class, length_km), ``areas`` (metro, land_area_km2).
    """
    classes = ("freeway", "arterial", "local")
    lengths = edges.groupBy("metro").agg(
        *[F.sum(F.when(F.col("road_class") == c, F.col("length_km")).otherwise(0.0)).alias(f"{c}_km")
          for c in classes],
        F.count(F.lit(1)).alias("edge_count"),
    )
    total = F.col("freeway_km") + F.col("arterial_km") + F.col("local_km")
    usable = (F.col("total_km") > 0) & (F.col("land_area_km2") > 0)
    share = {"freeway": "freeway_share", "arterial": "arterial_share", "local": "local_road_share"}
    return (
        areas.join(lengths, "metro", "left").fillna(0, [f"{c}_km" for c in classes] + ["edge_count"])
        .withColumn("total_km", total)
        .select(
            "metro", "edge_count", "total_km",
            *[F.when(usable, F.col(f"{c}_km") / F.col("total_km")).alias(share[c]) for c in classes],
            F.when(usable, F.col("total_km") / F.col("land_area_km2")).alias("road_density_km_per_km2"),
        )
    )
