"""The scored-feature registries and their transforms."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrosift.operators.checks import CheckFailed

PILLARS = ("familiarity", "readiness", "opportunity")


@dataclass(frozen=True)
class FeatureSpec:
    key: str
    label: str
    pillar: str
    unit: str
    transform: str
    weight: float
    maximum: float | None = None


# The two published registries, in their order; key, label, pillar, unit, transform, weight, maximum.
TEN_FEATURES = (
    FeatureSpec("annual_precipitation_mm", "Annual precipitation", "familiarity", "mm/year", "log1p", 0.2, None),
    FeatureSpec("annual_snowfall_mm", "Annual snowfall", "familiarity", "mm/year", "log1p", 0.2, None),
    FeatureSpec("hot_days_32c", "Days at or above 90°F", "familiarity", "days/year", "linear", 0.2, 366.0),
    FeatureSpec("mean_commute_minutes", "Mean commute", "familiarity", "minutes", "linear", 0.4, None),
    FeatureSpec("public_dc_ports_per_100k", "Public DC charging", "readiness", "ports/100k residents", "log1p", 0.7, None),
    FeatureSpec("population_share_in_counties_with_dc", "County charging coverage", "readiness", "fraction", "linear", 0.3, 1.0),
    FeatureSpec("population", "Resident population", "opportunity", "residents", "log1p", 0.3, None),
    FeatureSpec("population_density_per_km2", "Population density", "opportunity", "residents/km²", "log1p", 0.25, None),
    FeatureSpec("zero_vehicle_household_share", "Zero-vehicle households", "opportunity", "fraction", "linear", 0.3, 1.0),
    FeatureSpec("transit_commute_share", "Transit commute share", "opportunity", "fraction", "linear", 0.15, 1.0),
)
FIFTEEN_FEATURES = (
    FeatureSpec("annual_precipitation_mm", "Annual precipitation", "familiarity", "mm/year", "log1p", 0.1, None),
    FeatureSpec("annual_snowfall_mm", "Annual snowfall", "familiarity", "mm/year", "log1p", 0.1, None),
    FeatureSpec("hot_days_32c", "Days at or above 90°F", "familiarity", "days/year", "linear", 0.1, 366.0),
    FeatureSpec("mean_commute_minutes", "Mean commute", "familiarity", "minutes", "linear", 0.2, None),
    FeatureSpec("road_density_km_per_km2", "Road density", "familiarity", "km/km2", "log1p", 0.1, None),
    FeatureSpec("intersection_density_per_km2", "Intersection density", "familiarity", "intersections/km2", "log1p", 0.1, None),
    FeatureSpec("freeway_share", "Freeway share", "familiarity", "fraction", "linear", 0.1, 1.0),
    FeatureSpec("arterial_share", "Arterial share", "familiarity", "fraction", "linear", 0.1, 1.0),
    FeatureSpec("local_road_share", "Local road share", "familiarity", "fraction", "linear", 0.1, 1.0),
    FeatureSpec("public_dc_ports_per_100k", "Public DC charging", "readiness", "ports/100,000 persons", "log1p", 0.7, None),
    FeatureSpec("population_share_in_counties_with_dc", "County charging coverage", "readiness", "fraction of CBSA population", "linear", 0.3, 1.0),
    FeatureSpec("population", "Resident population", "opportunity", "persons", "log1p", 0.3, None),
    FeatureSpec("population_density_per_km2", "Population density", "opportunity", "persons/km2", "log1p", 0.25, None),
    FeatureSpec("zero_vehicle_household_share", "Zero-vehicle households", "opportunity", "fraction of households", "linear", 0.3, 1.0),
    FeatureSpec("transit_commute_share", "Transit commute share", "opportunity", "fraction of workers 16+", "linear", 0.15, 1.0),
)
# Reported but never scored, the default weights, and the shares that add up to one.
UNSCORED_UNITS = {"average_aadt": "vehicles/day", "lane_miles_per_km2": "lane-miles/km2"}
DEFAULT_WEIGHTS = {"familiarity": 0.4, "readiness": 0.2, "opportunity": 0.4}
ROAD_SHARES = ("freeway_share", "arterial_share", "local_road_share")

TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "linear": lambda value: value,
    "log1p": lambda value: F.log1p(value),
}


def check_registry(specs: Iterable[FeatureSpec], size: int | None = None) -> tuple[FeatureSpec, ...]:
    """Unique keys, known transforms and, per pillar, positive weights summing to one."""
    specs = tuple(specs)
    keys = [s.key for s in specs]
    if len(set(keys)) != len(keys) or (size is not None and len(keys) != size):
        raise CheckFailed(f"Registry must hold {size or 'only'} unique features")
    unknown = {s.transform for s in specs} - TRANSFORMS.keys()
    if unknown:
        raise CheckFailed(f"Unsupported transforms: {sorted(unknown)}")
    for pillar in PILLARS:
        weights = [s.weight for s in specs if s.pillar == pillar]
        if not weights or min(weights) <= 0 or not math.isclose(sum(weights), 1.0, abs_tol=1e-12):
            raise CheckFailed(f"{pillar} weights must be positive and sum to 1")
    return specs


def load_registry(spark: SparkSession, path: str, size: int | None = 15) -> tuple[FeatureSpec, ...]:
    """Read and check a registry file with a ``features`` list."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    fields = FeatureSpec.__dataclass_fields__
    return check_registry(
        (FeatureSpec(**{k: v for k, v in row.items() if k in fields})
         for row in json.loads(text)["features"]),
        size,
    )


def registry_table(spark: SparkSession, specs: Iterable[FeatureSpec]) -> DataFrame:
    rows = [
        (i, s.key, s.label, s.pillar, s.unit, s.transform, float(s.weight), s.maximum)
        for i, s in enumerate(specs)
    ]
    return spark.createDataFrame(
        rows,
        "position int, key string, label string, pillar string, unit string, "
        "transform string, weight double, maximum double",
    )


def transformed(value: Column, transform: str) -> Column:
    """One declared transform. Null stays null; a non-finite value, or a negative one
    under log1p, stops the job instead of being repaired."""
    if transform not in TRANSFORMS:
        raise CheckFailed(f"Unknown transform: {transform}")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    if transform == "log1p":
        bad = bad | (value < 0)
    return F.when(bad, F.raise_error(F.lit(f"Value outside the domain of {transform}"))).otherwise(
        TRANSFORMS[transform](value)
    )


def transformed_by(value: Column, transform: Column) -> Column:
    """The same with the transform named by a column (long tables)."""
    out = F.when(value.isNull(), F.lit(None).cast("double"))
    for name in TRANSFORMS:
        out = out.when(transform == name, transformed(value, name))
    return out.otherwise(F.raise_error(F.lit("Unknown transform")))


def normalized(value: Column, lower, upper) -> Column:
    """Min-max of an already transformed value, clipped to [0, 1]; null when constant."""
    lower = lower if isinstance(lower, Column) else F.lit(float(lower))
    upper = upper if isinstance(upper, Column) else F.lit(float(upper))
    share = (value - lower) / (upper - lower)
    return (
        F.when(lower > upper, F.raise_error(F.lit("Invalid normalization bounds")))
        .when(lower < upper, F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))))
    )


def transform_sql(spec: FeatureSpec) -> str:
    """``transformed`` of the key's own column as SQL text, for wide tables.

    They evaluate tens of these, and text crosses to the JVM in one call.
    """
    v = f"cast(`{spec.key}` AS DOUBLE)"
    bad, out = f"isnan({v}) OR abs({v}) = double('infinity')", v
    if spec.transform == "log1p":
        bad, out = f"{bad} OR {v} < 0", f"log1p({v})"
    elif spec.transform != "linear":
        raise CheckFailed(f"Unknown transform: {spec.transform}")
    return f"CASE WHEN {bad} THEN raise_error('Value outside the domain of {spec.transform}') ELSE {out} END"


def normal_sql(spec: FeatureSpec, lower: float, upper: float) -> str:
    """``normalized(transformed(column))`` as SQL text; ``lower < upper``."""
    return (
        f"CASE WHEN `{spec.key}` IS NOT NULL THEN least(1D, greatest(0D, "
        f"({transform_sql(spec)} - {lower!r}D) / ({upper!r}D - {lower!r}D))) END"
    )
