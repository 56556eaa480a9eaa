"""Parsing and cleaning of source columns. Missing is never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrosift.operators.checks import fail_when

# The published codes these rules must agree with.
CONTROLLED_TOTAL_MARGIN = -555555555
USABLE_MEASUREMENT_FLAGS = ["", "X"]
USABLE_COMPLETENESS_FLAGS = ["S", "R", "P", "E"]
AREA_ROW_PATTERN = r"^310M\d{3}US\d{5}$"
COUNTY_ROW_PREFIX = "0500000US"
TRACT_ROW_PREFIX = "1400000US"


def _double(col: Column) -> Column:
    return col.try_cast("double")


def finite(col: Column) -> Column:
    """Null for NaN and the infinities."""
    bad = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(~bad, col)


def number_or_null(col: Column) -> Column:
    """A finite value >= 0; text that is no number, and negative sentinels, become null."""
    value = finite(_double(col))
    return F.when(value >= 0, value)


def number_or_fail(col: Column, label: str) -> Column:
    value = number_or_null(col)
    return fail_when(value.isNull(), f"Missing or suppressed estimate: {label}", value)


def published_normal(value: Column, measurement_flag: Column, completeness_flag: Column) -> Column:
    """A reported climate normal, or null when its flags rule it out. Reported zero stays zero.

    An absent completeness flag is accepted, a blank one is not.
    """
    measured = F.trim(F.coalesce(measurement_flag, F.lit(""))).isin(USABLE_MEASUREMENT_FLAGS)
    complete = completeness_flag.isNull() | F.trim(completeness_flag).isin(
        USABLE_COMPLETENESS_FLAGS
    )
    return F.when(measured & complete, number_or_null(F.trim(value)))


def margin_status(margin: Column, may_be_controlled: bool | Column) -> Column:
    """Struct(status, value) of a margin of error; a negative margin stops the job."""
    value = _double(margin)
    allowed = may_be_controlled if isinstance(may_be_controlled, Column) else F.lit(may_be_controlled)
    controlled = allowed & (value == CONTROLLED_TOTAL_MARGIN)
    bad = value.isNull() | ((value < 0) & ~controlled)
    return F.struct(
        fail_when(
            bad, "Missing or invalid margin of error",
            F.when(controlled, "controlled_total").otherwise("reported"),
        ).alias("status"),
        F.when(~controlled, value.cast("long")).alias("value"),
    )


def area_code(geo_id: Column) -> Column:
    """Five-digit metro code of an area-level row, else null."""
    return F.when(geo_id.rlike(AREA_ROW_PATTERN), F.right(geo_id, F.lit(5)))


def county_code(geo_id: Column) -> Column:
    start = len(COUNTY_ROW_PREFIX) + 1
    return F.when(geo_id.startswith(COUNTY_ROW_PREFIX), F.substring(geo_id, start, 5))


def tract_code(geo_id: Column) -> Column:
    start = len(TRACT_ROW_PREFIX) + 1
    return F.when(geo_id.startswith(TRACT_ROW_PREFIX), F.substring(geo_id, start, 20))


def tract_key(state: Column, county: Column, tract: Column) -> Column:
    return F.concat(F.lpad(state, 2, "0"), F.lpad(county, 3, "0"), F.lpad(tract, 6, "0"))


def canonical_id(code: Column) -> Column:
    """``12345`` and ``cbsa:12345`` both become ``cbsa:12345``; anything else stops the job."""
    ok = code.rlike(r"^(cbsa:)?\d{5}$")
    return fail_when(
        ~F.coalesce(ok, F.lit(False)),
        F.concat(F.lit("Invalid area code: "), F.coalesce(code, F.lit("null"))),
        F.concat(F.lit("cbsa:"), F.right(code, F.lit(5))),
    )


def total_ports(ports: Column) -> Column:
    """Sum of an array of port counts given as text; entries that are no integer add nothing."""
    return F.aggregate(
        F.transform(F.coalesce(ports, F.array().cast("array<string>")), lambda p: p.try_cast("int")),
        F.lit(0),
        lambda total, p: total + F.coalesce(p, F.lit(0)),
    )


def first_present(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate name the table has, compared without case."""
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def at_most_two_decimals(price: Column) -> Column:
    cents = price.cast("decimal(18,6)") * 100
    return cents == F.floor(cents)
