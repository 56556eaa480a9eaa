"""Fail-closed checks: each looks for a violating row and stops the job if one exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """Input or result breaks a stated rule."""


def require_none(violations: DataFrame, message: str, show: int = 5) -> None:
    bad = violations.limit(show).collect()
    if bad:
        raise CheckFailed(f"{message}: {[row.asDict() for row in bad]}")


def require_columns(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise CheckFailed(f"{label} lacks columns {missing}")
    return df


def require_unique(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    require_none(repeated, f"Duplicate keys in {label}")
    return df


def require_keys(df: DataFrame, required: DataFrame, keys: list[str], label: str) -> DataFrame:
    require_none(required.select(*keys).join(df, keys, "left_anti"), f"Missing keys in {label}")
    return df


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Multiset equality of two tables with the same columns."""
    columns = a.columns
    return a.exceptAll(b.select(*columns)).isEmpty() and b.select(*columns).exceptAll(a).isEmpty()


def fail_when(condition: Column, message: Column | str, otherwise: Column) -> Column:
    """``otherwise``, but the job stops on a row where ``condition`` holds."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.raise_error(text)).otherwise(otherwise)
