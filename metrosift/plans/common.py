"""Reading the test tables, and the pieces several registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrosift.functions.shapes import SHAPE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r4(column: Column | str, places: int = 4) -> Column:
    """Doubles are compared by hash, so sums made in different orders are rounded.

    Adding 0.0 turns a rounded negative zero into zero.
    """
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, places) + F.lit(0.0)


def big(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("long")


def point_x(key: Column) -> Column:
    """Stand-in coordinates: keys scattered over a 100 x 100 square."""
    return F.pmod(key * 7919, F.lit(10007)) / 100.0


def point_y(key: Column) -> Column:
    return F.pmod(key * 104729, F.lit(10009)) / 100.0


def board(spark: SparkSession) -> DataFrame:
    """A boundary over the whole square with a hole in its middle, as one shape."""
    rings = [[(a, a), (b, a), (b, b), (a, b)] for a, b in ((0.0, 100.0), (40.0, 60.0))]
    return spark.createDataFrame([([rings],)], f"shape {SHAPE}")


#: The same in SQL: covered, and farther than 2 from every edge.
SQL_OFF_BORDER = """x > 2 AND x < 98 AND y > 2 AND y < 98
    AND sqrt(pow(greatest(40 - x, 0, x - 60), 2) + pow(greatest(40 - y, 0, y - 60), 2)) > 2"""


def sql_x(key: str) -> str:
    return f"((({key}) * 7919) % 10007) / 100.0"


def sql_y(key: str) -> str:
    return f"((({key}) * 104729) % 10009) / 100.0"
