"""Small pieces the operators share: reading, sizing, words and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A to Z only; every other byte of UTF-8 stays as it is.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; bytes.split() cuts at space and \\x09-\\x0D exactly."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


def parts_for(rows: DataFrame, size: Column, per_part: int) -> int:
    """How many parts of about ``per_part`` the sum of ``size`` over all rows makes.

    Grows with the input and has no upper bound, so a part stays within a task's memory.
    """
    total = rows.agg(F.sum(size.cast("long")).alias("s")).first()["s"] or 0
    return int(max(1, -(-total // per_part)))


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours in a sorted array, and its length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))


def batches_of(schema: pa.Schema, rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_FINE = 100


def range_bounds(rows: DataFrame, key: str, parts: int) -> list[int]:
    """Rising values of the long column ``key``, the least first, that cut ``rows`` into about ``parts`` equal ranges."""
    shares = F.array(*[F.lit(i / parts) for i in range(parts)])
    found = rows.agg(F.percentile_approx(key, shares, F.lit(20 * parts + 1000)).alias("b"), F.min(key).alias("m")).first()
    return sorted({*(found["b"] or [0]), found["m"] or 0})


def range_of(bounds: list[int], key: Column) -> Column:
    """How many of the rising ``bounds`` are at most ``key``, looked up in two steps."""
    whole, coarse = F.array(*[F.lit(b).cast("long") for b in bounds]), F.array(*[F.lit(b).cast("long") for b in bounds[::_FINE]])
    step = F.greatest(F.size(F.filter(coarse, lambda b: b <= key)) - 1, F.lit(0))
    fine = F.slice(whole, step * _FINE + 1, F.lit(_FINE))
    return step * _FINE + F.size(F.filter(fine, lambda b: b <= key))
