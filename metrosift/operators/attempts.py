"""Exact attempt caps: only accepted attempts count against later ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrosift.operators.ordered import SLICE, SLOT, lay_out
from metrosift.session import stage

_OUT = f"{SLICE} long, {SLOT} long, accepted boolean, last_key string, recent array<long>"


def accept_capped(attempts: DataFrame, key: str, time: str, tie: str, seconds: int, cap: int) -> DataFrame:
    """Add ``accepted``: fewer than ``cap`` accepted attempts of the key in (t - seconds, t).

    An acceptance depends on the acceptances before it, so it is a fold, not a window.
    Rows are range-partitioned by (key, time, tie); every slice folds its rows in order
    holding at most ``cap`` times, first as if nothing preceded it. A slice whose
    predecessor ends with live acceptances of the same key is folded again with them,
    until no slice's start changes. The window forgets quickly, so two passes are usual,
    and a hot key is folded by as many tasks as it has slices. A boolean column
    ``given`` marks attempts accepted earlier.
    """
    rows = attempts if "given" in attempts.columns else attempts.withColumn("given", F.lit(False))
    laid = lay_out(rows, [F.col(key), F.col(time), ~F.col("given"), F.col(tie)])
    slim = laid.select(SLICE, SLOT, F.col(key).cast("string").alias("k"),
                       F.unix_micros(F.col(time).cast("timestamp")).alias("t"), "given")
    window = seconds * 1_000_000

    def fold(carried: dict):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            piece, name, recent = None, None, []

            def summary():
                return pd.DataFrame({SLICE: [piece], SLOT: [None], "accepted": [None],
                                     "last_key": [name], "recent": [recent]})

            for pdf in batches:
                verdicts = []
                for s, k, t, given in zip(pdf[SLICE], pdf["k"], pdf["t"], pdf["given"]):
                    if s != piece:
                        if piece is not None:
                            yield summary()
                        piece = s
                        name, recent = carried.get(s, (None, []))
                        recent = list(recent)
                    if k != name:
                        name, recent = k, []
                    recent = [x for x in recent if x > t - window]
                    ok = bool(given) or len(recent) < cap
                    if ok:
                        recent.append(t)
                    verdicts.append(ok)
                yield pd.DataFrame({SLICE: pdf[SLICE], SLOT: pdf[SLOT], "accepted": verdicts,
                                    "last_key": None, "recent": None})
            if piece is not None:
                yield summary()

        return run

    firsts = slim.groupBy(SLICE).agg(F.min_by("k", SLOT).alias("k")).collect()  # one row per slice
    first_key = {r[SLICE]: r["k"] for r in firsts}
    ends: dict[int, tuple] = {}
    used: dict[int, tuple] = {}
    outputs: list[tuple[DataFrame, set]] = []
    todo: set | None = None
    while True:
        part = slim if todo is None else slim.where(F.col(SLICE).isin(sorted(todo)))
        ordered = part.repartition(SLICE).sortWithinPartitions(SLICE, SLOT)
        result = stage(ordered.mapInPandas(fold(dict(used)), _OUT), "attempts")
        # One summary row per slice, each with at most cap times.
        heads = result.where(F.col(SLOT).isNull()).select(SLICE, "last_key", "recent").collect()
        for h in heads:
            ends[h[SLICE]] = (h["last_key"], list(h["recent"]))
        outputs.append((result, {h[SLICE] for h in heads}))
        order = sorted(ends)
        starts = {s: ends[p] for p, s in zip(order, order[1:])}
        todo = {s for s, c in starts.items() if first_key[s] == c[0] and used.get(s) != c}
        if not todo:
            break
        used.update({s: starts[s] for s in todo})
    final: dict[int, int] = {}
    for i, (_, slices) in enumerate(outputs):
        final.update({s: i for s in slices})
    verdicts = None
    for i, (result, _) in enumerate(outputs):
        mine = sorted(s for s, j in final.items() if j == i)
        if not mine:
            continue
        part = result.where(F.col(SLOT).isNotNull() & F.col(SLICE).isin(mine)).select(SLOT, "accepted")
        verdicts = part if verdicts is None else verdicts.unionByName(part)
    if verdicts is None:
        return laid.drop(SLICE, SLOT).withColumn("accepted", F.lit(None).cast("boolean"))
    return laid.join(verdicts, SLOT).drop(SLICE, SLOT)
