"""Exact quantiles of many columns at once, by distributed selection.

Doubles become integers of the same order. The value of a rank is then found digit by digit from the top: each round counts, for every rank that is sought, the next digit of the values that share the digits found so far, and goes on
in the digit where the counts reach the rank. Only counts are shuffled, at most ``2 ** DIGIT`` for each rank and round, however many rows and different values there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import discard, written

#: Bits of a digit.
DIGIT = 11
_SIGN = np.uint64(1 << 63)


def to_keys(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; both zeros are one."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_keys(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.uint64)
    return np.where(keys & _SIGN, keys & ~_SIGN, ~keys).view(np.float64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns, keys = [], []
        for k, column in enumerate(batch.columns):
            values = column.drop_null().to_numpy(zero_copy_only=False)
            values = values[~np.isnan(values)]
            columns.append(np.full(len(values), k, np.int32))
            keys.append(to_keys(values).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(columns)), pa.array(np.concatenate(keys))], names=["column", "key"])


def _selected(keys: DataFrame, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Values of (column, rank) among ``keys`` (column, key)."""
    spark = keys.sparkSession
    # Each sought (column, rank): digits found, and the rank among the values that share them.
    state = {target: (0, target[1]) for target in wanted}
    shift = 64
    while shift:
        width = min(DIGIT, shift)
        shift -= width
        places = sorted({(column, found, rank) for (column, _), (found, rank) in state.items()})
        sought = F.broadcast(spark.createDataFrame([(c, _signed(f), r) for c, f, r in places], "column int, found long, rank long"))
        above = shift + width
        prefix = F.lit(0).cast("long") if above == 64 else F.shiftrightunsigned("key", above)
        digit = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << width) - 1))
        counts = keys.select("column", prefix.alias("found"), digit.alias("digit")).join(F.broadcast(sought.select("column", "found").distinct()), ["column", "found"]).groupBy("column", "found", "digit").count()
        up_to = F.sum("count").over(Window.partitionBy("column", "found").orderBy("digit"))
        hit = counts.select("column", "found", "digit", (up_to - F.col("count")).alias("low"), up_to.alias("high")).join(sought, ["column", "found"]).where("low <= rank AND rank < high")
        steps = {(r["column"], r["found"], r["rank"]): (r["digit"], r["rank"] - r["low"]) for r in hit.collect()}
        for target, (found, rank) in state.items():
            step, rest = steps[target[0], _signed(found), rank]
            state[target] = ((found << width) | step, rest)
    return {target: float(from_keys(np.array([found], np.uint64))[0]) for target, (found, _) in state.items()}


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def quantiles(df: DataFrame, names: Sequence[str], points: Sequence[float]) -> dict[str, list[float | None]]:
    """For each numeric column its exact quantiles at ``points``, interpolated between neighbours; None for a column without values. Nulls and NaN count for nothing.

    The driver sees two values for each column and point.
    """
    if not names or not points:
        return {name: [] for name in names}
    chosen = df.select(*(F.col(f"`{n}`").cast("double").alias(f"c{k}") for k, n in enumerate(names)))
    keys = written(chosen.mapInArrow(_keyed, "column int, key long"), "rank-keys")
    sizes = {r["column"]: r["count"] for r in keys.groupBy("column").count().collect()}
    places = {(k, p): (p * (sizes[k] - 1)) for k in sizes for p in points}
    found = _selected(keys, {(k, f(at)) for (k, _), at in places.items() for f in (math.floor, math.ceil)}) if sizes else {}
    discard(keys)

    def value(k: int, p: float) -> float | None:
        if k not in sizes:
            return None
        at = places[k, p]
        low, high = found[k, math.floor(at)], found[k, math.ceil(at)]
        return low if low == high else low + (high - low) * (at - math.floor(at))

    return {name: [value(k, p) for p in points] for k, name in enumerate(names)}
