"""The order in which a training run meets its rows, without a shuffle of the rows.

A keyed permutation of row numbers says for every row by itself where it stands in an epoch: no sort, no state, the same on any partitioning, and it can be inverted, so a run can go on at any step. The permutation
is a Feistel network over pairs (a, b) of about equal ranges whose product is just above the number of rows; a number that leaves the rows is permuted again until it is back among them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8


def _mixed(values: np.ndarray, key: int) -> np.ndarray:
    """Numbers spread over 64 bits by ``key``."""
    x = values.astype(np.uint64) + np.uint64(key & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A permutation of 0 to ``rows`` - 1 that ``seed`` and ``epoch`` decide."""

    def __init__(self, rows: int, seed: int, epoch: int) -> None:
        self.rows = rows
        self.high = max(1, math.isqrt(rows))
        self.low = -(-rows // self.high) if rows else 1
        self.keys = [(seed * 0x9E3779B97F4A7C15 + epoch * 0xD1B54A32D192ED03 + k * 0x8CB92BA72F3D8DD7) & (2**64 - 1) for k in range(ROUNDS)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        a, b = np.divmod(x, self.low)
        for k, key in enumerate(self.keys):
            if k % 2:
                b = (b + (_mixed(a, key) % np.uint64(self.low)).astype(np.int64)) % self.low
            else:
                a = (a + (_mixed(b, key) % np.uint64(self.high)).astype(np.int64)) % self.high
        return a * self.low + b

    def _back(self, x: np.ndarray) -> np.ndarray:
        a, b = np.divmod(x, self.low)
        for k, key in reversed(list(enumerate(self.keys))):
            if k % 2:
                b = (b - (_mixed(a, key) % np.uint64(self.low)).astype(np.int64)) % self.low
            else:
                a = (a - (_mixed(b, key) % np.uint64(self.high)).astype(np.int64)) % self.high
        return a * self.low + b

    def _within(self, step, x) -> np.ndarray:
        out = step(np.asarray(x, np.int64))
        while (outside := out >= self.rows).any():
            out[outside] = step(out[outside])
        return out

    def position(self, number) -> np.ndarray:
        """Where rows of these numbers stand."""
        return self._within(self._once, number)

    def number(self, position) -> np.ndarray:
        """Which rows stand there."""
        return self._within(self._back, position)


def position(number: Column, rows: int, seed: int, epoch: int) -> Column:
    """The place of each row number in an epoch over ``rows`` rows."""
    order = Permutation(rows, seed, epoch)

    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(order.position(numbers.to_numpy()))

    return F.pandas_udf(placed, "long")(number.cast("long"))


def epoch(numbered: DataFrame, rows: int, *, seed: int, epoch: int, world: int = 1, drop_last: bool = False, number: str = "number") -> DataFrame:
    """``numbered`` rows (``number``: 0 to ``rows`` - 1) with ``position``, ``rank`` and ``place`` in an epoch of ``world`` ranks, which take positions in turn.

    Ranks get equally many: the rows of the first positions stand at its end once more, or with ``drop_last`` those of the last positions nowhere. A run that stopped after ``n`` rows of each rank goes on at ``place >= n``.
    """
    found = numbered.withColumn("position", position(F.col(number), rows, seed, epoch))
    if drop_last:
        found = found.where(F.col("position") < rows // world * world)
    elif rows % world:
        extra = world - rows % world
        again = F.sequence(F.lit(0), F.lit(extra // rows + 1))
        turns = found.select(*numbered.columns, "position", F.explode(again).alias("__turn"))
        found = turns.withColumn("position", F.col("position") + F.col("__turn") * rows).where(F.col("position") < rows + extra).drop("__turn")
    return found.withColumns({"rank": F.pmod(F.col("position"), F.lit(world)).cast("int"), "place": F.floor(F.col("position") / world).cast("long")})


def schedule(batches: int, accumulation: int, epochs: int, warmup_ratio: float) -> tuple[int, int]:
    """Optimizer steps of a run, at least one, and how many of them warm up."""
    steps = max(1, -(-batches // accumulation) * epochs)
    return steps, int(steps * warmup_ratio)
