"""Pool selection and group-disjoint splits."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Selection:
    """Settings of a curation run."""

    train_size: int = 2000
    val_size: int = 500
    max_per_group: int = 6
    near_duplicate_threshold: float = 0.93
    dedup_neighbors: int = 8
    seed: int = 42
    trials: int = 8000


def capped_pool(df: DataFrame, size: int, max_per_group: int, reward: str = "final_reward", tie: str = "index", group: str = "group") -> DataFrame:
    """The ``size`` best rows with at most ``max_per_group`` of a group. Groups cap on their own, so this equals a greedy walk by reward."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(reward), tie))
    return df.withColumn("__place", place).where(F.col("__place") <= max_per_group).orderBy(F.desc(reward), tie).limit(size).drop("__place")


def checked_size(df: DataFrame, size: int) -> DataFrame:
    found = df.count()
    if found != size:
        raise ValueError(f"only {found} rows are left, {size} are needed: raise max_per_group or lower the threshold")
    return df


def distribution(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def group_summary(df: DataFrame, reward: str = "final_reward", tie: str = "index") -> list:
    """Per group its first row, size, rewards and levels: as many rows as the bounded pool has groups."""
    levels = df.groupBy("group", "level").agg(F.count("*").alias("n")).groupBy("group").agg(F.collect_list(F.struct("level", "n")).alias("levels"))
    order = F.min(F.struct((-F.col(reward)).alias("r"), F.col(tie).alias("t"))).alias("first")
    rows = df.groupBy("group").agg(order, F.count("*").alias("n"), F.sum(reward).alias("reward")).join(levels, "group").orderBy("first")
    return rows.collect()


def _first_fits(orders: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """Which groups each order (a row of group numbers) takes when it goes along and takes what still fits into ``room``: a row of flags by group number."""
    taken = np.zeros(orders.shape, bool)
    left = np.full(len(orders), room)
    rows = np.arange(len(orders))
    for column in orders.T:
        fits = sizes[column] <= left
        left = left - np.where(fits, sizes[column], 0)
        taken[rows, column] = fits
    return taken


def misfits(taken: np.ndarray, sizes: np.ndarray, levels: np.ndarray, rewards: np.ndarray, mean: float, deviation: float) -> np.ndarray:
    """How unlike the whole pool the taken groups of each row are: relative errors of the level counts, plus the gap of mean rewards in standard deviations."""
    n = taken @ sizes
    expected = np.outer(n / sizes.sum(), levels.sum(axis=0))
    errors = (np.abs(taken @ levels - expected) / np.maximum(1.0, expected)).sum(axis=1)
    return errors + np.abs(taken @ rewards / n - mean) / max(deviation, 1e-8)


def group_split(pool: DataFrame, val_size: int, seed: int = 42, trials: int = 8000, reward: str = "final_reward", tie: str = "index") -> DataFrame:
    """``pool`` with ``split`` (train or validation): whole groups of exactly ``val_size`` rows go to validation.

    Of ``trials`` successive shuffles of the groups, each filled in order as far as groups fit, the first with the least misfit wins. Only one row
    for each group of the pool, whose size is a setting, comes to the driver. Raises ValueError if no shuffle fits.
    """
    groups = group_summary(pool, reward, tie)
    names = sorted({x["level"] for g in groups for x in g["levels"]}, key=str)
    sizes, rewards = np.asarray([g["n"] for g in groups], np.int64), np.asarray([g["reward"] for g in groups], float)
    levels = np.zeros((len(groups), len(names)))
    for k, g in enumerate(groups):
        for x in g["levels"]:
            levels[k, names.index(x["level"])] = x["n"]
    stats = pool.agg(F.avg(reward), F.stddev_pop(reward)).first()
    order, shuffle = list(range(len(groups))), random.Random(seed).shuffle
    least, best = math.inf, None
    for start in range(0, trials, 500):
        orders = np.empty((min(500, trials - start), len(groups)), np.int64)
        for row in orders:
            shuffle(order)
            row[:] = order
        taken = _first_fits(orders, sizes, val_size)
        exact = taken[(taken @ sizes == val_size) & taken.any(axis=1)]
        if len(exact):
            found = misfits(exact, sizes, levels, rewards, stats[0], stats[1])
            if found.min() < least:
                least, best = found.min(), exact[found.argmin()]
    if best is None:
        raise ValueError("no whole groups add up to the validation size: try another seed or max_per_group")
    held = [groups[k]["group"] for k in np.flatnonzero(best)]
    return pool.withColumn("split", F.when(F.col("group").isin(held), "validation").otherwise("train"))


def split_checks(split: DataFrame) -> DataFrame:
    """(what, overlap): groups, ids and message hashes that both splits hold; all 0 in a sound split."""
    parts = None
    for column in ("group", "id", "message_hash"):
        both = split.groupBy(F.col(column)).agg(F.countDistinct("split").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("overlap"))
        part = both.select(F.lit(column).alias("what"), "overlap")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def split_stats(split: DataFrame, reward: str = "final_reward") -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("group").alias("groups"), F.avg(reward).alias("mean_reward"))


def validated(split: DataFrame, settings: Selection) -> DataFrame:
    """``split``, or ValueError if sizes or disjointness do not hold."""
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    if (sizes.get("train", 0), sizes.get("validation", 0)) != (settings.train_size, settings.val_size):
        raise ValueError(f"split sizes are {sizes}")
    leaks = [r["what"] for r in split_checks(split).where("overlap > 0").collect()]
    if leaks:
        raise ValueError(f"both splits share values of {', '.join(leaks)}")
    return split
