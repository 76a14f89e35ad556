"""Epoch orders: permutations that can be inverted, the same on any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import epochs


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 10, 97, 100, 1000, 4097, 50_000])
def test_each_row_has_a_place_of_its_own(rows):
    orders = [epochs.Permutation(rows, seed, epoch) for seed, epoch in ((42, 0), (42, 1), (7, 0))]
    for order in orders:
        places = order.position(np.arange(rows))
        assert sorted(places.tolist()) == list(range(rows))
        assert order.number(places).tolist() == list(range(rows))
    if rows >= 97:
        first, second, third = (o.position(np.arange(rows)) for o in orders)
        assert (first == second).mean() < 0.1 and (first == third).mean() < 0.1 and (first == np.arange(rows)).mean() < 0.1


def test_places_are_spread():
    """Neighbours do not stay together: the mean distance of their places is about a third of all."""
    places = epochs.Permutation(30_000, 1, 3).position(np.arange(30_000))
    assert 0.3 < np.abs(np.diff(places)).mean() / 30_000 < 0.37


@pytest.mark.parametrize("rows, world", [(103, 4), (100, 4), (3, 8), (1, 5)])
def test_ranks_take_turns_on_any_partitioning(spark, rows, world):
    frames = []
    for parts in (1, 4, 32):
        df = spark.range(rows).withColumnRenamed("id", "number").repartition(parts)
        frames.append(sorted(map(tuple, epochs.epoch(df, rows, seed=42, epoch=2, world=world).select("position", "rank", "place", "number").collect())))
    assert frames[0] == frames[1] == frames[2]
    order = epochs.Permutation(rows, 42, 2).number(np.arange(rows)).tolist()
    total = -(-rows // world) * world
    padded = (order * (total // rows + 1))[:total]
    assert frames[0] == [(p, p % world, p // world, padded[p]) for p in range(total)]
    kept = epochs.epoch(spark.range(rows).withColumnRenamed("id", "number"), rows, seed=42, epoch=2, world=world, drop_last=True)
    assert sorted(r["position"] for r in kept.collect()) == list(range(rows // world * world))


def test_a_run_goes_on_where_it_stopped(spark):
    df = spark.range(50).withColumnRenamed("id", "number")
    whole = epochs.epoch(df, 50, seed=1, epoch=0, world=2)
    done = {(r["rank"], r["place"]): r["number"] for r in whole.collect()}
    rest = epochs.epoch(df, 50, seed=1, epoch=0, world=2).where(F.col("place") >= 20)
    assert {(r["rank"], r["place"]): r["number"] for r in rest.collect()} == {k: v for k, v in done.items() if k[1] >= 20}


def test_schedules():
    assert epochs.schedule(11_793, 8, 1, 0.03) == (1475, 44) and epochs.schedule(0, 8, 3, 0.1) == (1, 0)
