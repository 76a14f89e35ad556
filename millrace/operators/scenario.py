"""Seeded scenario simulation of the contribution profit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import narratives as N
from millrace.functions.text import filled, money, percent, stable_fraction

from .commerce import ADS, PROFIT, REVENUE

#: Standard deviations of demand, cost of advertising and returns; least variable margin.
SPREAD = {"demand": 0.07, "ads": 0.05, "returns": 0.06}
LEAST_MARGIN = 0.05


def normal(trial: Column, salt: str) -> Column:
    """A standard normal number for each trial, by Box and Muller from two stable fractions."""
    one, two = stable_fraction(trial, f"{salt}-1"), stable_fraction(trial, f"{salt}-2")
    return F.sqrt(-2 * F.log(1 - one)) * F.cos(2 * math.pi * two)


def base_figures(df: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    return df.agg(total(REVENUE).alias("revenue"), total(PROFIT).alias("profit"), total(ADS).alias("ads"), total(F.when(F.col("is_return"), F.abs(REVENUE))).alias("returns"))


def simulate(df: DataFrame, demand_pct: float, ad_cost_pct: float, return_pct: float, trials: int = 1500) -> DataFrame:
    """(trial, profit) for each trial: a change of demand at the variable margin, dearer advertising, more returns."""
    base = base_figures(df)
    drawn = lambda name, pct: 1 + pct / 100 + SPREAD[name] * normal(F.col("trial"), name)
    runs = df.sparkSession.range(trials).withColumnRenamed("id", "trial").crossJoin(F.broadcast(base))
    margin = F.greatest((F.col("profit") + F.col("ads")) / F.greatest(F.col("revenue"), F.lit(1.0)), F.lit(LEAST_MARGIN))
    profit = F.col("profit") + F.col("revenue") * (drawn("demand", demand_pct) - 1) * margin - F.col("ads") * (drawn("ads", ad_cost_pct) - 1) - F.col("returns") * (drawn("returns", return_pct) - 1)
    return runs.select("trial", profit.alias("profit"))


def quantiles(runs: DataFrame) -> DataFrame:
    """One row: 5, 50 and 95 percent points, exact, and the share of losses."""
    p = lambda q: F.percentile("profit", q)
    return runs.agg(p(0.05).alias("p5"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.avg((F.col("profit") < 0).cast("int")).alias("loss_probability"), F.count("*").alias("trials"))


def summary(points: DataFrame, language: str = N.ENGLISH) -> DataFrame:
    """One sentence over the one row of ``quantiles``."""
    values = {"trials": F.format_number("trials", 0), "p5": money(F.col("p5")), "p50": money(F.col("p50")), "p95": money(F.col("p95")), "loss": percent(F.col("loss_probability"), 1)}
    return points.select(filled(N.SIMULATED[language], values).alias("summary"))


def histogram(runs: DataFrame, bins: int = 45) -> DataFrame:
    """(bin from 1, low, high, n) over equal widths from the least to the greatest profit; empty bins have no row."""
    whole = Window.partitionBy()
    ranged = runs.withColumn("least", F.min("profit").over(whole)).withColumn("width", (F.max("profit").over(whole) - F.min("profit").over(whole)) / bins)
    number = F.when(F.col("width") > 0, F.least(F.floor((F.col("profit") - F.col("least")) / F.col("width")) + 1, F.lit(bins))).otherwise(1)
    return ranged.groupBy(number.cast("long").alias("bin"), "least", "width").agg(F.count("*").alias("n")).select("bin", (F.col("least") + (F.col("bin") - 1) * F.col("width")).alias("low"), (F.col("least") + F.col("bin") * F.col("width")).alias("high"), "n")
