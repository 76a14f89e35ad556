"""Profiles of any table: missing values, numeric statistics, a text of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranks


def _absent(df: DataFrame, name: str):
    column = F.col(f"`{name}`")
    return column.isNull() | F.isnan(column) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else column.isNull()


def missing_counts(df: DataFrame, top: int = 20) -> DataFrame:
    """(column, n_missing) of columns that miss values, most first, in one pass over ``df``."""
    counts = df.agg(*(F.count(F.when(_absent(df, c), 1)).alias(c) for c in df.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_missing")) for c in df.columns))
    return counts.select(F.inline(pairs)).where("n_missing > 0").orderBy(F.desc("n_missing"), "column").limit(top)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


_STATISTICS = "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
_QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, most: int = 30, few: bool = False) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) of up to ``most`` numeric columns, to 4 decimals; quartiles are exact.

    They come from counts alone (``ranks.quantiles``), so a table may have any number of rows. ``few``: the table is known to be small, such as an upload that is cut to 10,000 rows, and one aggregate holds its values.
    """
    names = numeric_columns(df)[:most]
    if not names:
        return df.sparkSession.createDataFrame([], _STATISTICS)
    points = {} if few else ranks.quantiles(df, names, _QUARTILES)

    def of(name: str):
        value = F.when(~_absent(df, name), F.col(f"`{name}`").cast("double"))
        point = F.percentile(value, F.array(*map(F.lit, _QUARTILES))) if few else F.array(*(F.lit(p).cast("double") for p in points[name]))
        return F.struct(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), point.alias("p"), F.max(value).alias("max"))

    one = df.agg(*(of(n).alias(n) for n in names))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("s")) for n in names))).alias("r"))
    r4 = lambda c, n: F.round(c, 4).alias(n)
    return rows.select("r.column", "r.s.count", r4(F.col("r.s.mean"), "mean"), r4(F.col("r.s.std"), "std"), r4(F.col("r.s.min"), "min"), r4(F.col("r.s.p")[0], "p25"), r4(F.col("r.s.p")[1], "p50"), r4(F.col("r.s.p")[2], "p75"), r4(F.col("r.s.max"), "max"))


def total_missing(df: DataFrame) -> DataFrame:
    return df.agg(sum((F.count(F.when(_absent(df, c), 1)) for c in df.columns), F.lit(0)).cast("long").alias("n_missing"))


def context_text(df: DataFrame, name: str, encoding: str, limit: int = 14_000) -> str:
    """What a reader should know of an upload: shape, types, missing values, statistics, first rows; at most ``limit`` code points."""
    rows, missing = df.count(), missing_counts(df).collect()
    lines = ["Uploaded dataset summary (computed locally, not generated):", f"- File: {name}", f"- Parsed encoding: {encoding}", f"- Loaded shape: {rows} rows x {len(df.columns)} columns", "", "Columns and dtypes:"]
    lines += [f"{f.name} {f.dataType.simpleString()}" for f in df.schema]
    lines += ["", "Missing-value counts (non-zero, top 20):", *([f"{r['column']} {r['n_missing']}" for r in missing] or ["None"]), "", "Numeric descriptive statistics (up to 30 columns):"]
    stats = describe(df, few=True).collect()
    lines += [" ".join(str(v) for v in r) for r in stats] or ["No numeric columns"]
    lines += ["", "First 8 rows:", ",".join(df.columns), *(",".join("" if v is None else str(v) for v in r) for r in df.limit(8).collect())]
    return "\n".join(lines)[:limit]
