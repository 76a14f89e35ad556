"""Rows that are moved once, and outputs that are packed where that is asked for."""

import gzip
from pathlib import Path

from pyspark.sql import functions as F

from millrace.operators import commerce
from millrace.operators.trajectory import global_rank
from millrace.plans import preparation
from millrace.sources import readers

from .test_preparation import _RAW, plain, raw_rows


def test_ranks_move_rows_once(spark):
    """Ranks are those of one sort, and no exchange follows that by range."""
    df = spark.range(0, 3000, 1, 6).select(F.pmod(F.xxhash64("id"), F.lit(500)).alias("v"), "id")
    ranked = global_rank(df, F.col("v").asc(), F.col("id").desc())
    rows = ranked.collect()
    wanted = sorted(((r.v, -r.id) for r in rows))
    assert [(r.v, -r.id) for r in sorted(rows, key=lambda r: r["__rank"])] == wanted and sorted(r["__rank"] for r in rows) == list(range(3000)) and {r["__rows"] for r in rows} == {3000}
    plan = ranked._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan.split("__rank", 1)[1].split("Join", 1)[0] and plan.count("row_number") == 0
    assert global_rank(df.limit(0), F.col("v").asc()).count() == 0


def test_packed_marts_hold_the_same(spark, tmp_path):
    raw = spark.createDataFrame(raw_rows(), _RAW)
    for name, how in (("plain", "none"), ("packed", "gzip")):
        preparation.run(spark, raw, f"file://{tmp_path}/{name}", rows=None, compression=how)
    parts = sorted(Path(tmp_path, "packed", "transactions.csv").glob("part-*"))
    assert parts and all(p.name.endswith(".csv.gz") and gzip.decompress(p.read_bytes()).startswith(b"\xef\xbb\xbfline_id,") for p in parts)
    for mart in ("transactions", "inventory", "ads"):
        found = [plain(readers.sheets(spark, [f"file://{tmp_path}/{name}/{mart}.csv"]).collect()) for name in ("plain", "packed")]
        assert found[0] == found[1] and found[0]


def test_numbers_are_given_before_columns_are_derived(spark):
    raw = spark.createDataFrame(raw_rows(), _RAW)
    lines = preparation.lines(raw, None)
    assert lines.columns[: len(commerce.cleaned(raw).columns) + 1] == ["line_id", *commerce.cleaned(raw).columns]
    same = ["line_id", *commerce.cleaned(raw).columns]
    before = commerce.numbered(commerce.cleaned(raw), *preparation._TIES)
    assert plain(lines.select(same).collect()) == plain(before.select(same).collect())
