"""Small readers, writers and list functions."""

import json

import pytest

from millrace.operators import encoding
from millrace.sources import readers, sinks


def test_ids_of_lists_and_lists_of_lists(spark):
    df = spark.createDataFrame([([1.0, 2.0], [[3, 4], [5]]), ([], []), (None, None)], "plain array<double>, nested array<array<int>>")
    found = df.select(encoding.flat_ids(df, "plain").alias("plain"), encoding.flat_ids(df, "nested").alias("nested"))
    assert found.dtypes == [("plain", "array<bigint>"), ("nested", "array<bigint>")]
    assert [tuple(r) for r in found.collect()] == [([1, 2], [3, 4]), ([], []), (None, None)]


def test_the_run_of_least_loss_is_chosen(spark):
    runs = spark.createDataFrame([("b", 0.5, 1e-4), ("a", 0.5, 1e-4), ("c", None, 1e-5), ("d", float("nan"), 1e-6), ("e", 0.7, 1e-3)], "name string, val_loss double, learning_rate double")
    said = json.loads(sinks.grid_summary(runs, {"model": "m"}))
    assert said["selected_by_validation_loss"]["name"] == "a" and said["model"] == "m" and len(said["runs"]) == 5
    assert json.loads(sinks.grid_summary(runs.where("val_loss is null"), {}))["selected_by_validation_loss"] is None


@pytest.mark.parametrize(("encoding_name", "charset"), [("utf-8-sig", "utf-8-sig"), ("utf-8", "utf-8"), ("gb18030", "gb18030")])
def test_uploads_are_probed_by_their_first_bytes(spark, tmp_path, encoding_name, charset):
    path = tmp_path / "some.csv"
    path.write_bytes("名称,数量\n茶杯,3\n".encode(charset))
    df, found = readers.upload(spark, f"file://{path}")
    assert found == encoding_name and df.columns == ["名称", "数量"] and [tuple(r) for r in df.collect()] == [("茶杯", 3)]
    assert readers.upload(spark, f"file://{path}", rows=0)[0].count() == 0
