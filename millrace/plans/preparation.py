"""A run that prepares commerce data: raw sheets to transaction lines, three marts and a summary."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import commerce
from millrace.session import build, ship_package
from millrace.sources import readers, sinks, workbooks
from millrace.sources.shared import write_text

#: Columns that tell lines of one time apart; lines equal in all of them are equal.
_TIES = ("invoice_id", "sku", "description", "quantity", "unit_price_gbp", "customer_id", "country")
#: Fields that a summary calls observed and simulated.
OBSERVED_FIELDS = ("invoice_id", "sku", "description", "quantity", "invoice_timestamp", "unit_price_gbp", "customer_id", "country")
SIMULATED_FIELDS = ("channel", "sim_unit_cost_gbp", "sim_allocated_ad_spend_gbp", "sim_platform_fee_gbp", "sim_fulfilment_cost_gbp", "sim_contribution_profit_gbp", "inventory attributes", "ad clicks and impressions")


@dataclass
class Prepared:
    """Lines as they were written, which analyses read, and the marts over them."""

    lines: DataFrame
    inventory: DataFrame
    ads: DataFrame
    summary: dict


def lines(raw: DataFrame, rows: int | None = 65_000, seed: int = 42) -> DataFrame:
    """Transaction lines of raw sheet rows: cleaned, a sample of exactly ``rows`` of them (None: all), numbered by time, with channels and costs drawn by their number.

    Lines of one time are numbered by their other columns, so results do not hang on the order of the sheets.
    """
    found = commerce.typed(raw)
    if rows is not None:
        found = commerce.exact_sample(found, F.to_json(F.struct("invoice_timestamp", *_TIES)), rows, seed)
    # What follows from a line alone is derived after rows are shuffled for their numbers.
    found = commerce.derived(commerce.numbered(found, *_TIES))
    return commerce.simulated_costs(found.withColumn("channel", commerce.channel_of(F.col("line_id"))), F.col("line_id"))


def run(spark: SparkSession, raw: DataFrame, out: str, rows: int | None = 65_000, seed: int = 42, source: str = "", compression: str = "none") -> Prepared:
    """Prepare ``raw`` into the folder ``out``: ``transactions.parquet`` with typed lines, which all else is made from, and as CSV ``transactions.csv``, ``inventory.csv``, ``ads.csv``, and ``dataset_summary.json``.

    Lines are written once; the marts read them, and are packed by ``compression`` ("gzip") if it is given. Only the one row of the summary reaches the driver. A table without valid lines gives empty marts and a summary of zeros and nulls.
    """
    ship_package(spark)
    lines(raw, rows, seed).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/transactions.parquet")
    kept = spark.read.parquet(f"{out}/transactions.parquet")
    inventory, ads = commerce.inventory_mart(kept), commerce.ads_mart(kept)
    for name, mart in (("transactions", kept), ("inventory", inventory), ("ads", ads)):
        sinks.write_mart(mart, f"{out}/{name}.csv", compression)
    facts = commerce.dataset_summary(kept).first().asDict()
    summary = {"seed": seed, "source": source, "rows": facts.pop("n_rows"), **facts, "observed_fields": list(OBSERVED_FIELDS), "simulated_fields": list(SIMULATED_FIELDS)}
    write_text(spark, f"{out}/dataset_summary.json", json.dumps(summary, indent=2, ensure_ascii=False))
    return Prepared(kept, inventory, ads, summary)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("output")
    parser.add_argument("input", nargs="+", help="a workbook, or exported sheets as CSV")
    parser.add_argument("--sheet", action="append", default=[], help="a sheet of the workbook; may be given several times")
    parser.add_argument("--rows", type=int, default=65_000, help="size of the sample; 0 keeps all lines")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--gzip", action="store_true", help="pack the parts of the CSV marts")
    given = parser.parse_args()
    spark = build("preparation")
    ship_package(spark)
    raw = workbooks.workbook(spark, given.input[0], given.sheet).drop("sheet") if given.sheet else readers.sheets(spark, given.input)
    print(json.dumps(run(spark, raw, given.output, given.rows or None, given.seed, ", ".join(given.input), "gzip" if given.gzip else "none").summary, indent=2, ensure_ascii=False))


if __name__ == "__main__":
    main()
