"""A preparation run, its marts and files; prompts of a narrator."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.functions import narratives as N
from millrace.operators import commerce, guard
from millrace.plans import preparation
from millrace.sources import readers, sinks

_RAW = "Invoice string, StockCode string, Description string, Quantity double, InvoiceDate string, Price double, `Customer ID` string, Country string"


def raw_rows():
    words = ["CHRISTMAS star", 'red "JAM" mug', "wax candle, tall", None, "paper bag", "toy"]
    out = []
    for k in range(240):
        back = k % 8 == 7
        out.append((f"{'C' if back else ''}{5000 + k // 3}", f"s{k % 12}", words[k % 6], -1.0 if back else 1.0 + k % 5, f"2011-0{1 + k % 6}-{10 + k % 9} 0{k % 8}:15:00", 1.25 + k % 7, str(k % 30), None if k % 9 == 0 else "France"))
    # Lines without use: no time, no price, a price of nothing, no quantity.
    return [*out, ("x1", "s1", "a", 1.0, "soon", 1.0, "1", "F"), ("x2", "s1", "a", 1.0, "2011-01-01", None, "1", "F"), ("x3", "s1", "a", 1.0, "2011-01-01", 0.0, "1", "F"), ("x4", "s1", "a", 0.0, "2011-01-01", 1.0, "1", "F")]


def plain(rows):
    return sorted((tuple(map(str, r)) for r in rows), key=str)


def test_run_writes_marts_that_read_back(spark, tmp_path):
    raw = spark.createDataFrame(raw_rows(), _RAW)
    found = preparation.run(spark, raw, f"file://{tmp_path}/out", rows=None, source="made")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["ads.csv", "dataset_summary.json", "inventory.csv", "transactions.csv", "transactions.parquet"]
    assert sorted(r.line_id for r in found.lines.collect()) == list(range(1, 241))
    back = readers.transactions(spark, f"file://{tmp_path}/out/transactions.csv")
    columns = ["line_id", "invoice_id", "sku", "description", "channel", "category", "is_return", "invoice_timestamp"]
    assert plain(back.select(columns).collect()) == plain(found.lines.select(columns).collect())
    assert 'red "JAM" mug' in {r.description for r in back.collect()} and commerce.missing_columns(back.columns) == []
    for ours, read in zip(commerce.portfolio_totals(found.lines).first(), commerce.portfolio_totals(back).first()):
        assert ours == pytest.approx(read)
    summary = json.loads((tmp_path / "out" / "dataset_summary.json").read_text())
    assert summary == found.summary and summary["rows"] == 240 and summary["return_line_rate"] == 0.125 and summary["source"] == "made" and summary["date_min"] == "2011-01-10 00:15:00"
    assert summary["observed_net_revenue_gbp"] == round(sum(r[3] * r[5] for r in raw_rows()[:240]), 2)
    ads = spark.read.csv(f"file://{tmp_path}/out/ads.csv", header=True)
    assert {r.channel for r in ads.collect()} <= set(commerce.PAID) and float(ads.agg(F.sum("sim_spend_gbp")).first()[0]) == pytest.approx(float(found.lines.agg(F.sum(commerce.ADS)).first()[0]))


def test_every_part_of_a_mart_is_a_whole_file(spark, tmp_path):
    df = spark.range(0, 30, 1, 3).select("id", F.concat(F.lit('a "b", '), "id").alias("text"), F.lit(None).cast("string").alias("none"))
    sinks.write_mart(df, f"file://{tmp_path}/mart.csv")
    parts = sorted(Path(tmp_path, "mart.csv").glob("part-*.csv"))
    assert len(parts) == 3 and all(p.read_bytes().startswith(b"\xef\xbb\xbfid,text,none\n") for p in parts)
    assert parts[0].read_text("utf-8-sig").splitlines()[1] == '0,"a ""b"", 0",'
    back = readers.sheets(spark, [f"file://{tmp_path}/mart.csv"])
    assert back.columns == ["id", "text", "none"] and sorted(tuple(r) for r in back.collect()) == sorted((str(r[0]), r[1], None) for r in df.collect())


def test_samples_are_exact_and_do_not_hang_on_order(spark):
    raw = spark.createDataFrame(raw_rows(), _RAW)
    some = preparation.lines(raw, 50, 7)
    again = preparation.lines(raw.repartition(5).orderBy(F.rand(3)), 50, 7)
    assert some.count() == 50 and plain(some.collect()) == plain(again.collect())
    other = preparation.lines(raw, 50, 8)
    assert plain(some.select("invoice_id", "sku").collect()) != plain(other.select("invoice_id", "sku").collect())


def test_tables_without_lines(spark, tmp_path):
    found = preparation.run(spark, spark.createDataFrame(raw_rows()[240:], _RAW), f"file://{tmp_path}/none")
    assert found.lines.count() == found.inventory.count() == found.ads.count() == 0 and found.summary["rows"] == 0 and found.summary["date_min"] is None


@pytest.mark.parametrize("language", [N.ENGLISH, N.CHINESE])
def test_prompts_hold_the_decision_and_the_rules(spark, language):
    lines = preparation.lines(spark.createDataFrame(raw_rows(), _RAW), None)
    for task, key in ((N.PROFIT, "selected_category"), (N.MARKETING, "selected_channel"), (N.INVENTORY, "selected_sku")):
        known = commerce.evidence(lines, task, language)
        said = guard.prompts(known.text, known.table, known.decision, task, " why {target}? ", language).collect()
        assert len(said) == 1
        prompt, decision = said[0].prompt, known.decision.first()
        target = decision["target_category" if task == N.PROFIT else "target_entity"]
        payload = json.loads(re.search(r'\{".*\}', prompt).group())
        assert payload[key] == target and payload["selection_rule"] == N.RULES[task]
        assert payload.get("inventory_status_available", False) is False and (task == N.INVENTORY or payload["cost_basis"] == "simulated")
        assert "why {target}?" in prompt and known.text.first().evidence in prompt and N.TASK_RULES[language, task] in prompt
        assert prompt.endswith("\n".join(N.HEADINGS[language])) and N.TASK_LABELS[language][task] in prompt
    trend = commerce.evidence(lines, N.TREND, language)
    prompt = guard.prompts(trend.text, trend.table, None, N.TREND, "", language).first().prompt
    months = [r.month for r in trend.table.collect()]
    assert "month,revenue,contribution_profit\n" + months[0] in prompt and prompt.index(months[0]) < prompt.index(months[-1]) and N.default_question(language, N.TREND) in prompt
    assert prompt.endswith("\n".join(N.OPEN_HEADINGS[language]))
    empty = guard.prompts(trend.text, trend.table.limit(0), None, N.TREND, "", language).first().prompt
    assert "month,revenue,contribution_profit\n" in empty


def test_narratives_of_decisions_pass_and_invented_numbers_do_not(spark):
    lines = preparation.lines(spark.createDataFrame(raw_rows(), _RAW), None)
    for task in (N.PROFIT, N.MARKETING, N.INVENTORY):
        for language in (N.ENGLISH, N.CHINESE):
            decision = commerce.evidence(lines, task, language).decision
            safe = guard.safe_narrative(decision, task, language).first().narrative
            target = F.lit(decision.first()["target_category" if task == N.PROFIT else "target_entity"])
            known = [r[0] for r in lines.select("category" if task == N.PROFIT else "channel").distinct().collect()]
            rows = spark.createDataFrame([(safe,), (safe + "\nInvented metric: £999999",)], "value string")
            judged = guard.verdicts(rows.withColumns({"task": F.lit(task), "language": F.lit(language), "target": target, "known": F.array(*map(F.lit, known))}))
            assert [r.passed for r in judged.orderBy(F.length("value")).collect()] == [True, False], (task, language)
