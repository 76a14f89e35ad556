"""All queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import narratives as N
from millrace.functions import text as X
from millrace.operators import commerce, dedup, encoding, epochs, guard, judging, profiling, scenario, selection, trajectory
from millrace.session import ship_package
from millrace.sources import readers, sinks
from millrace.sources.shared import discard, shared_dir, written
from millrace.streaming import trend

from . import preparation
from .adapters import PART_WORDS, TRAJ, TXN, _category_sql, _fraction, table, trajectories, transactions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show."""
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


# Commerce.

_TOTALS = "totals AS (SELECT CAST(sum(revenue_line) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS profit, CAST(sum(ads) AS DOUBLE) AS ad_spend, count(DISTINCT invoice_id) AS orders, avg(CAST(is_return AS INT)) AS return_line_rate, count(*) AS n_rows FROM txn)"
_LEAK = """cat AS (SELECT category, CAST(sum(revenue_line) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS contribution_profit, CAST(sum(cogs) AS DOUBLE) AS cogs, CAST(sum(ads) AS DOUBLE) AS ad_spend, CAST(sum(fee) AS DOUBLE) AS platform_fee, CAST(sum(fulfilment) AS DOUBLE) AS fulfilment, avg(CAST(is_return AS INT)) AS return_line_rate FROM txn GROUP BY category),
leak AS (SELECT cat.*, totals.profit / totals.revenue AS portfolio_margin, contribution_profit / cat.revenue AS margin, (totals.profit / totals.revenue - contribution_profit / cat.revenue) * 100 AS margin_gap_pp, greatest(totals.profit / totals.revenue * cat.revenue - contribution_profit, 0.0) AS estimated_profit_leakage FROM cat, totals)"""


def rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


_LEAK_COLUMNS = "revenue contribution_profit cogs ad_spend platform_fee fulfilment return_line_rate portfolio_margin margin margin_gap_pp estimated_profit_leakage"


@query(f"WITH {TXN}, {_TOTALS} SELECT {rounded('revenue profit ad_spend return_line_rate')}, orders, n_rows, round(profit / revenue, 6) AS margin FROM totals")
def portfolio_totals(spark, d):
    return r(commerce.portfolio_totals(transactions(spark, d)))


@query(f"WITH {TXN}, {_TOTALS}, {_LEAK} SELECT category, {rounded(_LEAK_COLUMNS)} FROM leak")
def profit_leak(spark, d):
    return r(commerce.ordered(commerce.profit_leak(transactions(spark, d)), commerce.LEAK_ORDER))


@query(f"""WITH {TXN}, {_TOTALS}, {_LEAK} SELECT 'Profit Leak' AS task, category AS target_category, round(revenue, 6) AS target_revenue, round(contribution_profit, 6) AS target_profit, round(margin, 6) AS target_margin, {rounded('portfolio_margin margin_gap_pp estimated_profit_leakage return_line_rate')},
 round(cogs / revenue, 6) AS cogs_share, round(ad_spend / revenue, 6) AS ad_share, round(fulfilment / revenue, 6) AS fulfilment_share, 'simulated' AS cost_basis, (SELECT string_agg(category, ',' ORDER BY category) FROM cat) AS known_categories FROM leak WHERE revenue > 0 ORDER BY estimated_profit_leakage DESC, leak.margin, category LIMIT 1""")
def profit_leak_decision(spark, d):
    return r(commerce.profit_leak_decision(transactions(spark, d))).withColumn("known_categories", F.array_join("known_categories", ","))


_CHANNEL = "ch AS (SELECT channel, CAST(sum(revenue_line) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS contribution_profit, CAST(sum(ads) AS DOUBLE) AS ad_spend, count(DISTINCT invoice_id) AS orders FROM txn GROUP BY channel), eff AS (SELECT *, revenue / nullif(ad_spend, 0) AS roas, contribution_profit / nullif(ad_spend, 0) AS profit_per_ad_pound, contribution_profit / nullif(orders, 0) AS profit_per_order FROM ch)"


@query(f"WITH {TXN}, {_CHANNEL} SELECT channel, {rounded('revenue contribution_profit ad_spend roas profit_per_ad_pound profit_per_order')}, orders FROM eff")
def marketing_efficiency(spark, d):
    return r(commerce.ordered(commerce.marketing_efficiency(transactions(spark, d)), commerce.EFFICIENCY_ORDER))


@query(f"WITH {TXN}, {_CHANNEL} SELECT channel AS target_entity, round(revenue, 6) AS target_revenue, round(roas, 6) AS target_roas, round(profit_per_ad_pound, 6) AS target_profit_per_ad_pound FROM eff WHERE ad_spend > 0 AND orders > 0 ORDER BY eff.profit_per_ad_pound, eff.roas, channel LIMIT 1")
def marketing_decision(spark, d):
    return r(commerce.marketing_decision(transactions(spark, d)).select("target_entity", "target_revenue", "target_roas", "target_profit_per_ad_pound"))


_DEMAND = "dem AS (SELECT sku, description, sum(quantity) AS units, CAST(sum(revenue_line) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS contribution_profit, count(DISTINCT invoice_id) AS orders, count(invoice_id) AS transaction_lines FROM txn WHERE NOT is_return GROUP BY sku, description)"


@query(f"WITH {TXN}, {_DEMAND} SELECT sku, description, {rounded('units revenue contribution_profit')}, orders, transaction_lines FROM dem WHERE transaction_lines >= 10 AND units > 0 ORDER BY dem.units DESC, orders DESC, sku, description LIMIT 15")
def inventory_risk_top15(spark, d):
    return r(commerce.inventory_risk(transactions(spark, d)))


@query(f"WITH {TXN}, {_DEMAND} SELECT CAST(sku AS VARCHAR) AS target_entity, description AS target_description, units AS target_units, orders AS target_orders, transaction_lines AS target_transaction_lines FROM dem WHERE transaction_lines >= 10 AND units > 0 ORDER BY units DESC, orders DESC, sku, description LIMIT 1")
def inventory_decision(spark, d):
    return commerce.inventory_decision(transactions(spark, d)).select("target_entity", "target_description", "target_units", "target_orders", "target_transaction_lines")


@query(f"WITH {TXN}, m AS (SELECT coalesce(strftime(invoice_timestamp, '%Y-%m'), 'NaT') AS month, CAST(sum(revenue_line) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS contribution_profit FROM txn GROUP BY 1) SELECT month, {rounded('revenue contribution_profit', 3)} FROM m ORDER BY month DESC LIMIT 18")
def monthly_trend_tail18(spark, d):
    return r(commerce.monthly_trend(transactions(spark, d)), 3)


def _filled_sql(template: str, values: dict[str, str]) -> str:
    """``template`` as a concatenation of its texts and the SQL of each ``{name}``."""
    pieces = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"({values[piece]})" if k % 2 else "'" + piece.replace("'", "''") + "'" for k, piece in enumerate(pieces))


def _money_sql(c: str) -> str:
    return f"'£' || format('{{:,}}', CAST(round_even({c}, 0) AS BIGINT))"


def _fixed_sql(c: str, digits: int) -> str:
    return f"printf('%.{digits}f', {c})"


_SENTENCE = {"rows": "format('{:,}', n_rows)", "orders": "format('{:,}', orders)", "revenue": _money_sql("revenue"), "profit": _money_sql("profit"), "margin": _fixed_sql("100 * profit / revenue", 1) + " || '%'", "ads": _money_sql("ad_spend"), "returns": _fixed_sql("100 * return_line_rate", 2) + " || '%'"}


@query(f"WITH {TXN}, {_TOTALS} " + " UNION ALL ".join(f"SELECT '{language}' AS language, {_filled_sql(N.EVIDENCE[language], _SENTENCE)} AS evidence FROM totals" for language in N.EVIDENCE))
def evidence_text(spark, d):
    totals = commerce.portfolio_totals(transactions(spark, d))
    english, chinese = (commerce.evidence_text(totals, language).select(F.lit(language).alias("language"), "evidence") for language in N.EVIDENCE)
    return english.unionByName(chinese)


@query("SELECT CAST(l_orderkey AS VARCHAR) AS invoice_id, CAST(l_partkey AS VARCHAR) AS sku, l_quantity AS quantity, l_extendedprice AS unit_price_gbp, strftime(l_shipdate, '%Y-%m-%d') AS order_date, round(l_quantity * l_extendedprice, 4) AS net, 'Gifts' AS category FROM lineitem WHERE l_shipdate IS NOT NULL AND l_extendedprice > 0 AND l_quantity <> 0")
def clean_transactions(spark, d):
    lines = table(spark, d, "lineitem")
    raw = lines.select(F.col("l_orderkey").alias("Invoice"), F.col("l_partkey").alias("StockCode"), F.lit(None).cast("string").alias("Description"), F.col("l_quantity").alias("Quantity"), F.col("l_shipdate").alias("InvoiceDate"), F.col("l_extendedprice").alias("Price"), F.col("l_suppkey").alias("Customer ID"), F.lit(None).cast("string").alias("Country"))
    return commerce.cleaned(raw).select("invoice_id", "sku", "quantity", "unit_price_gbp", "order_date", F.round("observed_net_revenue_gbp", 4).alias("net"), "category")


@query(f"SELECT p_partkey, {_category_sql('p_name')} AS category FROM part")
def category_assign(spark, d):
    return table(spark, d, "part").select("p_partkey", commerce.category_of(F.col("p_name"), PART_WORDS).alias("category"))


@query(f"SELECT p_partkey, {_fraction('cogs', 'p_partkey')} AS fraction FROM part")
def stable_fraction(spark, d):
    return table(spark, d, "part").select("p_partkey", X.stable_fraction(F.col("p_partkey"), "cogs").alias("fraction"))


@query(f"WITH {TXN} SELECT channel, category, count(*) AS n, {', '.join(f'round(CAST(sum({c}) AS DOUBLE), 4) AS {c}' for c in ('unit_cost', 'ads', 'fee', 'fulfilment', 'cogs', 'profit'))} FROM txn GROUP BY channel, category")
def cost_simulation(spark, d):
    names = {"unit_cost": "sim_unit_cost_gbp", "ads": commerce.ADS, "fee": "sim_platform_fee_gbp", "fulfilment": "sim_fulfilment_cost_gbp", "cogs": "sim_cogs_gbp", "profit": commerce.PROFIT}
    return transactions(spark, d).groupBy("channel", "category").agg(F.count("*").alias("n"), *(F.round(F.sum(c).cast("double"), 4).alias(n) for n, c in names.items()))


@query(f"""WITH {TXN}, sold AS (SELECT sku, description, category, sum(quantity) AS units_sold, avg(unit_price_gbp) AS p, avg(CAST(unit_cost AS DOUBLE)) AS c FROM txn WHERE NOT is_return GROUP BY ALL ORDER BY units_sold DESC, sku, description, category LIMIT 500),
 led AS (SELECT *, CAST(4 + floor({_fraction('lead', 'sku')} * 25) AS BIGINT) AS sim_lead_time_days FROM sold), ro AS (SELECT *, CAST(ceil(greatest(units_sold / 365.0, 0.2) * sim_lead_time_days * (1.15 + 0.65 * {_fraction('safety', 'sku')})) AS BIGINT) AS sim_reorder_point_units FROM led)
 SELECT sku, description, category, units_sold, round(p, 4) AS avg_unit_price_gbp, round(c, 4) AS sim_unit_cost_gbp, sim_lead_time_days, sim_reorder_point_units, CAST(floor({_fraction('hand', 'sku')} * greatest(sim_reorder_point_units * 3, 2)) AS BIGINT) AS sim_on_hand_units, round(c * (0.015 + 0.02 * {_fraction('holding', 'sku')}), 4) AS sim_holding_cost_per_unit_month_gbp FROM ro""")
def inventory_mart_top500(spark, d):
    return r(commerce.inventory_mart(transactions(spark, d)).drop("operational_field_status"), 4)


@query(f"""WITH {TXN}, day AS (SELECT order_date, channel, CAST(sum(ads) AS DOUBLE) AS spend, CAST(sum(revenue_line) AS DOUBLE) AS revenue, count(DISTINCT invoice_id) AS orders FROM txn WHERE channel IN ('Meta Ads', 'Google Ads', 'TikTok Ads') AND NOT is_return GROUP BY ALL),
 cl AS (SELECT *, CAST(greatest(floor(spend / (0.35 + 1.05 * {_fraction('click', "(order_date || '|' || channel)")}) + 0.5), 1) AS BIGINT) AS sim_clicks FROM day)
 SELECT order_date, channel, round(spend, 4) AS sim_spend_gbp, round(revenue, 4) AS observed_attributed_revenue_gbp, orders, sim_clicks, CAST(floor(sim_clicks / (0.008 + 0.027 * {_fraction('impression', "(order_date || '|' || channel)")}) + 0.5) AS BIGINT) AS sim_impressions FROM cl""")
def ads_mart(spark, d):
    return r(commerce.ads_mart(transactions(spark, d)), 4)


@query(f"WITH {TXN} SELECT count(*) AS n_rows, count(DISTINCT invoice_id) AS orders, count(DISTINCT sku) AS products, count(DISTINCT country) AS countries, strftime(min(invoice_timestamp), '%Y-%m-%d %H:%M:%S') AS date_min, strftime(max(invoice_timestamp), '%Y-%m-%d %H:%M:%S') AS date_max, round(CAST(sum(revenue_line) AS DOUBLE), 2) AS observed_net_revenue_gbp, round(CAST(sum(profit) AS DOUBLE), 2) AS sim_contribution_profit_gbp, round(avg(CAST(is_return AS INT)), 6) AS return_line_rate FROM txn")
def dataset_summary(spark, d):
    return commerce.dataset_summary(transactions(spark, d))


#: Words that give the lines of a raw sheet their category, by the number of the part.
_ADDED = ("christmas tree", "mug", "lantern", "notebook", "umbrella", "toy")


def _prepared_sql() -> str:
    added = "CASE l_partkey % 6 " + " ".join(f"WHEN {k} THEN ' {word}'" for k, word in enumerate(_ADDED)) + " END"
    category = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(upper(description), '{w}')" for w in words) + f" THEN '{name}'" for name, words in commerce.CATEGORY_WORDS.items()) + f" ELSE '{commerce.DEFAULT_CATEGORY}' END"
    costs = TXN[TXN.index("chan AS") :].replace("rev AS DECIMAL", "quantity * unit_price_gbp AS DECIMAL", 1)
    return f"""WITH sheet AS (SELECT concat(CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END, l_orderkey) AS invoice_id, CAST(l_partkey AS VARCHAR) AS sku, trim(concat(p_name, {added})) AS description, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
  l_shipdate AS invoice_timestamp, round(l_extendedprice / l_quantity, 2) AS unit_price_gbp, CAST(l_suppkey AS VARCHAR) AS customer_id, CASE WHEN l_linestatus = 'F' THEN 'Unknown' ELSE 'United Kingdom' END AS country FROM lineitem JOIN part ON l_partkey = p_partkey),
placed AS (SELECT *, row_number() OVER (ORDER BY invoice_timestamp, invoice_id, sku, description, quantity, unit_price_gbp, customer_id, country) AS line_id FROM sheet WHERE unit_price_gbp > 0 AND quantity <> 0),
raw AS (SELECT *, line_id AS line, invoice_id LIKE 'C%' OR quantity < 0 AS is_return, {category} AS category, {_fraction('channel', 'line_id')} AS f_channel FROM placed),
{costs}
SELECT category, channel, count(*) AS n_lines, sum(CAST(is_return AS INT)) AS n_returns, count(DISTINCT invoice_id) AS orders, CAST(sum(line_id) AS BIGINT) AS line_ids, round(CAST(sum(revenue_line) AS DOUBLE), 2) AS revenue, round(CAST(sum(ads) AS DOUBLE), 2) AS ad_spend, round(CAST(sum(profit) AS DOUBLE), 2) AS profit FROM txn GROUP BY ALL"""


@query(_prepared_sql())
def prepared_lines(spark, d):
    """All lineitems as two exported sheets, read, prepared by the run and read back from its CSV mart."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    back, word = F.col("l_returnflag") == "R", F.element_at(F.array(*(F.lit(f" {w}") for w in _ADDED)), (F.col("l_partkey") % 6 + 1).cast("int"))
    sheet = table(spark, d, "lineitem").join(parts, "l_partkey").select(
        F.concat(F.when(back, "C").otherwise(""), F.col("l_orderkey")).alias("Invoice"), F.col("l_partkey").alias("StockCode"), F.concat("p_name", word).alias("Description"), F.when(back, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("Quantity"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("InvoiceDate"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("Price"), F.col("l_suppkey").alias("Customer ID"), F.when(F.col("l_linestatus") != "F", "United Kingdom").alias("Country"),
    )
    out = f"{shared_dir(spark)}/millrace/prepared-{uuid.uuid4().hex}"
    for name, status in (("one", F.col("Country").isNull()), ("two", F.col("Country").isNotNull())):
        sinks.write_mart(sheet.where(status), f"{out}/{name}.csv", "gzip")
    preparation.run(spark, readers.sheets(spark, [f"{out}/one.csv", f"{out}/two.csv"]), out, rows=None, compression="gzip")
    lines = readers.transactions(spark, f"{out}/transactions.csv")
    total = lambda c: F.round(F.sum(c).cast("double"), 2)
    by = ["category", "channel"]
    # Orders are counted apart: beside them the sums would be shuffled for each order, alone they are a few rows a task.
    sums = lines.groupBy(by).agg(
        F.count("*").alias("n_lines"), F.sum(F.col("is_return").cast("int")).alias("n_returns"), F.sum(F.col("line_id").cast("long")).alias("line_ids"),
        total(commerce.REVENUE).alias("revenue"), total(commerce.ADS).alias("ad_spend"), total(commerce.PROFIT).alias("profit"),
    )
    return sums.join(lines.groupBy(by).agg(F.countDistinct("invoice_id").alias("orders")), by).select(*by, "n_lines", "n_returns", "orders", "line_ids", "revenue", "ad_spend", "profit")


_LINE = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), l_returnflag, strftime(l_shipdate, '%Y-%m-%d'), CAST(round(l_extendedprice * 100) AS BIGINT))"


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem ORDER BY sha256('20261002|' || {_LINE}) LIMIT 1000")
def exact_n_sample(spark, d):
    lines = table(spark, d, "lineitem")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    return commerce.exact_sample(lines, key, 1000, 20261002).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query(f"WITH {TXN} SELECT row_number() OVER (ORDER BY invoice_timestamp, line) AS line_id, invoice_id, line FROM txn")
def line_numbers(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), F.col("l_shipdate").alias("invoice_timestamp"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("line"))
    return commerce.numbered(lines, "line").select("line_id", "invoice_id", "line")


@query("SELECT 0 AS n_missing")
def required_columns_gate(spark, d):
    return spark.createDataFrame([(len(commerce.missing_columns(transactions(spark, d).columns)),)], "n_missing int")


_BASE_FIGURES = "base AS (SELECT CAST(sum(revenue_line) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS profit, CAST(sum(ads) AS DOUBLE) AS ads, CAST(coalesce(sum(abs(revenue_line)) FILTER (is_return), 0) AS DOUBLE) AS returns FROM txn)"


def _normal_sql(name: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_fraction(name + '-1', 'trial')})) * cos(2 * pi() * {_fraction(name + '-2', 'trial')}))"


_RUNS = f"runs AS (SELECT trial, profit + revenue * (1 + 0.1 + 0.07 * {_normal_sql('demand')} - 1) * greatest((profit + ads) / greatest(revenue, 1.0), 0.05) - ads * (1 + 0.05 + 0.05 * {_normal_sql('ads')} - 1) - returns * (1 + 0.0 + 0.06 * {_normal_sql('returns')} - 1) AS p FROM base, range(1500) t(trial))"


@query(f"WITH {TXN}, {_BASE_FIGURES}, {_RUNS} SELECT round(quantile_cont(p, 0.05), 2) AS p5, round(quantile_cont(p, 0.5), 2) AS p50, round(quantile_cont(p, 0.95), 2) AS p95, avg(CAST(p < 0 AS INT)) AS loss_probability, count(*) AS trials FROM runs")
def monte_carlo_quantiles(spark, d):
    return r(scenario.quantiles(scenario.simulate(transactions(spark, d), 10, 5, 0)), 2)


_POINTS = "q AS (SELECT quantile_cont(p, 0.05) AS p5, quantile_cont(p, 0.5) AS p50, quantile_cont(p, 0.95) AS p95, avg(CAST(p < 0 AS INT)) AS loss, count(*) AS trials FROM runs)"
_SUMMARY = {"trials": "format('{:,}', trials)", "loss": _fixed_sql("100 * loss", 1) + " || '%'"} | {p: _money_sql(p) for p in ("p5", "p50", "p95")}


@query(f"WITH {TXN}, {_BASE_FIGURES}, {_RUNS}, {_POINTS} " + " UNION ALL ".join(f"SELECT '{language}' AS language, {_filled_sql(N.SIMULATED[language], _SUMMARY)} AS summary FROM q" for language in N.SIMULATED))
def scenario_summary(spark, d):
    points = scenario.quantiles(scenario.simulate(transactions(spark, d), 10, 5, 0))
    english, chinese = (scenario.summary(points, language).select(F.lit(language).alias("language"), "summary") for language in N.SIMULATED)
    return english.unionByName(chinese)


@query(f"WITH {TXN}, {_BASE_FIGURES}, {_RUNS}, w AS (SELECT min(p) AS lo, (max(p) - min(p)) / 45 AS w FROM runs) SELECT CAST(least(floor((p - lo) / w) + 1, 45) AS BIGINT) AS bin, count(*) AS n FROM runs, w GROUP BY 1")
def scenario_histogram(spark, d):
    return scenario.histogram(scenario.simulate(transactions(spark, d), 10, 5, 0)).select("bin", "n")


# Profiles.


@query("SELECT * FROM (SELECT 'c_acctbal' AS column, count(*) FILTER (c_acctbal IS NULL OR c_acctbal < 0) AS n_missing FROM customer) WHERE n_missing > 0")
def profile_missing(spark, d):
    customers = table(spark, d, "customer")
    return profiling.missing_counts(customers.withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))))


def _describe_sql(column: str, of: str = "part") -> str:
    return f"SELECT '{column}' AS column, count({column}) AS count, round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS std, round(min({column})::DOUBLE, 4) AS min, round(quantile_cont({column}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({column}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({column}::DOUBLE, 0.75), 4) AS p75, round(max({column})::DOUBLE, 4) AS max FROM {of}"


@query(" UNION ALL ".join(map(_describe_sql, ("p_partkey", "p_size", "p_retailprice"))))
def profile_describe(spark, d):
    return profiling.describe(table(spark, d, "part"))


_MEASURES = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(_describe_sql(c, "lineitem") for c in _MEASURES))
def profile_describe_lines(spark, d):
    return profiling.describe(table(spark, d, "lineitem"))


# Trajectories.


@query(f"WITH {TRAJ} SELECT id, grp AS \"group\", level, n_messages, length(alltext) AS characters FROM traj")
def traj_messages(spark, d):
    return trajectories(spark, d).select("id", "group", "level", F.size("messages").cast("long").alias("n_messages"), F.length(trajectory.joined(F.col("messages"))).cast("long").alias("characters"))


@query(f"WITH {TRAJ} SELECT id, grp AS \"group\", level, n_messages, length(alltext) AS characters FROM traj")
def trajectory_lists(spark, d):
    """Trajectories written as JSON lists, a list for each part, and read again by ranges of bytes."""
    rows = trajectories(spark, d).select("id", F.col("group").alias("filename"), "level", "messages")
    path = f"{shared_dir(spark)}/millrace/trajectory-lists-{uuid.uuid4().hex}"
    sinks.write_lists(rows, path)
    back = readers.trajectories(spark, path)
    return back.select("id", "group", "level", F.size("messages").cast("long").alias("n_messages"), F.length(trajectory.joined(F.col("messages"))).cast("long").alias("characters"))


@query(f"WITH {TRAJ} SELECT id, prompt FROM traj")
def traj_prompt(spark, d):
    return trajectories(spark, d).select("id", trajectory.task_prompt(F.col("messages")).alias("prompt"))


def _normal_prompt_sql(column: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({column}), '`[^`]+`', ' CODE ', 'g'), '\b[0-9]+(?:\.[0-9]+)?\b', ' NUM ', 'g'), '[^\p{{L}}\p{{N}}\s_]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256(n) AS prompt_hash, length(n) AS n FROM (SELECT doc_id, {_normal_prompt_sql('text')} AS n FROM documents)")
def prompt_normalize_hash(spark, d):
    df = table(spark, d, "documents").withColumn("n", X.normalize_prompt(F.col("text")))
    return df.select("doc_id", F.sha2(F.col("n").cast("binary"), 256).alias("prompt_hash"), F.length("n").cast("long").alias("n"))


@query(f"WITH {TRAJ} SELECT id, " + ", ".join(f"CAST(regexp_matches(alltext, '(?is)<{t}>.*?</{t}>') AS DOUBLE) AS has_{t}" for t in X.TAGS) + " FROM traj")
def tag_flags(spark, d):
    text = trajectory.joined(F.col("messages"))
    return trajectories(spark, d).select("id", *(X.has_tag(text, t).cast("double").alias(f"has_{t}") for t in X.TAGS))


_BLOCKS = r"len(list_filter(CASE WHEN len(regexp_extract_all(assistant_text, '(?is)```(?:python|py|sql)?\s*(.*?)```', 1)) > 0 THEN regexp_extract_all(assistant_text, '(?is)```(?:python|py|sql)?\s*(.*?)```', 1) ELSE regexp_extract_all(assistant_text, '(?is)<code>\s*(.*?)\s*</code>', 1) END, lambda b: trim(b, ' ' || chr(10)) <> ''))"


@query(f"WITH {TRAJ} SELECT id, {_BLOCKS} AS code_blocks FROM traj")
def code_blocks(spark, d):
    return trajectories(spark, d).select("id", F.size(X.code_blocks(trajectory.joined(F.col("messages"), "assistant"))).cast("long").alias("code_blocks"))


_EXEC = "CASE WHEN seen = 0 THEN 0.0 WHEN bad > 0 AND answered THEN least(1.0, (good + 0.45 * greatest(0, seen - good - bad)) / seen + 0.15) ELSE (good + 0.45 * greatest(0, seen - good - bad)) / seen END"


@query(f"WITH {TRAJ} SELECT id, good AS successes, bad AS errors, round(CAST({_EXEC} AS DOUBLE), 8) AS score FROM traj")
def execution_signals(spark, d):
    return trajectories(spark, d).select("id", trajectory.execution(F.col("messages")).alias("e")).select("id", "e.successes", "e.errors", F.round("e.score", 8).alias("score"))


def _quality_sql(n: str, low: int, ideal: int, high: int) -> str:
    return f"CASE WHEN {n} <= 0 THEN 0.0 WHEN {n} < {low} THEN {n} / {low}.0::DOUBLE WHEN {n} <= {high} THEN 1.0 ELSE greatest(0.0, 1.0 - ({n} - {high}) / {max(high, ideal)}.0::DOUBLE) END"


@query(f"SELECT doc_id, round(CAST({_quality_sql('length(text)', 12, 300, 2400)} AS DOUBLE), 8) AS quality FROM documents")
def length_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.bounded_length_quality(F.length("text"), 12, 300, 2400), 8).alias("quality"))


_RAW = f"1.2 * ln(1 + assistant_turns) + 0.9 * ln(1 + {_BLOCKS}) + 0.8 * ln(1 + good + bad) + 0.45 * ln(1 + length(alltext) / 1000.0::DOUBLE)"


@query(f"WITH {TRAJ} SELECT id, round({_RAW}, 8) AS complexity_raw FROM traj")
def complexity_raw(spark, d):
    return trajectory.records(trajectories(spark, d)).select("id", F.round("complexity_raw", 8).alias("complexity_raw"))


@query(f"WITH {TRAJ}, c AS (SELECT idx, id, round({_RAW}, 9) AS raw FROM traj) SELECT id, round((row_number() OVER (ORDER BY raw, idx) - 1) / (SELECT count(*) - 1 FROM c)::DOUBLE, 8) AS complexity_score FROM c")
def complexity_rank(spark, d):
    scored = trajectory.records(trajectories(spark, d)).select("index", "id", F.round("complexity_raw", 9).alias("complexity_raw"))
    return trajectory.percentile_rank(scored, "complexity_raw", "complexity_score").select("id", F.round("complexity_score", 8).alias("complexity_score"))


def _scored(spark, d) -> DataFrame:
    df = trajectory.records(trajectories(spark, d)).withColumn("complexity_raw", F.round("complexity_raw", 9))
    return trajectory.rewarded(df)


_PY = "len(regexp_extract_all(assistant_text, '```python'))"
#: Blocks are print(n), which parses, print((n), which does not, or a select by construction: the share of the first among the first two, 0.5 with selects alone, 0 without blocks.
_PARSES = r"len(regexp_extract_all(assistant_text, '```python\nprint\([0-9]+\)\n```'))"
_SYNTAX = f"CASE WHEN {_PY} > 0 THEN {_PARSES} / {_PY}::DOUBLE WHEN {_BLOCKS} > 0 THEN 0.5 ELSE 0.0 END"
_COMPLETE = "(" + " + ".join(f"CAST(regexp_matches(alltext, '(?is)<{t}>.*?</{t}>') AS DOUBLE)" for t in X.TAGS) + ") / 4"
_REWARD = f"""sc AS (SELECT *, round({_RAW}, 9) AS raw, CAST({_SYNTAX} AS DOUBLE) AS syntax_score, CAST({_EXEC} AS DOUBLE) AS exec, {_COMPLETE} AS complete, CAST({_quality_sql('length(prompt)', 12, 300, 2400)} AS DOUBLE) AS pq, CAST({_quality_sql('length(answer)', 20, 350, 3000)} AS DOUBLE) AS aq FROM traj),
rk AS (SELECT *, (row_number() OVER (ORDER BY raw, idx) - 1) / (SELECT count(*) - 1 FROM sc)::DOUBLE AS cs FROM sc), rw AS (SELECT *, round(0.2 * cs + 0.2 * syntax_score + 0.2 * exec + 0.2 * complete + 0.1 * pq + 0.1 * aq, 8) AS final_reward FROM rk)"""


@query(f"WITH {TRAJ}, {_REWARD} SELECT id, round(syntax_score, 8) AS syntax_score, round(complete, 8) AS completeness_score, round(cs, 8) AS complexity_score, final_reward FROM rw")
def reward_scores(spark, d):
    return _scored(spark, d).select("id", *(F.round(c, 8).alias(c) for c in ("syntax_score", "completeness_score", "complexity_score", "final_reward")))


@query(f"WITH {TRAJ} SELECT id, CAST({_SYNTAX} AS DOUBLE) AS syntax_score FROM traj")
def python_syntax(spark, d):
    return trajectories(spark, d).select("id", trajectory.syntax_score(X.code_blocks(trajectory.joined(F.col("messages"), "assistant"))).alias("syntax_score"))


@query(f"WITH {TRAJ}, {_REWARD}, p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY final_reward DESC, idx) AS place FROM rw) SELECT id, grp AS \"group\", final_reward FROM p WHERE place <= 6 ORDER BY final_reward DESC, idx LIMIT 2500")
def capped_topk(spark, d):
    scored = _scored(spark, d).withColumn("final_reward", F.round("final_reward", 8))
    return selection.capped_pool(scored, 2500, 6).select("id", "group", "final_reward")


@query(
    f"""WITH {TRAJ}, j AS (SELECT conv_id, string_agg('{{"content": ' || CAST(to_json(content) AS VARCHAR) || ', "role": "' || role || '"}}', ', ' ORDER BY turn) AS j FROM msg GROUP BY conv_id)
 SELECT CAST(conv_id AS VARCHAR) AS id, sha256('[' || j || ']') AS message_hash FROM j"""
)
def message_hashes(spark, d):
    return trajectories(spark, d).select("id", trajectory.message_hash(F.col("messages")).alias("message_hash"))


@query()
def epoch_order(spark, d):
    """Where each document stands in the second epoch of a run on four ranks. Tests hold the order against its definition."""
    docs = trajectory.global_rank(table(spark, d, "documents").select("doc_id"), F.asc("doc_id"))
    return epochs.epoch(docs.select("doc_id", F.col("__rank").alias("number")), docs.count(), seed=42, epoch=1, world=4).select("doc_id", "position", "rank", "place")


def _split(spark, d) -> DataFrame:
    plain = selection.Selection()
    pool = written(selection.capped_pool(_scored(spark, d).withColumn("final_reward", F.round("final_reward", 8)), plain.train_size + plain.val_size, plain.max_per_group), "pool")
    # Where there are fewer conversations than a production pool has, validation takes the first groups that hold a fifth of them: a size that whole groups reach.
    sizes = [r["count"] for r in pool.groupBy("group").count().orderBy("group").collect()]
    fifth = next(n for n in itertools.accumulate(sizes) if 5 * n >= sum(sizes))
    return selection.group_split(pool, min(plain.val_size, fifth), plain.seed, plain.trials)


@query()
def group_split(spark, d):
    return _split(spark, d).select("id", "group", "split")


@query("SELECT * FROM (VALUES ('group', 0), ('id', 0), ('message_hash', 0)) t(what, overlap)")
def split_checks(spark, d):
    return selection.split_checks(_split(spark, d)).withColumn("overlap", F.col("overlap").cast("int"))


@query(
    f"""WITH {TRAJ}, g AS (SELECT grp, least(count(*), 6) AS k FROM traj GROUP BY grp), c AS (SELECT sum(k) OVER (ORDER BY grp) AS s, sum(k) OVER () AS n FROM g), v AS (SELECT max(n) AS n, min(s) FILTER (5 * s >= n) AS v FROM c)
 SELECT 'train' AS split, CAST(n - v AS INT) AS n FROM v UNION ALL SELECT 'validation', CAST(v AS INT) FROM v"""
)
def split_stats(spark, d):
    return selection.split_stats(_split(spark, d)).select("split", F.col("n").cast("int"))


@query(f"WITH {TRAJ} SELECT level AS value, count(*) AS n FROM traj GROUP BY level")
def level_distribution(spark, d):
    return selection.distribution(trajectories(spark, d), "level")


@query("SELECT d.doc_id, round(CASE WHEN l.doc_id IS NOT NULL THEN 0.75 * least(d.n_chars, 4000) / 4000.0::DOUBLE + 0.25 * l.quality ELSE least(d.n_chars, 4000) / 4000.0::DOUBLE END, 8) AS final_reward FROM documents d LEFT JOIN labels l USING (doc_id)")
def judge_cache_blend(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("message_hash"), (F.least("n_chars", F.lit(4000)) / 4000.0).alias("deterministic_reward"))
    cache = table(spark, d, "labels").select(F.lit(0).alias("position"), F.col("doc_id").alias("message_hash"), F.col("quality").cast("double").alias("score"), F.lit("").alias("reason"), F.lit(True).alias("api_success"))
    return judging.blended(docs, judging.latest_verdicts(cache)).select("doc_id", F.round("final_reward", 8).alias("final_reward"))


@query(f"""WITH {TRAJ}, a AS (SELECT m.conv_id, m.turn, strlen(m.content) AS target, (SELECT sum(strlen(p.content) + 2 * strlen(p.role) + 5) FROM msg p WHERE p.conv_id = m.conv_id AND p.turn <= m.turn) AS whole FROM msg m WHERE m.role = 'assistant')
 SELECT (SELECT count(*) FROM traj) AS trajectories, count(*) AS assistant_turns, count(*) FILTER (target < 2048 AND target > 0) AS examples, count(*) FILTER (target < 2048 AND target > 0 AND whole > 2048) AS left_truncated, count(*) FILTER (target >= 2048) AS dropped_target_too_long, 0 AS template_alignment_fallbacks, count(*) AS content_alignment_fallbacks, 0 AS dropped_alignment_failures FROM a""")
def turn_encode_stats(spark, d):
    traj = trajectories(spark, d)
    stats = encoding.encoding_stats(encoding.encode_turns(traj, 2048), traj)
    return stats.withColumns({c: F.col(c).cast("int") for c in ("template_alignment_fallbacks", "dropped_alignment_failures")})


def _hex(ids) -> str:
    """Ids of bytes as hex digits, ignored ones as dashes."""
    return F.array_join(F.transform(ids, lambda i: F.when(i < 0, "--").otherwise(F.lpad(F.hex(i), 2, "0"))), "")


_WHOLE = "(SELECT string_agg('<' || p.role || '>' || p.content || '</' || p.role || '>', '' ORDER BY p.turn) FROM msg p WHERE p.conv_id = m.conv_id AND p.turn <= m.turn)"
_CLOSED = 2 * len("</assistant>")


@query(
    f"""WITH {TRAJ}, a AS (SELECT CAST(conv_id AS VARCHAR) AS id, (SELECT count(*) FROM msg p WHERE p.conv_id = m.conv_id AND p.turn < m.turn) AS turn, hex(encode(content)) AS target, hex(encode({_WHOLE})) AS whole FROM msg m WHERE m.role = 'assistant'),
 w AS (SELECT *, length(target) BETWEEN 1 AND 4095 AS fits, right(whole, 4096) AS win FROM a)
 SELECT id, turn, CASE WHEN fits THEN 'example' ELSE 'target_too_long' END AS status, fits AND length(whole) > 4096 AS left_truncated, CASE WHEN fits THEN sha256(win) END AS ids_sha256,
 CASE WHEN fits THEN sha256(repeat('-', length(win) - length(right(target, greatest(length(win) - {_CLOSED}, 0))) - {_CLOSED}) || right(target, greatest(length(win) - {_CLOSED}, 0)) || repeat('-', {_CLOSED})) END AS labels_sha256 FROM w"""
)
def turn_encode(spark, d):
    turns = encoding.encode_turns(trajectories(spark, d), 2048)
    sha = lambda c: F.sha2(_hex(F.col(c)).cast("binary"), 256)
    return turns.select("id", "turn", "status", "left_truncated", sha("input_ids").alias("ids_sha256"), sha("labels").alias("labels_sha256"))


def _chat_tokenizer(path: str):
    return lambda: encoding.ChatTokenizer(path)


@query()
def turn_encode_masked(spark, d):
    """Turns by an installed vocabulary with a chat template that marks what assistants say. No SQL makes its ids; tests hold them against encoding each turn anew."""
    import public_tokenizers

    turns = encoding.encode_turns(trajectories(spark, d), 2048, _chat_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    return turns.select("id", "turn", "status", "aligned_by", "left_truncated", "input_ids", "labels")


@query("SELECT event_type, round(sum(value * (user_id % 7 + 1)) / greatest(1.0, sum(user_id % 7 + 1)), 6) AS loss FROM events GROUP BY event_type")
def weighted_loss(spark, d):
    events = table(spark, d, "events").withColumn("tokens", F.col("user_id") % 7 + 1)
    return encoding.weighted_loss(events, "value", "tokens", "event_type").withColumn("loss", F.round("loss", 6))


@query("SELECT event_type, round(min(value), 6) AS loss FROM events GROUP BY event_type ORDER BY min(value), event_type LIMIT 1")
def best_lr(spark, d):
    runs = table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("loss"))
    return encoding.best_setting(runs, "event_type", "loss").select("event_type", F.round("loss", 6).alias("loss"))


# Dedup.


#: One row after the other, with what the rows kept so far hold.
_SCAN = """WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, md5(text) AS a, left(text, 40) AS b, lang || '/' || n_chars AS c FROM documents),
s(i, doc_id, keep, xa, xb, xc) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[] UNION ALL
 SELECT i, doc_id, k, CASE WHEN k THEN list_append(xa, a) ELSE xa END, CASE WHEN k THEN list_append(xb, b) ELSE xb END, CASE WHEN k THEN list_append(xc, c) ELSE xc END
 FROM (SELECT d.*, xa, xb, xc, NOT (list_contains(xa, a) OR list_contains(xb, b) OR list_contains(xc, c)) AS k FROM s JOIN d ON d.i = s.i + 1))
SELECT doc_id FROM s WHERE keep"""


@query(_SCAN)
def exact_dedup(spark, d):
    """Documents by text, opening, and language with length: keys that conflict across one another."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"), F.substring("text", 1, 40).alias("opening"), F.concat_ws("/", "lang", "n_chars").alias("measure"))
    return dedup.exact_dedup(docs, "doc_id", ["hash", "opening", "measure"]).select("doc_id")


@query(_SCAN)
def exact_dedup_rounds(spark, d):
    """The same rows by rounds and components alone, without a scan of all that is left."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"), F.substring("text", 1, 40).alias("opening"), F.concat_ws("/", "lang", "n_chars").alias("measure"))
    return dedup.exact_dedup(docs, "doc_id", ["hash", "opening", "measure"], few=0, rounds=2).select("doc_id")


#: Terms of a table ``t`` (id, text).
_GRAMS = """w AS (SELECT id, unnest(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')) AS w FROM t), p AS (SELECT id, ' ' || w || ' ' AS p, count(*) AS c FROM w WHERE w <> '' GROUP BY ALL),
g AS (SELECT id, c, substring(p, CAST(s AS BIGINT), n) AS term FROM (SELECT id, p, c, n, unnest(range(1, length(p) - n + 2)) AS s FROM p, (VALUES (3), (4), (5)) t(n) WHERE length(p) >= n)), terms AS (SELECT id, term, CAST(sum(c) AS BIGINT) AS tf FROM g GROUP BY ALL)"""
_TERMS = f"t AS (SELECT item_id AS id, text FROM benchmark), {_GRAMS}"
_TFIDF = "voc AS (SELECT term, count(*) AS df FROM terms GROUP BY term HAVING count(*) >= 2), nn AS (SELECT count(DISTINCT id) AS n FROM terms), raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS raw FROM terms JOIN voc USING (term), nn), vec AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)"


def _terms(spark, d) -> DataFrame:
    return dedup.char_ngrams(table(spark, d, "benchmark"), "item_id", "text")


@query(f"WITH {_TERMS}, {_TFIDF} SELECT id, term, round(weight, 6) AS weight FROM vec")
def tfidf_terms(spark, d):
    return r(dedup.tfidf(_terms(spark, d), max_features=None))


@query(f"WITH {_TERMS}, {_TFIDF} SELECT x.id AS a, y.id AS b, round(sum(x.weight * y.weight), 6) AS similarity FROM vec x JOIN vec y ON x.term = y.term AND x.id < y.id GROUP BY ALL HAVING sum(x.weight * y.weight) >= 0.3")
def cosine_pairs(spark, d):
    return r(dedup.cosine_pairs(dedup.tfidf(_terms(spark, d), max_features=None), 0.3))


_SIMILAR = """voc AS (SELECT term, count(*) AS df, sum(tf) AS total FROM terms GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 45000), nn AS (SELECT count(DISTINCT id) AS n FROM terms),
raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS raw FROM terms JOIN voc USING (term), nn), vec AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw),
pairs AS (SELECT x.id AS a, y.id AS b, sum(x.weight * y.weight) AS s FROM vec x JOIN vec y ON x.term = y.term AND x.id <> y.id GROUP BY ALL HAVING sum(x.weight * y.weight) >= 0.93),
near AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM pairs) WHERE k <= 7), links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach(a, b) AS (SELECT id, id FROM t UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)"""
_PROMPTS = f"t AS (SELECT idx AS id, CASE WHEN n <> '' THEN n ELSE prompt END AS text FROM (SELECT idx, prompt, {_normal_prompt_sql('prompt')} AS n FROM traj))"


@query(f"WITH RECURSIVE {TRAJ}, {_PROMPTS}, {_GRAMS}, {_SIMILAR} SELECT a AS index FROM reach GROUP BY a HAVING min(b) = a")
def near_dedup(spark, d):
    docs = trajectory.records(trajectories(spark, d)).select("index", "normalized_prompt", "task_prompt")
    return dedup.near_dedup(docs, "index", "normalized_prompt", "task_prompt").select("index")


# Guardrail and sinks.


#: Responses of a narrator made from documents by rule, and what is known of each: the same texts for Spark and DuckDB.
_TARGET, _KNOWN = "Gifts", ("Accessories", "Gifts", "Kitchen", "Home Decor", "Seasonal", "Stationery")
_SAID = """concat(CASE WHEN doc_id % 5 = 4 THEN '### Interpretation' ELSE '{headings}' END, chr(10), CASE WHEN doc_id % 7 = 6 THEN 'It' ELSE 'GIFTS' END, ' stands out. ', CASE WHEN doc_id % 2 = 0 THEN '' ELSE coalesce(text, '') END,
 CASE doc_id % 11 WHEN 1 THEN ' A look at kitchen wares helps.' WHEN 2 THEN ' Contribution profit was far higher than all revenue.' WHEN 3 THEN ' It is highly cost-effective.' WHEN 4 THEN ' Revenue is a little less than the contribution profit.' WHEN 6 THEN ' It costs £9.' ELSE '' END)""".replace("{headings}", "\n".join(N.HEADINGS[N.ENGLISH]))
_TASK = f"CASE doc_id % 3 WHEN 0 THEN '{N.PROFIT}' WHEN 1 THEN '{N.MARKETING}' ELSE CASE WHEN doc_id % 13 = 0 THEN '{N.TREND}' ELSE '{N.PROFIT}' END END"


def _verdict_sql() -> str:
    headings = " AND ".join(f"contains(low, '{h.lower()}')" for h in N.HEADINGS[N.ENGLISH])
    others = " ".join(f"WHEN regexp_matches(value, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){e}($|[^\\p{{L}}\\p{{N}}_])') THEN 'unverified entity comparison: {e}'" for e in _KNOWN if e != _TARGET)
    wrong = " OR ".join(f"(task = '{t}' AND regexp_matches(low, '{p}'))" for t in (N.PROFIT, N.MARKETING) for p in N.CONTRADICTIONS[t])
    return f"""WITH said AS (SELECT doc_id, {_SAID} AS value, {_TASK} AS task FROM documents), lowered AS (SELECT *, lower(value) AS low FROM said),
judged AS (SELECT doc_id, CASE WHEN task = '{N.TREND}' THEN 'not-applicable' WHEN NOT ({headings}) THEN 'missing required narrative sections' WHEN NOT contains(low, '{_TARGET.lower()}') THEN 'selected entity was omitted' {others}
 WHEN regexp_matches(regexp_replace(value, '(?i){_TARGET}', '', 'g'), '[£$€%]|\\p{{Nd}}') THEN 'model repeated an unverified numeric value' WHEN {wrong} THEN 'financial consistency rule failed' ELSE 'passed' END AS reason FROM lowered)
SELECT doc_id, reason, reason IN ('passed', 'not-applicable') AS passed FROM judged"""


@query(_verdict_sql())
def guardrail_verdicts(spark, d):
    said = table(spark, d, "documents").select("doc_id", F.expr(_SAID).alias("value"), F.expr(_TASK).alias("task"))
    known = F.array(*(F.lit(e) for e in _KNOWN))
    return guard.verdicts(said.withColumns({"language": F.lit(N.ENGLISH), "target": F.lit(_TARGET), "known": known})).select("doc_id", "reason", "passed")


#: Responses with markup in them, made from documents by rule.
_MARKED = """concat(CASE doc_id % 3 WHEN 0 THEN '<svg width="9">' WHEN 1 THEN '<CODE>' ELSE '' END, CASE WHEN doc_id % 17 = 0 THEN 'short' ELSE replace(coalesce(text, ''), ' the ', '&#x20;the ') END, CASE doc_id % 3 WHEN 0 THEN '</svg>' WHEN 1 THEN '</code >' ELSE '' END,
 CASE doc_id % 5 WHEN 0 THEN concat(chr(10), '```xml', chr(10), '<a>', chr(10), '```', chr(10), 'end') WHEN 1 THEN concat(chr(10), '```python', chr(10), 'x') WHEN 2 THEN concat(chr(10), ' SVG ', chr(10), 'end') WHEN 3 THEN concat(chr(10), '```svg', chr(10), 'open') ELSE concat(chr(10), chr(10), ' ', chr(10), chr(10), 'end') END)"""
_CLEANING = r"""WITH a AS (SELECT doc_id, replace({said}, '&#x20;', ' ') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(t, '(?is)```(?:xml|svg)\s*.*?(?:```|\z)', '', 'g') AS t FROM a), c AS (SELECT doc_id, regexp_replace(t, '(?is)</?(?:code|svg|xml)(?:\s+[^>]*)?>', '', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '(?im)^\s*(?:svg|xml)\s*$', '', 'g') AS t FROM c), e AS (SELECT doc_id, trim(regexp_replace(t, '(?:\n\s*){{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM d),
f AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(t, '```')) % 2 = 1 THEN t || chr(10) || '```' ELSE t END AS t FROM e) SELECT doc_id, CASE WHEN length(t) < 20 THEN '{unusable}' ELSE t END AS text FROM f"""


@query(_CLEANING.format(said=_MARKED, unusable=N.UNUSABLE))
def clean_response(spark, d):
    return table(spark, d, "documents").select("doc_id", guard.cleaned_response(F.expr(_MARKED)).alias("text"))


_FOUND = {
    N.PROFIT: {"target": "category", "margin": _fixed_sql("100 * margin", 2) + " || '%'", "portfolio": _fixed_sql("100 * portfolio_margin", 2) + " || '%'", "gap": _fixed_sql("margin_gap_pp", 2), "leakage": _money_sql("estimated_profit_leakage")},
    N.MARKETING: {"target": "channel", "pound": _fixed_sql("profit_per_ad_pound", 2), "roas": _fixed_sql("roas", 2), "order": "format('{:,}', CAST(trunc(profit_per_order) AS BIGINT)) || right(" + _fixed_sql("profit_per_order", 2) + ", 3)"},
    N.INVENTORY: {"target": "CAST(sku AS VARCHAR)", "description": "description", "lines": "'10'", "units": "format('{:,}', CAST(units AS BIGINT))", "orders": "format('{:,}', orders)"},
}
_FIRST = {
    N.PROFIT: "leak WHERE revenue > 0 ORDER BY estimated_profit_leakage DESC, margin, category LIMIT 1",
    N.MARKETING: "eff WHERE ad_spend > 0 AND orders > 0 ORDER BY profit_per_ad_pound, roas, channel LIMIT 1",
    N.INVENTORY: "dem WHERE transaction_lines >= 10 AND units > 0 ORDER BY units DESC, orders DESC, sku, description LIMIT 1",
}


@query(f"WITH {TXN}, {_TOTALS}, {_LEAK}, {_CHANNEL}, {_DEMAND} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{language}' AS language, '{task}' AS task, {_filled_sql(text, _FOUND[task])} AS finding FROM {_FIRST[task]})" for (language, task), text in N.FINDINGS.items()))
def verified_finding(spark, d):
    # Joined and costed once: each task reads its columns of the table.
    lines, out = written(transactions(spark, d).select(*commerce.DECIDED), "finding-lines"), None
    for task in _FOUND:
        decision = commerce.evidence(lines, task).decision
        for language in (N.ENGLISH, N.CHINESE):
            said = guard.finding(decision, task, language).select(F.lit(language).alias("language"), F.lit(task).alias("task"), "finding")
            out = said if out is None else out.unionByName(said)
    discard(lines)  # a decision is a row of its own
    return out


_AUDITED = {"final_reward": "final_reward", "deterministic_reward": "final_reward", "complexity_score": "cs", "syntax_score": "syntax_score", "execution_consistency_score": "exec", "completeness_score": "complete"}
_COUNTED = {"assistant_turns": "assistant_turns", "code_blocks": _BLOCKS, "interpreter_turns": "good + bad", "characters": "length(alltext)"}


@query(
    f"WITH {TRAJ}, {_REWARD} SELECT '' AS split, id, grp AS \"group\", level, {', '.join(f"printf('%.8f', {c}) AS {n}" for n, c in _AUDITED.items())}, {', '.join(f'CAST({c} AS VARCHAR) AS {n}' for n, c in _COUNTED.items())}, "
    "'' AS glm_score, '' AS glm_api_success, '' AS glm_reason FROM rw"
)
def audit_rows(spark, d):
    scored = _scored(spark, d).withColumn("final_reward", F.round("final_reward", 8))
    return sinks.audit_rows(scored)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_trend(spark, d):
    """An extension: the batch form of the streaming trend."""
    out = trend.event_trend(table(spark, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

