"""The generic tables as transaction lines and trajectories, as DataFrames and as SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.commerce import COST_BASE, PAID, category_of, channel_of, simulated_costs

#: Categories of the parts, by word of their name.
PART_WORDS = {"Seasonal": ("HOT", "COLD"), "Kitchen": ("PLATE", "BOLT"), "Home Decor": ("RING", "ROD"), "Stationery": ("WIDGET",), "Accessories": ("GEAR",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction line for each lineitem. The part table stays small beside the lines, so the planner may broadcast it; lines are joined to nothing else: the order's key is all they need of it."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    df = lines.join(parts.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    back = F.col("l_returnflag") == "R"
    sign = F.when(back, -1).otherwise(1)
    revenue = (F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))) * sign
    df = df.select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_partkey").alias("sku"), F.col("p_name").alias("description"), (F.col("l_quantity") * sign).alias("quantity"), F.col("l_shipdate").alias("invoice_timestamp"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price_gbp"),
        F.col("l_suppkey").alias("customer_id"), F.lit("Unknown").alias("country"), back.alias("is_return"), category_of(F.col("p_name"), PART_WORDS).alias("category"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("order_date"), revenue.cast("decimal(20,4)").alias("observed_net_revenue_gbp"), channel_of(F.col("l_orderkey")).alias("channel"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("__line"),
    )
    return simulated_costs(df, F.col("__line")).drop("__line")


def _fraction(salt: str, value: str) -> str:
    return f"(('0x' || sha256('{salt}|' || CAST({value} AS VARCHAR))[1:16])::UBIGINT::DOUBLE / 18446744073709551616.0)"


def _category_sql(column: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(upper({column}), '{word}')" for word in words) + f" THEN '{name}'" for name, words in PART_WORDS.items())
    return f"CASE {cases} ELSE 'Gifts' END"


_BASE = "CASE category " + " ".join(f"WHEN '{name}' THEN {share}" for name, share in COST_BASE.items()) + " END"
_PAID = ", ".join(f"'{name}'" for name in PAID)

#: Transaction lines, ``txn``, as a common table expression.
TXN = f"""
raw AS (SELECT l_orderkey AS invoice_id, l_partkey AS sku, p_name AS description, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
  l_shipdate AS invoice_timestamp, l_extendedprice / l_quantity AS unit_price_gbp, l_returnflag = 'R' AS is_return, {_category_sql('p_name')} AS category,
  strftime(l_shipdate, '%Y-%m-%d') AS order_date, CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS rev,
  {_fraction('channel', 'l_orderkey')} AS f_channel, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS line, 'Unknown' AS country
  FROM lineitem JOIN part ON l_partkey = p_partkey),
chan AS (SELECT *, CAST(rev AS DECIMAL(20,4)) AS revenue_line, CASE WHEN f_channel < 0.29 THEN 'Organic' WHEN f_channel < 0.48 THEN 'Meta Ads' WHEN f_channel < 0.68 THEN 'Google Ads' WHEN f_channel < 0.78 THEN 'TikTok Ads' WHEN f_channel < 0.88 THEN 'Email' ELSE 'Marketplace' END AS channel FROM raw),
cost AS (SELECT *, greatest(CAST(revenue_line AS DOUBLE), 0.0) AS gain, CAST(round(unit_price_gbp * least(greatest({_BASE} + ({_fraction('cogs', 'sku')} - 0.5) * 0.12, 0.24), 0.62), 4) AS DECIMAL(20,4)) AS unit_cost FROM chan),
fees AS (SELECT *, CAST(round(CASE WHEN channel IN ({_PAID}) AND NOT is_return THEN gain * (0.08 + (0.24 - 0.08) * {_fraction('ads', 'line')}) ELSE 0.0 END, 4) AS DECIMAL(20,4)) AS ads,
  CAST(round(CASE WHEN NOT is_return THEN gain * (0.025 + (0.075 - 0.025) * {_fraction('fee', 'line')}) ELSE 0.0 END, 4) AS DECIMAL(20,4)) AS fee,
  CAST(round(CASE WHEN NOT is_return THEN 1.15 + abs(quantity) * (0.08 + (0.22 - 0.08) * {_fraction('fulfilment', 'line')}) ELSE 0.45 END, 4) AS DECIMAL(20,4)) AS fulfilment,
  CAST(round(CASE WHEN NOT is_return THEN abs(quantity) ELSE -abs(quantity) END * CAST(unit_cost AS DOUBLE), 4) AS DECIMAL(20,4)) AS cogs FROM cost),
txn AS (SELECT *, CAST(revenue_line - cogs - ads - fee - fulfilment AS DECIMAL(20,4)) AS profit FROM fees)"""


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trajectory for each conversation, with code, answers and interpreter output put in by rule, since the table has none."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(DECORATED).alias("content"))
    gathered = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    messages = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")
    return gathered.select(
        F.col("conv_id").alias("index"), F.col("conv_id").cast("string").alias("id"), F.expr(GROUPED).alias("group"), F.when(F.size("m") <= 3, "Easy").when(F.size("m") <= 5, "Medium").otherwise("Hard").alias("level"), messages
    )


#: Group of a conversation by rule: a third of all share one.
GROUPED = "CASE WHEN conv_id % 3 = 0 THEN 'g0' ELSE concat('g', conv_id % 23) END"

#: Content of a message by rule; the same text for Spark and DuckDB. Every seventh conversation opens with a prompt of one template, in three wordings that differ by a letter or two; every fifth has code that does not parse.
DECORATED = r"""CASE
 WHEN role = 'user' AND turn <= 1 AND conv_id % 7 = 1 THEN concat('Please sum up the quarterly report of the northern branch office for the board of directors, with all figures and every open question', CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN 's' ELSE ' ?' END)
 WHEN role = 'assistant' AND (conv_id * 7 + turn) % 4 = 0 AND conv_id % 5 = 0 THEN concat(text, chr(10), '```python', chr(10), 'print((', turn, ')', chr(10), '```')
 WHEN role = 'assistant' AND (conv_id * 7 + turn) % 4 = 0 THEN concat('<think>plan</think>', text, chr(10), '```python', chr(10), 'print(', turn, ')', chr(10), '```')
 WHEN role = 'assistant' AND (conv_id * 7 + turn) % 4 = 1 THEN concat(text, chr(10), '<code>select 1</code>')
 WHEN role = 'assistant' AND (conv_id * 7 + turn) % 4 = 2 THEN concat(text, '<answer>', left(text, 60), '</answer>')
 WHEN role = 'user' AND turn > 1 AND (conv_id + turn) % 3 = 0 THEN concat('<interpreter>Code run successfully. ', text, '</interpreter>')
 WHEN role = 'user' AND turn > 1 AND (conv_id + turn) % 3 = 1 THEN concat('<interpreter>error:x ', text, '</interpreter>')
 ELSE text END"""

#: Messages, ``msg``, and trajectories, ``traj``, as common table expressions.
TRAJ = f"""
msg AS (SELECT conv_id, turn, role, {DECORATED} AS content FROM conversations),
traj AS (SELECT conv_id AS idx, CAST(conv_id AS VARCHAR) AS id, {GROUPED} AS grp, CASE WHEN count(*) <= 3 THEN 'Easy' WHEN count(*) <= 5 THEN 'Medium' ELSE 'Hard' END AS level,
  string_agg(content, chr(10) ORDER BY turn) AS alltext, count(*) AS n_messages,
  coalesce(string_agg(content, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS assistant_text,
  count(*) FILTER (role = 'assistant') AS assistant_turns,
  count(*) FILTER (contains(lower(content), '<interpreter>')) AS seen,
  count(*) FILTER (contains(lower(content), '<interpreter>') AND regexp_matches(content, '(?i)\\b(code run successfully|executed successfully|output has been saved|the output content is|rows? returned|query executed successfully)\\b')) AS good,
  count(*) FILTER (contains(lower(content), '<interpreter>') AND regexp_matches(content, '(?i)\\b(traceback|exception|syntaxerror|nameerror|failed|error:)\\b')) AS bad,
  bool_or(regexp_matches(content, '(?is)<answer>.*?</answer>')) AS answered,
  coalesce(trim(first(content ORDER BY turn) FILTER (role = 'user' AND NOT contains(lower(content), '<interpreter>')), ' ' || chr(9) || chr(10) || chr(13)), '') AS prompt,
  coalesce(regexp_extract(last(content ORDER BY turn) FILTER (role = 'assistant' AND regexp_matches(content, '(?is)<answer>.*?</answer>')), '(?is)<answer>.*?</answer>'), '') AS answer
  FROM msg GROUP BY conv_id)"""
