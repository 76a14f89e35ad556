"""Commerce marts and evidence over transaction lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import narratives as N
from millrace.functions.text import divided, filled, money, percent, stable_fraction, strip

#: Categories by keyword, the first that matches wins; all other lines are DEFAULT_CATEGORY.
CATEGORY_WORDS = {
    "Seasonal": ("CHRISTMAS", "EASTER", "HALLOWEEN", "VALENTINE"),
    "Kitchen": ("MUG", "CUP", "PLATE", "BOWL", "KITCHEN", "TEA"),
    "Home Decor": ("LANTERN", "CANDLE", "FRAME", "LIGHT", "DECORATION"),
    "Stationery": ("NOTEBOOK", "PENCIL", "PEN ", "CARD", "PAPER"),
    "Accessories": ("BAG", "PURSE", "NECKLACE", "BRACELET", "UMBRELLA"),
}
DEFAULT_CATEGORY = "Gifts"
#: Cost of goods by category, share of the price.
COST_BASE = {"Seasonal": 0.43, "Kitchen": 0.39, "Home Decor": 0.46, "Stationery": 0.34, "Accessories": 0.42, "Gifts": 0.40}
#: Channels with their shares, and those that are paid for.
CHANNELS = {"Organic": 0.29, "Meta Ads": 0.19, "Google Ads": 0.20, "TikTok Ads": 0.10, "Email": 0.10, "Marketplace": 0.12}
PAID = ("Meta Ads", "Google Ads", "TikTok Ads")
#: Names of the raw sheet's columns.
RAW_NAMES = {"Invoice": "invoice_id", "StockCode": "sku", "Description": "description", "Quantity": "quantity", "InvoiceDate": "invoice_timestamp", "Price": "unit_price_gbp", "Customer ID": "customer_id", "Country": "country"}
#: Columns that an upload must have, observed and simulated.
OBSERVED = frozenset({"invoice_id", "sku", "description", "quantity", "invoice_timestamp", "unit_price_gbp", "customer_id", "country", "observed_net_revenue_gbp"})
SIMULATED = frozenset({"channel", "sim_unit_cost_gbp", "sim_allocated_ad_spend_gbp", "sim_platform_fee_gbp", "sim_fulfilment_cost_gbp", "sim_cogs_gbp", "sim_contribution_profit_gbp"})
#: Money is exact to 4 decimals, so sums do not hang on the order of rows.
_MONEY = "decimal(20,4)"
REVENUE, PROFIT, ADS = "observed_net_revenue_gbp", "sim_contribution_profit_gbp", "sim_allocated_ad_spend_gbp"

#: Columns that decisions and their evidence read.
DECIDED = ("invoice_id", "sku", "description", "quantity", "is_return", "category", "channel", "invoice_timestamp", REVENUE, PROFIT, ADS, "sim_cogs_gbp", "sim_platform_fee_gbp", "sim_fulfilment_cost_gbp")


def missing_columns(columns: list[str]) -> list[str]:
    """Required columns that ``columns`` lacks. ``category`` and ``is_return`` count as required too, since the analyses read them."""
    return sorted((OBSERVED | SIMULATED | {"category", "is_return"}) - set(columns))


def category_of(description: Column, words: dict[str, tuple[str, ...]] | None = None, default: str = DEFAULT_CATEGORY) -> Column:
    upper, out = F.upper(F.coalesce(description, F.lit(""))), None
    for name, keys in (words or CATEGORY_WORDS).items():
        hit = F.lit(False)
        for key in keys:
            hit = hit | F.contains(upper, F.lit(key))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def typed(raw: DataFrame) -> DataFrame:
    """Raw sheet rows with typed columns: rows without a time, price or quantity, with a price of 0 or less or a quantity of 0 go."""
    df = raw.withColumnsRenamed(RAW_NAMES)
    df = df.withColumns(
        {
            "invoice_id": F.col("invoice_id").cast("string"),
            "sku": F.col("sku").cast("string"),
            "description": strip(F.coalesce(F.col("description"), F.lit("Unknown item"))),
            "country": F.coalesce("country", F.lit("Unknown")),
            "invoice_timestamp": F.try_to_timestamp(F.col("invoice_timestamp").cast("string")),
            "unit_price_gbp": F.col("unit_price_gbp").try_cast("double"),
            "quantity": F.col("quantity").try_cast("double"),
        }
    )
    return df.na.drop(subset=["invoice_timestamp", "unit_price_gbp", "quantity"]).where("unit_price_gbp > 0 and quantity <> 0 and not isnan(unit_price_gbp) and not isnan(quantity)")


def derived(df: DataFrame) -> DataFrame:
    """Adds to typed rows what follows from each: return, category, day, revenue."""
    return df.withColumns(
        {
            "is_return": F.startswith(F.upper("invoice_id"), F.lit("C")) | (F.col("quantity") < 0),
            "category": category_of(F.col("description")),
            "order_date": F.date_format("invoice_timestamp", "yyyy-MM-dd"),
            REVENUE: F.col("quantity") * F.col("unit_price_gbp"),
        }
    )


def cleaned(raw: DataFrame) -> DataFrame:
    """Transaction lines of raw sheet rows, those without use aside (``typed``), with ``derived`` columns."""
    return derived(typed(raw))


def exact_sample(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows, chosen by a hash of ``key`` and ``seed``; ``key`` must tell rows apart for the choice to be one of rows."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"), 256)).limit(n)


def numbered(df: DataFrame, *ties: str) -> DataFrame:
    """Puts ``line_id`` 1, 2, ... by time, then ``ties``, before the other columns."""
    from .trajectory import global_rank

    ranked = global_rank(df, F.col("invoice_timestamp").asc(), *(F.col(c).asc() for c in ties))
    return ranked.select((F.col("__rank") + 1).alias("line_id"), *df.columns)


def channel_of(key: Column) -> Column:
    """A channel by the stable fraction of ``key`` and the channels' shares."""
    fraction, total, out = stable_fraction(key, "channel"), 0, None
    for name, share in list(CHANNELS.items())[:-1]:
        total += round(100 * share)
        out = (F.when if out is None else out.when)(fraction < total / 100, name)
    return out.otherwise(list(CHANNELS)[-1])


def _exact(value: Column) -> Column:
    return F.round(value, 4).cast(_MONEY)


def simulated_costs(df: DataFrame, line_key: Column) -> DataFrame:
    """Adds the simulated cost columns. Rates come from stable fractions of ``line_key`` (of the sku for the cost ratio), so they do not hang on row order."""
    base = None
    for name, share in COST_BASE.items():
        base = (F.when if base is None else base.when)(F.col("category") == name, share)
    ratio = F.least(F.greatest(base + (stable_fraction(F.col("sku"), "cogs") - 0.5) * 0.12, F.lit(0.24)), F.lit(0.62))
    rate = lambda salt, low, high: low + (high - low) * stable_fraction(line_key, salt)
    sold, gain, units = ~F.col("is_return"), F.greatest(F.col(REVENUE).cast("double"), F.lit(0.0)), F.abs("quantity")
    df = df.withColumn("sim_unit_cost_gbp", _exact(F.col("unit_price_gbp") * ratio))
    df = df.withColumns(
        {
            ADS: _exact(F.when(F.col("channel").isin(*PAID) & sold, gain * rate("ads", 0.08, 0.24)).otherwise(0.0)),
            "sim_platform_fee_gbp": _exact(F.when(sold, gain * rate("fee", 0.025, 0.075)).otherwise(0.0)),
            "sim_fulfilment_cost_gbp": _exact(F.when(sold, 1.15 + units * rate("fulfilment", 0.08, 0.22)).otherwise(0.45)),
            "sim_cogs_gbp": _exact(F.when(sold, units).otherwise(-units) * F.col("sim_unit_cost_gbp").cast("double")),
        }
    )
    profit = F.col(REVENUE).cast(_MONEY) - F.col("sim_cogs_gbp") - F.col(ADS) - F.col("sim_platform_fee_gbp") - F.col("sim_fulfilment_cost_gbp")
    return df.withColumn(PROFIT, profit.cast(_MONEY)).withColumns({"observed_source": F.lit("observed transactions"), "operational_field_status": F.lit("cost, ad, fee and fulfilment fields are simulated")})


def _sum(name: str) -> Column:
    """Sum as a double; 0 over nulls alone."""
    return F.coalesce(F.sum(name), F.lit(0)).cast("double")


def portfolio_totals(df: DataFrame) -> DataFrame:
    """One row: revenue, profit, ad spend, orders, share of returns, margin (0 without revenue), rows."""
    out = df.agg(_sum(REVENUE).alias("revenue"), _sum(PROFIT).alias("profit"), _sum(ADS).alias("ad_spend"), F.countDistinct("invoice_id").alias("orders"), F.avg(F.col("is_return").cast("int")).alias("return_line_rate"), F.count("*").alias("n_rows"))
    return out.withColumn("margin", F.coalesce(divided(F.col("profit"), F.col("revenue")), F.lit(0.0)))


def profit_leak(df: DataFrame) -> DataFrame:
    """Per category (null ones aside) sums, margin, gap to the margin of all lines and profit below it. One pass: a category's sums are small, so the totals are a window over them."""
    sums = df.groupBy("category").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).cast("decimal(34,4)").alias(n) for c, n in ((REVENUE, "revenue"), (PROFIT, "contribution_profit"), ("sim_cogs_gbp", "cogs"), (ADS, "ad_spend"), ("sim_platform_fee_gbp", "platform_fee"), ("sim_fulfilment_cost_gbp", "fulfilment"))),
        F.avg(F.col("is_return").cast("int")).alias("return_line_rate"),
    )
    whole = Window.partitionBy()
    total = lambda c: F.sum(c).over(whole).cast("double")
    df = sums.withColumn("portfolio_margin", F.coalesce(divided(total("contribution_profit"), total("revenue")), F.lit(0.0))).where("category is not null")
    df = df.withColumns({c: F.col(c).cast("double") for c in ("revenue", "contribution_profit", "cogs", "ad_spend", "platform_fee", "fulfilment")})
    df = df.withColumn("margin", divided(F.col("contribution_profit"), F.col("revenue")))
    leak = F.col("portfolio_margin") * F.col("revenue") - F.col("contribution_profit")
    return df.withColumns({"margin_gap_pp": (F.col("portfolio_margin") - F.col("margin")) * 100, "estimated_profit_leakage": F.greatest(leak, F.lit(0.0))})


LEAK_ORDER = (F.desc_nulls_last, "estimated_profit_leakage"), (F.asc_nulls_last, "margin"), (F.asc, "category")


def ordered(df: DataFrame, order) -> DataFrame:
    return df.orderBy(*(way(name) for way, name in order))


def profit_leak_decision(df: DataFrame) -> DataFrame:
    """The category to look at first, with its shares; no row if none has revenue."""
    table = profit_leak(df).withColumn("known_categories", F.array_sort(F.collect_list("category").over(Window.partitionBy())))
    top = ordered(table.where("revenue > 0"), LEAK_ORDER).limit(1)
    share = lambda c: F.col(c) / F.col("revenue")
    return top.select(
        F.lit("Profit Leak").alias("task"), F.col("category").alias("target_category"), F.col("revenue").alias("target_revenue"), F.col("contribution_profit").alias("target_profit"), F.col("margin").alias("target_margin"), "portfolio_margin", "margin_gap_pp",
        "estimated_profit_leakage", share("cogs").alias("cogs_share"), share("ad_spend").alias("ad_share"), share("fulfilment").alias("fulfilment_share"), "return_line_rate", F.lit("simulated").alias("cost_basis"), "known_categories",
    )


def marketing_efficiency(df: DataFrame) -> DataFrame:
    """Per channel sums, orders, revenue and profit for each pound of advertising, profit for each order."""
    out = df.where("channel is not null").groupBy("channel").agg(_sum(REVENUE).alias("revenue"), _sum(PROFIT).alias("contribution_profit"), _sum(ADS).alias("ad_spend"), F.countDistinct("invoice_id").alias("orders"))
    return out.withColumns({"roas": divided(F.col("revenue"), F.col("ad_spend")), "profit_per_ad_pound": divided(F.col("contribution_profit"), F.col("ad_spend")), "profit_per_order": divided(F.col("contribution_profit"), F.col("orders"))})


EFFICIENCY_ORDER = (F.asc_nulls_last, "profit_per_ad_pound"), (F.asc_nulls_last, "roas"), (F.asc, "channel")


def marketing_decision(df: DataFrame) -> DataFrame:
    """The paid channel that earns least for a pound; no row if none is paid."""
    table = marketing_efficiency(df).withColumn("known_entities", F.array_sort(F.collect_list("channel").over(Window.partitionBy())))
    top = ordered(table.where("ad_spend > 0 and orders > 0"), EFFICIENCY_ORDER).limit(1)
    return top.select(
        F.lit("Marketing Efficiency").alias("task"), F.col("channel").alias("target_entity"), F.lit("channel").alias("target_kind"), F.col("revenue").alias("target_revenue"), F.col("contribution_profit").alias("target_profit"), F.col("ad_spend").alias("target_ad_spend"),
        F.col("roas").alias("target_roas"), F.col("profit_per_ad_pound").alias("target_profit_per_ad_pound"), F.col("profit_per_order").alias("target_profit_per_order"), F.lit(N.RULES[N.MARKETING]).alias("selection_rule"), F.lit("simulated").alias("cost_basis"), "known_entities",
    )


def inventory_demand(df: DataFrame) -> DataFrame:
    """Per sku and description, returns aside: units, revenue, profit, orders, lines."""
    return df.where("not is_return and sku is not null and description is not null").groupBy("sku", "description").agg(
        _sum("quantity").alias("units"), _sum(REVENUE).alias("revenue"), _sum(PROFIT).alias("contribution_profit"), F.countDistinct("invoice_id").alias("orders"), F.count("invoice_id").alias("transaction_lines")
    )


DEMAND_ORDER = (F.desc, "units"), (F.desc, "orders"), (F.asc, "sku"), (F.asc, "description")


def inventory_risk(df: DataFrame, minimum_lines: int = 10, n: int = 15) -> DataFrame:
    """The ``n`` products in greatest demand of those with enough lines."""
    return ordered(inventory_demand(df).where((F.col("transaction_lines") >= minimum_lines) & (F.col("units") > 0)), DEMAND_ORDER).limit(n)


def inventory_decision(df: DataFrame, minimum_lines: int = 10) -> DataFrame:
    """The product in greatest demand; no row if none has enough lines. The skus it may be confused with are not gathered: the narrative check needs none."""
    return inventory_risk(df, minimum_lines, 1).select(
        F.lit("Inventory Risk").alias("task"), F.col("sku").cast("string").alias("target_entity"), F.lit("SKU").alias("target_kind"), F.col("description").alias("target_description"), F.col("units").alias("target_units"), F.col("orders").alias("target_orders"),
        F.col("transaction_lines").alias("target_transaction_lines"), F.lit(minimum_lines).cast("long").alias("minimum_transaction_lines"), F.lit(N.RULES[N.INVENTORY]).alias("selection_rule"), F.lit(False).alias("inventory_status_available"),
    )


def monthly_trend(df: DataFrame, n: int = 18) -> DataFrame:
    """Revenue and profit of the last ``n`` months, in order; lines without a time form the month ``NaT``, after all others."""
    month = F.coalesce(F.date_format("invoice_timestamp", "yyyy-MM"), F.lit("NaT")).alias("month")
    return df.groupBy(month).agg(_sum(REVENUE).alias("revenue"), _sum(PROFIT).alias("contribution_profit")).orderBy(F.desc("month")).limit(n).orderBy("month")


def evidence_text(totals: DataFrame, language: str = N.ENGLISH) -> DataFrame:
    """One sentence over the one row of ``portfolio_totals``."""
    values = {
        "rows": F.format_number("n_rows", 0), "orders": F.format_number("orders", 0), "revenue": money(F.col("revenue")), "profit": money(F.col("profit")),
        "margin": percent(F.col("margin"), 1), "ads": money(F.col("ad_spend")), "returns": F.coalesce(percent(F.col("return_line_rate"), 2), F.lit("nan%")),
    }
    return totals.select(filled(N.EVIDENCE[language], values).alias("evidence"))


@dataclass
class Evidence:
    """What is known about a task: a sentence, a table in the order of its chart, and the one row that names a target (None for trends)."""

    text: DataFrame
    table: DataFrame
    decision: DataFrame | None


def evidence(df: DataFrame, task: str, language: str = N.ENGLISH, minimum_lines: int = 10) -> Evidence:
    """Evidence over transaction lines for a task by its name in any language; a name of none is a trend.

    Raises ValueError if a task that names a target finds none, as in an empty table. Of the data only the row of the decision reaches the driver.
    """
    named = [t for names in N.TASK_LABELS.values() for t, label in names.items() if task in (t, label)]
    task = named[0] if named else N.TREND
    text = evidence_text(portfolio_totals(df), language)
    decision = {N.PROFIT: profit_leak_decision, N.MARKETING: marketing_decision, N.INVENTORY: lambda d: inventory_decision(d, minimum_lines)}.get(task)
    table = {
        N.PROFIT: lambda: ordered(profit_leak(df), LEAK_ORDER), N.MARKETING: lambda: ordered(marketing_efficiency(df), EFFICIENCY_ORDER),
        N.INVENTORY: lambda: inventory_risk(df, minimum_lines), N.TREND: lambda: monthly_trend(df),
    }[task]()
    if decision is None:
        return Evidence(text, table, None)
    found = decision(df)
    row = found.collect()
    if not row:
        raise ValueError(N.NO_TARGET[task])
    return Evidence(text, table, df.sparkSession.createDataFrame(row, found.schema))


def inventory_mart(df: DataFrame, n: int = 500) -> DataFrame:
    """The ``n`` products sold most, with prices, unit cost and simulated stock; draws are stable fractions of the sku."""
    sold = df.where("not is_return").groupBy("sku", "description", "category").agg(_sum("quantity").alias("units_sold"), F.avg("unit_price_gbp").alias("avg_unit_price_gbp"), F.avg(F.col("sim_unit_cost_gbp").cast("double")).alias("sim_unit_cost_gbp"))
    top = sold.orderBy(F.desc("units_sold"), "sku", "description", "category").limit(n)
    fraction = lambda salt: stable_fraction(F.col("sku"), salt)
    lead = (4 + F.floor(fraction("lead") * 25)).cast("long")
    reorder = F.ceil(F.greatest(F.col("units_sold") / 365.0, F.lit(0.2)) * F.col("sim_lead_time_days") * (1.15 + 0.65 * fraction("safety"))).cast("long")
    top = top.withColumn("sim_lead_time_days", lead).withColumn("sim_reorder_point_units", reorder)
    hand = F.floor(fraction("hand") * F.greatest(F.col("sim_reorder_point_units") * 3, F.lit(2))).cast("long")
    return top.withColumns({"sim_on_hand_units": hand, "sim_holding_cost_per_unit_month_gbp": F.col("sim_unit_cost_gbp") * (0.015 + 0.02 * fraction("holding")), "operational_field_status": F.lit("inventory attributes are simulated")})


def ads_mart(df: DataFrame) -> DataFrame:
    """Per day and paid channel, returns aside: spend, revenue, orders, simulated clicks and impressions."""
    paid = df.where(F.col("channel").isin(*PAID) & ~F.col("is_return"))
    out = paid.groupBy("order_date", "channel").agg(_sum(ADS).alias("sim_spend_gbp"), _sum(REVENUE).alias("observed_attributed_revenue_gbp"), F.countDistinct("invoice_id").alias("orders"))
    key = F.concat_ws("|", "order_date", "channel")
    clicks = F.greatest(F.floor(F.col("sim_spend_gbp") / (0.35 + 1.05 * stable_fraction(key, "click")) + 0.5), F.lit(1)).cast("long")
    out = out.withColumn("sim_clicks", clicks)
    return out.withColumn("sim_impressions", F.floor(F.col("sim_clicks") / (0.008 + 0.027 * stable_fraction(key, "impression")) + 0.5).cast("long"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row about the whole table."""
    return df.agg(
        F.count("*").alias("n_rows"), F.countDistinct("invoice_id").alias("orders"), F.countDistinct("sku").alias("products"), F.countDistinct("country").alias("countries"), F.min("invoice_timestamp").cast("string").alias("date_min"), F.max("invoice_timestamp").cast("string").alias("date_max"),
        F.round(_sum(REVENUE), 2).alias("observed_net_revenue_gbp"), F.round(_sum(PROFIT), 2).alias("sim_contribution_profit_gbp"), F.round(F.avg(F.col("is_return").cast("int")), 6).alias("return_line_rate"),
    )
