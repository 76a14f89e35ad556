"""Narratives held against computed facts, and the texts that state those facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import narratives as N
from millrace.functions.text import casefold, filled, money, percent, strip


def _any(column: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.rlike(column, F.lit(pattern))
    return hit


def _literal(text: Column) -> Column:
    """``text`` as a regular expression for itself."""
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1")


def verdicts(responses: DataFrame) -> DataFrame:
    """Adds ``passed`` and ``reason`` to responses (value, task, language, target, known: array of entities).

    The first rule that fails gives the reason: headings, target, other entities or identifiers, numbers, contradictions.
    Tasks without a selected entity always pass. A null value counts as empty.
    """
    value, target = F.coalesce("value", F.lit("")), F.coalesce("target", F.lit(""))
    low, own = casefold(value), casefold(target)
    lacks = lambda language: ~F.forall(F.array(*(F.lit(h.casefold()) for h in N.HEADINGS[language])), lambda h: F.contains(low, h))
    headings = F.when(F.col("language") == N.CHINESE, lacks(N.CHINESE)).otherwise(lacks(N.ENGLISH))
    identifiers = F.regexp_extract_all(value, F.lit(r"(?U)\b(?=[A-Za-z0-9-]*\d)[A-Za-z0-9-]+\b"), F.lit(0))
    strange = F.exists(identifiers, lambda i: casefold(i) != own)
    others = F.filter(F.coalesce("known", F.array().cast("array<string>")), lambda e: (casefold(e) != own) & F.rlike(value, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), _literal(e), F.lit(r"(?![\p{L}\p{N}_])"))))
    numbers = F.rlike(F.when(target == "", value).otherwise(F.regexp_replace(value, F.concat(F.lit("(?iu)"), _literal(target)), F.lit(""))), F.lit(r"(?U)[£$€%]|\d"))
    wrong = F.lit(False)
    for task, patterns in N.CONTRADICTIONS.items():
        wrong = wrong | ((F.col("task") == task) & _any(low, patterns))
    # The reasons of a verdict, and above them the patterns of identifiers and numbers.
    reason = (
        F.when(~F.coalesce(F.col("task").isin(*N.CONTRADICTIONS), F.lit(False)), "not-applicable")
        .when(headings, "missing required narrative sections")
        .when(~F.contains(low, own), "selected entity was omitted")
        .when((F.col("task") == N.INVENTORY) & strange, "unverified SKU identifier")
        .when((F.col("task") != N.INVENTORY) & (F.size(others) > 0), F.concat(F.lit("unverified entity comparison: "), F.get(others, 0)))
        .when(numbers, "model repeated an unverified numeric value")
        .when(wrong, "financial consistency rule failed")
        .otherwise("passed")
    )
    return responses.withColumn("reason", reason).withColumn("passed", F.col("reason").isin("passed", "not-applicable"))


def cleaned_response(value: Column) -> Column:
    """Markup that no reader should see goes; an open fence is closed; what is too short becomes a fixed message."""
    text = F.replace(F.coalesce(value, F.lit("None")), F.lit("&#x20;"), F.lit(" "))
    # What markup goes, in this order.
    for pattern, by in ((r"(?is)```(?:xml|svg)\s*.*?(?:```|\z)", ""), (r"(?is)</?(?:code|svg|xml)(?:\s+[^>]*)?>", ""), (r"(?im)^\s*(?:svg|xml)\s*$", ""), (r"(?:\n\s*){3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, by)
    text = strip(text)
    text = F.when(F.regexp_count(text, F.lit("```")) % 2 == 1, F.concat(text, F.lit("\n```"))).otherwise(text)
    return F.when(F.length(text) < 20, N.UNUSABLE).otherwise(text)


def finding(decision: DataFrame, task: str, language: str = N.ENGLISH) -> DataFrame:
    """``decision`` (a decision of the commerce operators) with ``finding``, the fact in words."""
    share = lambda c: percent(F.col(c), 2)
    two = lambda c: F.format_number(F.col(c), 2)
    values = {
        N.PROFIT: lambda: {"target": F.col("target_category"), "margin": share("target_margin"), "portfolio": share("portfolio_margin"), "gap": two("margin_gap_pp"), "leakage": money(F.col("estimated_profit_leakage"))},
        N.MARKETING: lambda: {"target": F.col("target_entity"), "pound": two("target_profit_per_ad_pound"), "roas": two("target_roas"), "order": two("target_profit_per_order")},
        N.INVENTORY: lambda: {"target": F.col("target_entity"), "description": F.col("target_description"), "lines": F.col("minimum_transaction_lines").cast("string"), "units": F.format_number("target_units", 0), "orders": F.format_number("target_orders", 0)},
    }
    return decision.withColumn("finding", filled(N.FINDINGS[language, task], values[task]()) if task in values else F.lit(""))


def safe_narrative(decision: DataFrame, task: str, language: str = N.ENGLISH) -> DataFrame:
    """``decision`` with ``narrative``, which holds nothing that could be wrong."""
    target = F.col("target_category" if task == N.PROFIT else "target_entity")
    return decision.withColumn("narrative", filled(N.SAFE[language, task], {"target": target}))


def narrated(decision: DataFrame, task: str, narrator=None, language: str = N.ENGLISH) -> DataFrame:
    """``decision`` with ``narrative``, ``reason``: what ``narrator`` (a Column from the decision's columns) says, cleaned, if it passes, else the safe narrative."""
    safe = safe_narrative(decision, task, language)
    if narrator is None:
        return safe.withColumn("reason", F.lit("no narrator"))
    known = "known_categories" if task == N.PROFIT else "known_entities"
    entities = F.col(known) if known in decision.columns else F.array().cast("array<string>")
    checked = verdicts(safe.withColumns({"value": cleaned_response(narrator), "task": F.lit(task), "language": F.lit(language), "target": F.col("target_category" if task == N.PROFIT else "target_entity"), "known": entities}))
    return checked.withColumn("narrative", F.when(F.col("passed"), F.col("value")).otherwise(F.col("narrative"))).drop("value", "known", "language", "target", "passed")


def _payload(task: str, decision: DataFrame) -> Column:
    """The decision that a narrator must keep to, as JSON; keys and rules by task are those of the decision's columns."""
    rule = F.col("selection_rule") if "selection_rule" in decision.columns else F.lit(N.RULES[N.PROFIT])
    fields = {
        N.PROFIT: lambda: (F.col("target_category").alias("selected_category"), rule.alias("selection_rule"), F.col("cost_basis")),
        N.MARKETING: lambda: (F.col("target_entity").alias("selected_channel"), rule.alias("selection_rule"), F.col("cost_basis")),
        N.INVENTORY: lambda: (F.col("target_entity").alias("selected_sku"), F.col("target_description").alias("description"), rule.alias("selection_rule"), F.col("inventory_status_available")),
    }
    return F.to_json(F.struct(*fields[task]()), {"ignoreNullFields": "false"})


def _csv(table: DataFrame, rows: int) -> DataFrame:
    """(table): a header and the first ``rows`` rows as CSV text, in the order of ``table``; the header alone over an empty one."""
    head = table.limit(rows).select(F.monotonically_increasing_id().alias("at"), F.to_csv(F.struct(*table.columns)).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return head.agg(F.array_join(F.concat(F.array(F.lit(",".join(table.columns))), lines), "\n").alias("table"))


def prompts(text: DataFrame, table: DataFrame, decision: DataFrame | None, task: str, question: str = "", language: str = N.ENGLISH, rows: int = 12) -> DataFrame:
    """(prompt), one row: instructions for a narrator from the evidence of a task.

    With ``decision`` (one row) it holds the payload that is final, the rules of the task and the headings that ``verdicts`` asks for;
    without one, as for trends, the first ``rows`` rows of ``table``. An empty question becomes the task's own. Only sides of one row are joined.
    """
    task = N.canonical_task(task)
    labels = {"task": F.lit(N.TASK_LABELS[language][task]), "question": F.lit(question.strip() or N.default_question(language, task)), "evidence": F.col("evidence")}
    if decision is None:
        values = labels | {"table": F.col("table"), "headings": F.lit("\n".join(N.OPEN_HEADINGS[language]))}
        return text.crossJoin(_csv(table, rows)).select(filled(N.OPEN_PROMPT[language], values).alias("prompt"))
    target = F.col("target_category" if task == N.PROFIT else "target_entity")
    own = decision.limit(1).select(_payload(task, decision).alias("payload"), target.alias("target"))
    values = labels | {"decision": F.col("payload"), "target": F.col("target"), "rule": F.lit(N.TASK_RULES[language, task]), "headings": F.lit("\n".join(N.HEADINGS[language]))}
    return text.crossJoin(own).select(filled(N.PROMPT[language], values).alias("prompt"))
