"""Chat formatting from event logs, with DataFrame functions alone.

The log of a conversation is folded in order of its sequence numbers: a message, an edit or a regeneration sets the
text of its turn, deltas append to it, a regeneration also voids what later turns had by then. The final messages
are rendered with a template whose control strings are escaped inside texts, so that parsing gives the messages back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the template: what opens a turn, what parts its role from its text, what closes it.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]\n", "</s>\n"
#: Start of a control string, to be broken inside texts, as a regular expression.
_CONTROL = r"(<(?=/?s>)|\[(?=/?INST\]))"
#: The role whose text is under the loss mask.
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    r"""Backslashes are doubled, then ``\;`` parts the first character of each control string from the rest."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\;")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|;)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of events (conv_id, seq, kind, turn, role, text).

    Kinds: ``message``, ``edit`` and ``regenerate`` set the role (unless null) and text of a turn, ``delta``
    appends to it; ``regenerate`` also voids all earlier events of later turns. Other kinds and null kinds are
    ignored. A null text counts as empty, a null role keeps the role so far; a turn without any role has a
    null role. Events with equal sequence numbers go by kind, role and text, so repeated rows have a defined order.
    Null conversations form one conversation, a null turn stands before all others; other columns are
    ignored. A turn whose events are all void is dropped. One exchange by conversation: a conversation becomes one row in the end, whatever its size.
    """
    order = [F.col("seq").asc_nulls_first(), "kind", "role", "text"]
    earlier = Window.partitionBy("conv_id").orderBy(F.col("__turn")).rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "turn").orderBy(*order)
    kinds = events.select("conv_id", "seq", "kind", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).where(F.col("kind").isin("message", "edit", "regenerate", "delta"))
    live = (
        kinds.withColumn("__turn", F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))))
        .withColumn("__void", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier))
        .where(F.col("__void").isNull() | (F.col("seq") > F.col("__void")))
        .withColumn("__n", F.row_number().over(own))
        .withColumn("__set", F.max(F.when(F.col("kind") != "delta", F.col("__n"))).over(Window.partitionBy("conv_id", "turn")))
    )
    parts = F.array_sort(F.collect_list(F.when(F.col("__set").isNull() | (F.col("__n") >= F.col("__set")), F.struct("__n", "text"))))
    role = F.max_by("role", F.when(F.col("role").isNotNull(), F.col("__n")))
    return live.groupBy("conv_id", "turn").agg(role.alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation of messages (conv_id, turn, role, text): ``formatted`` and ``loss_spans``.

    Turns stand in order of their number, then role and text; null roles and texts count as empty. A span of
    the loss mask is (turn from 0, start and length in code points within the turn's rendering), one for each assistant text.
    """
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(MIDDLE))
    body = escape(F.coalesce("text", F.lit("")))
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.col("text").alias("plain"), F.concat(head, body, F.lit(CLOSE)).alias("rendered"), F.length(head).cast("long").alias("start"), F.length(body).cast("long").alias("length")
    )
    gathered = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == ASSISTANT, F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length")))), lambda s: s.isNotNull())
    return gathered.select("conv_id", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """The messages of rendered conversations: ``messages``, an array of (role, text), and ``loss_texts``, what the mask covers, both unescaped."""
    pieces = F.split("formatted", CLOSE, -1)
    df = formatted.withColumn("__pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    at = lambda p: F.locate(MIDDLE, p)
    message = lambda p: F.struct(
        unescape(F.substring(p, F.lit(len(OPEN) + 1), at(p) - len(OPEN) - 1)).alias("role"), unescape(F.substring(p, at(p) + len(MIDDLE), F.length(p))).alias("text")
    )
    covered = F.transform("loss_spans", lambda s: unescape(F.substring(F.get("__pieces", s["turn"]), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return df.withColumn("messages", F.transform("__pieces", message)).withColumn("loss_texts", covered).drop("__pieces")


def message_events(rows: DataFrame) -> DataFrame:
    """A log with one ``message`` event for each row (conv_id, turn, role, text): rows of a conversation by turn, then role and text, are its turns 0, 1, ..."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    return rows.select("conv_id", n.cast("long").alias("seq"), F.lit("message").alias("kind"), n.cast("long").alias("turn"), "role", "text")


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant who say control strings of templates."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """Fold, render and read back ``rows`` (conv_id, turn, role, text); per conversation the digests of what was read."""
    back = parse(render(fold(message_events(rows))))
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(F.array_join("loss_texts", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("loss_texts", "").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
