"""Readers of trajectories, transactions, uploads and side files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import strip
from millrace.operators import trajectory
from millrace.operators.commerce import missing_columns

from . import json_list
from .shared import owning, path_and_filesystem

#: Encodings of an upload, in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")
_FIELDS = ("id", "task_id", "filename", "db_id", "level", "difficulty")


def _bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _in_order(rows: DataFrame, *columns) -> DataFrame:
    """``columns`` of the lines ``rows`` of text files, and ``index``: 0, 1, ... over all files by path, in the order of their lines, however files are split.

    Lines of a split follow one another in a task, so a line's number is its place there plus the lines of the splits before: one aggregation with a row for each split, and no exchange of lines.
    """
    placed = rows.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__line"), *columns)
    splits = placed.groupBy("__file", "__start").agg(F.count("*").alias("__n"), F.min("__line").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__file", "__start")) - F.col("__n")
    at = splits.select(F.col("__file").alias("__f"), F.col("__start").alias("__s"), "__first", before.alias("__before"))
    joined = placed.join(F.broadcast(at), (F.col("__file") == F.col("__f")) & (F.col("__start") == F.col("__s")))
    return joined.withColumn("index", F.col("__before") + F.col("__line") - F.col("__first")).drop("__file", "__start", "__line", "__f", "__s", "__first", "__before")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256 in upper-case hex) of the files at ``path``."""
    return _bytes(spark, path).select("path", F.upper(F.sha2("content", 256)).alias("sha256"))


def _string_fields(item, names=_FIELDS):
    """Fields of a JSON object as text; empty texts, 0, false and empty lists and objects count as missing, a text that says 0 does not."""
    for name in names:
        value = F.try_variant_get(item, f"$.{name}", "string")
        is_text = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")) == "STRING"
        yield F.when((is_text & (value != "")) | (~is_text & ~value.isin("0", "false", "[]", "{}", "0.0")), value).alias(name)


def _messages(item, field: str):
    """Messages of a JSON object's field; content that is no string becomes null."""
    raw = F.coalesce(F.try_variant_get(item, f"$.{field}", "array<variant>"), F.array().cast("array<variant>"))
    is_text = lambda m: F.schema_of_variant(F.try_variant_get(m, "$.content", "variant")) == "STRING"
    has = lambda m: F.try_variant_get(m, "$.content", "variant")
    return F.transform(raw, lambda m: F.struct(F.coalesce(F.try_variant_get(m, "$.role", "string"), F.lit("")).alias("role"), F.when(has(m).isNull(), F.lit("")).when(is_text(m), F.try_variant_get(m, "$.content", "string")).alias("content")))


def trajectories(spark: SparkSession, path: str, limit: int = 0, lines: bool = False) -> DataFrame:
    """(index, id, group, level, messages, raw) of a JSON list, or of JSON lines with ``lines``; only the first ``limit`` items if it is above 0.

    Raises ValueError if a whole file is no list. A list is read by as many tasks as its file has splits.
    """
    if lines:
        items = _in_order(spark.read.text(path).where(F.trim("value") != ""), F.parse_json("value").alias("item"))
    else:
        listed = json_list.items(spark, path)
        items = listed.select("index", F.parse_json("text").alias("item"))
    if limit > 0:
        items = items.where(F.col("index") < limit)
    extra = F.try_variant_get("item", "$.extra_info.db_id", "string").alias("extra_db_id")
    df = items.select("index", *_string_fields(F.col("item")), extra, _messages(F.col("item"), "messages").alias("m"), _messages(F.col("item"), "trajectory").alias("t"), F.to_json("item").alias("raw"))
    df = df.withColumn("sid", trajectory.sample_id(F.col("id"), F.col("task_id"), F.col("index")))
    out = df.select(
        "index", F.col("sid").alias("id"), trajectory.group_key(F.col("filename"), F.col("db_id"), F.col("extra_db_id"), F.col("sid")).alias("group"), trajectory.level_of(F.col("level"), F.col("difficulty")).alias("level"),
        trajectory.cleaned_messages(F.col("m"), F.col("t")).alias("messages"), "raw",
    )
    return out if lines else owning(out, listed)


def training_lines(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """(index, messages) of JSON lines for training: role and content as text whatever their type, messages without both and lines without messages left out; ``limit`` counts lines that are kept."""
    items = _in_order(spark.read.text(path).where(F.trim("value") != ""), F.parse_json("value").alias("item"))
    raw = F.coalesce(F.try_variant_get("item", "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda m, name: F.try_variant_get(m, f"$.{name}", "string")
    both = F.filter(F.transform(raw, lambda m: F.struct(text(m, "role").alias("role"), text(m, "content").alias("content"))), lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    df = items.select("index", both.alias("messages")).where(F.size("messages") > 0)
    return df.orderBy("index").limit(limit) if limit > 0 else df


def transactions(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """Transaction lines with typed time and returns. CSV columns are strings, but numbers where the analyses add them; Parquet keeps its types."""
    df = spark.read.csv(path, header=True, escape='"') if format == "csv" else spark.read.format(format).load(path)
    numbers = [c for c in df.columns if c.startswith("sim_") or c in ("quantity", "unit_price_gbp", "observed_net_revenue_gbp")]
    df = df.withColumns({c: F.col(c).try_cast("decimal(20,4)" if c.endswith("_gbp") and c != "unit_price_gbp" else "double") for c in numbers})
    return df.withColumns({"invoice_timestamp": F.try_to_timestamp(F.col("invoice_timestamp").cast("string")), "is_return": F.lower(strip(F.col("is_return").cast("string"))).isin("true", "1", "yes")})


def gated(upload: DataFrame, fallback: DataFrame) -> tuple[DataFrame, list[str]]:
    """``upload``, or ``fallback`` if it lacks required columns, with the names it lacks."""
    lacking = missing_columns(upload.columns)
    return (fallback if lacking else upload), lacking


def sheets(spark: SparkSession, paths: list[str], format: str = "csv") -> DataFrame:
    """Exported sheets one below the other."""
    out = None
    for path in paths:
        df = spark.read.csv(path, header=True, escape='"') if format == "csv" else spark.read.format(format).load(path)
        out = df if out is None else out.unionByName(df)
    return out


def upload(spark: SparkSession, path: str, rows: int = 10_000, probe: int = 1 << 20) -> tuple[DataFrame, str]:
    """The first ``rows`` rows of a CSV file and its encoding, the first of ``ENCODINGS`` that decodes its first ``probe`` bytes."""
    if not path.lower().endswith(".csv"):
        raise ValueError("a .csv file is expected")
    target, files = path_and_filesystem(spark, path)
    source = files.open(target)
    head = bytes(source.readNBytes(probe))
    source.close()
    for encoding in ENCODINGS:
        try:
            head[: len(head) if len(head) < probe else -4].decode(encoding)
        except UnicodeDecodeError:
            continue
        if encoding == "utf-8-sig" and not head.startswith(b"\xef\xbb\xbf"):
            encoding = "utf-8"
        charset = "UTF-8" if encoding.startswith("utf-8") else "GB18030"
        if charset != "UTF-8":
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark reads no other character sets of Java's without it
        return spark.read.csv(path, header=True, inferSchema=True, encoding=charset).limit(rows), encoding
    raise ValueError(f"the file is in none of {', '.join(ENCODINGS)}")


def judge_cache(spark: SparkSession, path: str) -> DataFrame:
    """(position, message_hash, score, reason, api_success) of a verdict log."""
    glm = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("reason", T.StringType()), T.StructField("api_success", T.BooleanType())])
    schema = T.StructType([T.StructField("message_hash", T.StringType()), T.StructField("glm", glm)])
    log = spark.read.schema(schema).json(path)
    return _in_order(log, "message_hash", "glm.*").select(F.col("index").alias("position"), "message_hash", "score", "reason", "api_success")


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """A whole JSON file, such as a summary or golden results."""
    return spark.read.json(path, multiLine=True)
