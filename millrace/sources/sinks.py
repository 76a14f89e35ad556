"""Writers of training rows, audits, manifests and marts."""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of an audit; rewards have 8 decimals.
AUDIT = ("split", "id", "group", "level", "final_reward", "deterministic_reward", "complexity_score", "syntax_score", "execution_consistency_score", "completeness_score", "assistant_turns", "code_blocks", "interpreter_turns", "characters", "glm_score", "glm_api_success", "glm_reason")
_SCORES = frozenset(AUDIT[4:10])


def training_rows(df: DataFrame) -> DataFrame:
    return df.select("messages")


#: Scores and counts of a row that its metadata tell.
_METRICS = ("final_reward", "deterministic_reward", "complexity_score", "complexity_raw", "syntax_score", "execution_consistency_score", "completeness_score", "prompt_quality_score", "final_answer_quality_score", "assistant_turns", "code_blocks", "successful_interpreter_turns", "error_interpreter_turns", "interpreter_turns", "characters")


def metadata_rows(df: DataFrame) -> DataFrame:
    """(value): the raw item with its cleaned messages and a ``_selection`` object in place of those it may have, as JSON text. Nulls are kept."""
    of = lambda names: [F.col(c) for c in names if c in df.columns]
    verdict = F.struct(*(F.col(c).alias(c.removeprefix("glm_")) for c in ("glm_score", "glm_reason", "glm_api_success") if c in df.columns)) if "glm_score" in df.columns else F.lit(None)
    chosen = F.struct(*of(("split", "id", "group", "level", "prompt_hash", "message_hash")), F.struct(*of(_METRICS)).alias("metrics"), verdict.alias("glm"))
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    rest = F.map_filter(F.variant_get(F.parse_json("raw"), "$", "map<string,variant>"), lambda k, _: ~k.isin("messages", "_selection"))
    body = F.regexp_replace(F.to_json(rest, {"ignoreNullFields": "false"}), r"\}\z", "")
    comma = F.when(F.size(rest) == 0, "").otherwise(",")
    return df.select(F.concat(body, comma, F.lit('"messages":'), text("messages"), F.lit(',"_selection":'), text(chosen), F.lit("}")).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, as part files in the order of ``df``, nulls included; a frame with the one column ``value`` is JSON text already."""
    lines = df if df.columns == ["value"] else df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite").text(path)


def audit_rows(df: DataFrame, *more: str) -> DataFrame:
    """The audit's columns as text, and columns ``more`` as they are; what ``df`` lacks is empty."""
    def of(name: str):
        if name not in df.columns:
            return F.lit("").alias(name)
        return (F.format_string("%.8f", F.col(name)) if name in _SCORES else F.coalesce(F.col(name).cast("string"), F.lit(""))).alias(name)

    return df.select(*(of(name) for name in AUDIT), *more)


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """One CSV part file in UTF-8 with a byte order mark and one header, for audits, whose size is a setting. Rows go by the columns ``order``, of which only those of the audit are written."""
    names = [c for c in df.columns if c in AUDIT or c not in order]
    head = "\ufeff" + ",".join(names)
    rows = df.select(F.struct(F.lit(1).alias("n"), *(F.col(c) for c in order)).alias("place"), F.to_csv(F.struct(*(F.col(c).cast("string") for c in names))).alias("value"))
    first = df.sparkSession.range(1).select(F.lit(head).alias("head"))
    placed = rows.withColumn("line", F.lit(1)).select("line", "place", "value").unionByName(first.select(F.lit(0).alias("line"), F.lit(None).cast(rows.schema["place"].dataType).alias("place"), F.col("head").alias("value")))
    placed.repartition(1).sortWithinPartitions("line", "place").select("value").write.mode("overwrite").text(path)


def grid_summary(runs: DataFrame, source: dict) -> str:
    """The runs of a grid of settings and the one of least ``val_loss`` (ties: the first by the other columns) as JSON. Runs without a checkpoint have a null loss and are never chosen; a grid holds a few."""
    rows = [r.asDict(recursive=True) for r in runs.orderBy(F.col("val_loss").asc_nulls_last(), *(c for c in runs.columns if c != "val_loss")).collect()]
    chosen = next((r for r in rows if r["val_loss"] is not None and r["val_loss"] == r["val_loss"]), None)
    return json.dumps({"created_at_utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **source, "runs": rows, "selected_by_validation_loss": chosen}, ensure_ascii=False, indent=2)


def write_mart(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV part files, each whole by itself in UTF-8 with a byte order mark and a header, so that marts of any size are written by all tasks. Quotes in texts are doubled; nulls are empty. With ``compression`` ("gzip") each part is packed."""
    first, *rest = df.columns
    df.toDF("\ufeff" + first, *rest).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue='""', timestampFormat="yyyy-MM-dd HH:mm:ss", compression=compression)


def manifest(split: DataFrame, counts: dict, settings: dict, source: dict, outputs: dict[str, str]) -> str:
    """A run's source, counts, settings, overlaps, distributions, outputs and time as JSON. Only rows of small aggregates reach the driver."""
    from millrace.operators.selection import distribution, split_checks, split_stats

    stats = {r["split"]: r for r in split_stats(split).collect()}
    parts = {name: split.where(F.col("split") == name) for name in ("train", "validation")}
    said = {
        "created_at_utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
        "python": sys.version,
        "input": source,
        "selection": settings | counts,
        "checks": {f"{r['what']}_overlap_count": r["overlap"] for r in split_checks(split).collect()},
        "distributions": {f"{name}_level": {r["value"]: r["n"] for r in distribution(part, "level").collect()} for name, part in parts.items()}
        | {f"{name}_groups": row["groups"] for name, row in stats.items()}
        | {f"{name}_reward_mean": row["mean_reward"] for name, row in stats.items()},
        "outputs": outputs,
    }
    return json.dumps(said, indent=2, ensure_ascii=False)


def write_lists(rows: DataFrame, path: str) -> None:
    """Write rows as JSON lists, one file with a list for each partition that has rows."""

    def listed(batches):
        begun = False
        for batch in batches:
            marks = ["," if begun or k else "[" for k in range(len(batch))]
            begun = begun or len(batch) > 0
            yield batch.assign(value=[m + v for m, v in zip(marks, batch["value"])])
        if begun:
            yield batch.iloc[:0].reindex([0]).assign(value="]")

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInPandas(listed, "value string").write.text(path)
