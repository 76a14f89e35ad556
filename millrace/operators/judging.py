"""An optional outside judge of the best rows, with a cache of its verdicts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import discard, written

#: Shares of the deterministic reward and of the judge's score.
OWN, JUDGE = 0.75, 0.25


def latest_verdicts(cache: DataFrame, position: str = "position", retry_failures: bool = True) -> DataFrame:
    """One verdict for each message_hash, the last by ``position``. With ``retry_failures`` those do not count, so that they are tried again; without, a failure is a verdict for good."""
    good = cache.where("api_success") if retry_failures else cache.where(F.col("message_hash").isNotNull())
    return good.withColumn("__n", F.row_number().over(Window.partitionBy("message_hash").orderBy(F.desc(position)))).where("__n = 1").select("message_hash", "score", "reason", "api_success")


def blended(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds glm_score and glm_api_success, and blends the score into final_reward where the judge succeeded."""
    seen = verdicts.select("message_hash", F.col("score").alias("glm_score"), F.col("api_success").alias("__ok"))
    out = df.join(seen, "message_hash", "left").withColumn("glm_api_success", F.coalesce("__ok", F.lit(False))).drop("__ok")
    return out.withColumn("final_reward", F.when(F.col("glm_api_success"), OWN * F.col("deterministic_reward") + JUDGE * F.col("glm_score")).otherwise(F.col("deterministic_reward")))


_VERDICT = "message_hash string, score double, reason string, api_success boolean"


def _questions(df: DataFrame) -> DataFrame:
    answer = F.coalesce(F.element_at(F.filter("messages", lambda m: m["role"] == "assistant"), -1)["content"], F.lit(""))
    return df.select("message_hash", F.substring("task_prompt", 1, 1800).alias("prompt"), F.right(answer, F.lit(2200)).alias("answer"))


def _verdicts(questions: DataFrame, ask: Callable[[str, str], tuple[float, str]], pause: float = 0.0) -> DataFrame:
    """Verdicts of ``ask`` on (message_hash, prompt, answer); a task leaves ``pause`` seconds from the beginning of a call to that of the next."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = time.monotonic()
        for batch in batches:
            out = []
            for digest, prompt, answer in batch.itertuples(index=False):
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + pause
                try:
                    mark, reason = ask(prompt, answer)
                    if not 1 <= mark <= 5:
                        raise ValueError(f"a mark of {mark}")
                    out.append((digest, mark / 5, reason, True))
                except Exception as failure:  # a failed call is a verdict of its own
                    out.append((digest, None, repr(failure), False))
            yield pd.DataFrame(out, columns=["message_hash", "score", "reason", "api_success"])

    return questions.mapInPandas(rows, _VERDICT)


def judge(df: DataFrame, limit: int, ask: Callable[[str, str], tuple[float, str]] | None = None, tie: str = "index", parallel: int = 8) -> DataFrame:
    """Verdicts (message_hash, score, reason, api_success) of ``ask``(prompt, answer) on the ``limit`` best rows, by ``parallel`` tasks. ``ask`` gives a mark from 1 to 5 and a reason; what it raises is the reason of a failure. Off unless ``ask`` is given."""
    if ask is None or limit <= 0:
        return df.sparkSession.createDataFrame([], _VERDICT)
    return _verdicts(_questions(df.orderBy(F.desc("deterministic_reward"), tie).limit(limit)).repartition(parallel), ask)


def judge_into(df: DataFrame, limit: int, ask: Callable[[str, str], tuple[float, str]], path: str, *, known: DataFrame | None = None, tie: str = "index", parallel: int = 8, per_task: int = 4, rate: float | None = None) -> int:
    """Ask about those of the ``limit`` best rows that ``known`` (message_hash, ...) has no verdict on, and append what is said to the log at ``path``. Returns how many were asked.

    Questions go out in batches of ``parallel`` tasks with ``per_task`` calls each, and every batch is committed to the log before the next begins: what a run has paid for stays when it dies, and the run after it, which
    knows the log, asks on from there. A task that is lost asks again what it was given, so at most ``per_task`` calls. All tasks together make at most ``rate`` calls a second. Rows with the same messages are one question.
    """
    best = df.orderBy(F.desc("deterministic_reward"), tie).limit(limit)
    open_ = best if known is None else best.join(known.select("message_hash").distinct(), "message_hash", "left_anti")
    first = Window.partitionBy("message_hash").orderBy(F.desc("deterministic_reward"), tie)
    asked = open_.withColumn("__k", F.row_number().over(first)).where("__k = 1")
    # At most ``limit`` rows are left, a setting, so one task may number them.
    numbered = asked.withColumn("__at", F.row_number().over(Window.orderBy(F.desc("deterministic_reward"), tie)) - 1)
    size = parallel * per_task
    questions = written(numbered.select("message_hash", "task_prompt", "messages", "__at"), "judge-questions")
    total = questions.count()
    for low in range(0, total, size):
        batch = questions.where((F.col("__at") >= low) & (F.col("__at") < low + size)).repartitionByRange(parallel, "__at")
        append_verdicts(_verdicts(_questions(batch), ask, parallel / rate if rate else 0.0), path, parallel)
    discard(questions)
    return total


def append_verdicts(verdicts: DataFrame, path: str, files: int = 1) -> None:
    """Append verdicts (message_hash, score, reason, api_success) to the log at ``path``: a folder of JSON lines, which ``sources.readers.judge_cache`` reads. Files of later calls sort behind those of earlier ones; those of a call that fails do not count."""
    glm = F.struct("score", "reason", "api_success").alias("glm")
    lines = verdicts.select(F.to_json(F.struct("message_hash", glm), {"ignoreNullFields": "false"}).alias("value"))
    (lines if files > 1 else lines.coalesce(1)).write.mode("append").text(f"{path}/run={time.time_ns():020d}")
