"""The log of an outside judge: what is paid for stays, and nothing finished is asked twice."""

import os
import time
from collections import Counter

import pytest

from millrace.operators import judging
from millrace.sources import readers

SCHEMA = "index long, message_hash string, task_prompt string, messages array<struct<role:string,content:string>>, deterministic_reward double"


def _rows(spark, n=40):
    return spark.createDataFrame([(k, f"h{k}", f"prompt {k}", [("assistant", f"answer {k}")], 1.0 - k / 100) for k in range(n)], SCHEMA)


def _asker(folder, dies_at=None):
    """Notes every call as a file; ends its whole worker once, where ``dies_at`` says."""

    def ask(prompt, answer):
        k = int(prompt.split()[1])
        if k == dies_at and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(1)
        open(f"{folder}/{k}-{time.time_ns()}", "w").close()
        if k % 10 == 3:
            raise RuntimeError("no answer")
        return 4, f"reason {k}"

    return ask


def _calls(folder):
    return Counter(int(name.split("-")[0]) for name in os.listdir(folder) if "-" in name)


def test_a_run_that_dies_keeps_what_is_paid_for(spark, tmp_path):
    df, log, calls = _rows(spark), f"file://{tmp_path}/log", tmp_path / "calls"
    calls.mkdir()
    ask = _asker(str(calls), dies_at=21)
    with pytest.raises(Exception):
        judging.judge_into(df, 30, ask, log, parallel=4, per_task=2)
    before = _calls(calls)
    known = judging.latest_verdicts(readers.judge_cache(spark, log), retry_failures=False)
    paid = {int(r["message_hash"][1:]) for r in known.collect()}
    assert paid == set(range(16))  # two batches of eight were committed
    asked = judging.judge_into(df, 30, ask, log, known=known, parallel=4, per_task=2)
    after = _calls(calls)
    assert asked == 14 and set(after) == set(range(30))
    assert all(after[k] == 1 for k in paid), "what is in the log is not asked again"
    assert sum(after.values()) - 30 <= sum(before[k] for k in range(16, 24))  # only calls of the batch that was lost
    found = readers.judge_cache(spark, log).collect()
    assert Counter(r["message_hash"] for r in found) == Counter(f"h{k}" for k in range(30))
    assert {r["message_hash"] for r in found if not r["api_success"]} == {"h3", "h13", "h23"}


def test_failures_are_tried_again_or_are_verdicts(spark, tmp_path):
    df, log, calls = _rows(spark, 14), f"file://{tmp_path}/log", tmp_path / "calls"
    calls.mkdir()
    ask = _asker(str(calls))
    assert judging.judge_into(df, 14, ask, log, parallel=2, per_task=4) == 14
    cache = readers.judge_cache(spark, log)
    assert judging.judge_into(df, 14, ask, log, known=judging.latest_verdicts(cache, retry_failures=False)) == 0
    assert judging.judge_into(df, 14, ask, log, known=judging.latest_verdicts(cache)) == 2
    blended = judging.blended(df, judging.latest_verdicts(readers.judge_cache(spark, log), retry_failures=False)).collect()
    assert {r["index"] for r in blended if not r["glm_api_success"]} == {3, 13}


def test_calls_keep_a_common_pace(spark, tmp_path):
    log, calls = f"file://{tmp_path}/log", tmp_path / "calls"
    calls.mkdir()
    judging.judge_into(_rows(spark, 12), 12, _asker(str(calls)), log, parallel=3, per_task=4, rate=12)
    times = sorted(int(name.split("-")[1]) for name in os.listdir(calls))
    assert (times[-1] - times[0]) / 1e9 >= 0.7  # twelve calls at twelve a second, three at once: three pauses of a quarter


def test_equal_messages_are_one_question(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    df = _rows(spark, 6)
    assert judging.judge_into(df.unionByName(df), 12, _asker(str(calls)), f"file://{tmp_path}/log") == 6
    assert set(_calls(calls).values()) == {1}
