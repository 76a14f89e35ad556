"""Text functions held against Python's own over all code points."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import trajectory

EVERY = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]


def test_folding_is_that_of_python(spark):
    texts = ["".join(EVERY[k : k + 400]) for k in range(0, len(EVERY), 400)] + ["Straße ΣΊΣΥΦΟΣ ﬁ İ", "", None]
    found = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", X.casefold(F.col("t")).alias("f")).collect()
    assert {r["k"]: r["f"] for r in found} == {k: t if t is None else t.casefold() for k, t in enumerate(texts)}


def test_json_is_that_of_the_module(spark):
    texts = ["".join(map(chr, range(0, 300))), 'quote " and \\ back \\" both', "  \x7f\x80é🙂", "plain", "", None]
    found = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", X.json_text(F.col("t")).alias("j")).collect()
    assert {r["k"]: r["j"] for r in found} == {k: json.dumps(t, ensure_ascii=False) for k, t in enumerate(texts)}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.text(max_size=4), st.text(max_size=30)), max_size=4), min_size=1, max_size=20))
def test_message_digests_are_those_of_the_module(spark, conversations):
    rows = [(k, m) for k, m in enumerate([*conversations, None])]
    df = spark.createDataFrame(rows, "k int, messages array<struct<role:string,content:string>>")
    found = {r["k"]: r["h"] for r in df.select("k", trajectory.message_hash(F.col("messages")).alias("h")).collect()}
    for k, messages in rows:
        assert found[k] == trajectory.message_digest([{"role": r, "content": c} for r, c in messages or []])
