import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import narratives as N
from millrace.functions import text as X
from millrace.operators import commerce, dedup, encoding, guard, judging, profiling, selection, trajectory
from millrace.sources import readers, sinks

MANY = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def scan(rows):
    """Greedy dedup of (rank, keys) one row after the other."""
    seen, kept = set(), []
    for rank, keys in sorted(rows):
        keys = {k for k in enumerate(keys) if k[1] is not None}
        if not keys & seen:
            seen |= keys
            kept.append(rank)
    return kept


def test_a_dropped_row_reserves_no_key(spark):
    df = spark.createDataFrame([(1, "1", "X", "P"), (2, "2", "Y", "P"), (3, "2", "Z", "Q"), (4, "4", "V", ""), (5, "5", "W", "")], "r long, id string, m string, p string")
    assert sorted(x.r for x in dedup.exact_dedup(df, "r", ["id", "m", "p"], ("p",)).collect()) == [1, 3, 4, 5]


@MANY
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.one_of(st.none(), st.integers(0, 9))), max_size=40))
def test_rounds_equal_a_scan(spark, keys):
    rows = [(i, *(None if k is None else str(k) for k in ks)) for i, ks in enumerate(keys)]
    df = spark.createDataFrame(rows, "r long, a string, b string, c string")
    assert sorted(x.r for x in dedup.exact_dedup(df, "r", ["a", "b", "c"]).collect()) == scan([(r[0], r[1:]) for r in rows])


@MANY
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
def test_components_are_those_of_union_find(spark, edges):
    root = list(range(16))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    nodes = spark.range(16)
    links = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")
    assert {r.id: r.component for r in dedup.linked_components(nodes, links).collect()} == {i: find(i) for i in range(16)}


def test_near_dedup_follows_chains_and_empty_prompts(spark):
    base = "compare the monthly revenue of all product categories in the northern region"
    rows = [(0, base, base), (1, base + "s", base), (2, base + "ss", base), (3, "quite another question about stock", ""), (4, "", "tell me about the stock of bolts"), (5, "", "tell me about the stock of bolts")]
    df = spark.createDataFrame(rows, "rank long, n string, p string")
    assert sorted(r["rank"] for r in dedup.near_dedup(df, "rank", "n", "p", threshold=0.9).collect()) == [0, 3, 4]


def test_prefixes_lose_no_pair(spark):
    r = random.Random(5)
    words = ["red", "blue", "bolt", "gear", "ring", "old", "new"]
    df = spark.createDataFrame([(i, " ".join(r.choices(words, k=6))) for i in range(30)], "i long, t string")
    vectors = dedup.tfidf(dedup.char_ngrams(df, "i", "t"), max_features=None).cache()
    held = {}
    for row in vectors.collect():
        held.setdefault(row.id, {})[row.term] = row.weight
    brute = {(a, b) for a in held for b in held if a < b and sum(w * held[b].get(t, 0) for t, w in held[a].items()) >= 0.6}
    assert {(x.a, x.b) for x in dedup.cosine_pairs(vectors, 0.6).collect()} == brute and brute


def test_percentile_ranks_part_equal_values(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 1.0), (3, 1.0)], "index long, v double").repartition(4)
    assert {r["index"]: round(r.p, 4) for r in trajectory.percentile_rank(df, "v", "p").collect()} == {0: 1.0, 1: 0.0, 2: 0.3333, 3: 0.6667}
    assert trajectory.percentile_rank(df.limit(1), "v", "p").first().p == 1.0
    assert trajectory.percentile_rank(df.limit(0), "v", "p").count() == 0


def test_signals_follow_word_bounds(spark):
    assert column(spark, ["error: x", "error:x", "Traceback", "TypeError x", "a"], "string", lambda c: c.rlike(X.ERROR_SIGNAL)) == [False, True, True, False, False]


def test_code_blocks(spark):
    texts = ["```python\nprint(1)\n``` <code>x</code>", "<code> a </code>", "``` ```", "none"]
    assert column(spark, texts, "string", X.code_blocks) == [["print(1)"], ["a"], [], []]


def test_length_quality(spark):
    got = column(spark, [0, 11, 12, 2400, 2401, 99999], "int", lambda c: X.bounded_length_quality(c, 12, 300, 2400))
    assert [round(x, 6) for x in got] == [0, round(11 / 12, 6), 1, 1, round(1 - 1 / 2400, 6), 0]


@MANY
@given(st.lists(st.text("aZ09é`. \t_-Ω", max_size=30), min_size=1, max_size=20))
def test_prompts_are_normalized_as_in_python(spark, texts):
    import re

    def plain(text):
        text = re.sub(r"`[^`]+`", " CODE ", text.lower())
        text = re.sub(r"\b\d+(?:\.\d+)?\b", " NUM ", text)
        return " ".join(re.sub(r"[^\w\s]", " ", text).split())

    assert column(spark, texts, "string", X.normalize_prompt) == [plain(t) for t in texts]


def test_syntax():
    assert [trajectory.syntax_share(b) for b in ([], ["select 1"], ["x = 1", "x ="], ["x = 1"])] == [0.0, 0.5, 0.5, 1.0]


def test_pool_caps_groups(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b", float(10 - i)) for i in range(10)], "index long, group string, final_reward double")
    assert [r["index"] for r in selection.capped_pool(df, 7, 6).collect()] == [0, 1, 2, 3, 4, 5, 8]
    with pytest.raises(ValueError):
        selection.checked_size(selection.capped_pool(df, 9, 6), 9)


def test_split_keeps_groups_together(spark):
    df = spark.createDataFrame([(i, f"g{i % 7}", "Easy" if i % 2 else "Hard", float(i), str(i), str(i)) for i in range(35)], "index long, group string, level string, final_reward double, id string, message_hash string").cache()
    split = selection.group_split(df, 10, trials=50).cache()
    settings_ = selection.Selection(train_size=25, val_size=10)
    assert selection.validated(split, settings_).count() == 35
    assert {r.what: r.overlap for r in selection.split_checks(split).collect()} == {"group": 0, "id": 0, "message_hash": 0}
    with pytest.raises(ValueError):
        selection.group_split(df, 3, trials=20)


def test_judge_blends_successes_only(spark):
    df = spark.createDataFrame([("a", 0.4), ("b", 0.4), ("c", 0.4)], "message_hash string, deterministic_reward double")
    cache = spark.createDataFrame([(0, "a", 0.2, "", True), (1, "a", 1.0, "", True), (2, "b", None, "boom", False)], "position long, message_hash string, score double, reason string, api_success boolean")
    got = {r.message_hash: (r.glm_api_success, round(r.final_reward, 6)) for r in judging.blended(df, judging.latest_verdicts(cache)).collect()}
    assert got == {"a": (True, 0.55), "b": (False, 0.4), "c": (False, 0.4)}
    assert judging.judge(df, 5).count() == 0


def said(*contents):
    return [(role, content) for role, content in zip(("system", "user", "assistant", "user", "assistant"), contents)]


def test_turns_are_masked_and_cut_on_the_left():
    messages = said("rules", "question", "answer one", "tool output", "answer two")
    turn = encoding.encode_turn(messages, encoding.ByteTokenizer(), 512)
    start = next(i for i, x in enumerate(turn["labels"]) if x != encoding.IGNORED)
    assert turn["status"] == "example" and start > 0
    assert bytes(x for x in turn["labels"] if x != encoding.IGNORED) == b"answer two"
    long = encoding.encode_turn(said("x" * 400, "question", "answer one"), encoding.ByteTokenizer(), 96)
    assert long["left_truncated"] and len(long["input_ids"]) == 96 and bytes(x for x in long["labels"] if x >= 0) == b"answer one"
    assert encoding.encode_turn(said("r", "q", "y" * 100), encoding.ByteTokenizer(), 96)["status"] == "target_too_long"
    assert encoding.last_occurrence([1, 2, 1, 2], [1, 2]) == (2, 4) and encoding.last_occurrence([256, 0], [0, 1]) is None
    assert encoding.last_run([0, 1, 1, 0, 1, 0]) == (4, 5) and encoding.common_prefix([1, 2], [1, 3]) == 1


def test_commerce_nulls_and_zeros(spark):
    schema = "invoice_id string, sku string, description string, category string, channel string, quantity double, unit_price_gbp double, is_return boolean, invoice_timestamp timestamp, observed_net_revenue_gbp decimal(20,4), sim_contribution_profit_gbp decimal(20,4), sim_cogs_gbp decimal(20,4), sim_allocated_ad_spend_gbp decimal(20,4), sim_platform_fee_gbp decimal(20,4), sim_fulfilment_cost_gbp decimal(20,4)"
    from decimal import Decimal as D

    rows = [("1", "s", "d", None, "Organic", 1.0, 1.0, False, None, D(10), D(4), D(1), D(0), D(1), D(1)), ("2", "s", "d", "A", None, 1.0, 1.0, False, None, D(0), D(0), D(1), D(0), D(1), D(1)), ("3", "s", "d", "B", "Email", 1.0, 1.0, True, None, D(10), D(1), D(1), D(2), D(1), D(1))]
    df = spark.createDataFrame(rows, schema)
    leak = {r.category: r for r in commerce.profit_leak(df).collect()}
    assert set(leak) == {"A", "B"} and leak["A"].margin is None and round(leak["B"].estimated_profit_leakage, 6) == 1.5
    assert {r.channel: r.roas for r in commerce.marketing_efficiency(df).collect()} == {"Organic": None, "Email": 5.0}
    assert [r.month for r in commerce.monthly_trend(df).collect()] == ["NaT"]
    assert commerce.inventory_risk(df).count() == 0 and commerce.marketing_decision(df).first().target_entity == "Email"
    assert commerce.portfolio_totals(df.limit(0)).first().margin == 0.0
    paid = commerce.evidence(df, "营销效率", N.CHINESE)
    assert paid.decision.first().target_entity == "Email" and paid.decision.first().selection_rule == N.RULES[N.MARKETING] and paid.decision.first().known_entities == ["Email", "Organic"]
    assert paid.text.first().evidence.startswith(f"数据行数={df.count()}；") and [r.channel for r in paid.table.collect()][0] == "Email"
    assert commerce.evidence(df, "Profit Leak").decision.first().target_category in commerce.evidence(df, "Profit Leak").decision.first().known_categories
    assert commerce.evidence(df, "no such task").decision is None and [r.month for r in commerce.evidence(df, "趋势诊断").table.collect()] == ["NaT"]
    assert commerce.evidence(df.limit(0), N.TREND).text.first().evidence.startswith("Rows=0; Orders=0; Observed net revenue=£0;")
    for task, none in ((N.PROFIT, df.limit(0)), (N.MARKETING, df.where("channel = 'Organic'")), (N.INVENTORY, df)):
        with pytest.raises(ValueError, match=N.NO_TARGET[task]):
            commerce.evidence(none, task)


def test_guardrail(spark):
    def text(language, target, more=""):
        return "\n".join(f"{h}\n{target} {more}" for h in N.HEADINGS[language])

    cases = [
        (text("English", "Gifts"), N.PROFIT, "English", "Gifts", ["Gifts", "Cards"], "passed"),
        (text("中文", "Gifts"), N.PROFIT, "中文", "Gifts", ["Gifts"], "passed"),
        (text("English", "Gifts"), N.PROFIT, "中文", "Gifts", ["Gifts"], "missing required narrative sections"),
        (text("English", "x"), N.PROFIT, "English", "Gifts", ["Gifts"], "selected entity was omitted"),
        (text("English", "Gifts", "cards"), N.PROFIT, "English", "Gifts", ["Gifts", "Cards"], "unverified entity comparison: Cards"),
        (text("English", "Gifts", "postcards"), N.PROFIT, "English", "Gifts", ["Gifts", "Cards"], "passed"),
        (text("English", "Gifts", "£999999"), N.PROFIT, "English", "Gifts", ["Gifts"], "model repeated an unverified numeric value"),
        (text("English", "Email", "is the most efficient"), N.MARKETING, "English", "Email", ["Email"], "financial consistency rule failed"),
        (text("English", "84879"), N.INVENTORY, "English", "84879", [], "passed"),
        (text("English", "84879", "and B12"), N.INVENTORY, "English", "84879", [], "unverified SKU identifier"),
        ("anything 9", N.TREND, "English", "", [], "not-applicable"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, value string, task string, language string, target string, known array<string>, want string")
    assert all(r.reason == r.want for r in guard.verdicts(df).collect())
    for task in (N.PROFIT, N.MARKETING, N.INVENTORY):
        for language in N.HEADINGS:
            decision = spark.createDataFrame([("Gifts", "Gifts")], "target_category string, target_entity string")
            safe = guard.safe_narrative(decision, task, language).select(F.col("narrative").alias("value"), F.lit(task).alias("task"), F.lit(language).alias("language"), F.lit("Gifts").alias("target"), F.array(F.lit("Gifts")).alias("known"))
            assert guard.verdicts(safe).first().passed
    assert N.canonical_task("库存风险") == N.INVENTORY and N.canonical_task("?") == N.PROFIT


def test_cleaned_responses(spark):
    got = column(spark, ["```svg\nxx\n``` A text that is long enough", "A text that is long enough ```python", "short", None, "one two three four five\n\n\n\n\nsix"], "string", guard.cleaned_response)
    assert got == ["A text that is long enough", "A text that is long enough ```python\n```", N.UNUSABLE, N.UNUSABLE, "one two three four five\n\nsix"]


def test_readers_and_sinks(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('[{"id": "a-1", "messages": [{"role": " user ", "content": "hi"}, {"role": "user", "content": 5}, {"role": "", "content": "x"}]}, {"task_id": "b", "db_id": "DB", "difficulty": "Hard", "trajectory": [{"role": "assistant", "content": "yo"}]}, {"id": 0}]')
    rows = [r.asDict(True) for r in readers.trajectories(spark, str(path)).orderBy("index").collect()]
    assert [(r["id"], r["group"], r["level"]) for r in rows] == [("a-1", "a", "Unknown"), ("b", "db", "Hard"), ("row-000002", "row", "Unknown")]
    assert [r["messages"] for r in rows] == [[{"role": "user", "content": "hi"}], [{"role": "assistant", "content": "yo"}], []]
    assert readers.trajectories(spark, str(path), limit=1).count() == 1
    bad = tmp_path / "bad.json"
    bad.write_text('{"id": 1}')
    with pytest.raises(ValueError):
        readers.trajectories(spark, str(bad))
    csv = tmp_path / "u.csv"
    csv.write_bytes("名称,数量\n螺栓,3\n".encode("gb18030"))
    df, encoding_ = readers.upload(spark, str(csv))
    assert encoding_ == "gb18030" and df.count() == 1
    assert "Loaded shape: 1 rows x 2 columns" in profiling.context_text(df, "u.csv", encoding_)
    import hashlib

    assert readers.fingerprint(spark, str(csv)).first().sha256 == hashlib.sha256(csv.read_bytes()).hexdigest().upper()
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"messages": [{"role": "user", "content": 5}]}\n{"messages": []}\n')
    assert [r.messages[0].content for r in readers.training_lines(spark, str(lines)).collect()] == ["5"]
    sinks.write_jsonl(spark.range(2), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":0}', '{"id":1}']


def test_streaming_trend_equals_batch(spark, tmp_path):
    from millrace.streaming.trend import event_trend

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = event_trend(stream).writeStream.outputMode("complete").format("memory").queryName("trend").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("trend")) == key(event_trend(source))


def item(id_, prompt, answer, group, level="Easy"):
    return {"id": id_, "db_id": group, "level": level, "extra": {"kept": [1, None]}, "messages": [{"role": "user", "content": prompt}, {"role": "assistant", "content": answer}]}


def test_curation_from_file_to_outputs(spark, tmp_path):
    import json

    from millrace.plans import curation
    from millrace.sources import readers

    names = "copper lemon river violin harbour saddle meadow candle thunder walnut pepper glacier".split()
    items = [item(f"t{i}", " ".join(names[(i + k) % 12] for k in (0, 1, 3, 5)), f"```python\nprint({i})\n```<answer>{n} {i}</answer>", f"db{i % 4}", "Easy" if i % 2 else "Hard") for i, n in enumerate(names)]
    items += [item("t0", "Another task altogether with its own words", "x", "db9"), item("t98", items[1]["messages"][0]["content"], "short", "db1"), item("t99", items[2]["messages"][0]["content"] + "!", "short", "db2")]
    items[0]["_selection"] = {"old": True}
    source = tmp_path / "in.json"
    source.write_text(json.dumps(items))
    settings = selection.Selection(train_size=9, val_size=3, max_per_group=3, trials=200)
    found = curation.run(spark, f"file://{source}", f"file://{tmp_path}/out", settings)
    # t0 and t98 repeat an id and a prompt; t99 has a prompt that is the same but for one mark.
    assert (found.source, found.source - found.after_exact >= 2, found.after_near) == (15, True, 12)
    manifest = json.loads((tmp_path / "out/selection_manifest.json").read_text())
    assert manifest["checks"] == {"group_overlap_count": 0, "id_overlap_count": 0, "message_hash_overlap_count": 0}
    assert manifest["selection"]["exact_duplicates_removed"] + manifest["selection"]["near_duplicates_removed"] == 3
    assert manifest["distributions"]["train_groups"] + manifest["distributions"]["validation_groups"] == 4 and len(manifest["input"]["sha256"]) == 1
    lines = [json.loads(x) for part in sorted((tmp_path / "out/train_metadata.jsonl").glob("part-*")) for x in part.read_text().splitlines()]
    assert len(lines) == 9 and all(x["extra"] == {"kept": [1, None]} and x["_selection"]["split"] == "train" and x["_selection"]["glm"] is None for x in lines)
    assert [x["_selection"]["metrics"]["final_reward"] for x in lines] == sorted((x["_selection"]["metrics"]["final_reward"] for x in lines), reverse=True)
    audit = (next((tmp_path / "out/selection_audit.csv").glob("part-*"))).read_text(encoding="utf-8")
    assert audit.startswith("﻿split,id,group") and audit.count("split,id") == 1 and len(audit.splitlines()) == 13
    # Metadata can be read again, in the order of the file.
    again = readers.trajectories(spark, f"file://{tmp_path}/out/train_metadata.jsonl", lines=True).orderBy("index").collect()
    assert [r.id for r in again] == [x["id"] for x in lines] and all(r["raw"].count('"_selection"') == 1 for r in again)
    with pytest.raises(ValueError, match="are needed"):
        curation.run(spark, f"file://{source}", f"file://{tmp_path}/no", selection.Selection(train_size=20, val_size=4, max_per_group=3, trials=5))


def test_verdicts_are_cached_and_failures_tried_again(spark, tmp_path):
    from millrace.plans import curation
    from millrace.sources import readers

    names = "copper lemon river violin harbour saddle".split()
    items = [item(f"t{i}", f"{n} {m}", f"answer {n}", f"g{i}") for i, (n, m) in enumerate(zip(names, names[1:] + names[:1]))]
    rows = [(i, x["id"], x["db_id"], x["level"], [(m["role"], m["content"]) for m in x["messages"]]) for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, "index long, id string, group string, level string, messages array<struct<role:string,content:string>>")
    settings = selection.Selection(train_size=4, val_size=2, max_per_group=1, trials=50)
    path = f"file://{tmp_path}/cache"

    def ask(prompt, answer):
        if prompt.startswith("lemon"):
            raise RuntimeError("down")
        return (5, "good") if prompt.startswith("river") else (2, "poor")

    curation.curate(df, settings, ask=ask, judged=6, cache_path=path)
    first = readers.judge_cache(spark, path).collect()
    assert len(first) == 6 and sum(r.api_success for r in first) == 5
    split = curation.curate(df, settings, ask=lambda p, a: (4, "late"), judged=6, cache=readers.judge_cache(spark, path), cache_path=path).split
    later = readers.judge_cache(spark, path).orderBy("position").collect()
    assert len(later) == 7 and later[-1].reason == "late" and split.where("glm_api_success").count() == 6


def test_chains_of_conflicts_end_in_a_scan(spark):
    # Each row conflicts with the next in rank only.
    df = spark.createDataFrame([(i, f"a{i // 2}", f"b{(i + 1) // 2}", None if i else "x") for i in range(60)], "rank long, a string, b string, c string")
    for few in (1000, 0):
        kept = sorted(r["rank"] for r in dedup.exact_dedup(df.where("rank < 12") if few == 0 else df, "rank", ["a", "b", "c"], few=few).collect())
        assert kept == list(range(0, 12 if few == 0 else 60, 2))


def test_long_chains_are_scanned_by_component(spark):
    """Chains that rounds would take hundreds of turns for, with a bounded number of jobs; a component above the bound goes on by rounds."""
    rows = [(c * 3000 + i, f"{c}a{i // 2}", f"{c}b{(i + 1) // 2}") for c in range(3) for i in range(3000 if c else 8)]
    df = spark.createDataFrame(rows, "rank long, a string, b string")
    tracker, before = spark.sparkContext.statusTracker(), len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    kept = sorted(r["rank"] for r in dedup.exact_dedup(df, "rank", ["a", "b"], few=0, rounds=1).collect())
    assert kept == sorted(r[0] for r in rows if r[0] % 2 == 0)
    assert len(tracker.getJobIdsForGroup()) - before < 400
    small = df.where("rank < 8 OR rank >= 6000 AND rank < 6040")
    kept = sorted(r["rank"] for r in dedup.exact_dedup(small, "rank", ["a", "b"], few=0, rounds=1, largest=20).collect())
    assert kept == [r for r in range(0, 8, 2)] + list(range(6000, 6040, 2))


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    wanted, k = [], 0
    for f in range(3):
        with open(folder / f"part-{f}.jsonl", "w") as out:
            for _ in range(50):
                out.write(json.dumps({"messages": [{"role": "user", "content": f"line {k}"}]}) + "\n" * (1 + k % 2))
                wanted.append((k, f"line {k}"))
                k += 1
    from millrace.sources import readers

    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = readers.training_lines(spark, str(folder))
        assert sorted((r["index"], r["messages"][0]["content"]) for r in df.collect()) == wanted
        items = readers.trajectories(spark, str(folder), lines=True)
        assert sorted((r["index"], r["messages"][0]["content"]) for r in items.collect()) == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_the_table_rows_make_queries_drop_some(spark):
    """Caps, near copies and code that does not parse are among the trajectories, so that their queries show it."""
    from millrace.plans import catalog

    sf = "/root/testdata/sf0.01"
    total = catalog.QUERIES["traj_messages"](spark, sf).count()
    assert catalog.QUERIES["capped_topk"](spark, sf).count() < total > catalog.QUERIES["near_dedup"](spark, sf).count()
    assert catalog.QUERIES["python_syntax"](spark, sf).where("syntax_score IN (0.0, 0.5, 1.0)").select("syntax_score").distinct().count() == 3


def test_a_curation_run_leaves_the_split_alone(spark, tmp_path):
    """Of all tables on the way from a file to its outputs, the shared folder keeps that of the split."""
    import os

    from millrace.plans import curation
    from millrace.sources.shared import discard, shared_dir

    words = "copper lemon river violin harbour saddle marble lantern".split()
    source = tmp_path / "source.json"
    source.write_text(json.dumps([item(f"t{i}", f"{a} {b}", f"answer {a}", f"g{i}") for i, (a, b) in enumerate(zip(words, words[1:] + words[:1]))]))
    folder = shared_dir(spark).removeprefix("file://") + "/millrace"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = curation.run(spark, f"file://{source}", f"file://{tmp_path}/out", selection.Selection(train_size=5, val_size=2, max_per_group=1, trials=50))
    left = set(os.listdir(folder)) - before
    assert [name.split("-")[:2] for name in left] == [["curation", "split"]] and found.split.count() == 7
    discard(found.split)
    assert set(os.listdir(folder)) == before
