"""The pipeline's stages, each on what the one before has kept."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_operators import jaccard_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name.replace(" ", "-"))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "substring dedup", "packing"]
    assert all(set(df.columns) == set(stages[0].columns) for df in stages[:-1])


def test_quality_keeps_rows_as_they_are(stages):
    assert 0 < stages[1].count() < stages[0].count()
    assert stages[1].exceptAll(stages[0].select(stages[1].columns)).count() == 0


def test_lines_go_but_in_the_smallest_document(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    after = {r.doc_id: r.text for r in stages[2].collect()}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    owner = {}
    for d in sorted(before):
        for line in before[d].split("\n"):
            owner.setdefault(key(line), d)
    want = {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == d) for d, t in before.items()}
    assert after == {d: t for d, t in want.items() if t.split()} and len(after) < len(before)


def test_one_document_of_each_group_stays(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    found = jaccard_components([t for _, t in rows], 5)
    assert sorted(r.doc_id for r in stages[3].collect()) == [d for i, (d, _) in enumerate(rows) if found[i] == i]


def test_substrings_only_shorten(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[3:5])
    assert set(after) <= set(before) and all(len(t) <= len(before[d]) and t.split() for d, t in after.items())
    # What goes with a document is all there in others.
    left = "\n".join(after.values())
    assert all(any(" ".join(before[d].split()[k : k + 8]) in " ".join(t.split()) for t in after.values()) for d in set(before) - set(after) for k in (0, 20)) and left


def test_packing_holds_all_documents(stages):
    held = collections.Counter()
    for r in stages[5].collect():
        held[r.doc_id, r.doc_tokens] += r.length
    assert {d for d, _ in held} == {r.doc_id for r in stages[4].collect()} and all(n == tokens for (_, tokens), n in held.items())


def test_run_gives_the_last_stage(spark, stages):
    ours = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert ours.exceptAll(stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"))).count() == 0


def odd(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "row": F.lit("a"), "kept": F.lit("b"), "mark": F.lit(3), "key": F.lit("c"), "__doc": F.lit("d"), "level": F.lit("e")})


def through(spark, docs, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    return docs


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(1, a, "en", "s"), (2, f"{a} x", "en", "s"), (2, b, "en", None), (3, None, "en", "s"), (4, "", None, None), (None, c, "de", "s"), (None, c, "de", "s"), (5, b, "en", "s"), (6, "few words", "en", "s"), (1, c, "en", "s")]
    docs = odd(spark, rows)
    kept = through(spark, docs, tmp_path)
    assert kept.columns == docs.columns
    # (2, b) shares its id with a near copy of (1, a) and stays; (5, b) is a copy of it; rows with a null id stay.
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, a), (1, c), (2, b), (0, c), (0, c)])
    pieces = corpus_pipeline.pack(spark, kept, "").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in pieces} == {1, 2, None}


def test_an_empty_table_gives_nothing(spark, tmp_path):
    kept = through(spark, odd(spark, []), tmp_path)
    assert kept.count() == 0 and corpus_pipeline.pack(spark, kept, "").count() == 0


def test_verdicts_do_not_hang_on_how_rows_are_split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality(spark, docs.repartition(7), SF)
    first.count()
    again = corpus_pipeline.quality(spark, docs.repartition(3, "source"), SF)
    assert first.exceptAll(again).count() == 0 and again.exceptAll(first).count() == 0


def test_copies_are_gone_and_no_document_is_empty(stages):
    texts = [r.text for r in stages[4].select("text").collect()]
    assert len(texts) == len(set(texts)) and all(t.split() for t in texts)
