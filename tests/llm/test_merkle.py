"""The Merkle manifest, held against trees built level by level in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root, and the siblings (before, after) of each leaf by level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for leaf, at in enumerate(places):
            run = runs[at // 16]
            paths[leaf].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        places = [at // 16 for at in places]
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def brute(rows):
    """The rows of ``audited``, from (doc_id, text, lang, source, n_chars)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = leaf_of(doc_id, source, lang, n_chars, text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        start = leaf_of(doc_id, source, lang, n_chars, text and text.translate(low)) if hit else leaf
        groups.setdefault(source, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, start))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {name: tree([x[2] for x in sorted(groups[name])]) for name in names}
    root, tops = tree([trees[name][0] for name in names])
    out = []
    for name, top in zip(names, tops):
        for (_, doc_id, leaf, node), path in zip(sorted(groups[name]), trees[name][1]):
            for before, after in path + top:
                node = sha(before + node + after)
            out.append((doc_id, leaf, trees[name][0], root, sha("".join(b + a for b, a in path + top)), node, node == root))
    return out


def held(spark, rows, height=merkle.HEIGHT):
    found = merkle.audited(spark.createDataFrame(rows, SCHEMA), height)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("leaves", [0, 1, 2, 15, 16, 17, 31, 33, 255, 256, 257, 272, 300, 1000])
def test_a_traversal_gives_the_siblings_of_each_leaf(leaves):
    nodes = [sha(str(i)) for i in range(leaves)]
    found = list(merkle.traverse(nodes, merkle.levels_of(leaves)))
    assert found == (tree(nodes)[1] if nodes else [])
    if nodes:
        assert list(merkle.Treehash(nodes, merkle.levels_of(leaves)).all()) == [tree(nodes)[0]]


def test_a_traversal_holds_a_few_runs_a_level():
    nodes, most = [sha(str(i)) for i in range(4096)], 0
    stack = merkle.Treehash(nodes, 3)
    while not stack.ended:
        stack.step()
        most = max(most, sum(map(len, stack.open)))
    assert most <= 3 * 15


@pytest.mark.parametrize("height", [1, 2])
def test_blocks_make_layers(spark, height):
    draw = random.Random(height)
    rows = [(i, f"Text {draw.random()}", "en", "hot" if i % 3 else f"src{i % 40:02d}", i % 7) for i in range(900)]
    held(spark, rows, height)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0), (2, "Again", "en", "", 5), (None, "Née", "fr", "ü", 3), (None, "NÉE", "fr", "ü", 3), (-5, "x" * 200_000 + "A", "en", None, 200_001), (3, "one leaf", "en", "z", 8)]
    held(spark, rows + [(i, "Same", "en", "ü", 4) for i in (9, 9, 9)])


def test_one_row_is_its_own_root(spark):
    held(spark, [(7, "Alone", "en", "a", 5)])


def test_an_empty_table_gives_nothing(spark):
    assert merkle.audited(spark.createDataFrame([], SCHEMA)).collect() == []


def test_columns_of_any_name_may_stand_beside(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 3}", 2) for i in range(40)]
    wide = spark.createDataFrame(rows, SCHEMA)
    for name in ("g", "digest", "position", "path", "total", "part", "place", "x_doc_id", "leaf", "root"):
        wide = wide.withColumn(name, F.lit(1))
    assert sorted(map(tuple, merkle.audited(wide).collect())) == sorted(brute(rows))


def test_a_kept_proof_shows_any_change(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}", 6) for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    proofs = merkle.manifest(docs, F.col("source"), merkle.leaf(*values), F.col("doc_id"), doc_id=F.col("doc_id"))
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 41, "Text 42").otherwise(F.col("text"))).select("doc_id", merkle.leaf(*values).alias("now"))
    back = proofs.join(changed, "doc_id").where(merkle.folded(F.col("path"), F.col("now")) != F.col("root")).select("doc_id")
    assert [r[0] for r in back.collect()] == [41]
