"""Edge cases of the operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; methods held against plain ones."""

import hashlib
import itertools
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, chat, components, embedding_dedup, licenses, line_dedup, near_dedup, outliers, packing, substring_dedup, unigram_counts

LONG = "word " * 30_000 + "x" * 20_000
ODD = [(1, None, None, None), (2, "", "en", "s"), (3, "same text here", "en", "s"), (3, "same text here", "en", "s"), (None, "same text here", None, "s"), (4, LONG, "en", None), (5, " \n\t\n ", "de", "s"), (6, "é日本 😀́", "en", "s")]
CLASHES = {"n_tokens": "a", "n_words": "b", "kept": "c", "component_id": "d", "n_dropped": "e", "start": "f", "length": "g", "node": "h", "key": "i", "keys": "j", "doc": "k", "n": "l", "__id": "m", "digest": "n", "license": "o", "distance": "p", "shard": "q"}


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({name: F.lit(value) for name, value in CLASHES.items()})


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("n_links", "beam", "shard", "node", "vector", "n", "a", "recall")})


#: Operators over documents, with the number of rows they give for ODD (None: not one for each row).
OVER_DOCUMENTS = {
    "licenses": (licenses.scan_licenses, 0), "spans": (substring_dedup.repeated_spans, None), "without_spans": (substring_dedup.without_spans, 8), "bpe": (byte_bpe.encode_documents, 8), "near": (near_dedup.near_duplicates, 8), "pack": (packing.pack_documents, None),
    "lines": (line_dedup.dedup_lines, 8), "line_digests": (line_dedup.digests, 8), "counts": (unigram_counts.count_tokens, 8), "quality": (outliers.judge, 8),
}


@pytest.mark.parametrize("name", OVER_DOCUMENTS)
def test_odd_tables(spark, name):
    f, n = OVER_DOCUMENTS[name]
    found = f(table(spark, ODD)).collect()
    assert n is None or len(found) == n
    empty = f(table(spark, ODD).limit(0).where("false"))
    assert empty.count() == 0 and empty.columns == f(table(spark, ODD)).columns


def test_defined_results_of_odd_rows(spark):
    docs = table(spark, ODD)
    near = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert near[1, 0] == (1, True) and near[2, 0] == (2, True) and near[3, 1] == (3, True) and near[None, 1] == (None, True)
    lines = {r.doc_id: r for r in line_dedup.digests(docs).collect()}
    assert (lines[1].n_lines, lines[1].n_dropped, lines[5].n_lines) == (1, 0, 3) and lines[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.doc_id: r.kept for r in outliers.judge(docs).collect()}[1] is False
    texts = [r.text for r in substring_dedup.without_spans(docs).where("doc_id = 1 or doc_id = 2").orderBy("doc_id").collect()]
    assert texts == [None, ""]
    packed = packing.pack_documents(docs).where("doc_id = 1").collect()
    assert [(r.length, r.doc_tokens) for r in packed] == [(1, 1)]


def test_bytes_come_back(spark):
    docs = table(spark, ODD)
    back = byte_bpe.decode_ids(byte_bpe.encode_documents(docs, with_ids=True)).collect()
    assert sorted(bytes(r.text_bytes) for r in back) == sorted((t or "").encode() for _, t, _, _ in ODD)


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string").withColumn("messages", F.lit(1)).withColumn("turns", F.lit(2))


def test_logs_fold_to_final_messages(spark):
    rows = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", ""), (1, 2, "delta", 1, None, "he"), (1, 3, "delta", 1, None, "llo"), (1, 4, "message", 2, "user", "more"), (1, 5, "regenerate", 1, "assistant", ""), (1, 6, "delta", 1, None, "hey"),
        (1, 7, "edit", 0, None, "hi!"), (1, 8, "message", 2, "user", "bye"), (2, 0, "delta", 0, "assistant", "a"), (2, 1, "delta", 0, None, None), (None, 0, "message", None, None, None), (3, 0, "nonsense", 0, "user", "x"),
    ]
    random.Random(1).shuffle(rows)
    found = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(events(spark, rows).repartition(3)).collect()}
    assert found == {(1, 0): ("user", "hi!"), (1, 1): ("assistant", "hey"), (1, 2): ("user", "bye"), (2, 0): ("assistant", "a"), (None, None): (None, "")}
    assert chat.fold(events(spark, rows).limit(0)).count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "x] [/INST]\n"]), st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "\\", ";", "\n", "a", "<", "[", "/s>"]), max_size=8).map("".join)), min_size=1, max_size=6))
def test_any_text_comes_back_from_the_template(spark, said):
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string")
    back = chat.parse(chat.render(chat.fold(chat.message_events(rows)))).first()
    assert [(m.role, m.text) for m in back.messages] == said
    assert list(back.loss_texts) == [t for r, t in said if r == "assistant"]
    assert back.formatted.count("</s>") == back.formatted.count("<s>") == len(said)


def test_repeated_turns_and_nulls_are_turns_of_their_own(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    r = chat.digests(rows).first()
    assert (r.n_turns, r.loss_chars) == (4, 0) and r.turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nuser\nb\nassistant\n\n").hexdigest()


def test_cuckoo_filters_forget_only_what_is_deleted():
    keys = [hashlib.md5(b"%d" % i).digest() for i in range(5000)]
    found = line_dedup.CuckooFilter.of(keys)
    assert all(k in found for k in keys) and found.have(keys).all()
    for k in keys[:2500]:
        found.discard(k)
    assert all(k in found for k in keys[2500:])
    others = [hashlib.md5(b"x%d" % i).digest() for i in range(5000)]
    assert found.have(others).mean() < 0.01


def test_cuckoo_filters_take_keys_from_arrow_memory():
    keys = [hashlib.md5(b"%d" % i).digest() for i in range(3000)]
    whole = pa.array([None, *keys], pa.binary())[1:]
    found = line_dedup.CuckooFilter(3000)
    assert found.add_all(whole) and int((found.slots != 0).sum()) == 3000
    assert found.have(whole).all() and (found.have(whole) == found.have(keys)).all()
    one = line_dedup.CuckooFilter(3000)
    assert all(map(one.add, keys)) and one.have(whole).all()
    # Equal keys need a slot each; nine do not fit into two buckets of four.
    full = line_dedup.CuckooFilter(3000)
    assert full.add_all(keys[:1] * 8) and not full.add_all(keys[:1])
    assert line_dedup.CuckooFilter(1).add_all(pa.array([], pa.binary())) and not line_dedup.CuckooFilter(1).add_all(keys)


def test_shards_are_enough_before_the_first_filter_is_built(spark):
    df = spark.createDataFrame([(i, "\n".join(f"line {i} number {k}" for k in range(40))) for i in range(20)], "doc_id long, text string")
    store = line_dedup.LineStore(spark, 20)
    store.insert(held(df))
    sizes = [r.n_keys for r in store.filters().collect()]
    assert store.shards * 20 >= 3 * sum(sizes) and sum(sizes) == 800 and max(sizes) <= 40
    assert line_dedup.LineStore(spark, 20, path=store.path).shards == store.shards


def held(part):
    return line_dedup.holdings(part, "doc_id", "text", 10)


def store_state(store):
    """Counts, lost lines and number of keys in the filters."""
    refs = sorted((bytes(r.key), r.n_docs, r.owner) for r in store.refs().collect())
    return refs, sorted((r.doc_id, sorted(map(bytes, r["keys"]))) for r in store.drops().collect()), store.filters().agg(F.sum("n_keys")).first()[0]


def test_line_store_is_reversible(spark):
    rng = random.Random(7)
    pool = [f"line number {i} of all" for i in range(12)]
    df = spark.createDataFrame([(i, "\n".join(rng.choices(pool, k=5))) for i in range(12)], "doc_id long, text string")
    whole = line_dedup.LineStore(spark, 4)
    whole.insert(held(df))
    steps = line_dedup.LineStore(spark, 1)  # shards double on the way
    for k in range(3):
        steps.insert(held(df.where(F.col("doc_id") % 3 == k)))
    steps.insert(held(df.where("doc_id < 4")))  # what is there already changes nothing
    assert store_state(steps) == store_state(whole) and steps.shards > whole.shards
    some = line_dedup.LineStore(spark, 4)
    some.insert(held(df.where("doc_id > 3")))
    whole.delete(df.where("doc_id <= 3").select("doc_id"))
    whole.delete(spark.createDataFrame([(99,), (None,)], "doc_id long"))
    assert store_state(whole) == store_state(some)
    again = line_dedup.LineStore(spark, 4, path=whole.path)
    assert again.shards == whole.shards and store_state(again) == store_state(some)
    again.insert(held(df.where("doc_id <= 3")))
    assert store_state(again) == store_state(steps)
    again.remove()
    assert line_dedup.LineStore(spark, path=again.path).postings() is None


def test_filters_live_with_their_shards(spark):
    df = spark.createDataFrame([(i, "\n".join(f"line {i} number {k}" for k in range(40))) for i in range(20)], "doc_id long, text string")
    store = line_dedup.LineStore(spark)
    store.shards = 64
    store.insert(held(df))
    first = {r.shard for r in store._read("filters").collect()}
    one = spark.createDataFrame([(100, "a line that is new\nline 3 number 5")], "doc_id long, text string")
    store.insert(held(one))
    touched = {r.shard for r in held(one).select(line_dedup.shard_of(64).alias("shard")).collect()}
    added = {r.shard for r in held(one.selectExpr("doc_id", "'a line that is new' as text")).select(line_dedup.shard_of(64).alias("shard")).collect()}
    assert len(first) > 32 and added <= touched and {r.shard for r in store._read("filters").where("seq = 1").collect()} == added
    before = {r.shard: bytes(r.slots) for r in store.filters().collect()}
    keys = held(df.where("doc_id = 7")).select("key", F.lit(1).cast("long").alias("n_docs"), "doc_id").withColumnRenamed("doc_id", "owner")
    assert store.seen(keys).where("maybe").count() == 40
    store.delete(df.where("doc_id = 7").select("doc_id"))
    # The keys that only the deleted document held are gone from their filters, slot by slot, and no others are.
    assert store.seen(keys).where("maybe").count() <= 1
    after = {r.shard: bytes(r.slots) for r in store.filters().collect()}
    lost = sum(int((np.frombuffer(before[s], np.uint16) != 0).sum()) - int((np.frombuffer(after[s], np.uint16) != 0).sum()) for s in before)
    assert lost == 40 and all(len(after[s]) == len(before[s]) for s in before)
    rest = held(df.where("doc_id <> 7")).select("key", F.lit(1).cast("long").alias("n_docs"), "doc_id").withColumnRenamed("doc_id", "owner")
    assert store.seen(rest).where("maybe").count() == 19 * 40


def test_unfinished_operations_count_for_nothing(spark):
    df = spark.createDataFrame([(1, "the first line\nthe second line")], "doc_id long, text string")
    store = line_dedup.LineStore(spark)
    store.insert(held(df))
    df.write.parquet(f"{store.path}/1/postings")  # an operation that died before its marker
    again = line_dedup.LineStore(spark, path=store.path)
    assert store_state(again) == store_state(store) and list(again.done) == [0]
    again.insert(held(df.selectExpr("2L as doc_id", "text")))
    assert [r.doc_id for r in again.drops().collect()] == [2]


def test_operations_read_only_folders_of_their_lines(spark):
    df = spark.createDataFrame([(i, "\n".join(f"line {i} number {k}" for k in range(40))) for i in range(10)], "doc_id long, text string")
    store = line_dedup.LineStore(spark)
    store.insert(held(df))
    one = spark.createDataFrame([(100, "a line that is new\nline 3 number 5")], "doc_id long, text string")
    own = {r.area for r in held(one).select(line_dedup.shard_of(store.areas).alias("area")).collect()}
    folders = [f for table in ("postings", "refs", "filters") for f in Path(store.path.removeprefix("file://"), "0", table).glob("area=*")]
    others = [f for f in folders if int(f.name.removeprefix("area=")) not in own]
    assert store.areas == 4 and len(own) <= 2 and len(others) == 3 * (4 - len(own))
    files = {f: f.read_bytes() for folder in others for f in folder.iterdir() if f.suffix == ".parquet"}
    for f in files:
        f.write_bytes(b"no table")  # whoever reads it fails
        f.with_name(f".{f.name}.crc").unlink()
    store.insert(held(one))
    again = line_dedup.LineStore(spark, path=store.path)
    again.insert(held(one))  # holds nothing new
    for f, content in files.items():
        f.write_bytes(content)
    assert [r.asDict() for r in again.drops().selectExpr("doc_id", "size(keys) as n").collect()] == [{"doc_id": 100, "n": 1}]
    assert store_state(again)[2] == 401 == again.n_keys


def test_compacted_stores_hold_the_same(spark):
    rng = random.Random(9)
    pool = [f"line number {i} of all" for i in range(30)]
    df = spark.createDataFrame([(i, "\n".join(rng.choices(pool, k=4))) for i in range(12)], "doc_id long, text string")
    store = line_dedup.LineStore(spark, compact_after=3)
    for k in range(3):
        store.insert(held(df.where(F.col("doc_id") % 3 == k)))
    store.delete(df.where("doc_id in (2, 5)").select("doc_id"))  # the fourth operation, after which tables are written anew
    plain = line_dedup.LineStore(spark)
    plain.insert(held(df.where("doc_id not in (2, 5)")))
    assert list(store.done) == [4] and store_state(store) == store_state(plain) and store.n_keys == plain.n_keys
    # A run that died between its marker and the removal of what it replaces.
    plain.compact()
    (Path(plain.path.removeprefix("file://")) / "0" / "refs").mkdir(parents=True)
    (Path(plain.path.removeprefix("file://")) / "0" / "done").write_text('{"tables": ["refs"], "areas": 4, "shards": 4, "n_keys": 1, "whole": false}')
    again = line_dedup.LineStore(spark, path=plain.path)
    assert list(again.done) == [1] and store_state(again) == store_state(plain)
    again.insert(held(df.where("doc_id in (2, 5)")))
    everything = line_dedup.LineStore(spark)
    everything.insert(held(df))
    assert store_state(again) == store_state(everything)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    root = {i: i for e in edges for i in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {i: find(i) for i in root}


def variants(seed, n, change):
    """Texts that differ from one another by different numbers of words, so that many are on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(change)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def jaccard_components(texts, width):
    sets = {}
    for i, t in enumerate(texts):
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [512, 16])
def test_near_groups_around_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "_BLOCK", block)
    texts = variants(1, 70, 14) + variants(2, 20, 4) + ["a b c", "A  B\nc", "a b", "", "one two three four five six"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, width=4).collect()}
    assert [found[i] for i in range(len(texts))] == jaccard_components(texts, 4)


def test_rows_that_share_an_id_go_by_their_own_text(spark):
    a, b, c = variants(3, 1, 1)[0], variants(4, 1, 1)[0], variants(5, 1, 1)[0]
    rows = [(5, a), (3, a + " x"), (3, b), (7, b), (7, b), (7, c), (None, a), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert found == sorted([(5, 116, 3, False), (3, 117, 3, True), (3, 116, 3, True), (7, 116, 3, False), (7, 116, 3, False), (7, 116, 7, True), (0, 116, 0, True), (9, 0, 9, True), (9, 0, 9, True)])
    kept = [(r.doc_id, r.text) for r in near_dedup.without_near_duplicates(df).collect()]
    assert sorted(kept, key=str) == sorted([(3, a + " x"), (3, b), (7, c), (None, a), (9, None), (9, "")], key=str)


def test_unlike_members_of_a_bucket_send_no_sets():
    rng = np.random.default_rng(9)
    universe = rng.integers(0, 2**63, (6, 400)).astype(np.uint64)
    sets = [np.unique(u) for u in universe]
    sets.append(np.unique(np.concatenate([sets[0][:380], universe[1][:15]])))
    r = near_dedup.registers(sets)
    n, part = np.asarray([len(s) for s in sets]), np.arange(len(sets))
    mine, other = near_dedup._promising((part[:6], n[:6], r[:6]), (part, n, r), 80)
    assert mine.tolist() == [True] + [False] * 5 and other.tolist() == [False] * 6 + [True]


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(5)
    universe = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    a, b = universe[:2000], universe[400:2400]
    ra, rb, union = near_dedup.registers([a, b, np.union1d(a, b)], 1000)
    assert (np.maximum(ra, rb) == union).all()
    likely = near_dedup.likely_jaccard(ra[None], rb[None], np.asarray([2000.0]), np.asarray([2000.0]))[0]
    assert abs(likely - 1600 / 2400) < 0.05


def test_chunks_resist_shifts():
    rng = random.Random(2)
    text = " ".join(f"word{rng.randrange(3000)}" for _ in range(3000)).encode()
    cut = lambda t: {t[a:b] for a, b in zip([0, *substring_dedup.cuts(t, 6, 16, 1024)], substring_dedup.cuts(t, 6, 16, 1024))}
    whole = cut(text)
    assert len(whole & cut(b"inserted words " + text)) >= len(whole) - 3
    h = 0
    for byte in text[:100]:
        h = (2 * h + int(substring_dedup._gear()[byte])) % 2**32
    assert substring_dedup.rolling(np.frombuffer(text[:100], np.uint8))[-1] == h
    assert substring_dedup.cuts(b"", 6, 16, 1024) == []
    forced = substring_dedup.cuts("é".encode() * 1000, 6, 16, 255)
    assert forced[-1] == 2000 and all(x % 2 == 0 for x in forced)
    ideographs = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000)).encode()
    whole = cut(ideographs)
    assert len(whole) > 100 and len(whole & cut("新しい".encode() + ideographs)) >= len(whole) - 4


def test_shared_passages_go_and_others_stay(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passages = [words(80) for _ in range(30)]
    rows = [(i, f"{words(60)} {passages[i % 30]} {words(60)}") for i in range(60)] + [(100 + i, words(200)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in substring_dedup.repeated_spans(df).collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_words
        assert r.first_doc == r.doc_id - 30
    assert set(found) <= set(range(30, 60)) and len(found) >= 29 and min(found.values()) >= 15
    kept = {r.doc_id: r.text for r in substring_dedup.without_spans(df).collect()}
    assert all(kept[d] == t for d, t in rows if d < 30 or d >= 100)
    assert sum(len(kept[d]) < len(dict(rows)[d]) for d in found) == len(found)


def cosine_links(rows):
    out = {}
    for i, v, label in rows:
        v = None if v is None or any(x is None for x in v) else np.asarray(v, float)
        out[i] = (v, label)
    return out


def test_vectors_with_and_without_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        rows += [(100 * c + i, (centre + rng.normal(size=16) * 0.3).astype(np.float32).tolist(), c % 2) for i in range(40)]
    odd = [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, [None] * 16, 0), (9004, rows[0][1], None), (9005, [float("inf")] + [1.0] * 15, 0), (9006, [], 0), (9007, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    found = {r.vec_id: r for r in embedding_dedup.near_vectors(vectors(spark, rows + odd), shard_rows=50).collect()}
    assert len(found) == len(rows) + len(odd)
    for i, v, label in rows:
        v = np.asarray(v, float)
        brute = [j for j, w, other in rows if j != i and other == label and v @ np.asarray(w, float) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93]
        assert found[i].n_links == len(brute)
        assert found[i].component_id <= min([i, *brute])
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i, _, _ in odd if i is not None)
    assert found[None].kept and embedding_dedup.near_vectors(vectors(spark, []), shard_rows=50).count() == 0


def test_embedding_recall_against_brute_force():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 32))
    v = (centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 32)) * 0.25).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph = embedding_dedup.Graph.stored(v, embedding_dedup.Graph(v, np.arange(1500)).stores())
    truth = v @ v.T >= 0.93
    found, beam, recall = embedding_dedup.searched(graph, v, 0.93, 32, 0.99, 64)
    assert recall >= 0.99 and (truth & found).sum() >= 0.99 * truth.sum() and beam <= 64
    # Queries without neighbours have met the target and leave the beam as it is.
    foreign = rng.normal(size=(300, 32)).astype(np.float32)
    foreign /= np.linalg.norm(foreign, axis=1)[:, None]
    found, beam, recall = embedding_dedup.searched(graph, foreign, 0.93, 32, 0.99, 64)
    assert not found.any() and (beam, recall) == (32, 1.0)
    # A graph with nodes that no link leads to fails its audit at every width, and is then searched whole.
    graph.links[0][:] = -1
    found, beam, recall = embedding_dedup.searched(graph, v, 0.93, 32, 0.99, 64)
    assert (beam, recall) == (1500, 1.0) and (found == (v @ v.T >= 0.93 - 1e-5)).all()


def test_each_shard_has_one_graph_and_beams_stay_narrow(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(8)
    v = np.concatenate([c + rng.normal(size=(4, 16)) * 0.1 for c in rng.normal(size=(400, 16))])
    made, kept = embedding_dedup.written, []
    monkeypatch.setattr(embedding_dedup, "written", lambda df, label: kept.append((label, made(df, label))) or kept[-1][1])
    monkeypatch.setattr(embedding_dedup, "discard", lambda *tables: None)
    rows = [(i, w, i % 2) for i, w in enumerate(v.tolist())]
    found = embedding_dedup.near_vectors(vectors(spark, rows), shard_rows=200).collect()
    tables = dict(kept)
    assert tables["vector-graphs"].count() == 8  # 800 vectors of each of two labels
    audits = tables["vector-links"].where("vec_id is null").collect()
    assert len(audits) == 2 * (4 * 5 // 2) and min(r.recall for r in audits) >= 0.99 and max(r.beam for r in audits) <= 64
    assert all(r.recall >= 0.99 and r.beam <= 64 for r in found)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    truth = (unit @ unit.T >= 0.93) & (np.arange(1600)[:, None] % 2 == np.arange(1600) % 2)
    assert sum(r.n_links for r in found) >= 0.999 * (truth.sum() - 1600)


def test_copies_of_a_vector_and_extreme_components(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(50)] + [(100, [1.01, 2.0, 3.0], 1), (101, [-1.0, 2.0, 0.0], 1)]
    df = vectors(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))
    large = df.where("vec_id < 2").withColumn("vec_id", F.col("vec_id") + 200).withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(1e200)))
    small = df.where("vec_id < 2").withColumn("vec_id", F.col("vec_id") + 300).withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(1e-300)))
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df.unionByName(large).unionByName(small)).collect()}
    assert found == {i: (54, 0) for i in [*range(50), 100, 200, 201, 300, 301]} | {101: (0, 101)}


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(3, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(60, 300))), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(100)), "en", "s0") for i in range(20)]
    found = {r.doc_id: r.kept for r in outliers.judge(table(spark, rows).repartition(5)).collect()}
    assert not any(found[1000 + i] for i in range(20)) and sum(found[i] for i in range(300)) >= 297
    again = {r.doc_id: r.kept for r in outliers.judge(table(spark, rows).repartition(2)).collect()}
    assert again == found


def test_long_licenses_and_other_texts():
    text = licenses.NOTICES["MIT"][0]
    words = text.split()
    wrapped = "Intro\n" + "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)) + "\nend of it"
    found = licenses.notices(wrapped, 0.2, 0.34)
    assert found[0][2] == "MIT" and found[0][1] >= 7
    for plain in ("The license of the river was lost.", "Licensed under GPL version 7.", "A copyright question in a story"):
        assert licenses.notices(plain, 0.2, 0.34) == []


def test_notices_within_lines():
    def found(text):
        return [(r[0], r[1], r[2], r[4], r[5], r[6]) for r in licenses.notices(text, 0.2, 0.34)]

    for others in (0, 5, 10, 50, 400):
        around = "plain words of a tale " * (others // 5)
        assert found(f"{around}Licensed under the MIT License. {around}") == [(0, 1, "MIT", 0, 0, "Licensed under the MIT License" if others else "Licensed under the MIT License. ")]
    assert [r[2] for r in found("Copyright (c) 2021 Jane Roe and contributors. All rights reserved.")] == ["All-rights-reserved"]
    two = "One\nThe code is released under the MIT License. The pictures are licensed under CC BY-NC 4.0. All rights reserved."
    assert [(r[0], r[2]) for r in found(two)] == [(1, "MIT"), (1, "CC-BY-NC-4.0"), (1, "All-rights-reserved")]
    inside = "So they said " * 40 + licenses.NOTICES["ISC"][0] + " and went on" * 40
    assert [r[2:5] for r in found(inside)] == [("ISC", 0, 0)]
    wrapped = licenses.NOTICES["ISC"][0].replace(" for any purpose", "\nfor any purpose").replace(" copyright notice", "\ncopyright notice")
    assert [r[:5] for r in found("Head\n" + wrapped)] == [(1, 3, "ISC", 0, 0)]


def test_identifiers_headers_and_titles():
    def found(text):
        return [r[2] for r in licenses.notices(text, 0.2, 0.34)]

    cases = {
        "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0", "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
        "Licensed under GPL-3.0": "GPL-3.0", "This file is licensed under the GNU GPL v2 or later.": "GPL-2.0", "Released under the BSD license": "BSD", "Released under the BSD 3-Clause License.": "BSD-3-Clause",
    }
    assert {text: found(text) for text in cases} == {text: [name] for text, name in cases.items()}
    for name, notices in licenses.NOTICES.items():
        for text in notices:
            assert found(f"Some words before it. {text} And some behind.")[:1] == [name], text
    # The gate lets every template through, and each is found as its own license.
    for templates in licenses._templates():
        assert all(licenses._TRIGGER.search(" ".join(said)) for _, said in templates.texts)
        assert all(found(" ".join(said)) == [name] for name, said in templates.texts)
    assert found("SPDX-License-Identifier: NONE-1.0") == [] and found("He wrote about the license of MIT and of the river") == [] and found("Die Lizenz mit dem Hut") == []


def test_long_texts_are_scanned_whole():
    text = "ordinary words of a tale " * 20_000 + "Licensed under the MIT License." + " and so on" * 20_000
    assert [r[2] for r in licenses.notices(text, 0.2, 0.34)] == ["MIT"]


def test_long_notices_of_other_licenses():
    def found(text):
        return [r[2] for r in licenses.notices(text, 0.2, 0.34)]

    gnu = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for what, kind, version, name in (("program", "", "2", "GPL-2.0"), ("library", "", "3", "GPL-3.0"), ("library", "Lesser ", "2.1", "LGPL-2.1"), ("program", "Lesser ", "3", "LGPL-3.0"), ("program", "Affero ", "3", "AGPL-3.0")):
        assert found("Head\n" + gnu.format(what, kind, version) + "\nTail") == [name]
    assert found(gnu.format("library", "Library ", "2")) == [] and found(gnu.format("program", "", "1")) == [] and found("Licensed under the GNU Library General Public License, version 2.") == []
    first = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    advertising = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n"
    third = "3. Neither the name of the Apache Works nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    rest = 'THIS SOFTWARE IS PROVIDED BY THE HOLDERS "AS IS" AND ANY WARRANTIES ARE DISCLAIMED.'
    assert found(first + rest) == ["BSD-2-Clause"] and found(first + third + rest) == ["BSD-3-Clause"] and found(first + advertising + third + rest) == []
    other = licenses.NOTICES["Apache-2.0"][0].replace("Apache License", "Educational Community License").replace("www.apache.org/licenses/LICENSE-2.0", "www.opensource.org/licenses/ECL-2.0")
    assert found(other) == [] and found(licenses.NOTICES["Apache-2.0"][0] + ".txt") == ["Apache-2.0"]
    without = licenses.NOTICES["MIT"][0].split(", subject to")[0] + "."
    assert found(without) == [] and found(licenses.NOTICES["MIT"][0]) == ["MIT"]


def test_each_length_of_vectors_links(spark):
    rows = [(0, [1.0, 0.0, 0.0], 1)] + [(i, [1.0, 0.01 * i, 0.0, 1.0], 1) for i in range(1, 5)] + [(i, [0.0, 1.0], 1) for i in range(5, 8)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(vectors(spark, rows)).collect()}
    assert found == {0: (0, 0)} | {i: (3, 1) for i in range(1, 5)} | {i: (2, 5) for i in range(5, 8)}


def test_small_groups_beside_large_ones_link(spark):
    rng = np.random.default_rng(1)
    v = [c + rng.normal(size=(120, 16)) * 0.02 for c in rng.normal(size=(10, 16))] + [c + rng.normal(size=(2, 16)) * 0.1 for c in rng.normal(size=(150, 16))]
    v = np.concatenate(v).astype(np.float32)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    for shard_rows in (8192, 400):
        found = {r.vec_id: r for r in embedding_dedup.near_vectors(vectors(spark, [(i, w, 1) for i, w in enumerate(v.tolist())]), shard_rows=shard_rows).collect()}
        assert [found[i].n_links for i in range(1500)] == want.tolist()
        assert all(found[i].component_id == i for i in range(1500) if not want[i]) and len({r.component_id for r in found.values() if r.n_links}) < (want > 0).sum()
