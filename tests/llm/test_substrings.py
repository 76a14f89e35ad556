"""Repeated spans held against plain search, which knows nothing of chunks."""

import bisect
import random
import re

from millrace.llm import substring_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def spans(df):
    out = {}
    for r in substring_dedup.repeated_spans(df).collect():
        out.setdefault(r.doc_id, []).append((r.start, r.start + r.length, r.n_words, r.first_doc))
    return out


def pieces(text, before):
    """Fewest parts of ``text`` that each occur in one of ``before``."""
    n = at = 0
    while at < len(text):
        low, high = at + 1, len(text)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if any(text[at:middle] in b for b in before) else (low, middle - 1)
        n, at = n + 1, low
    return n


def test_spans_repeat_and_long_repeats_are_spans(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    found, seen, passages, hits = spans(df), {}, 0, 0
    for doc in sorted(texts):
        text = texts[doc]
        for start, end, words, first in found.get(doc, []):
            part = text[start:end]
            # Chunks have 16 bytes at least, and each was there before.
            before = [texts[d] for d in texts if d < doc] + [text[:start]]
            assert first <= doc and words == len(WORD.findall(part)) >= 15
            assert pieces(part, before) <= len(part.encode()) // 16 + 1
        places = [m.span() for m in WORD.finditer(text)]
        tokens = [text[a:b] for a, b in places]
        # Runs of more than 50 words that a smaller document has word for word.
        k = 0
        while k + 60 <= len(tokens):
            if tuple(tokens[k : k + 60]) in seen:
                passages += 1
                begins = sorted(s[0] for s in found.get(doc, []))
                at = bisect.bisect_right(begins, places[k + 59][1])
                hits += bool(at) and max(s[1] for s in found[doc] if s[0] <= begins[at - 1]) > places[k][0]
                k += 60
            else:
                k += 1
        for k in range(len(tokens) - 59):
            seen.setdefault(tuple(tokens[k : k + 60]), doc)
    assert passages > 20 and hits >= 0.98 * passages


def test_passages_without_spaces_are_found(spark):
    rng = random.Random(4)
    ideographs = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    ascii_ = lambda n: "".join(rng.choices("abcdefghijklmnop0123456789", k=n))
    for make, least in ((ideographs, 450), (ascii_, 450)):
        passages = [make(600) for _ in range(10)]
        rows = [(i, make(rng.randrange(50, 90)) + passages[i % 10] + make(40)) for i in range(20)] + [(100 + i, make(700)) for i in range(5)]
        found = spans(table(spark, rows))
        assert set(found) == set(range(10, 20))
        for doc, own in found.items():
            assert sum(b - a for a, b, _, _ in own) >= least and all(first == doc - 10 for *_, first in own)
            text, before = dict(rows)[doc], dict(rows)[doc - 10]
            assert all(text[a:b] in before for a, b, _, _ in own)


def test_rows_that_share_an_id_lose_their_own_spans_only(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    shared, other = words(150), words(150)
    rows = [(1, shared), (2, f"a {shared}"), (2, other), (2, other), (3, None), (3, ""), (None, shared), (4, f"{other} b c")]
    kept = sorted((r.doc_id or 0, r.text or "") for r in substring_dedup.without_spans(table(spark, rows)).collect())
    assert [d for d, _ in kept] == [0, 1, 2, 2, 2, 3, 3, 4]
    assert (1, shared) in kept and (0, shared) in kept and kept.count((2, other)) == 2
    assert len(next(t for d, t in kept if d == 2 and t != other)) < 200 and len(dict(kept)[4]) < 200
    fewer = substring_dedup.without_spans(table(spark, [(1, shared), (2, shared), (3, None), (3, " ")]), keep_emptied=False)
    assert sorted((r.doc_id, r.text) for r in fewer.where("text is not null").collect()) == [(1, shared), (3, " ")] and fewer.count() == 3
