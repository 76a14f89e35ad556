"""Alignment of tokenizers, held against the libraries over whole texts and plain loops."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(models, text):
    """(id, bytes) of both sides; none where the bytes differ from those of the text."""
    first, second = models
    if not text:
        return [], []
    found = first.encode(" " + text, add_special_tokens=False)
    back = alignment._byte_level()
    a = [(i, bytes(back[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def spans(side):
    at, out = 0, []
    for i, data in side:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(models, rows):
    """The rows of ``align_documents`` of (doc_id, text)."""
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = map(spans, tokens(models, text))
        links = Counter()
        k = 0
        for i, low, high in a:
            while k and b[k][1] > low:
                k -= 1
            while k < len(b) and b[k][2] <= low:
                k += 1
            j = k
            while j < len(b) and b[j][1] < high:
                links[i, b[j][0]] += 1
                j += 1
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, x, y = [], 0, 0
        for cut in cuts:
            left, right = [], []
            while x < len(a) and a[x][2] <= cut:
                left.append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= cut:
                right.append(str(b[y][0]))
                y += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        counts.update(links.keys())
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = Counter()
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(d, na, nb, ng, sum(ln.values()), sum(n for p, n in ln.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in ln.items()), sha) for d, na, nb, ng, ln, sha in docs]


ODD = [
    "a \n b", "a  b\n\n  c   ", "   ", "\n", " x  y", "é　 z", "don't  stop's", " ", "a\x1c b", "12 34  56", "​ a", "x▁y z", "▁", "tab\t tab\t\ttab ", "<s> </s> <unk> <|endoftext|> <0x41>", "日本語の テキスト です。", "🙂🙂 a🙂", "\x00 nul", "nbsp  x  y", "\u0085 n\u0085 l",
    "ends in space ", "ends in two  ", "ends\n ", "x" * 5000 + " " + "y z " * 3000, "\r\n \r\n", "a  b  c", "ﬁ ½ ́e",
]


def test_pieces_are_encoded_as_within_their_text(models):
    first, second = alignment.ByteLevel(A), alignment.Pieces(B)
    for text in ODD:
        pieces = alignment._PIECE.findall(" " + text)
        assert "".join(pieces) == " " + text
        assert sum(first.encode(pieces), []) == models[0].encode(" " + text, add_special_tokens=False).ids, repr(text)
        if "▁" not in text:
            assert sum(second.encode(pieces), []) == models[1].encode(text), repr(text)


def test_no_piece_of_the_model_goes_on_behind_a_space():
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    assert not [p for p in map(model.id_to_piece, range(len(model))) if "▁" in p.strip("▁") or p.rstrip("▁") != p and p.strip("▁")]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 3])
def test_rows_are_those_of_plain_loops(spark, models, frequent, monkeypatch):
    for name in ("CHUNK", "SLICE", "KNOWN"):
        monkeypatch.setattr(alignment, name, 500 if name == "CHUNK" else 300)
    rows = [(k, text) for k, text in enumerate([*ODD, None, "", *ODD[:3]])] + [(3, "repeated id"), (None, "no id"), (3, "repeated id")]
    rows += [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("a", F.lit(2)).withColumn("id", F.lit(3))
    found = alignment.scored(alignment.align(docs, A, B), frequent).drop("groups")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(models, rows), key=repr)


def test_groups_as_text(spark, models):
    docs = spark.createDataFrame([(1, "Aligned, twice over."), (2, None)], "doc_id long, text string")
    rows = {r["id"]: r for r in alignment.align(docs, A, B, with_groups=True).where("row IS NOT NULL").collect()}
    assert hashlib.sha256(rows[1]["groups"].encode()).hexdigest() == rows[1]["groups_sha256"] and rows[2]["groups"] == "" == rows[2]["groups_sha256"]
    assert rows[1]["groups"].count(";") == rows[1]["n_groups"] - 1


def test_an_empty_table_gives_nothing(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
