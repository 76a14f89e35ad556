"""Queries held against SQL, or against plain Python where SQL can not express them."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer, models

from millrace.llm import byte_bpe, packing, queries, unigram_counts

from ..compare import mismatch

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in queries.queries()[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_are_those_of_the_sql(spark, name):
    assert mismatch(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) is None


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_as_the_library(spark):
    own, lib = rows(spark, "op4_byte_bpe"), library()
    for doc, text in texts(spark).items():
        ids = lib.encode_ordinary(text)
        assert (own[doc].n_tokens, own[doc].ids_sha256, own[doc].decoded_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_byte_bpe_on_odd_texts():
    own, lib, rng = byte_bpe.ByteBPE(P.path("byte_bpe_50k.tiktoken")), library(), np.random.default_rng(1)
    letters = list("abcT Z\n\t  é's'll.,!—123½²\x1c\x85日本語́😀 ")
    odd = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)] + ["a" * 5000, " " * 3000, "ab" * 2000, "'" * 500, "\n" * 400 + "x"]
    assert all(np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode_ordinary(t) for t in odd)


def test_token_counts_as_the_library(spark):
    own = rows(spark, "op9_token_counts")
    pieces = unigram_counts.load_pieces(P.path("piece_bpe_32k.model"))
    byte = [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    lib = Tokenizer(models.Unigram([("<unk>", 0.0), *byte, *pieces], 0, True))
    for doc, text in texts(spark).items():
        assert own[doc].n_tokens == (len(lib.encode("▁" + text.replace(" ", "▁")).ids) if text else 0)


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_break_ties_as_the_library(fallback):
    pieces = [("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -3.0), ("aa", -3.0), ("ba", -4.0), ("abab", -8.0)]
    byte = [(f"<0x{i:02X}>", 0.0) for i in range(256)] if fallback else []
    lib = Tokenizer(models.Unigram([("<unk>", 0.0), *byte, *pieces], 0, fallback))
    own, rng = unigram_counts.Unigram([*pieces], fallback), np.random.default_rng(2)
    for _ in range(500):
        text = "".join(rng.choice(list("ab é"), rng.integers(1, 25)))
        assert own.count(text)[0] == len(lib.encode("▁" + text.replace(" ", "▁")).ids)


def test_packing_holds_every_id_once(spark):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.queries()["op6_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts(spark).items():
        ids = np.asarray([*lib.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    used = 0
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        used += at
        padding += 2048 - at if at & (at - 1) else 0
    assert padding <= 0.01 * used


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 300).tolist()
    room = []  # the same rule, window by window
    for n in sorted(lengths, reverse=True):
        fits = [i for i, free in enumerate(room) if free >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(64 - n)
    found = packing.best_fit(lengths, 64)
    assert sorted(i for w in found for i in w) == list(range(300))
    assert sorted(64 - sum(lengths[i] for i in w) for w in found) == sorted(room)


@pytest.mark.parametrize("as_text", [False, True])
def test_word_parts_have_the_ids_of_whole_texts(as_text):
    own, rng = packing.WordBPE(P.path("word_bpe_49k.json"), as_text), np.random.default_rng(4)
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    if as_text:
        lib.encode_special_tokens = True
    letters = [*"ab'st llZÉé1½.,—≠\n\t\x1c ΣİK日<|endoftext|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    odd = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)] + ["hello <|endoftext|> there", "<|endoftext|>", "a<|startoftext|>b"]
    assert all(np.frombuffer(own.encode(t), "<u4").tolist() == e.ids for t, e in zip(odd, lib.encode_batch(odd, add_special_tokens=False)))


def test_quality_base_rules(spark):
    own = rows(spark, "op10_quality_rules")
    for doc, text in texts(spark).items():
        words = WORDS.findall(text)
        windows = list(zip(words, words[1:], words[2:]))
        times = collections.Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
        lines = [line for line in text.split("\n") if WORDS.search(line)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (own[doc].n_words, own[doc].word_chars, own[doc].n_symbols, own[doc].n_dup_lines, own[doc].n_repeat_words) == want
        assert own[doc].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (own[doc].base_failed and own[doc].kept)


def test_licenses_are_found(spark):
    found = collections.defaultdict(set)
    for r in queries.queries()["op1_license_scan"](spark, SF).collect():
        found[r.doc_id].add(r.license)
    notices = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "All-rights-reserved"}
    for doc, text in texts(spark).items():
        assert found.get(doc, set()) == {name for line, name in notices.items() if line in text.split("\n")}
