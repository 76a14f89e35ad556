"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Every match of the split pattern is merged on its own. The leaf at a live byte position holds the rank of
the pair that starts there; each node the minimum of 32 children, so that the leftmost minimum is found from the
root down. A merge changes at most three leaves, each by a walk of logarithmic length, so a pattern match of n bytes costs O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo

#: Letters of the fast path, and code points there that are not white space.
_L, _PLAIN = "A-Za-zÀ-ÖØ-öø-ɏ", "!-~À-ɏ"
#: The first branches are whole matches of the split pattern, known to end where they do by the ASCII code point
#: that follows. The last takes whatever else there is, up to the next place where the pattern always ends a match:
#: before a single space or line feed between plain code points.
_CHUNKS = re.compile(
    rf" ?[{_L}]+(?=[\n -@\[-`{{-~]|\Z)|'(?:[stmd]|re|ve|ll)| ?[!-&(-/:-@\[-`{{-~]+(?=[\n 0-9A-Za-z]|\Z)| ?[0-9]+(?=[\n -/:-~]|\Z)"
    rf"|\n(?=[{_PLAIN}])|(?s:.+?)(?=(?<=[{_PLAIN}])[ \n][{_PLAIN}]|\Z)"
)
_LETTERS = frozenset(chr(c) for c in range(0x250) if re.match(f"[{_L}]", chr(c)))
#: Children of a node of the segment tree.
_WIDE = 32


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one pattern match: merge the leftmost pair of minimum rank until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    if n == 0:
        return []
    none = 1 << 40
    if n <= _WIDE:  # the tree is one node: dead positions leave it
        cuts = list(range(n + 1))
        node = [get(piece[i : i + 2], none) for i in range(n - 1)]
        while node and (low := min(node)) < none:
            at = node.index(low)
            del node[at], cuts[at + 1]
            if at < len(node):
                node[at] = get(piece[cuts[at] : cuts[at + 2]], none)
            if at:
                node[at - 1] = get(piece[cuts[at - 1] : cuts[at + 1]], none)
        return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]
    ends = list(range(1, n + 1))  # of the live token at each start
    before = list(range(-1, n))
    tree = [[get(piece[i : i + 2], none) for i in range(n - 1)] + [none]]
    while len(tree[-1]) > _WIDE:
        below = tree[-1]
        tree.append([min(below[k : k + _WIDE]) for k in range(0, len(below), _WIDE)])
    leaves, top, high = tree[0], tree[-1], len(tree) > 1
    while (low := min(top)) < none:
        at = top.index(low)  # the leftmost, and so on down to the leaf
        for level in tree[-2::-1] if high else ():
            at = level.index(low, at * _WIDE)
        gone = ends[at]
        end = ends[at] = ends[gone]
        leaves[gone] = none
        changed = [gone, at]
        if end < n:
            before[end] = at
            after = ends[end]
            leaves[at] = get(piece[at:after], none) if after - at <= longest else none
        else:
            leaves[at] = none
        left = before[at]
        if left >= 0:
            leaves[left] = get(piece[left:end], none) if end - left <= longest else none
            changed.append(left)
        if high:
            for k in changed:
                for below, level in zip(tree, tree[1:]):
                    k //= _WIDE
                    level[k] = min(below[k * _WIDE : (k + 1) * _WIDE])
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return out


class ByteBPE:
    """Encoder and decoder for one rank file. Ids travel as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = load_ranks(path)
        self.longest = max(map(len, self.ranks))
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.pieces = Memo(self._piece, 600_000)
        #: _CHUNKS holds for the pattern of the rank files only.
        self.chunks = Memo(self._chunk, 600_000) if pattern == public_tokenizers.PATTERN else None

    def _piece(self, piece: str) -> bytes:
        ids = merge(piece.encode(), self.ranks, self.longest)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if chunk[-1] in _LETTERS and chunk[0] != "'" and "\n" not in chunk and chunk[1:].isalpha():
            return self._piece(chunk)
        return b"".join(map(self.pieces.__getitem__, self.split.findall(chunk)))

    def encode(self, text: str) -> bytes:
        if self.chunks is None:
            return self._chunk(text)
        return b"".join(map(self.chunks.__getitem__, _CHUNKS.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: id, n_tokens, ids_sha256 and decoded_sha256, and with ``with_ids`` the ids themselves.

    Texts are encoded whole, without special tokens, and the ids are decoded again. A null text counts as
    empty (0 tokens, digests of no bytes); null or repeated ids are kept as rows of their own; other columns
    are ignored. Rows never leave their partition: no shuffle, and a lost task is simply run again.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            lengths, digests, decoded, kept = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                lengths.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(rows, schema)


def decode_ids(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Per row: id and ``text_bytes``, the bytes that the ids stand for; null ids give null. An id outside the vocabulary fails the job."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, public_tokenizers.PATTERN)
        for batch in batches:
            out = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "text_bytes"])

    return encoded.select(id_col, ids_col).mapInArrow(rows, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text_bytes binary")
