"""Packing of tokenized documents into fixed windows, best fit decreasing.

Documents longer than a window are first cut into full windows. The remainders, longest first, each go to the open
window with the least room that still holds them; a segment tree indexed by remaining capacity finds it in
logarithmic time. Windows that stay too empty are laid end to end and cut again, so that nothing is padded much:
what is left of a partition in the end goes into sequences whose lengths are powers of two, which need no padding.
Every partition packs its own rows in blocks of bounded size: no shuffle, and memory does not grow with the input.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Memo

_A = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Parts of a text whose ids do not depend on what is around them: letters, marks and digits of ASCII and Latin-1 up to
#: a code point that ends them in any case, or else all that follows up to white space.
_PARTS = re.compile(rf"[{_A}]+(?=[\t-\r -&(-@\[-`{{-~]|\Z)|[!-&(-/:-@\[-`{{-~]+(?=[\t-\r 0-9{_A}]|\Z)|[0-9](?=[\t-\r -~]|\Z)|[^\t-\r ]+")


#: The parts that are one word of the tokenizer each: lower-cased, they go to its merges at once.
_WORD = re.compile(rf"[{_A}]+|[!-&(-/:-@\[-`{{-~]+|[0-9]")


class WordBPE:
    """Ids of whole texts by the tokenizers library, remembered part by part. Names of special tokens in a text are those tokens, as the library has it, or with ``special_as_text`` ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        named = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts with such a name go to the library whole.
        self.special = re.compile("|".join(named), re.I) if named and not special_as_text else None
        self.merges = self.tokenizer.model.tokenize
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        #: Latin-1 letters as the characters that stand for their UTF-8 bytes.
        self.level = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.memo = Memo(self._part, 600_000)

    def _part(self, part: str) -> bytes:
        if _WORD.fullmatch(part):
            part = part.lower()
            ids = [token.id for token in self.merges(part if part.isascii() else part.translate(self.level))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.memo.__getitem__, _PARTS.findall(text)))


@lru_cache(maxsize=2)
def _loaded(path: str, special_as_text: bool) -> WordBPE:
    return WordBPE(path, special_as_text)


class Room:
    """Open windows by remaining capacity: a segment tree over the capacities holds how many there are."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        k, tree = self.size + capacity, self.tree
        while k:
            tree[k] += 1
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that an open window has."""
        tree, k = self.tree, self.size + need
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        return k - self.size

    def take(self, capacity: int) -> int:
        k, tree = self.size + capacity, self.tree
        while k:
            tree[k] -= 1
            k >>= 1
        return self.windows[capacity].pop()


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Positions in ``lengths`` by window, each window's in the order in which they were put there."""
    room, out = Room(window), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        capacity = room.tightest(lengths[i])
        if capacity is None:
            out.append([])
            capacity, at = window, len(out) - 1
        else:
            at = room.take(capacity)
        out[at].append(i)
        if capacity > lengths[i]:
            room.add(capacity - lengths[i], at)
    return out


def packed(documents: Iterable[tuple[object, bytes]], window: int, block_ids: int, waste: float) -> Iterator[tuple]:
    """Pieces (id, start, length, crc32, tokens of the document, sequence, offset) of ``documents``, given with their ids as bytes."""
    sequence = 0
    rest: list[tuple] = []  # id, start, ids, tokens of the document
    held = 0

    def piece(part: tuple, number: int, offset: int) -> tuple:
        return part[0], part[1], len(part[2]) // 4, zlib.crc32(part[2]), part[3], number, offset

    def cut(parts: list[tuple], sizes: Iterator[int]) -> Iterator[tuple[list[tuple], int]]:
        """``parts`` end to end, cut into runs of the given sizes; what is left comes last."""
        now, filled, size = [], 0, next(sizes)
        for name, start, ids, tokens in parts:
            while ids:
                took = ids[: 4 * (size - filled)]
                now.append((name, start, took, tokens))
                filled += len(took) // 4
                start, ids = start + len(took) // 4, ids[len(took) :]
                if filled == size:
                    yield now, filled
                    now, filled, size = [], 0, next(sizes, window)
        if now:
            yield now, filled

    def flush(last: bool) -> Iterator[tuple]:
        nonlocal rest, held, sequence
        loose: list[tuple] = []
        for found in best_fit([len(part[2]) // 4 for part in rest], window):
            used = sum(len(rest[i][2]) // 4 for i in found)
            if window - used > waste * window:
                loose += (rest[i] for i in found)
                continue
            offset = 0
            for i in found:
                yield piece(rest[i], sequence, offset)
                offset += len(rest[i][2]) // 4
            sequence += 1
        rest, held = [], 0
        for run, filled in cut(loose, iter(lambda: window, None)):
            if filled < window and not last:
                rest, held = run, filled
                break
            powers = iter([filled] if filled == window else [1 << k for k in range(filled.bit_length() - 1, -1, -1) if filled >> k & 1])
            for part, _ in cut(run, powers):
                offset = 0
                for x in part:
                    yield piece(x, sequence, offset)
                    offset += len(x[2]) // 4
                sequence += 1

    for name, ids in documents:
        tokens = len(ids) // 4
        full = tokens // window * window
        for start in range(0, full, window):
            yield piece((name, start, ids[4 * start : 4 * (start + window)], tokens), sequence, 0)
            sequence += 1
        if tokens > full:
            rest.append((name, full, ids[4 * full :], tokens))
            held += tokens - full
            if held >= block_ids:
                yield from flush(False)
    yield from flush(True)


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, window: int = 2048, block_ids: int = 4_000_000, waste: float = 0.01, special_as_text: bool = False) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``window`` ids.

    A document's ids are those of its text without special tokens added, then ``end_id``; a null or empty text is
    that one id. Names of special tokens that stand in a text are encoded as the library does by default, with ``special_as_text`` as ordinary text.
    An empty table gives no pieces. Per piece: id, start (the document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id and offset (gapless from 0). A sequence is padded to the window by whoever reads it, unless its
    length is a power of two; only windows that lack at most ``waste`` of their length are left unfilled. A
    document is cut at multiples of the window and, in windows that best fit leaves emptier, where they are cut
    again. Null and repeated ids are packed as documents of their own; other columns are ignored. Up to
    ``block_ids`` ids are held at a time. sequence_id: partition number x 2^32 plus the number in the partition.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes]]:
        bpe = _loaded(path, special_as_text)
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                yield name.as_py(), bpe.encode(text.as_py() or "") + end

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], name_type), *(pa.array(c, pa.int64()) for c in columns[1:5]), pa.array([first + n for n in columns[5]], pa.int64()), pa.array(columns[6], pa.int64())], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        name_type = None

        def named() -> Iterator[pa.RecordBatch]:
            nonlocal name_type
            for batch in batches:
                name_type = batch.schema.field(0).type
                yield batch

        for piece in packed(documents(named()), window, block_ids, waste):
            out.append(piece)
            if len(out) == 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return docs.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
