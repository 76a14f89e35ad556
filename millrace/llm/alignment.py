"""Alignment of two tokenizers over the same bytes: groups between common ends, and which ids overlap in how many documents.

Tokens of a byte-level BPE (A) and of a sentence-piece model (B) are intervals of bytes. Both models keep white space at the front of what follows, so neither joins bytes across a place where a space
follows a character that is no white space: texts are cut there, both tokenizers end there, and a task encodes and aligns every different piece once (or again, when it has met so many that it starts afresh). DuckDB does that over interval tables of many pieces at a time:
as-of joins find the B tokens under the first and the last byte of each A token, a range join gives those between, window sums of common ends number the groups. It then adds up the pieces of each document, and the chunk's
pairs by document; Spark merges these partial counts, and the counts go back to the documents.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, count, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A piece of a text: spaces, then all up to the next space behind a character that is no white space.
_PIECE = re.compile(r" *[^ ]+(?:(?<=\s) +[^ ]+)*(?:(?<=\s) +$)?| +")
#: Characters of text whose documents are put together at a time; a longer text is a chunk of its own.
CHUNK = 2 << 20
#: Pieces that are aligned at a time, and that a task remembers before it starts afresh.
SLICE, KNOWN = 50_000, 300_000
#: So many of the pairs found in most documents are broadcast (16 bytes each); all others are joined by their key.
FREQUENT = 1 << 17
_LISTS = "a array<int>, b array<int>, n array<int>"
_ALIGNED = f"row long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, {_LISTS}"


def _byte_level() -> dict[str, int]:
    """Bytes by the characters that stand for them in byte-level vocabularies: printable Latin-1 for itself, all others by the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.ranked = None
        back, vocabulary = _byte_level(), self.model.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            self.bytes[number] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
        self.ranked = self._by_rank(path)
        if self.ranked is not None:
            self.model = None

    def _by_rank(self, path: str):
        """The same model as ranks, which is several times faster, if that is what the file holds: ids that rise with the merges, no normalizer, and the split of its kind."""
        import public_tokenizers
        import tiktoken

        said = json.loads(Path(path).read_text())
        merges = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
        vocabulary, split = said["model"]["vocab"], said["pre_tokenizer"]
        plain = said["normalizer"] is None and split["type"] == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
        if not plain or [vocabulary.get("".join(m)) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {entry: number for number, entry in enumerate(self.bytes[: 256 + len(merges)])}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, pieces: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(p) for p in pieces]
        return [e.ids for e in self.model.encode_batch(pieces, add_special_tokens=False)]


class Pieces:
    """Tokenizer B: a sentence-piece model, which puts a space before a text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._of(i) for i in range(len(self.model))]

    def _of(self, number: int) -> bytes:
        piece = self.model.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(number) else piece.replace("▁", " ").encode()

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces that begin with a space. The model gives none for an empty text, so a lone space is looked up."""
        ids = self.model.encode([p[1:] for p in pieces], num_threads=1) if pieces else []
        return [of or [self.model.piece_to_id("▁")] for of in ids]


@cache
def _loaded(kind: type, path: str):
    return kind(path)


#: The first B token under each A token, and the last, by as-of joins; where they differ, all behind the first by a range join.
_MET = """CREATE OR REPLACE TEMP TABLE met AS SELECT f.piece, f.id AS a, f.nth AS nth, f.other AS b, f.first AS first, l.nth AS last
 FROM (SELECT a.*, b.nth AS first, b.id AS other FROM ta a ASOF JOIN tb b ON a.start >= b.start) f ASOF JOIN tb l ON f.stop - 1 >= l.start"""
_LINKS = """INSERT INTO links SELECT piece, a, b, count(*) AS n FROM (
 SELECT piece, a, b FROM met UNION ALL SELECT m.piece, m.a, b.id FROM (SELECT * FROM met WHERE last > first) m JOIN tb b ON b.nth > m.first AND b.nth <= m.last) GROUP BY ALL"""
_GROUP = "SELECT id, coalesce(sum(cut) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM (SELECT {0}.nth, {0}.id, ({1}.stop IS NOT NULL)::INT AS cut FROM {0} LEFT JOIN {1} USING (stop)) ORDER BY nth"
_PAIRS = "CREATE OR REPLACE TEMP TABLE pairs AS SELECT doc, a, b, sum(o.n * l.n)::INT AS n FROM held o JOIN links l ON l.piece = o.piece GROUP BY ALL"


def _intervals(ids: list[list[int]], lengths: np.ndarray, base: int) -> dict[str, np.ndarray]:
    """Tokens of pieces, numbered from ``base``, that are laid one behind the other: piece, number, id, bytes from ``start`` to ``stop``."""
    flat = np.array(list(chain.from_iterable(ids)), np.int32)
    stop = np.cumsum(lengths[flat], dtype=np.int64)
    return {"piece": np.repeat(np.arange(base, base + len(ids), dtype=np.int32), list(map(len, ids))), "nth": np.arange(len(flat), dtype=np.int32), "id": flat, "start": stop - lengths[flat], "stop": stop}


def _given_back(pieces: list[str], ids: list[list[int]], table: list[bytes]) -> np.ndarray:
    """Which pieces the bytes of their ids spell."""
    flat = np.array(list(chain.from_iterable(ids)), np.int32)
    ends = np.r_[0, np.cumsum(np.array(list(map(len, table)))[flat])]
    own = np.cumsum(list(map(len, map(str.encode, pieces))))
    if np.array_equal(ends[np.cumsum(list(map(len, ids)), dtype=np.int64)], own) and b"".join(map(table.__getitem__, flat.tolist())) == "".join(pieces).encode():
        return np.ones(len(pieces), bool)
    return np.array([b"".join([table[i] for i in of]) == p.encode() for p, of in zip(pieces, ids)], bool)


def _shown(sides: list[dict[str, np.ndarray]], numbers: list[np.ndarray]) -> tuple[np.ndarray, list[str]]:
    """Number of groups of each piece, and its groups as text, from the tokens (id, g) of both sides and their numbers by piece."""
    side = np.repeat([0, 1], [len(s["id"]) for s in sides])
    g, ids = np.concatenate([s["g"] for s in sides]), np.concatenate([s["id"] for s in sides])
    piece = np.concatenate([np.repeat(np.arange(len(n)), n) for n in numbers])
    order = np.argsort(2 * g + side, kind="stable")
    g, ids, side, piece = g[order], ids[order], side[order], piece[order]
    fresh = lambda x: np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
    begins, of_side, of_piece = fresh(g), fresh(2 * g + side), fresh(piece)
    marks = pa.array(np.select([of_piece, begins, of_side], ["", ";", "|"], ",").tolist(), pa.string())
    words = pc.binary_join_element_wise(marks, pa.array(ids).cast(pa.string()), "")
    # The bytes of all words lie one behind the other, so the text of a piece runs from its first word to that of the next piece.
    first = np.flatnonzero(of_piece)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    text, out = bytes(words.buffers()[2] or b"").decode() if len(words) else "", [""] * len(numbers[0])
    for at, low, high in zip(piece[first].tolist(), offsets[first].tolist(), offsets[np.r_[first[1:], len(words)]].tolist() if len(first) else []):
        out[at] = text[low:high]
    return np.bincount(piece[begins], minlength=len(out)), out


class _Known:
    """Pieces that are encoded and aligned, by number: their tokens, groups, links and groups as text; links by pair are a table of DuckDB."""

    def __init__(self, con, first: ByteLevel, second: Pieces) -> None:
        self.con, self.models = con, (first, second)
        self.lengths = [np.array([len(b) for b in model.bytes], np.int64) for model in self.models]
        self.start()

    def start(self) -> None:
        self.codes: dict[str, int] = defaultdict(count().__next__)
        self.shown: list[str] = []
        self.good = np.zeros(0, bool)
        #: n_a, n_b, n_groups and n_links of each piece.
        self.totals = np.zeros((4, 0), np.int64)
        self.con.execute("CREATE OR REPLACE TEMP TABLE links (piece INT, a INT, b INT, n BIGINT)")

    def learn(self) -> None:
        """Align the pieces that have got a number since the last time."""
        new = list(islice(self.codes, len(self.shown), None))
        for low in range(0, len(new), SLICE):
            self._learn(new[low : low + SLICE])

    def _learn(self, pieces: list[str]) -> None:
        base, con = len(self.shown), self.con
        encoded, good = [], np.ones(len(pieces), bool)
        for model in self.models:
            encoded.append(model.encode(pieces))
            good &= _given_back(pieces, encoded[-1], model.bytes)
        # A piece whose bytes a tokenizer does not give back leaves its documents without tokens, and must not shift those behind it.
        held = [ids if good.all() else [of if ok else [] for of, ok in zip(ids, good)] for ids in encoded]
        numbers = [np.array(list(map(len, ids)), np.int64) for ids in held]
        for name, ids, lengths in zip(("ta", "tb"), held, self.lengths):
            con.register(name, pa.table(_intervals(ids, lengths, base)))
        con.execute(_MET)
        con.execute(_LINKS)
        groups, shown = _shown([con.execute(_GROUP.format(*names)).fetchnumpy() for names in (("ta", "tb"), ("tb", "ta"))], numbers)
        counted = con.execute("SELECT piece, sum(n)::BIGINT AS n FROM links WHERE piece >= ? GROUP BY piece", [base]).fetchnumpy()
        links = np.zeros(len(pieces), np.int64)
        links[counted["piece"] - base] = counted["n"]
        for name in ("ta", "tb"):
            con.unregister(name)
        self.shown += shown
        self.good = np.r_[self.good, good]
        self.totals = np.c_[self.totals, np.stack([*numbers, groups, links])]


class _Chunk:
    """Documents that are put together from their pieces at a time."""

    def __init__(self) -> None:
        self.rows: list[int] = []
        self.docs: list[np.ndarray] = []
        self.size = 0

    def add(self, row: int, text: str | None, known: _Known) -> None:
        pieces = _PIECE.findall(" " + text) if text else []
        self.docs.append(np.array(list(map(known.codes.__getitem__, pieces)), np.int32))
        self.rows.append(row)
        self.size += len(text or "")

    def aligned(self, known: _Known, with_groups: bool) -> Iterator[pa.RecordBatch]:
        """A row for each document, and one without number for the chunk's pairs: how many of its documents hold each."""
        known.learn()
        con = known.con
        docs = [codes if known.good[codes].all() else codes[:0] for codes in self.docs]
        parts = [np.unique(codes, return_counts=True) for codes in docs]
        join = lambda k: np.concatenate([p[k] for p in parts]).astype(np.int32)
        con.register("held", pa.table({"doc": np.repeat(np.arange(len(parts), dtype=np.int32), [len(codes) for codes, _ in parts]), "piece": join(0), "n": join(1)}))
        con.execute(_PAIRS)
        con.unregister("held")
        pairs = con.execute("SELECT doc, a, b, n FROM pairs ORDER BY doc, a, b").fetchnumpy()
        ends = np.searchsorted(pairs["doc"], np.arange(len(parts) + 1)).astype(np.int32)
        totals = np.stack([known.totals[:, codes].sum(axis=1) for codes in docs])
        texts = [";".join([known.shown[c] for c in codes.tolist()]) for codes in docs]
        lists = lambda table, ends: {name: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(table[name].astype(np.int32))) for name in "abn"}
        digests = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], pa.string())
        names = ("n_a", "n_b", "n_groups", "n_links")
        said = {"groups": pa.array(texts if with_groups else [None] * len(texts), pa.string()), "groups_sha256": digests}
        yield pa.RecordBatch.from_pydict({"row": pa.array(self.rows, pa.int64())} | {name: pa.array(totals[:, k], pa.int64()) for k, name in enumerate(names)} | said | lists(pairs, ends))
        partial = con.execute("SELECT a, b, count(*) AS n FROM pairs GROUP BY ALL").fetchnumpy()
        nothing = {name: pa.nulls(1, pa.int64()) for name in ("row", *names)} | {name: pa.nulls(1, pa.string()) for name in said}
        yield pa.RecordBatch.from_pydict(nothing | lists(partial, np.array([0, len(partial["a"])], np.int32)))


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """The written alignment of every text by the tokenizer files ``first`` (A) and ``second`` (B).

    Rows of documents: (``id_col``, row: a number of its own, n_a, n_b, n_groups, n_links, groups if ``with_groups``, groups_sha256, a, b, n: ids of its different linked pairs, in order, and how often each is linked);
    then rows without a number for chunks of documents, whose a, b, n say how many of them hold each pair. Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        models = _loaded(ByteLevel, first), _loaded(Pieces, second)
        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        con.execute("SET preserve_insertion_order = false")
        gc.disable()  # lists of ids hold no cycles, and looking for some takes a fifth of the time
        number = TaskContext.get().partitionId() << 36
        known, chunk, ids = _Known(con, *models), _Chunk(), []

        def done() -> Iterator[pa.RecordBatch]:
            for k, batch in enumerate(chunk.aligned(known, with_groups)):
                names = pa.array(ids, type_) if k == 0 else pa.nulls(1, type_)
                yield pa.RecordBatch.from_arrays([names, *batch.columns], names=["id", *batch.schema.names])

        type_ = None
        for batch in batches:
            type_ = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(name)
                chunk.add(number, text.as_py(), known)
                number += 1
                if chunk.size >= CHUNK:
                    yield from done()
                    chunk, ids = _Chunk(), []
                    if len(known.codes) > KNOWN:
                        known.start()
        if ids:
            yield from done()
        con.close()
        gc.enable()

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(rows, f"id {kind}, {_ALIGNED}")
    return written(found, "alignment")


def _exploded(lists: DataFrame, *beside: str) -> DataFrame:
    pair = F.explode(F.arrays_zip("a", "b", "n")).alias("p")
    return lists.select(*beside, pair).select(*beside, (F.shiftleft(F.col("p.a").cast("long"), 32) + F.col("p.b")).alias("pair"), F.col("p.n").cast("long").alias("n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair: A id times 2 ** 32 plus B id, documents that hold it linked, best: no pair of its A id is in more). An A id has at most as many pairs as B has ids."""
    counts = _exploded(aligned.where("row IS NULL")).groupBy("pair").agg(F.sum("n").alias("documents"))
    return counts.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy(F.shiftright("pair", 32))))


def scored(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Documents of ``aligned`` (id, n_a, ..., groups_sha256) with n_best, the links whose pair is a best one, and count_sum, the documents of the pairs of all links.

    The ``frequent`` pairs of most documents are looked up where the documents are; only links of others are shuffled, so no pair that is in many documents is joined by its key.
    """
    counts = written(pair_counts(aligned), "pair-counts")
    top = written(counts.orderBy(F.desc("documents"), "pair").limit(frequent), "pair-top")
    docs = aligned.where("row IS NOT NULL")
    met = _exploded(docs, "row").join(F.broadcast(top), "pair", "left")
    sums = [F.sum(F.col("n") * F.col("best").cast("int")).alias("n_best"), F.sum(F.col("n") * F.col("documents")).alias("count_sum")]
    here = met.where("documents IS NOT NULL").groupBy("row").agg(*sums)
    rest = counts.join(F.broadcast(top.select("pair")), "pair", "left_anti")
    there = met.where("documents IS NULL").select("row", "pair", "n").join(rest, "pair").groupBy("row").agg(*sums)
    both = here.unionByName(there).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.drop("a", "b", "n").join(both, "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups", "groups_sha256")


def align_documents(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of documents by the installed tokenizer files, or those given. Rows that share an id are documents of their own, null ids too; an empty table gives no rows."""
    import public_tokenizers

    aligned = align(docs, first or public_tokenizers.path("byte_bpe_50k.json"), second or public_tokenizers.path("piece_bpe_32k.model"))
    return scored(aligned).drop("groups").withColumnRenamed("id", "doc_id")
