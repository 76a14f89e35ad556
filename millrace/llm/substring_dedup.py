"""Substring dedup by content-defined chunks.

A gear rolling hash over 32 bytes picks cuts at white space and, in long stretches without any, at code points, so where chunks end
depends on nothing but the bytes just before: an insertion shifts the chunks around it and no others. Chunks are compared by
128-bit digest; all but the first occurrence of a chunk are repeats. Runs of repeated chunks that together have enough words are spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, discard, written

_WINDOW = 32
#: Bytes since the last white space from which on a text is cut at code points, one in how many of these, and how many of them count as a word.
_UNSPACED, _ONE_POINT_IN, _POINTS_A_WORD = 64, 16, 4


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    """A random 32-bit number for each byte."""
    return np.asarray([xxhash.xxh32_intdigest(b"gear %d" % k) for k in range(256)], np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: h = 2 h + gear[byte] modulo 2^32, so of the last 32 bytes only. Built by doubling the width."""
    h = _gear()[data]
    width = 1
    while width < _WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    return h


def _unspaced(b: np.ndarray, space: np.ndarray) -> np.ndarray:
    """For each byte whether none of the last ``_UNSPACED`` bytes, itself included, is white space."""
    if not len(b) or len(b) <= _UNSPACED:
        return np.zeros(len(b), bool)
    at = np.arange(len(b))
    return at - np.maximum.accumulate(np.where(space, at, -1)) >= _UNSPACED


def cuts(data: bytes, one_in: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of ``data``, ``least`` to ``most`` bytes apart: after white space where the hash is below 1/``one_in`` of its range, in stretches without white space after code points where it is below 1/16.
    Where there is no such place for ``most`` bytes, as in a repeated character, a chunk ends before the next code point."""
    if not data:
        return []
    b = np.frombuffer(data, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    h = rolling(b)
    good = space & (h < np.uint32(2**32 // one_in))
    dense = _unspaced(b, space)
    if dense.any():
        last_of_point = np.ones(len(b), bool)
        last_of_point[:-1] = (b[1:] & 0xC0) != 0x80
        good |= dense & last_of_point & (h < np.uint32(2**32 // _ONE_POINT_IN))
    likely = np.flatnonzero(good) + 1
    out, last, n = [], 0, len(data)
    for cut in [*likely.tolist(), n]:
        while cut - last > most:
            forced = last + most
            while forced > last + 1 and forced < n and data[forced] & 0xC0 == 0x80:
                forced -= 1
            out.append(forced)
            last = forced
        if cut - last >= least or cut == n:
            if cut > last:
                out.append(cut)
                last = cut
    return out


_CHUNK = "doc long, mark long, n int, start int, length int, words int, h1 long, h2 long"


def chunks(docs: DataFrame, one_in: int, least: int, most: int) -> DataFrame:
    """Chunks of ``docs`` (doc, mark, text): number, start and length in code points, words, digest. Where there is no white space for long, some code points count as a word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list) -> pa.RecordBatch:
            doc, mark, n, start, length, words, digests = (list(x) for x in zip(*parts))
            arrays = [np.concatenate(x) for x in (doc, mark, n, start, length, words)]
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([*(pa.array(a, k) for a, k in zip(arrays, kinds)), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc", "mark", "n", "start", "length", "words", "h1", "h2"])

        for batch in batches:
            parts, size = [], 0
            for name, mark, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                ends = cuts(data, one_in, least, most)
                if not ends:
                    continue
                b = np.frombuffer(data, np.uint8)
                at = np.asarray([0, *ends])
                points = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])[at]
                space = (b == 32) | ((b >= 9) & (b <= 13))
                begins = ~space
                begins[1:] &= space[:-1]
                words = np.concatenate([[0], np.cumsum(begins)])
                dense = _unspaced(b, space)
                if dense.any():
                    words[1:] += np.cumsum(dense & ((b & 0xC0) != 0x80)) // _POINTS_A_WORD
                words = words[at]
                k = len(ends)
                parts.append((np.full(k, name.as_py()), np.full(k, mark.as_py()), np.arange(k), points[:-1], np.diff(points), np.diff(words), b"".join([xxhash.xxh3_128_digest(data[x:y]) for x, y in zip([0, *ends], ends)])))
                size += k
                if size > 100_000:
                    yield flush(parts)
                    parts, size = [], 0
            if parts:
                yield flush(parts)

    return docs.mapInArrow(rows, _CHUNK)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, mark, text) of the rows with an id: the mark tells the texts of an id apart."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def _spans(docs: DataFrame, one_in: int, least: int, most: int, least_words: int) -> DataFrame:
    """Spans (doc, mark, start, length, n_words, first_doc) of ``docs`` (doc, mark, text)."""
    made = written(chunks(docs, one_in, least, most), "chunks")
    # Counts by half a digest find what can repeat; the full digest decides. What is joined is written first, so that
    # both sides of a join are plain exchanges, whose hot keys adaptive execution can split.
    often = written(made.groupBy("h1").agg(F.count("*").alias("times")).where("times > 1").select("h1"), "chunks-often")
    twice = written(made.join(often, "h1"), "chunks-twice")
    place = F.struct("doc", "mark", "n")
    first = written(twice.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").select("h1", "h2", "first"), "chunks-first")
    repeats = twice.join(first, ["h1", "h2"]).where(place != F.col("first"))
    own = Window.partitionBy("doc", "mark").orderBy("n")
    # A row that is there twice has its chunks twice.
    once = repeats.withColumn("before", F.lag("n").over(own)).where("before is null or before <> n")
    runs = once.select("doc", "mark", "n", "start", "length", "words", F.col("first.doc").alias("first_doc"), (F.col("n") - F.row_number().over(own)).alias("run"))
    spans = runs.groupBy("doc", "mark", "run").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.sum("words").alias("n_words"), F.min_by("first_doc", "n").alias("first_doc"))
    out = written(spans.where(F.col("n_words") >= least_words).select("doc", "mark", F.col("start").cast("long"), "length", "n_words", "first_doc"), "spans")
    discard(made, often, twice, first)
    return out


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", one_in: int = 6, least: int = 16, most: int = 1024, least_words: int = 15) -> DataFrame:
    """Spans of ``docs`` that repeat what a document with a smaller id, or the same document further ahead, holds: (id, start, length, n_words, first_doc).

    start and length are in code points of the whole text; first_doc is the smallest document that holds the span's first chunk. A span is a
    run of repeated chunks with at least ``least_words`` words; a passage of more than 50 words that occurs twice is
    found unless both its ends fall far from a cut, since about ``one_in`` words at each end belong to chunks with other words. Words are parted by white space;
    beyond 64 bytes without any, every 4 code points count as one. Null or empty texts have no spans, rows with a null id are left out. Rows that
    share an id but not the text are documents of their own; equal rows are one. Other columns are ignored.
    """
    found = _spans(_marked(docs, id_col, text_col), one_in, least, most, least_words)
    return found.select(F.col("doc").alias(id_col), "start", "length", "n_words", "first_doc")


def without_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", one_in: int = 6, least: int = 16, most: int = 1024, least_words: int = 15, keep_emptied: bool = True) -> DataFrame:
    """``docs`` with ``text_col`` less its repeated spans (see ``repeated_spans``). Each row loses the spans of its own text. Rows without spans are as they were, null texts too.
    A row all of whose words repeat stays with what is left, or goes where ``keep_emptied`` is false."""
    found = _spans(_marked(docs, id_col, text_col), one_in, least, most, least_words)
    gone = found.groupBy(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("__spans"))
    joined = docs.join(gone, (docs[id_col].cast("long") == gone["__doc"]) & (F.xxhash64(docs[text_col]) == gone["__mark"]), "left").select(*(docs[c] for c in docs.columns), gone["__spans"])
    names = docs.columns
    at = names.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = [], []
            for text, spans in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                text, spans = text.as_py(), spans.as_py()
                if text and spans:
                    kept, last = [], 0
                    for span in spans:
                        kept.append(text[last : span["start"]])
                        last = span["start"] + span["length"]
                    text = "".join([*kept, text[last:]])
                texts.append(text)
                stay.append(keep_emptied or not spans or bool(text.strip(SPACES)))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stay, pa.bool_()))

    return joined.mapInArrow(rows, T.StructType(docs.schema.fields))
