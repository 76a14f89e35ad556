"""Near-duplicate groups by SetSketch registers, confirmed on full shingle sets.

A document's sketch has registers of exponentially spaced, truncated minima: K = floor(1 - log_b x), where x is the least
of exponential hash values of its shingles; registers of two sets merge by maximum. Bands of registers send documents
to buckets. In every bucket all members are first compared with one centre, the member that stands in the
fullest buckets; a pair's Jaccard index is estimated from both sketches and both set sizes by maximum likelihood,
and what is not clearly below the threshold is confirmed on the full sets. Members that are then still in
different components are compared block by block, sketches first and full sets of the promising ones then, so that no link within a bucket between two components is lost, and no pair is made a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, Memo, discard, written
from .components import components

#: Base of the registers, number of registers, registers in a band.
BASE, REGISTERS, BAND = 1.001, 160, 5
_LAST = 2**16 - 2
_RATE = 20.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Members of a block that are compared with those of another in one task.
_BLOCK = 512


def _seeds(n: int) -> list[tuple[np.uint64, np.uint64]]:
    """For each register an odd multiplier and a mask."""
    return [(np.uint64(xxhash.xxh3_64_intdigest(b"multiply %d" % k) | 1), np.uint64(xxhash.xxh3_64_intdigest(b"mask %d" % k))) for k in range(n)]


def tokens(text: str | None) -> list[bytes]:
    """Words of the text, A to Z lower-cased, in UTF-8."""
    return (text or "").encode().translate(LOWER_AZ).split()


class Shingles:
    """Sets of hashed shingles of ``width`` words; a shorter text has its whole sequence as one, an empty text has none."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.words = Memo(xxhash.xxh3_64_intdigest, 400_000)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct 64-bit hashes."""
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.width:
            return np.asarray([xxhash.xxh3_64_intdigest(b"\0".join(words), len(words))], np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.width + 1
        out = h[:n].copy()
        for k in range(1, self.width):
            out ^= out >> np.uint64(29)
            out *= _MIX
            out += h[k : k + n]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def registers(sets: list[np.ndarray], n: int = REGISTERS) -> np.ndarray:
    """Registers, a row for each set; empty sets have zeros."""
    sizes = np.asarray([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sets), n), np.uint16)
    if not len(full):
        return out
    values = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    for k, (multiplier, mask) in enumerate(_seeds(n)):
        least = np.minimum.reduceat((values ^ mask) * multiplier, starts)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / _RATE
        out[full, k] = np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, _LAST + 1)
    return out


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard index of pairs of sketches (rows of ``a`` and ``b``) with known set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    log_b = math.log(BASE)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / log_b
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    likelihood = lambda j: more * np.log(p(u - v * j)) + less * np.log(p(v - u * j)) + same * np.log(np.clip(1 - p(u - v * j) - p(v - u * j), 1e-12, 1))
    for _ in range(40):
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, mark, digest of the word sequence, n_shingles, registers) of ``docs`` (doc_id long, mark, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)

        def flush(ids: list, marks: list, digests: list, sets: list) -> pa.RecordBatch:
            found = registers(sets)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.astype(">u2").tobytes() for r in found], pa.binary())], ["doc_id", "mark", "digest", "n_shingles", "registers"])

        for batch in batches:
            ids, marks, digests, sets, size = [], [], [], [], 0
            for name, mark, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                words = tokens(text.as_py())
                ids.append(name.as_py())
                marks.append(mark.as_py())
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sets.append(shingles.of(words))
                size += len(sets[-1])
                if size > 200_000:
                    yield flush(ids, marks, digests, sets)
                    ids, marks, digests, sets, size = [], [], [], [], 0
            yield flush(ids, marks, digests, sets)

    return docs.mapInArrow(rows, "doc_id long, mark long, digest binary, n_shingles long, registers binary")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles: the sorted hashes as bytes) of ``docs`` (node, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles.of(tokens(t.as_py())).tobytes() for t in part.column(1)], pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(rows, "node long, shingles binary")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` (with sizes n_, registers r_ and shingles s_ of both) at or above the threshold: likelihood first, then full sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                column = dict(zip(batch.schema.names, part.columns))
                n_a, n_b = (np.asarray(column[c], np.float64) for c in ("n_a", "n_b"))
                r_a, r_b = (np.frombuffer(b"".join(column[c].to_pylist()), ">u2").reshape(part.num_rows, -1) for c in ("r_a", "r_b"))
                likely = likely_jaccard(r_a, r_b, n_a, n_b)
                # Six standard deviations of a share of registers, so that the estimate turns down nothing that could pass.
                slack = 6 * math.sqrt(0.25 / r_a.shape[1])
                for i in np.flatnonzero(likely >= percent / 100 - slack):
                    x, y = (np.frombuffer(column[c][int(i)].as_py(), np.uint64) for c in ("s_a", "s_b"))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(k + int(i))
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.mapInArrow(rows, "a long, b long")


def _links(mine: list[tuple], other: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Links between members (node, component, shingles) of two sides that are in different components, one for each two components."""
    sets = [np.frombuffer(x[2], np.uint64) for x in other]
    sizes = np.asarray([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    parts = np.asarray([x[1] for x in other])
    done: set[tuple[int, int]] = set()
    for node, part, shingles in mine:
        own = np.frombuffer(shingles, np.uint64)
        first = np.searchsorted(values, own)
        count = np.searchsorted(values, own, side="right") - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for k in np.flatnonzero((100 * both >= percent * (len(own) + sizes - both)) & (parts != part)).tolist():
            pair = (min(part, other[k][1]), max(part, other[k][1]))
            if pair not in done:
                done.add(pair)
                yield node, other[k][0]


def _promising(mine: tuple, other: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which members (components, sizes, registers) of two sides have a partner of another component whose sketch is not clearly below the threshold."""
    (part_a, n_a, r_a), (part_b, n_b, r_b) = mine, other
    registers, share = r_a.shape[1], percent / 100
    # The number of equal registers is binomial, with the Jaccard index or more as its probability; six standard deviations leave nothing out.
    least = registers * share - 6 * math.sqrt(registers * share * (1 - share))
    hit_a, hit_b = np.zeros(len(part_a), bool), np.zeros(len(part_b), bool)
    for k in range(len(part_a)):
        close = np.flatnonzero((part_b != part_a[k]) & (100 * np.minimum(n_b, n_a[k]) >= percent * np.maximum(n_b, n_a[k])))
        close = close[(r_b[close] == r_a[k]).sum(axis=1) >= least]
        hit_b[close] = True
        hit_a[k] = len(close) > 0
    return hit_a, hit_b


def _blocks(members: DataFrame, payload: list[str], found, schema: str) -> DataFrame:
    """``found`` (rows of side 0, rows of side 1; lists of payload tuples) of each block of ``members`` (key, i, j, side, payload); blocks with one side give nothing."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sides = None, ([], [])

        def closed() -> pa.RecordBatch:
            out = list(found(block, *sides)) if sides[0] and sides[1] else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[c.split()[1]]) for k, c in enumerate(schema.split(", "))], names)

        for batch in batches:
            for key, i, j, side, *rest in zip(*(column.to_pylist() for column in batch.columns)):
                if (key, i, j) != block:
                    yield closed()
                    block, sides = (key, i, j), ([], [])
                sides[side].append(tuple(rest))
        yield closed()

    return members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "side", *payload).mapInArrow(rows, schema)


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within blocks of ``members`` (key, i, j, side, node, component): those on side 0 are compared with those on side 1.

    Sketches go to the blocks first; full sets (``sets``: node, n_shingles, registers, shingles) follow only for members with a promising partner there.
    """

    def promising(block: tuple, *sides: list[tuple]) -> Iterator[tuple]:
        of = lambda side: (np.asarray([x[1] for x in side]), np.asarray([x[2] for x in side]), np.frombuffer(b"".join(x[3] for x in side), ">u2").reshape(len(side), -1))
        for number, (side, hit) in enumerate(zip(sides, _promising(of(sides[0]), of(sides[1]), percent))):
            for k in np.flatnonzero(hit):
                yield (*block, number, side[k][0], side[k][1])

    sketched = members.join(sets.select("node", "n_shingles", "registers"), "node")
    near = written(_blocks(sketched, ["node", "component", "n_shingles", "registers"], promising, "key long, i int, j int, side int, node long, component long"), "promising")
    full = near.join(sets.select("node", "shingles"), "node")
    out = written(_blocks(full, ["node", "component", "shingles"], lambda block, mine, other: _links(mine, other, percent), "a long, b long"), "block-links")
    discard(near)
    return out


def _numbered(named: DataFrame, width: int, percent: int) -> DataFrame:
    """``_verdicts`` where ids repeat: each id and text gets a number, in order of the ids, and is a document."""
    full = named.where("doc_id is not null")
    ordered = full.select("doc_id", "mark").distinct().orderBy("doc_id", "mark")
    numbers = written(ordered.withColumn("number", F.monotonically_increasing_id()), "numbers")
    texts = full.join(numbers, ["doc_id", "mark"]).groupBy("number").agg(F.min("text").alias("text")).select(F.col("number").alias("doc_id"), F.lit(0).cast("long").alias("mark"), "text")
    found = _verdicts(texts, width, percent).select(F.col("doc_id").alias("number"), "n_shingles", F.col("component_id").alias("first"))
    firsts = numbers.select(F.col("number").alias("first"), F.col("doc_id").alias("component_id"))
    out = written(found.join(firsts, "first").join(numbers, "number").select("doc_id", "mark", "n_shingles", "component_id"), "verdicts")
    discard(numbers)
    without = sketches(named.where("doc_id is null"), width).select("doc_id", "mark", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return full.select("doc_id", "mark").join(out, ["doc_id", "mark"]).unionByName(without)


def _verdicts(named: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) per row of ``named`` (doc_id, mark, text)."""
    all_rows = written(sketches(named, width), "sketches")
    rows = all_rows.where("doc_id is not null")
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        discard(all_rows)
        return _numbered(named, width, percent)
    # Documents with the same word sequence are one node, the smallest of them. What is joined is written first, so that a join can split a hot digest.
    full = rows.where("n_shingles > 0")
    firsts = written(full.groupBy("digest").agg(F.min("doc_id").alias("node")), "digests")
    placed = written(full.select("doc_id", "digest", "n_shingles", "registers").join(firsts, "digest").select("doc_id", "node", "n_shingles", F.when(F.col("doc_id") == F.col("node"), F.col("registers")).alias("registers")), "nodes")
    unique = placed.where("doc_id = node").select("node", "n_shingles", "registers")
    wide = 2 * BAND
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("registers", k * wide + 1, wide)) for k in range(REGISTERS // BAND)))
    bands = unique.select("node", F.explode(keys).alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(bands.join(sizes, "key"), "buckets")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    centres = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("m"))).alias("c")).select("key", (-F.col("c.m")).alias("centre"))
    stars = members.join(centres, "key").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    texts = named.join(weight.select("node"), F.col("doc_id") == F.col("node"), "inner").select("node", "text")
    sets = full_sets(texts, width)
    sketched = unique.join(weight.select("node"), "node", "left_semi")
    sets = written(sets.join(sketched, "node"), "sets")
    side = lambda s: sets.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"), F.col("shingles").alias(f"s_{s}"))
    sized = lambda df: df.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    links = written(_confirmed(sized(stars.join(side("a"), "a").join(side("b"), "b")), percent), "star-links")
    found = components(links)
    # What a bucket still holds of more than one component.
    part = members.select("node", "key").join(found, "node", "left").select("node", "key", F.coalesce("component", "node").alias("component"))
    parts = written(part.groupBy("key", "component").agg(F.count("*").alias("n")), "parts")
    largest = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("l"), F.count("*").alias("n_parts"), F.sum("n").alias("size")).where("n_parts > 1")
    loose = part.join(largest.select("key", F.col("l.component").alias("largest"), (F.col("size") - F.col("l.n")).alias("n_loose"), "size"), "key")
    blocks = lambda n: F.ceil(F.col(n) / _BLOCK).cast("int")
    spot = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    mine = loose.where("component <> largest").withColumn("i", spot("n_loose", 1)).withColumn("j", every("size")).withColumn("side", F.lit(0))
    other = loose.withColumn("j", spot("size", 2)).withColumn("i", every("n_loose")).withColumn("side", F.lit(1))
    block = mine.unionByName(other).select("key", "i", "j", "side", "node", "component")
    more = _across(block, sets, percent)
    again = components(links.unionByName(more))
    united = placed.select("doc_id", "node").join(again, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    out = written(all_rows.select("doc_id", "mark", "n_shingles").join(united, "doc_id", "left").select("doc_id", "mark", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "verdicts")
    discard(all_rows, firsts, placed, members, sets, parts, links, more)
    return out


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, text): the mark tells the texts of an id apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id and ``kept``.

    Sets are of distinct shingles of ``width`` words (A to Z lower-cased, parted by ASCII white space); documents whose
    intersection is at least ``percent`` of the union are linked. component_id is the smallest id that links reach, itself
    included; a document without words links with nothing. ``kept``: the id is the component's. Rows that share an id but
    not the text are documents of their own, each linked by its own text, and equal rows are one. A row with a null id links with
    nothing, has a null component and is kept. Other columns are ignored; an empty table gives an empty result. A link at the threshold is missed with a
    probability of 3 in 1,000,000 (no common band); links found are always confirmed on full sets of 64-bit shingle hashes.
    """
    out = _verdicts(_named(docs, id_col, text_col), width, percent)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` less the rows that ``near_duplicates`` does not keep; each row goes or stays by its own text."""
    gone = _verdicts(_named(docs, id_col, text_col), width, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark")).distinct()
    return docs.join(gone, (docs[id_col].cast("long") == gone["__doc"]) & (F.xxhash64(docs[text_col]) == gone["__mark"]), "left_anti")
