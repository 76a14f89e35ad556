"""Incremental, reversible line dedup: exact reference counts behind sharded cuckoo filters.

State is a folder of Parquet tables that the cluster shares; each operation adds a numbered folder to it and ends with a marker, so
a store can be opened again, and an operation that did not end counts for nothing. ``postings`` says which document holds which
line keys, ``refs`` how many documents hold a key and the smallest of them, ``filters`` has a cuckoo filter for each shard of the keys.
All three lie in folders by area, a group of shards, so an operation reads the folders of the areas that its keys fall into and no others.
An insertion asks the filters first: keys that they have not seen are new, only the others are looked up in ``refs``; counts
are appended, and new keys are added to the filters of their shards. A deletion finds the lines of its documents by one scan of the postings, counts its keys anew in the shards that it touches, and discards from their filters
the keys that nobody holds any more, so that the lines of the rest come back. After some operations all tables are written anew as one.
Hot keys are counted before they are shuffled, and their postings are dealt over several files; filters never leave their shard.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_AZ, SPACES, children, discard, read_text, remove, shared_dir, write_text, written

_SPACES = SPACES.encode()
_SLOTS = 4
_KEY = "key binary"


def line_keys(text: str, least: int) -> list[bytes | None]:
    """Digest of each line's key, null for keys under ``least`` code points. A key is the line without white space at its ends, A to Z lower-cased."""
    out = []
    for line in text.encode().translate(LOWER_AZ).split(b"\n"):
        line = line.strip(_SPACES)
        size = len(line)
        if size >= least and (size >= 4 * least or line.isascii() or len(line.decode()) >= least):
            out.append(xxhash.xxh3_128_digest(line))
        else:
            out.append(None)
    return out


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a worker holds few texts at a time."""
    for batch in batches:
        for k in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(k, rows)


def holdings(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """One row (doc_id, key) for each distinct key of each document of ``docs``; rows that share an id are one document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, keys = [], []
            for name, text in zip(batch.column(0), batch.column(1)):
                found = {k for k in line_keys(text.as_py() or "", least) if k is not None}
                ids += [name.as_py()] * len(found)
                keys += found
                if len(ids) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])
                    ids, keys = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_col)
    out = named.mapInArrow(rows, f"doc_id long, {_KEY}")
    several = named.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return out.distinct() if several else out


class CuckooFilter:
    """Approximate set of 128-bit keys that supports deletion: 16-bit fingerprints in buckets of four, two buckets a key.

    A key that was inserted is always found; one that was not is found with a probability of about 1/8,000.
    ``of`` doubles the table when there is no place for all keys.
    """

    def __init__(self, capacity: int, table: bytes | None = None) -> None:
        self.buckets = 1 << max(4, (int(capacity / (0.85 * _SLOTS))).bit_length())
        if table is not None:
            self.slots = np.frombuffer(table, np.uint16).copy().reshape(-1, _SLOTS)
            self.buckets = len(self.slots)
        else:
            self.slots = np.zeros((self.buckets, _SLOTS), np.uint16)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        number = int.from_bytes(key[:8], "little")
        mark = (number >> 48) % 65_535 + 1
        first = number & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _all_places(self, keys: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_places`` of many keys; those in Arrow memory become no Python objects."""
        if isinstance(keys, list):
            number = np.frombuffer(b"".join(k[:8] for k in keys), "<u8")
        else:
            fixed = keys.cast(pa.binary(16))
            number = np.frombuffer(fixed.buffers()[1], "<u8").reshape(-1, 2)[fixed.offset : fixed.offset + len(fixed), 0] if len(fixed) else np.zeros(0, np.uint64)
        mark = (number >> np.uint64(48)) % np.uint64(65_535) + np.uint64(1)
        first = number & np.uint64(self.buckets - 1)
        second = (first ^ (mark * np.uint64(0x5BD1E995))) & np.uint64(self.buckets - 1)
        return mark.astype(np.uint16), first.astype(np.int64), second.astype(np.int64)

    def add(self, key: bytes) -> bool:
        return self.add_all([key])

    def add_all(self, keys: list[bytes] | pa.Array) -> bool:
        """Add ``keys``; false, and only some of them added, if there is no place for all."""
        marks, first, second = self._all_places(keys)
        left = np.arange(len(marks))
        for bucket in (first, second):
            left = left[~self._fill(bucket[left], marks[left])]
        return all(self._push(int(first[k]), int(marks[k])) for k in left)

    def _fill(self, buckets: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; which of them found one."""
        order = np.argsort(buckets, kind="stable")
        sorted_buckets = buckets[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_buckets, sorted_buckets)
        free = self.slots[sorted_buckets] == 0
        own = free & (free.cumsum(axis=1) == rank[:, None] + 1)
        fits = own.any(axis=1)
        self.slots[sorted_buckets[fits], own.argmax(axis=1)[fits]] = marks[order][fits]
        out = np.empty(len(order), bool)
        out[order] = fits
        return out

    def _push(self, bucket: int, mark: int) -> bool:
        """Put a mark into a full bucket, and the one that was there into its other bucket, until one finds a free slot."""
        for kick in range(500):
            slot = (kick + bucket) % _SLOTS
            mark, self.slots[bucket, slot] = int(self.slots[bucket, slot]), mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = mark
                return True
        return False

    def discard(self, key: bytes) -> None:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(_SLOTS):
                if self.slots[bucket, slot] == mark:
                    self.slots[bucket, slot] = 0
                    return

    def __contains__(self, key: bytes) -> bool:
        mark, first, second = self._places(key)
        return bool((self.slots[first] == mark).any() or (self.slots[second] == mark).any())

    def have(self, keys: list[bytes] | pa.Array) -> np.ndarray:
        """For each key whether it may be in the set."""
        mark, first, second = self._all_places(keys)
        return ((self.slots[first] == mark[:, None]) | (self.slots[second] == mark[:, None])).any(axis=1)

    @classmethod
    def of(cls, keys: list[bytes] | pa.Array, room: int = 1) -> CuckooFilter:
        """A filter of ``keys`` with room for ``room`` times as many."""
        capacity = room * len(keys)
        while True:
            out = cls(capacity)
            if out.add_all(keys):
                return out
            capacity = 2 * max(capacity, 8)


def shard_of(shards: int):
    """Number of a key's shard; the filters use other bits of the key."""
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


#: Columns of the tables of an operation; ``seq`` is its number. Those with an area are in folders by it.
_TABLES = {
    "postings": "doc_id long, key binary, seq int, area int",
    "refs": "shard int, key binary, n_docs long, owner long, maybe boolean, seq int, area int",
    "filters": "shard int, slots binary, n_keys long, seq int, area int",
    "deleted": "doc_id long, seq int",
    "resets": "shard int, seq int",
}


_FILTER = pa.schema([("shard", pa.int32()), ("slots", pa.binary()), ("n_keys", pa.int64()), ("seq", pa.int32())])


def _keys(table: pa.Table) -> pa.Array:
    return pa.concat_arrays(table["key"].chunks) if table.num_rows else pa.array([], pa.binary())


def _changed(seq: int):
    """The filter of a shard after its ``changes`` (key, adds); null slots where it has no room for them."""

    def change(changes: pa.Table, stored: pa.Table) -> pa.Table:
        if not changes.num_rows:
            return _FILTER.empty_table()
        new, old = _keys(changes.filter(changes["adds"])), _keys(changes.filter(pc.invert(changes["adds"])))
        number = (stored["n_keys"][0].as_py() if stored.num_rows else 0) + len(new) - len(old)
        if stored.num_rows:
            held = CuckooFilter(1, stored["slots"][0].as_py())
            for key in old:
                held.discard(key.as_py())
            room = number <= 0.9 * held.slots.size and held.add_all(new)
            slots = held.slots if room else None
        else:
            slots = CuckooFilter.of(new).slots
        return pa.Table.from_pylist([{"shard": changes["shard"][0].as_py(), "slots": None if slots is None else slots.tobytes(), "n_keys": number, "seq": seq}], _FILTER)

    return change


class LineStore:
    """Reference counts and filters of the lines of all documents inserted so far, in the folder ``path``: what it holds is opened.

    There are at least as many shards as shuffle partitions; ``keys_per_shard`` bounds a shard's filter (about 2.4 bytes
    a key), and so the memory of the task that holds it: keys are counted first, and shards double before they are full.
    ``areas``, a power of two, is the number of folders of a table (at most that of the first shards): many let a small operation read little, one
    suits a store whose every operation touches all. After ``compact_after`` operations the tables are written anew as one. Null document ids hold no keys. One writer at a time.
    """

    def __init__(self, spark: SparkSession, keys_per_shard: int = 250_000, path: str | None = None, areas: int = 64, compact_after: int = 32) -> None:
        if areas < 1 or areas & (areas - 1):
            raise ValueError("the number of areas must be a power of two")
        self.spark, self.keys_per_shard, self.compact_after = spark, keys_per_shard, compact_after
        self.path = path or f"{shared_dir(spark)}/millrace/lines-{uuid.uuid4().hex}"
        self.shards = 1
        while self.shards < int(spark.conf.get("spark.sql.shuffle.partitions")):
            self.shards *= 2
        self.areas = min(areas, self.shards)
        #: Number of different keys that the filters hold.
        self.n_keys = 0
        #: Tables of each operation that has ended, and of the one that goes on.
        self.done: dict[int, list[str]] = {}
        for name in sorted(children(spark, self.path), key=int):
            if "done" not in children(spark, f"{self.path}/{name}"):
                remove(spark, f"{self.path}/{name}")
                continue
            said = json.loads(read_text(spark, f"{self.path}/{name}/done"))
            if said["whole"]:
                self._forget(list(self.done))
            self.done[int(name)] = said["tables"]
            self.areas, self.shards, self.n_keys = said["areas"], said["shards"], said["n_keys"]

    def _forget(self, operations: list[int]) -> None:
        for seq in operations:
            self.done.pop(seq)
            remove(self.spark, f"{self.path}/{seq}")

    def _read(self, table: str, areas: list[int] | None = None) -> DataFrame | None:
        """A table of all operations, or its folders of ``areas``."""
        parts = None
        paths = [f"{self.path}/{seq}/{table}" for seq, tables in self.done.items() if table in tables]
        for path in paths:
            # One operation after the other, since each folder is a table by areas of its own.
            part = self.spark.read.schema(_TABLES[table]).parquet(path)
            part = part if areas is None or "area" not in part.columns else part.where(F.col("area").isin(areas))
            parts = part if parts is None else parts.unionByName(part)
        return parts

    def _write(self, seq: int, table: str, df: DataFrame) -> None:
        """Write a table of an operation, those with areas in even shares of an area: it makes few files, and a hot key's rows several."""
        names = [c.split()[0] for c in _TABLES[table].split(", ")]
        df = df.withColumn("seq", F.lit(seq))
        if "area" in names:
            # Both numbers are powers of two, so all keys of a shard are of one area.
            df = df.withColumn("area", F.pmod("shard", F.lit(self.areas)).cast("int") if "shard" in df.columns else shard_of(self.areas))
            df = df.hint("rebalance", "area") if self.areas > 1 else df
        writer = df.select(names).write
        (writer.partitionBy("area") if "area" in names else writer).parquet(f"{self.path}/{seq}/{table}")
        self.done.setdefault(seq, []).append(table)

    @contextmanager
    def _operation(self, whole: bool = False) -> Iterator[int]:
        """The number of a new operation, which is ended or else undone. ``whole``: it takes the place of all before it."""
        before = list(self.done)
        seq = max(before, default=-1) + 1
        shards, n_keys = self.shards, self.n_keys
        try:
            yield seq
            write_text(self.spark, f"{self.path}/{seq}/done", json.dumps({"tables": self.done[seq], "areas": self.areas, "shards": self.shards, "n_keys": self.n_keys, "whole": whole}))
        except BaseException:
            self.done.pop(seq, None)
            self.shards, self.n_keys = shards, n_keys
            remove(self.spark, f"{self.path}/{seq}")
            raise
        if whole:
            self._forget(before)

    def postings(self, areas: list[int] | None = None) -> DataFrame | None:
        """(doc_id, key) of all documents that are in the store, of keys in ``areas`` if these are given."""
        found, deleted = self._read("postings", areas), self._read("deleted")
        if found is None or deleted is None:
            return found and found.select("doc_id", "key")
        last = deleted.groupBy("doc_id").agg(F.max("seq").alias("gone"))
        return found.join(last, "doc_id", "left").where("gone is null or seq > gone").select("doc_id", "key")

    def refs(self, areas: list[int] | None = None) -> DataFrame:
        """(shard, key, n_docs, owner) of all keys that a document holds, or of those in ``areas``."""
        found, resets = self._read("refs", areas), self._read("resets")
        if resets is not None:
            last = resets.groupBy("shard").agg(F.max("seq").alias("reset"))
            found = found.join(last, "shard", "left").where("reset is null or seq >= reset")
        return found.groupBy("shard", "key").agg(F.sum("n_docs").alias("n_docs"), F.min("owner").alias("owner"))

    def filters(self, areas: list[int] | None = None) -> DataFrame | None:
        """(shard, slots, n_keys): the last filter of each shard, or of those in ``areas``."""
        found = self._read("filters", areas)
        last = F.max_by(F.struct("slots", "n_keys"), "seq").alias("f")
        return found and found.groupBy("shard").agg(last).select("shard", "f.slots", "f.n_keys")

    def _touched(self, keys: DataFrame) -> tuple[list[int], int]:
        """Areas of ``keys`` (key), whose number is a setting, and the number of rows."""
        return tuple(keys.agg(F.array_sort(F.collect_set(shard_of(self.areas))), F.count("*")).first())

    def seen(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key, n_docs, owner: one row a key) with ``shard`` and ``maybe``: false only if no document of the store holds the key. Filters of other areas are not read."""
        return self._probed(keys, self._touched(keys)[0])

    def _probed(self, keys: DataFrame, areas: list[int]) -> DataFrame:
        def probe(new: pa.Table, stored: pa.Table) -> pa.Table:
            known = new.num_rows and stored.num_rows
            maybe = CuckooFilter(1, stored["slots"][0].as_py()).have(_keys(new)) if known else np.zeros(new.num_rows, bool)
            return new.append_column("maybe", pa.array(maybe, pa.bool_()))

        keys = keys.select("key", "n_docs", "owner", shard_of(self.shards).alias("shard"))
        return keys.groupBy("shard").cogroup(self._stored(areas).groupBy("shard")).applyInArrow(probe, f"{_KEY}, n_docs long, owner long, shard int, maybe boolean")

    def _stored(self, areas: list[int]) -> DataFrame:
        found = self.filters(areas)
        return self.spark.createDataFrame([], "shard int, slots binary, n_keys long") if found is None else found

    def _update(self, seq: int, changes: DataFrame, areas: list[int]) -> None:
        """Bring the filters of the shards of ``changes`` (shard, key, adds) up to date; those without room are built anew from the exact keys."""
        after = written(changes.groupBy("shard").cogroup(self._stored(areas).groupBy("shard")).applyInArrow(_changed(seq), "shard int, slots binary, n_keys long, seq int"), "line-filters")
        full = after.where("slots is null").select("shard")
        new = after.where("slots is not null")
        if full.limit(1).count():
            new = new.unionByName(self._built(self.refs(areas).join(full, "shard", "left_semi")).withColumn("seq", F.lit(seq)))
        self._write(seq, "filters", new)
        discard(after)

    def _built(self, refs: DataFrame) -> DataFrame:
        def build(keys: pa.Table) -> pa.Table:
            found = CuckooFilter.of(_keys(keys), room=2)
            return pa.Table.from_pylist([{"shard": keys["shard"][0].as_py(), "slots": found.slots.tobytes(), "n_keys": keys.num_rows}], schema)

        schema = pa.schema([_FILTER.field(k) for k in range(3)])
        return refs.select("shard", "key").groupBy("shard").applyInArrow(build, "shard int, slots binary, n_keys long")

    def _of(self, seq: int, table: str) -> DataFrame:
        """A table that the operation that goes on has written."""
        return self.spark.read.schema(_TABLES[table]).parquet(f"{self.path}/{seq}/{table}")

    def _rebuild(self, seq: int, refs: DataFrame) -> None:
        """Write ``refs`` (key, n_docs, owner: one row a key of the whole store) and all filters anew."""
        self._write(seq, "refs", refs.withColumns({"shard": shard_of(self.shards), "maybe": F.lit(False)}))
        whole = self._of(seq, "refs")
        self.n_keys = whole.count()
        # Shards without keys get empty filters, lest their old ones be asked.
        every = self.spark.range(self.shards).select(F.col("id").cast("int").alias("shard"))
        empty = [F.lit(CuckooFilter.of([]).slots.tobytes()).alias("slots"), F.lit(0).cast("long").alias("n_keys")]
        none = every.join(whole.select("shard").distinct(), "shard", "left_anti").select("shard", *empty)
        self._write(seq, "resets", every)
        self._write(seq, "filters", self._built(whole).unionByName(none))

    def _grow(self, seq: int, counts: DataFrame, number: int) -> None:
        """Write ``counts`` and all counts before them by more shards, enough for three times ``number`` keys, and build all filters anew."""
        stored = counts if self._read("refs") is None else self.refs().select(counts.columns).unionByName(counts)
        while 3 * number > self.shards * self.keys_per_shard:
            self.shards *= 2
        self._rebuild(seq, stored.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("owner").alias("owner")))

    def insert(self, held: DataFrame, fresh: bool = False) -> None:
        """Add the documents of ``held`` (doc_id, key). ``fresh``: none of them is in the store yet; else a document gets the union of its keys."""
        first, asked = not self.done, None
        if not first and not fresh:
            asked = written(held, "line-held")
            held = asked.join(self.postings(self._touched(asked)[0]), ["doc_id", "key"], "left_anti")
        with self._operation() as seq:
            self._write(seq, "postings", held)
            counts = written(self._of(seq, "postings").groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("owner")), "line-counts")
            self._count(seq, counts, first)
        discard(counts, *([asked] if asked else []))
        self._compact_if_many()

    def _count(self, seq: int, counts: DataFrame, first: bool) -> None:
        """Add ``counts`` (key, n_docs, owner: one row a key) to the counts and filters."""
        areas, number = self._touched(counts)
        # The number of keys is known before any task holds those of a shard.
        if self.n_keys + number > self.shards * self.keys_per_shard:
            self._grow(seq, counts, self.n_keys + number)
            return
        if first:
            self._write(seq, "refs", counts.withColumns({"shard": shard_of(self.shards), "maybe": F.lit(False)}))
            unknown = self._of(seq, "refs")
        else:
            before = self.refs(areas).select("key")
            self._write(seq, "refs", self._probed(counts, areas))
            probed = self._of(seq, "refs")
            # Keys that the filters have not seen need no look at the counts.
            known = before.join(probed.where("maybe").select("key"), "key", "left_semi")
            unknown = probed.where("not maybe").unionByName(probed.where("maybe").join(known, "key", "left_anti").select(probed.columns))
        changes = written(unknown.select("shard", "key", F.lit(True).alias("adds")), "line-changes")
        self.n_keys += changes.count()
        self._update(seq, changes, areas)
        discard(changes)

    def delete(self, doc_ids: DataFrame) -> None:
        """Take out the documents of ``doc_ids`` (doc_id); ids that the store does not have change nothing."""
        postings = self.postings()
        if postings is None:
            return
        ids = doc_ids.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
        gone = written(postings.join(ids, "doc_id", "left_semi"), "line-gone")
        touched = written(gone.select("key").distinct().withColumn("shard", shard_of(self.shards)), "line-touched")
        areas, number = self._touched(touched)
        if not number:
            discard(gone, touched)
            return
        shards = touched.select("shard").distinct()
        # The counts of touched shards are written anew, those of touched keys from the documents that stay.
        rest = self.refs(areas).join(shards, "shard", "left_semi").join(touched.select("key"), "key", "left_anti").select("shard", "key", "n_docs", "owner")
        stay = self.postings(areas).join(touched, "key").join(gone.select("doc_id").distinct(), "doc_id", "left_anti")
        still = written(stay.groupBy("shard", "key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("owner")), "line-still")
        with self._operation() as seq:
            self._write(seq, "deleted", gone.select("doc_id").distinct())
            self._write(seq, "refs", rest.unionByName(still).withColumn("maybe", F.lit(True)))
            self._write(seq, "resets", shards)
            self._update(seq, touched.join(still.select("key"), "key", "left_anti").select("shard", "key", F.lit(False).alias("adds")), areas)
            self.n_keys -= number - still.count()
        discard(gone, touched, still)
        self._compact_if_many()

    def compact(self) -> None:
        """Write what the store holds as one operation that takes the place of all before it; deleted documents leave the disk with them."""
        if not self.done:
            return
        held, refs = self.postings(), self.refs().select("key", "n_docs", "owner")
        with self._operation(whole=True) as seq:
            self._write(seq, "postings", held)
            self._rebuild(seq, refs)

    def _compact_if_many(self) -> None:
        if len(self.done) > self.compact_after:
            self.compact()

    def shared(self, least_docs: int = 2) -> DataFrame:
        """Keys (key, owner) that at least ``least_docs`` documents hold."""
        return self.refs().where(F.col("n_docs") >= least_docs).select("key", "owner")

    def drops(self) -> DataFrame:
        """Per document the keys that it loses: (doc_id, keys), as a table of its own that outlives the store."""
        # Written first, so that a line that very many documents hold can be split in the join.
        shared = written(self.shared(), "line-shared")
        out = written(self.postings().join(shared, "key").where("doc_id <> owner").groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "line-drops")
        discard(shared)
        return out

    def remove(self) -> None:
        """Delete the folder."""
        remove(self.spark, self.path)
        self.done, self.n_keys = {}, 0


def kept_lines(text: str, drop: list[bytes], least: int) -> tuple[str, int, int]:
    """Text without the lines whose keys are in ``drop``, number of lines before, number dropped."""
    lines = text.split("\n")
    if not drop:
        return text, len(lines), 0
    gone = set(drop)
    kept = [line for line, key in zip(lines, line_keys(text, least)) if key is None or key not in gone]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10, batches: int = 2, store: LineStore | None = None, keep_emptied: bool = True) -> DataFrame:
    """``docs`` with ``text_col`` replaced, ``n_lines`` before dropping and ``n_dropped``; a column of ``docs`` with one of these two names is replaced.

    Lines are parted by line feeds; a null or empty text is one empty line and stays as it is. A line whose key
    has at least ``least`` code points and is held by another document with a smaller id is dropped; a key's
    smallest document keeps all lines with it. Rows with a null id keep all lines and count for no key. Rows
    that share an id are one document. The documents are inserted into ``store`` (an empty one by default) in ``batches``
    by a hash of their ids, so that later ones ask the filters of those before them. ``keep_emptied``: whether rows that lose all their words stay, with what is left of their text.
    """
    fresh, store = store is None, store or LineStore(docs.sparkSession, areas=1)
    for k in range(batches):
        store.insert(holdings(docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(batches)) == k), id_col, text_col, least), fresh)
    found = store.drops()
    if fresh:
        store.remove()
    drops = found.select(F.col("doc_id").alias("__doc"), F.col("keys").alias("__keys"))
    base = docs.drop(*(c for c in ("n_lines", "n_dropped") if c in docs.columns and c not in (id_col, text_col)))
    joined = base.join(drops, base[id_col].cast("long") == drops["__doc"], "left").select(*(base[c] for c in base.columns), drops["__keys"])
    names = base.columns
    at = names.index(text_col)
    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts, before, dropped = [], [], []
            for text, keys in zip(batch.column(at), batch.column(len(names))):
                text = text.as_py()
                kept, n, gone = kept_lines(text or "", keys.as_py() or [], least)
                texts.append(None if text is None else kept)
                before.append(n)
                dropped.append(gone)
            columns = [*batch.columns[: len(names)], pa.array(before, pa.int64()), pa.array(dropped, pa.int64())]
            columns[at] = pa.array(texts, pa.string())
            stay = [keep_emptied or not gone or bool((text or "").strip(SPACES)) for text, gone in zip(texts, dropped)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"]).filter(pa.array(stay, pa.bool_()))

    return joined.mapInArrow(rows, schema)


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """``dedup_lines`` as counts and digests: id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, least=least)
    return out.select(id_col, "n_lines", "n_dropped", F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256).alias("kept_sha256"))
