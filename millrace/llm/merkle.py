"""Merkle manifest of a dataset: a tree of digests for each source, a tree over their roots, and for every row the path that proves it.

Leaves of a source ascend by a key; every ``RUN`` consecutive nodes become the digest of their digests, level by level, until one remains (its subroot); subroots, by source, likewise give the root.
A tree is cut into aligned blocks of ``RUN ** height`` nodes. One task at a time traverses a block: each level keeps the run that the present leaf needs, while a treehash stack
takes one leaf a step and makes the next run, so that besides the block's digests only a few runs a level are held. The roots of blocks are the leaves of the next layer of blocks; their paths
are made last to first and appended to those of the block below, which share them. No task and no driver sees a whole source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Nodes of a run.
RUN = 16
#: Levels of a block: 4,096 leaves.
HEIGHT = 3
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
_PATH = "array<struct<before:string,after:string>>"


def field(column: Column) -> Column:
    """A value for hashing: ``-`` if it is null, else the UTF-8 bytes of its text, counted: ``3:abc``."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*columns).cast("binary"), 256)


def leaf(*columns: Column) -> Column:
    """The leaf of a row: the digest of its values."""
    return digest_of(*map(field, columns))


def folded(path: Column, start: Column) -> Column:
    """The root that ``path`` leads to from the leaf ``start``."""
    return F.aggregate(path, start, lambda node, step: digest_of(step["before"], node, step["after"]))


def siblings(path: Column) -> Column:
    """Digests of all siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def digest(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(leaves: int) -> int:
    """Levels of a tree of its own over so many leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // RUN), levels + 1
    return levels


class Treehash:
    """Nodes of one level, left to right, from leaves that are taken one by one; holds less than a run of open nodes for each level below."""

    def __init__(self, leaves: Iterable[str], level: int) -> None:
        self.leaves, self.open, self.ended = iter(leaves), [[] for _ in range(level)], False

    def step(self) -> str | None:
        """Take one leaf; the node that it completes, if any. Once leaves have run out, the node of those left over."""
        node = next(self.leaves, None)
        if node is None:
            return None if self.ended else self._last()
        for run in self.open:
            run.append(node)
            if len(run) < RUN:
                return None
            node = digest(run)
            run.clear()
        return node

    def _last(self) -> str | None:
        self.ended, node = True, None
        for run in self.open:
            if node is not None:
                run.append(node)
            node = digest(run) if run else None
            run.clear()
        return node

    def all(self) -> Iterator[str]:
        while not self.ended:
            node = self.step()
            if node is not None:
                yield node


def traverse(leaves: Sequence[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in order its siblings at each of ``levels``, as digests before and behind its own node."""
    ahead = [Treehash(leaves, level) for level in range(levels)]
    width = [RUN**level for level in range(levels)]
    now: list[list[str]] = []
    for level, made in enumerate(ahead):  # the first run of each level
        first: list[str] = []
        while len(first) < RUN and not made.ended:
            node = made.step()
            if node is not None:
                first.append(node)
        now.append(first)
    coming: list[list[str]] = [[] for _ in range(levels)]
    path: list[tuple[str, str]] = [("", "")] * levels
    for i in range(len(leaves)):
        for level in range(levels):
            if i % width[level] == 0:
                if i and i % (width[level] * RUN) == 0:
                    while len(coming[level]) < RUN and not ahead[level].ended:  # leaves that have run out close the last run
                        node = ahead[level].step()
                        if node is not None:
                            coming[level].append(node)
                    now[level], coming[level] = coming[level], []
                place = i // width[level] % RUN
                path[level] = ("".join(now[level][:place]), "".join(now[level][place + 1 :]))
            node = ahead[level].step() if len(coming[level]) < RUN else None
            if node is not None:
                coming[level].append(node)
        yield list(path)


def _block_levels(table: pa.Table, height: int) -> int:
    total = table["total"][0].as_py()
    return height if total > RUN**height else levels_of(total)


def _root(height: int):
    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        (root,) = Treehash(table["digest"].to_pylist(), _block_levels(table, height)).all()
        return pa.table({"g": table["g"][:1], "position": table["block"][:1], "digest": pa.array([root]), "total": pa.array([-(-table["total"][0].as_py() // RUN**height)], pa.int64())})

    return of


def _with_paths(height: int, extra: list[str]):
    def of(table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        upper = [(s["before"], s["after"]) for s in above["path"][0].as_py()]
        before: list[str] = []
        after: list[str] = []
        ends = [0]
        for path in traverse(table["digest"].to_pylist(), _block_levels(table, height)):
            for left, right in (*path, *upper):
                before.append(left)
                after.append(right)
            ends.append(len(before))
        steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], fields=list(_STEP))
        columns = {name: table[name] for name in ("g", "position", "digest", *extra)}
        return pa.table(columns | {"path": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps), "subroot": pa.array([above["subroot"][0].as_py()] * len(table), pa.string())})

    return of


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("position") / RUN**height).cast("long"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``place``: the number of a row among those of its ``g`` in this partition, which is sorted by it."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("g").dictionary_encode()
        found = codes.indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        names = [codes.dictionary[int(found[at])].as_py() for at in starts]
        place = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.r_[starts, batch.num_rows]))
        if names[0] == last:
            place[: starts[1] if len(starts) > 1 else None] += seen
        last, seen = names[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])


def placed(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (g, ...) with ``position``, their number within g by ``order``, and ``total``, the rows of g; and the written table below it.

    Rows are sorted by range over all groups, numbered within partitions and raised by the partitions before, so a group may be of any size.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    spread = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("part", F.spark_partition_id())
    table = written(spread.mapInArrow(_numbered, f"{schema}, part int, place long"), "merkle-numbered")
    counts = table.groupBy("part", "g").agg(F.count("*").alias("n"))
    of = Window.partitionBy("g")
    starts = counts.select("part", "g", (F.sum("n").over(of.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(of).alias("total"))
    return table.join(starts, ["part", "g"]).withColumn("position", F.col("start") + F.col("place")).drop("part", "place", "start"), table


def _layers(nodes: DataFrame, height: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Layers of nodes in blocks, and the roots of the blocks of each (g, position, digest, total: blocks of g)."""
    layers, roots = [], []
    while True:
        layers.append(_blocks(nodes, height))
        slim = layers[-1].select("g", "block", "position", "digest", "total")
        roots.append(written(slim.groupBy("g", "block").applyInArrow(_root(height), "g string, position long, digest string, total long"), "merkle-roots"))
        nodes = roots[-1].where("total > 1")
        if nodes.isEmpty():
            return layers, roots


def _tops(roots: list[DataFrame]) -> DataFrame:
    """(g, digest) of the last node of each group."""
    out = None
    for layer in roots:
        done = layer.where("total = 1").select("g", "digest")
        out = done if out is None else out.unionByName(done)
    return out


def _descend(layers: list[DataFrame], roots: list[DataFrame], tops: DataFrame, height: int, extra: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Nodes of the first layer with the paths to what ``tops`` (g, path, subroot) holds for their group, and the written paths of its blocks."""
    nodes = upper = None
    for k in range(len(layers) - 1, -1, -1):
        done = roots[k].where("total = 1").select("g", F.lit(0).cast("long").alias("block")).join(tops, "g").select("g", "block", "path", "subroot")
        above = done if nodes is None else done.unionByName(nodes.select("g", F.col("position").alias("block"), "path", "subroot"))
        old, upper = upper, written(above, "merkle-upper")
        if old is not None:
            discard(old)
        kept = extra if k == 0 else []
        kinds = "".join(f"`{c}` {layers[k].schema[c].dataType.simpleString()}, " for c in kept)
        grouped = layers[k].select("g", "block", "position", "digest", "total", *kept).groupBy("g", "block")
        nodes = grouped.cogroup(upper.groupBy("g", "block")).applyInArrow(_with_paths(height, kept), f"g string, position long, digest string, {kinds}path {_PATH}, subroot string")
    return nodes, upper


def manifest(rows: DataFrame, group: Column, leaf: Column, order: Column, height: int = HEIGHT, **extra: Column) -> DataFrame:
    """Every row as a leaf with its proof: (``extra`` columns, digest: its leaf, position within its group, path, subroot, root).

    ``path`` has the siblings of a leaf from its own level to the root, each level as digests before and behind the node; ``folded`` recomputes the root by it, at any time and without the dataset.
    Groups ascend by ``group``, a null one first and strings by UTF-8 bytes; leaves of a group by ``order``, null first, rows that share it by leaf; rows alike in all are leaves of their own. A group of one leaf has it as
    its subroot, a dataset of one group that as its root; an empty table gives no rows.
    """
    named = {"g": F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string"))), "digest": leaf, "o": order}
    slim = written(rows.select(*(c.alias(n) for n, c in named.items()), *(c.alias(f"x_{n}") for n, c in extra.items())), "merkle-leaves")
    # Rows alike in everything are told apart, so that one partition need not hold all of them.
    leaves, table = placed(slim.withColumn("tie", F.monotonically_increasing_id()), "o", "digest", "tie")
    layers, roots = _layers(leaves, height)
    discard(slim)
    tops = _tops(roots)
    nodes, listed = placed(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "name")
    top_layers, top_roots = _layers(nodes, height)
    root = _tops(top_roots).select(F.col("digest").alias("root"))
    begun = root.select(F.lit("").alias("g"), F.array().cast(_PATH).alias("path"), F.col("root").alias("subroot"))
    over, top_upper = _descend(top_layers, top_roots, begun, height, ["name"])
    subroots = written(over.select(F.col("name").alias("g"), "path", F.col("digest").alias("subroot")), "merkle-subroots")
    found, _ = _descend(layers, roots, subroots, height, [f"x_{n}" for n in extra])
    last = written(root, "merkle-root")
    discard(*roots, *top_roots, top_upper, listed, subroots)
    return found.crossJoin(F.broadcast(last)).select(*(F.col(f"x_{n}").alias(n) for n in extra), "digest", "position", "path", "subroot", "root")


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def audited(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents, of which every row whose id's CRC-32 5 divides is tampered with: its text is lower-cased.

    Null values are hashed as ``-``, so null texts cannot be tampered with; nor are rows with a null id. Only texts with a capital show it. Columns beside those that are hashed do not matter.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(hit, leaf(*own, F.translate("text", _CAPITALS, _SMALL)))
    rows = manifest(docs.select("doc_id", "source", "lang", "n_chars", "text"), F.col("source"), leaf(*own, F.col("text")), F.col("doc_id"), height, doc_id=F.col("doc_id"), tampered=tampered)
    back = rows.withColumn("folded_root", folded(F.col("path"), F.coalesce("tampered", "digest")))
    return back.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", digest_of(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
