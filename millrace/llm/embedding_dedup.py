"""Embedding near-dedup by hierarchical navigable small worlds, one for each shard.

Equal vectors are one node. The nodes of a label and length are dealt to shards of bounded size; the graph of a shard is built
once and stored. Then every two shards meet in a task: the vectors of each query the graph of the other, and of their own.
A query descends the levels, walks the lowest one with a beam, and where its beam is full of neighbours goes on along their links.
Sampled queries are held against all vectors of the shard; the beams are widened until enough of what the sample should find is found.
Found pairs are verified by their cosine in double precision, count at both ends, and unite components.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .components import components

#: Queries that walk a graph at once, nodes that each expands in a step, nodes that are put into a graph at once.
_QUERIES, _EXPANDED, _BATCH = 256, 4, 256
_LOW = np.float32(-np.inf)


def _levels(keys: np.ndarray, neighbours: int) -> np.ndarray:
    """Levels follow from the keys, so that a graph does not hang on chance."""
    mixed = (np.asarray(keys).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    uniform = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.minimum((-np.log(np.maximum(uniform, 1e-12)) / math.log(neighbours)).astype(int), 6)


class Graph:
    """Hierarchical navigable small world over unit vectors; similarity is the inner product.

    ``links[level]`` has a row of neighbours for each node, padded with -1; level 0 has twice as many as the others. Nodes go in by
    batches, the highest levels first: each finds its neighbours in the graph so far and among its own batch.
    """

    def __init__(self, vectors: np.ndarray, keys: np.ndarray, neighbours: int = 12, beam: int = 48) -> None:
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(self.vectors)
        levels = _levels(keys, neighbours)
        order = np.lexsort((np.asarray(keys), -levels))
        self.links = [np.full((n, neighbours * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(levels.max(initial=0)) + 1)]
        self.entry = int(order[0]) if n else -1
        at = 0
        while at < n:
            # No batch is larger than the graph that it is put into.
            batch = order[at : at + max(1, min(_BATCH, at))]
            batch = batch[levels[batch] == levels[batch[0]]]
            self._insert(batch, int(levels[batch[0]]), neighbours, beam)
            at += len(batch)

    @classmethod
    def stored(cls, vectors: np.ndarray, data: bytes) -> Graph:
        out = cls.__new__(cls)
        out.vectors = np.ascontiguousarray(vectors, np.float32)
        with np.load(io.BytesIO(data)) as found:
            out.links = [found[f"level{k}"] for k in range(len(found.files) - 1)]
            out.entry = int(found["entry"])
        return out

    def stores(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, entry=np.asarray(self.entry), **{f"level{k}": links for k, links in enumerate(self.links)})
        return out.getvalue()

    def search(self, queries: np.ndarray, entries: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` most similar nodes that each query finds from its entries (a row each, -1 for none): nodes and similarities, best first, -1 for none."""
        b, rows = len(queries), np.arange(len(queries))[:, None]
        vectors, links = self.vectors, self.links[level]
        visited = np.zeros((b, len(vectors) + 1), bool)  # the last stands for none
        ids = np.full((b, width), -1, np.int64)
        sims = np.full((b, width), _LOW)
        open_ = np.zeros((b, width), bool)

        def take(which: np.ndarray, nodes: np.ndarray) -> None:
            """Put ``nodes`` (a row for each query of ``which``) into the beams."""
            nodes = np.sort(nodes, axis=1)
            new = nodes >= 0
            new[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
            new &= ~visited[which[:, None], nodes]
            visited[which[:, None], np.where(new, nodes, len(vectors))] = True
            found = np.matmul(vectors[nodes], queries[which][:, :, None])[:, :, 0]
            found[~new] = _LOW
            sim = np.concatenate([sims[which], found], axis=1)
            node = np.concatenate([ids[which], np.where(new, nodes, -1)], axis=1)
            todo = np.concatenate([open_[which], new], axis=1)
            best = np.argpartition(-sim, width - 1, axis=1)[:, :width]
            sims[which], ids[which], open_[which] = (np.take_along_axis(x, best, 1) for x in (sim, node, todo))

        take(rows[:, 0], entries)
        active = rows[:, 0]
        step = min(_EXPANDED, width)
        while len(active):
            waiting = np.where(open_[active], sims[active], _LOW)
            picked = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
            live = np.take_along_axis(waiting, picked, 1) > _LOW
            going = live.any(axis=1)
            active, picked, live = active[going], picked[going], live[going]
            if not len(active):
                break
            nodes = np.where(live, ids[active[:, None], picked], -1)
            open_[active[:, None], picked] = False
            near = np.where((nodes >= 0)[:, :, None], links[nodes], -1)
            take(active, near.reshape(len(active), -1))
        best = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)

    def descend(self, queries: np.ndarray, level: int) -> np.ndarray:
        """Entries for ``level``: what the levels above lead to."""
        here = np.full((len(queries), 1), self.entry)
        for k in range(len(self.links) - 1, level, -1):
            here, _ = self.search(queries, here, _EXPANDED, k)
        return here

    def _chosen(self, own: np.ndarray, others: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Per row of ``own`` up to ``most`` of ``others`` (-1 for none) by the diversity rule: one that is nearer to a chosen neighbour than to the node waits until all others are in."""
        best = np.argsort(-sims, axis=1, kind="stable")
        others, sims = np.take_along_axis(others, best, 1), np.take_along_axis(sims, best, 1)
        b, c = others.shape
        among = np.matmul(self.vectors[others], self.vectors[others].transpose(0, 2, 1))
        highest = np.full((b, c), _LOW)
        diverse = np.zeros((b, c), bool)
        taken = np.zeros(b, int)
        for k in range(c):
            good = (others[:, k] >= 0) & (taken < most) & (highest[:, k] < sims[:, k])
            diverse[good, k] = True
            taken[good] += 1
            np.maximum(highest, np.where(good[:, None], among[:, k], _LOW), out=highest)
        rank = np.where(others < 0, 2 * c, np.arange(c) + np.where(diverse, 0, c))
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(others, first, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _insert(self, batch: np.ndarray, level: int, neighbours: int, beam: int) -> None:
        queries = self.vectors[batch]
        own = queries @ queries.T
        np.fill_diagonal(own, _LOW)
        empty = len(batch) == 1 and batch[0] == self.entry
        here = self.descend(queries, level) if not empty else None
        for k in range(level, -1, -1):
            near = np.full((len(batch), 1), -1)
            sims = np.full((len(batch), 1), _LOW)
            if here is not None:
                near, sims = self.search(queries, here, beam, k)
                here = near
            if len(batch) > 1:
                among = np.argsort(-own, axis=1, kind="stable")[:, : min(neighbours, len(batch) - 1)]
                near, sims = np.concatenate([near, batch[among]], axis=1), np.concatenate([sims, np.take_along_axis(own, among, 1)], axis=1)
            mine = self._chosen(batch, near, sims, neighbours)
            self.links[k][batch, :neighbours] = mine
            self._link_back(np.repeat(batch, neighbours), mine.ravel(), k)

    def _link_back(self, nodes: np.ndarray, others: np.ndarray, level: int) -> None:
        """Give each of ``others`` a link to its node; where that is too many, the diverse ones stay."""
        links = self.links[level]
        most = links.shape[1]
        ok = others >= 0
        nodes, others = nodes[ok], others[ok]
        if not len(nodes):
            return
        order = np.lexsort((nodes, others))
        nodes, others = nodes[order], others[order]
        targets, first, counts = np.unique(others, return_index=True, return_counts=True)
        for k in range(0, len(targets), 512):
            t, f, c = targets[k : k + 512], first[k : k + 512], counts[k : k + 512]
            at = f[:, None] + np.arange(c.max())
            more = np.where(np.arange(c.max()) < c[:, None], nodes[np.minimum(at, len(nodes) - 1)], -1)
            more[(more[:, :, None] == links[t][:, None, :]).any(axis=2)] = -1
            both = np.concatenate([links[t], more], axis=1)
            full = (both >= 0).sum(axis=1) > most
            both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
            links[t[~full]] = both[~full][:, :most]
            if full.any():
                sims = np.matmul(self.vectors[both[full]], self.vectors[t[full]][:, :, None])[:, :, 0]
                sims[both[full] < 0] = _LOW
                links[t[full]] = self._chosen(t[full], both[full], sims, most)

    def within(self, queries: np.ndarray, least: float, width: int) -> np.ndarray:
        """For each query the nodes found with a similarity of at least ``least``, as rows of a bitmap. Where all of a beam is so near, the walk goes on through nodes that lack up to ``slack``."""
        n, slack = len(self.vectors), least - 0.02 * width / 32
        out = np.zeros((len(queries), n), bool)
        width = min(width, n)
        ids, sims = self.search(queries, self.descend(queries, 0), width, 0)
        row, k = np.nonzero(sims >= least)
        out[row, ids[row, k]] = True
        for i in np.flatnonzero(sims[:, -1] >= slack):
            seen = np.zeros(n, bool)
            front = ids[i]
            seen[front] = True
            while len(front):
                near = self.links[0][front].ravel()
                near = np.unique(near[near >= 0])
                near = near[~seen[near]]
                seen[near] = True
                similar = self.vectors[near] @ queries[i]
                out[i, near[similar >= least]] = True
                front = near[similar >= slack]
        return out


def _sampled(found: np.ndarray, size: int) -> np.ndarray:
    """Queries to audit: evenly among those with no find, with few, and with many, so that small groups are audited beside large ones."""
    counts = found.sum(axis=1)
    picked = [np.zeros(0, int)]
    for stratum in (counts == 0, (counts > 0) & (counts <= 8), counts > 8):
        rows = np.flatnonzero(stratum)
        picked.append(rows[np.unique(np.linspace(0, len(rows) - 1, min(size, len(rows))).astype(int))] if len(rows) else rows)
    return np.concatenate(picked)


def searched(graph: Graph, queries: np.ndarray, threshold: float, beam: int, target: float, audit: int) -> tuple[np.ndarray, int, float]:
    """What all ``queries`` find in ``graph`` (a bitmap), the beam it took and the recall of the audit at the end.

    The beam doubles until sampled queries find ``target`` of what an exact search of the shard gives them; a sample without neighbours has met it. When the
    beam is as wide as the shard and that is not enough, parts of the graph are out of reach, and the queries are held against all vectors.
    """
    n = len(graph.vectors)
    while True:
        # Walks take single precision; what is a little below the threshold may be above it in double precision.
        found = np.concatenate([graph.within(queries[k : k + _QUERIES], threshold - 1e-5, beam) for k in range(0, len(queries), _QUERIES)])
        sample = _sampled(found, audit)
        truth = queries[sample] @ graph.vectors.T >= threshold + 1e-5
        total = int(truth.sum())
        recall = int((truth & found[sample]).sum()) / total if total else 1.0
        if recall >= target:
            return found, beam, recall
        if beam >= n:
            found = np.concatenate([queries[k : k + _QUERIES] @ graph.vectors.T >= threshold - 1e-5 for k in range(0, len(queries), _QUERIES)])
            return found, n, 1.0
        beam *= 2


def verified(found: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """The pairs of ``found`` whose cosine in double precision is at least ``threshold``. ``left`` and ``right`` have unit rows."""
    for i in np.flatnonzero(found.any(axis=1)):
        near = np.flatnonzero(found[i])
        found[i, near] = right[near] @ left[i] >= threshold
        # How a product rounds hangs on its shape: at the threshold both ends of a pair take the same sum.
        close = near[np.abs(right[near] @ left[i] - threshold) < 1e-12]
        found[i, close] = np.einsum("j,kj->k", left[i], right[close]) >= threshold
    return found


def _uniting(found: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ``found`` (nodes ``left`` by nodes ``right``) that unite what was apart: fewer than there are nodes."""
    nodes = np.unique(np.concatenate([left, right]))
    a, b = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    root, out = np.arange(len(nodes)), []
    for i in np.flatnonzero(found.any(axis=1)):
        near = np.flatnonzero(found[i])
        joined, first = np.unique(root[b[near]], return_index=True)
        here = root[a[i]]
        new = joined != here
        if new.any():
            gone = np.zeros(len(nodes), bool)
            gone[joined[new]] = True
            root[gone[root]] = here
            out += [(int(left[i]), int(x)) for x in right[near[first[new]]]]
    return out


_BUNDLE = "label string, width int, shard int, nodes binary, copies binary, vectors binary, graph binary"
_FOUND = "vec_id long, n_links long, neighbours array<long>, label string, width int, a int, b int, beam int, recall double"


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for a shard: its nodes, how many vectors each stands for, their unit vectors and the graph over them."""
    rows = rows.sort_values("vec_id")
    vectors = np.stack([np.asarray(v, np.float64) for v in rows["vector"]])
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    nodes = rows["vec_id"].to_numpy()
    graph = Graph(vectors, nodes)
    head = rows[["label", "width", "shard"]].iloc[:1].reset_index(drop=True)
    return head.assign(nodes=[nodes.astype("<i8").tobytes()], copies=[rows["copies"].to_numpy().astype("<i8").tobytes()], vectors=[vectors.astype("<f8").tobytes()], graph=[graph.stores()])


def _met(threshold: float, beam: int, target: float, audit: int):
    """For two shards: per node how many vectors it links with, and the links that unite; a row without a node has the audit."""

    def opened(row: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
        nodes = np.frombuffer(row["nodes"], "<i8")
        vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(nodes), -1)
        return nodes, np.frombuffer(row["copies"], "<i8"), vectors, Graph.stored(vectors, row["graph"])

    def meet(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        a, b = int(one["a"].iloc[0]), int(one["b"].iloc[0])
        nodes, copies, vectors, graph = opened(one.iloc[0])
        if a == b:
            nodes_b, copies_b, vectors_b = nodes, copies, vectors
            found, width, recall = searched(graph, graph.vectors, threshold, beam, target, audit)
            found |= found.T
            np.fill_diagonal(found, False)
        else:
            nodes_b, copies_b, vectors_b, graph_b = opened(other.iloc[0])
            found, width, recall = searched(graph_b, graph.vectors, threshold, beam, target, audit)
            back, width_b, recall_b = searched(graph, graph_b.vectors, threshold, beam, target, audit)
            found |= back.T
            width, recall = max(width, width_b), min(recall, recall_b)
        if a == b:  # each pair once, then at both ends
            found = np.triu(verified(np.triu(found), vectors, vectors, threshold))
            links = found | found.T
            counts, sides = links @ copies, [(nodes, links @ copies)]
        else:
            found = verified(found, vectors, vectors_b, threshold)
            sides = [(nodes, found @ copies_b), (nodes_b, found.T @ copies)]
        united: dict[int, list[int]] = {}
        for x, y in _uniting(found, nodes, nodes_b):
            united.setdefault(x, []).append(y)
        out = [(int(node), int(n), united.get(int(node), []) if side == 0 else []) for side, (own, counts) in enumerate(sides) for node, n in zip(own[counts > 0], counts[counts > 0])]
        found_rows = pd.DataFrame([*out, (None, 0, [])], columns=["vec_id", "n_links", "neighbours"]).astype({"vec_id": "Int64"})
        return found_rows.assign(label=one["label"].iloc[0], width=one["width"].iloc[0], a=a, b=b, beam=width, recall=recall)

    return meet


def near_vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, shard_rows: int = 4096, beam: int = 32, target: float = 0.99, audit: int = 64) -> DataFrame:
    """One row per row of ``table``: id, n_links (other vectors linked directly), component_id, ``kept``, and ``beam`` and ``recall``: the widest beam and the least audited recall of the searches in which the vector's shard took part.

    Vectors of equal length with equal, not null labels are linked if a search finds them and their cosine in double precision is at least ``threshold``. Vectors that
    are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows with a null id or label; they have no beam and recall. Where ids repeat, the least vector of an id
    stands for it, and all its rows get its counts. component_id is the smallest id reached by links; a null id has a
    null component and is kept. Other columns are ignored; an empty table gives an empty result. The different vectors of a label and length
    have as many shards as ``shard_rows`` asks for. Each has one graph, built once; each two shards meet in one task, so the searches of a label grow with its rows times its shards,
    and a task holds two shards, two graphs and one bitmap of their pairs.
    """
    named = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    sane = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = named.where("vec_id is not null and label is not null").where(sane)
    # Scaled by a power of two, which changes no direction: squares of very large or small components stay finite and above 0.
    usable = usable.withColumn("vector", F.when((largest > 1e100) | (largest < 1e-100), F.transform("vector", lambda x: x * F.pow(F.lit(2.0), -F.floor(F.log2(largest))))).otherwise(F.col("vector")))
    usable = usable.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("s")).select("vec_id", "s.label", "s.vector")
    same = ["label", "h1", "h2"]
    usable = written(usable.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit("second"), "vector")}), "vectors")
    nodes = usable.groupBy(*same).agg(F.min_by("vector", "vec_id").alias("vector"), F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("width", F.size("vector"))
    nodes = written(nodes, "vector-nodes")
    sizes = nodes.groupBy("label", "width").agg(F.count("*").alias("n")).select("label", "width", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(sizes, ["label", "width"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    rows = dealt.select("label", "width", "shard", F.col("node").alias("vec_id"), "copies", "vector")
    bundles = written(rows.groupBy("label", "width", "shard").applyInPandas(_built, _BUNDLE), "vector-graphs")
    held = bundles.select("label", "width", "shard")
    pairs = held.select("label", "width", F.col("shard").alias("a")).join(held.select("label", "width", F.col("shard").alias("b")), ["label", "width"]).where("a <= b")
    key = ["label", "width", "a", "b"]
    # Under names of their own, the two sides of a cogroup are not taken for one.
    one, other = (pairs.join(bundles.withColumnRenamed("shard", side), ["label", "width", side]).select(*(F.col(c).alias(f"{c}{mark}") for c in key), "nodes", "copies", "vectors", "graph") for side, mark in (("a", ""), ("b", "_other")))
    one = one.select(*(F.col(c).alias(c) for c in one.columns))
    found = written(one.groupBy(*key).cogroup(other.groupBy(*(f"{c}_other" for c in key))).applyInPandas(_met(threshold, beam, target, audit), _FOUND), "vector-links")
    counts = found.where("vec_id is not null").groupBy("vec_id").agg(F.sum("n_links").alias("n"))
    audits = found.where("vec_id is null").select("label", "width", F.explode(F.array_distinct(F.array("a", "b"))).alias("shard"), "beam", "recall").groupBy("label", "width", "shard").agg(F.max("beam").alias("beam"), F.min("recall").alias("recall"))
    links = found.select(F.col("vec_id").alias("a"), F.explode("neighbours").alias("b"))
    united = components(links)
    per_node = dealt.select(*same, "node", "copies", "width", "shard").join(audits, ["label", "width", "shard"], "left").join(counts.withColumnRenamed("vec_id", "node"), "node", "left").join(united, "node", "left")
    per_node = written(per_node.select(*same, F.coalesce("component", "node").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "beam", "recall"), "vector-results")
    per_id = written(usable.select("vec_id", *same).join(per_node, same).drop(*same), "vector-rows")
    discard(usable, nodes, bundles, found, per_node)
    out = named.select("vec_id").join(per_id, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"), "beam", "recall")
