"""Exact and near dedup of ranked rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import discard, owning, written


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranks ``r`` that a scan keeps, of rows (r, k) in order of r."""
    held: set[str] = set()
    now, keys = None, []

    def closed() -> list:
        if now is None or not held.isdisjoint(keys):
            return []
        held.update(keys)
        return [now]

    out: list = []
    for batch in batches:
        for r, k in batch.itertuples(index=False):
            if r != now:
                out += closed()
                now, keys = r, []
            keys.append(k)
    out += closed()
    yield pd.DataFrame({"r": out})


def _scan_group(group: pd.DataFrame) -> pd.DataFrame:
    """Ranks that a scan keeps of one component."""
    return next(_scan(iter([group[["r", "k"]].sort_values(["r", "k"], kind="stable")])))


def exact_dedup(df: DataFrame, rank: str, keys: list[str], optional: tuple[str, ...] = (), few: int = 100_000, rounds: int = 4, largest: int = 2_000_000) -> DataFrame:
    """The rows that a scan by ``rank`` keeps when it drops each row that shares a key with a row kept before; a dropped row reserves nothing.

    Rounds instead of a scan: a row that has the least rank among the undecided rows of all its keys is kept, undecided rows that share a
    key with it are dropped, until nothing is undecided (Blelloch, Fineman and Shun, 2012). Null keys never
    conflict, nor do empty ones of the columns in ``optional``. Ranks must differ. In random orders few rounds decide nearly all rows, but rows that each conflict with
    the next in rank alone are decided two a round. So after ``rounds`` rounds the undecided rows are parted into components, which share no key: each of up to ``largest`` keys (some 200 MB in a task) is scanned by itself, many at a
    time, and only larger ones take further rounds. At most ``few`` keys are scanned at once, without components.
    """
    keyed = F.array(*(F.when(F.col(k) != "", F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) if k in optional else F.concat(F.lit(f"{k}:"), F.col(k).cast("string")) for k in keys))
    links = written(df.select(F.col(rank).alias("r"), F.explode(F.filter(keyed, lambda k: k.isNotNull())).alias("k")), "dedup-keys")
    kind = df.schema[rank].dataType.simpleString()
    parts = [written(df.select(F.col(rank).alias("r")).join(links.select("r"), "r", "left_anti"), "dedup-kept")]
    done = 0
    while links.limit(few + 1).count() > few:
        if done == rounds:  # what conflicts in long chains is scanned component by component
            mates = links.join(links.groupBy("k").agg(F.min("r").alias("b")), "k").where("r <> b").select(F.col("r").alias("a"), "b").distinct()
            member = linked_components(links.select(F.col("r").alias("id")).distinct(), mates).withColumnRenamed("id", "r")
            sized = member.join(links.groupBy("r").agg(F.count("*").alias("n")), "r").groupBy("component").agg(F.sum("n").alias("n"))
            small = written(links.join(member, "r").join(sized.where(F.col("n") <= largest), "component").select("component", "r", "k"), "dedup-components")
            parts.append(written(small.groupBy("component").applyInPandas(_scan_group, f"r {kind}"), "dedup-winners"))
            links, old = written(links.join(small.select("r").distinct(), "r", "left_anti"), "dedup-keys"), links
            discard(old, small, member)
        else:
            least = links.groupBy("k").agg(F.min("r").alias("m"))
            winners = written(links.join(least, "k").groupBy("r").agg(F.min(F.expr("r = m")).alias("w")).where("w").select("r"), "dedup-winners")
            taken = links.join(winners, "r", "left_semi").select("k").distinct()
            gone = links.join(taken, "k", "left_semi").select("r").distinct()
            parts.append(winners)
            links, old = written(links.join(gone, "r", "left_anti"), "dedup-keys"), links
            discard(old)
        done += 1
    parts.append(written(links.repartition(1).sortWithinPartitions("r", "k").mapInPandas(_scan, f"r {kind}"), "dedup-winners"))
    discard(links)
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.unionByName(part)
    return owning(df.join(kept.withColumnRenamed("r", "__r"), F.col(rank) == F.col("__r"), "left_semi"), *parts)


#: A vocabulary of up to so many terms, some 30 bytes each, is sent to every task.
FEATURES = 200_000


def char_ngrams(df: DataFrame, id_col: str, text_col: str, low: int = 3, high: int = 5) -> DataFrame:
    """(id, term, tf): character n-grams within word bounds, each word padded by a space; a padded word has none longer than itself."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by id once, so that neither count below is an exchange of grams
    word = F.explode(F.split(F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " ")), " ")).alias("w")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(parts, "id")
    words = texts.select("id", word).where("w <> ''").groupBy("id", "w").count().select("id", F.concat(F.lit(" "), "w", F.lit(" ")).alias("p"), "count")
    of = lambda n: F.when(F.length("p") >= n, F.transform(F.sequence(F.lit(1), F.length("p") - n + 1), lambda s: F.substring(F.col("p"), s, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return words.select("id", "count", F.explode(F.concat(*(of(n) for n in range(low, high + 1)))).alias("term")).groupBy("id", "term").agg(F.sum("count").alias("tf"))


def tfidf(terms: DataFrame, *, min_df: int = 2, max_features: int | None = 45_000, counted: bool = False) -> DataFrame:
    """(id, term, weight) of ``terms`` (id, term, tf): 1 + ln tf times ln((1 + N) / (1 + df)) + 1, unit length per id. Of the terms in at least ``min_df`` rows the ``max_features`` most frequent count, equals by term. With ``counted`` also ``df``."""
    n = terms.agg(F.countDistinct("id").alias("n"))
    vocabulary = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    if max_features:
        vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(max_features)
        vocabulary = F.broadcast(vocabulary) if max_features <= FEATURES else vocabulary
    weighed = terms.join(vocabulary, "term").crossJoin(F.broadcast(n)).select("id", "term", "df", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("raw"))
    # A row for each id: what is shuffled is gathered before, and its length needs no join.
    whole = weighed.groupBy("id").agg(F.collect_list(F.struct("term", "df", "raw")).alias("v"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return whole.select("id", "norm", F.explode("v").alias("v")).select("id", "v.term", (F.col("v.raw") / F.col("norm")).alias("weight"), *(["v.df"] if counted else []))


def _prefixes(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, term, tail) of the indexed terms: from the rarest on, as long as what follows could reach ``threshold`` alone; ``tail`` is the length of the vector from the term on."""
    df = vectors.groupBy("term").agg(F.count("*").alias("df"))
    rest = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("term"))
    placed = vectors.join(df, "term").withColumn("tail", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(rest)))
    return placed.where(F.col("tail") >= threshold - 1e-9).select("id", "term", "tail")


def _listed_pairs(prefix: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, of vectors that share an indexed term. Where the first one they share stands, what is left of both bounds their product."""
    left, right = (prefix.select(F.col("id").alias(n), "term", F.col("tail").alias(f"tail_{n}")) for n in "ab")
    met = left.join(right, "term").where("a < b").groupBy("a", "b").agg(F.max(F.col("tail_a") * F.col("tail_b")).alias("most"))
    candidates = met.where(F.col("most") >= threshold - 1e-9).select("a", "b")
    x, y = vectors.select(F.col("id").alias("a"), "term", F.col("weight").alias("x")), vectors.select(F.col("id").alias("b"), "term", F.col("weight").alias("y"))
    return candidates.join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("similarity")).where(F.col("similarity") >= threshold)


#: Lists of up to so many vectors that share an indexed term are held many in a task; longer ones are dealt into blocks of about so many.
LIST, BLOCK = 200, 2048
#: Parts of a sketch, and rows of lists that a task holds at a time.
WIDTH, HELD = 192, 20_000
#: A list with more pairs than so many times its vectors under the bound of their sketches is multiplied in blocks.
FEW = 4
#: A term that so many vectors of two blocks hold is multiplied as a column of a full matrix, rarer ones each by itself.
FULL = 48


def products(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Inner products of sparse vectors (terms, weights), each of ``left`` with each of ``right``."""
    sides = []
    for vectors in (left, right):
        sizes = [len(t) for t, _ in vectors]
        sides.append((np.repeat(np.arange(len(vectors)), sizes), np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors])))
    terms, counts = np.unique(np.concatenate([sides[0][1], sides[1][1]]), return_counts=True)
    codes = [np.searchsorted(terms, side[1]) for side in sides]
    full = np.flatnonzero(counts >= FULL)
    place = np.full(len(terms), -1)
    place[full] = np.arange(len(full))
    dense = []
    for (rows, _, weights), code, vectors in zip(sides, codes, (left, right)):
        matrix = np.zeros((len(vectors), len(full)))
        on = place[code] >= 0
        matrix[rows[on], place[code[on]]] = weights[on]
        dense.append(matrix)
    out = dense[0] @ dense[1].T
    rare = []
    for (rows, _, weights), code in zip(sides, codes):
        keep = place[code] < 0
        order = np.argsort(code[keep], kind="stable")
        rare.append((code[keep][order], rows[keep][order], weights[keep][order]))
    for term in np.intersect1d(rare[0][0], rare[1][0]):
        (la, ha), (lb, hb) = (np.searchsorted(side[0], (term, term + 1)) for side in rare)
        out[np.ix_(rare[0][1][la:ha], rare[1][1][lb:hb])] += np.outer(rare[0][2][la:ha], rare[1][2][lb:hb])
    return out


def _block_heaps(threshold: float, k: int):
    """The ``k`` nearest of each vector of two blocks among those of the other."""

    def best(near: np.ndarray, ids: np.ndarray, others: np.ndarray) -> tuple[list, list, list]:
        out: tuple[list, list, list] = ([], [], [])
        for row, name in zip(near, ids):
            found = np.flatnonzero(row >= threshold)
            if len(found) > k:
                # The k-th value bounds the heap; of equals at the bound the smaller ids stay.
                bound = np.partition(row[found], -k)[-k]
                found = found[row[found] >= bound]
                found = found[np.lexsort((others[found], -row[found]))][:k]
            out[0].extend([name] * len(found))
            out[1].extend(others[found])
            out[2].extend(row[found])
        return out

    def of(table: pa.Table) -> pa.Table:
        block = table["block"].to_numpy()
        ids, tails = table["id"].to_numpy(), table["tail"].to_numpy()
        vectors = [(np.asarray(t.as_py(), np.int64), np.asarray(w.as_py(), float)) for t, w in zip(table["terms"], table["weights"])]
        first, second = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        columns: tuple[list, list, list] = ([], [], [])
        if len(left) and len(right) and tails[left].max() * tails[right].max() >= threshold - 1e-9:
            near = np.round(products([vectors[i] for i in left], [vectors[i] for i in right]), 12)
            near[ids[left][:, None] == ids[right][None, :]] = -1  # a vector is not its own neighbour
            for found in [best(near, ids[left], ids[right])] + ([best(near.T, ids[right], ids[left])] if first != second else []):
                for column, values in zip(columns, found):
                    column.extend(values)
        return pa.table({"a": pa.array(columns[0], table["id"].type), "b": pa.array(columns[1], table["id"].type), "similarity": pa.array(columns[2], pa.float64())})

    return of


def _dealt(lists: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``lists`` (id, n, and ``keys`` that name a list) for each two blocks (i, j) of their list, with the own ``block``."""
    dealt = lists.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rest = [c for c in lists.columns if c not in keys]
    return dealt.select(*keys, *rest, "block", other).select(*keys, *rest, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _blocked(prefix: DataFrame, rows: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b, similarity): up to ``k`` nearest of each vector for each pair of blocks of a list. Lists of the same vectors are one, read at the first of their terms."""
    kind = rows.schema["id"].dataType.simpleString()
    lists = prefix.groupBy("term").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.hash("id")).alias("h2"))
    members = prefix.join(lists, "term").groupBy("n", "h1", "h2", "id").agg(F.max("tail").alias("tail"))
    pairs = _dealt(members, "n", "h1", "h2")
    return pairs.join(rows.select("id", "terms", "weights"), "id").groupBy("n", "h1", "h2", "i", "j").applyInArrow(_block_heaps(threshold, k), f"a {kind}, b {kind}, similarity double")


def sketch(terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Lengths of the vector's parts by the hash of a term, rounded up to bytes, and the value of a step. By Cauchy and Schwarz, products of two sketches are no less than those of their vectors."""
    parts = np.sqrt(np.bincount(terms.view(np.uint64) % np.uint64(WIDTH), weights * weights, WIDTH)) * (1 + 1e-9)
    step = float(parts.max()) / 254 or 1.0
    return np.ceil(parts / step).astype(np.uint8), step


def _heads(threshold: float):
    """Of vectors with their rarest terms first: the terms to index, what is left of the vector from each on, and its sketch."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails, sketches, steps = [], [], [], []
            for t, w in zip(batch["terms"], batch["weights"]):
                t, w = t.values.to_numpy(), w.values.to_numpy()
                rest = np.sqrt(np.cumsum((w * w)[::-1])[::-1])
                n = int((rest >= threshold - 1e-9).sum())
                own, step = sketch(t, w)
                heads.append(t[:n])
                tails.append(rest[:n])
                sketches.append(own.tobytes())
                steps.append(step)
            names = ["id", "x", "y", "z", "terms", "tails", "sketch", "step"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:4]), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.float64())), pa.array(sketches, pa.binary()), pa.array(steps, pa.float64())], names=names)

    return of


def _bounded(threshold: float):
    """(a, b, term) of two vectors of a list whose tails and sketches let them reach ``threshold``; of a list with too many, (null, null, term)."""

    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by("term")
        terms, block, tails, steps, ids = (table[c].to_numpy() for c in ("term", "block", "tail", "step", "id"))
        sketches = np.frombuffer(b"".join(x.as_py() for x in table["sketch"]), np.uint8).reshape(-1, WIDTH).astype(np.float32)  # sums stay below 2 ** 24, so they are exact
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        out: tuple[list, list, list] = ([], [], [])
        cuts = np.flatnonzero(np.diff(terms)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(terms)]):
            rows = np.arange(low, high)
            left, right = rows[block[low:high] == i], rows[block[low:high] == j]
            bound = (sketches[left] @ sketches[right].T) * np.outer(steps[left], steps[right])
            may = (bound >= threshold - 1e-6) & (np.outer(tails[left], tails[right]) >= threshold - 1e-9)
            a, b = np.nonzero(np.triu(may, 1) if i == j else may)
            if len(a) > FEW * len(rows):
                out[0].append(None), out[1].append(None), out[2].append(terms[low])
                continue
            out[0].extend(ids[left[a]]), out[1].extend(ids[right[b]]), out[2].extend([terms[low]] * len(a))
        return pa.table({"a": pa.array(out[0], table["id"].type), "b": pa.array(out[1], table["id"].type), "term": pa.array(out[2], pa.int64())})

    return of


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, similarity) of pairs (a, b, at, aw, bt, bw) with their terms and weights."""
    for batch in batches:
        found = []
        for columns in zip(*(batch[c] for c in ("at", "aw", "bt", "bw"))):
            at, aw, bt, bw = (c.values.to_numpy() for c in columns)
            _, x, y = np.intersect1d(at, bt, assume_unique=True, return_indices=True)
            found.append(round(float(aw[x] @ bw[y]), 12))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(found, pa.float64())], names=["a", "b", "similarity"])


def nearest(vectors: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b, similarity): for each of the unit vectors (id, term, weight; ``df``, how many hold the term, if known) its up to ``k`` most similar others with at least ``threshold``, equals by id.

    Vectors that are equal are one class, which is compared once. Classes that share an indexed term are held against each other by sketches of fixed size alone, whose products are bounds; what is within them is multiplied: pair by pair, but for
    lists with many such pairs, which are dealt into blocks, each two are multiplied in a task and give only the ``k`` nearest of each vector. So whole vectors are sent only where there is something near, and the rows given out grow
    with the vectors times blocks, not with the square of a list. Each class then stands for its first ``k`` + 1 members.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    if "df" not in vectors.columns:
        vectors = vectors.join(vectors.groupBy("term").agg(F.count("*").alias("df")), "term")
    entries = vectors.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("term").alias("t"), "weight"))).alias("v"))
    close = F.transform("v", lambda e: F.struct(e["t"], F.round(e["weight"], 7)))
    rows = written(entries.select("id", F.xxhash64(close).alias("x"), F.hash(close).alias("y"), F.size("v").alias("z"), F.col("v.t").alias("terms"), F.col("v.weight").alias("weights")), "vector-rows")
    heads = written(rows.mapInArrow(_heads(threshold), f"id {kind}, x long, y int, z int, terms array<long>, tails array<double>, sketch binary, step double"), "vector-heads")
    of = Window.partitionBy("x", "y", "z")
    member = written(heads.select("id", F.min("id").over(of).alias("class"), (F.row_number().over(of.orderBy("id")) - 1).alias("place"), F.count("*").over(of).alias("size")), "vector-classes")
    own = written(heads.join(member.where("place = 0").select("id"), "id", "left_semi"), "vector-own")
    prefix = own.select("id", "sketch", "step", F.explode(F.arrays_zip("terms", "tails")).alias("e")).select("id", F.col("e.terms").alias("term"), F.col("e.tails").alias("tail"), "sketch", "step")
    lengths = written(prefix.groupBy("term").agg(F.count("*").alias("n")).where("n > 1"), "vector-lists")
    total = lengths.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Short lists share a group by a hash of their term; a longer one has groups of its own.
    short = F.pmod(F.xxhash64("term", F.lit(5)), F.lit(total // HELD + 1))
    lists = prefix.join(lengths, "term")
    groups = lists.where(F.col("n") <= LIST).withColumns({"block": F.lit(0), "i": F.lit(0), "j": F.lit(0)}).withColumn("g", short).withColumn("one", F.lit(0).cast("long"))
    groups = groups.unionByName(_dealt(lists.where(F.col("n") > LIST), "term").withColumns({"g": F.lit(-1).cast("long"), "one": F.col("term")}))
    bounded = written(groups.groupBy("g", "one", "i", "j").applyInArrow(_bounded(threshold), f"a {kind}, b {kind}, term long"), "vector-bounded")
    pairs = bounded.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    many = written(prefix.select("id", "term", "tail").join(bounded.where("a is null").select("term").distinct(), "term", "left_semi"), "vector-prefixes")
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(many.select("id")).distinct()
    some = written(rows.select("id", "terms", "weights").join(asked, "id", "left_semi"), "vector-some")
    left, right = (some.select(F.col("id").alias(c), F.col("terms").alias(f"{c}t"), F.col("weights").alias(f"{c}w")) for c in "ab")
    listed = written(pairs.join(left, "a").join(right, "b").select("a", "b", "at", "aw", "bt", "bw").mapInArrow(_products, f"a {kind}, b {kind}, similarity double").where(F.col("similarity") >= threshold), "vector-pairs")
    both = listed.unionByName(listed.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(_blocked(many, some, threshold, k))
    best = both.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    # A class with k others before it needs no more, as each has a member at least.
    ranked = best.withColumn("__k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("__k") <= k).drop("__k")
    first = member.where(F.col("place") <= k).select(F.col("class").alias("b"), F.col("id").alias("other"))
    near = written(ranked.join(first, "b").select(F.col("a").alias("class"), F.col("other").alias("b"), "similarity"), "vector-near")
    open_ = member.where(F.col("size") <= k).select(F.col("id").alias("a"), "class")
    mates = member.select(F.col("id").alias("a"), "class").join(first.select(F.col("b").alias("class"), F.col("other").alias("b")), "class").where("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    found = mates.unionByName(open_.join(near, "class").select("a", "b", "similarity"))
    out = written(found.withColumn("__k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("__k") <= k).drop("__k"), "vector-nearest")
    discard(rows, heads, member, own, lengths, bounded, many, some, listed, near)
    return out


def cosine_pairs(vectors: DataFrame, threshold: float, neighbors: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of unit vectors (id, term, weight) with at least ``threshold``.

    Only a prefix of each vector is indexed: two vectors that reach the threshold share a term of both prefixes. With ``neighbors``,
    a pair stays only if one is among the other's most similar so many, itself counted; then no list of all pairs is made (``nearest``).
    """
    if neighbors is None:
        return _listed_pairs(_prefixes(vectors, threshold), vectors, threshold)
    near = nearest(vectors, threshold, neighbors - 1)
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return owning(pairs, near)


def linked_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component: the smallest id reached) of ``nodes`` (id) over ``edges`` (a, b): labels spread until none changes, and jump over their own labels."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("other"))
        spread = labels.join(heard, "id", "left").select("id", "component", F.least("component", "other").alias("new"))
        jump = spread.select(F.col("id").alias("new"), F.col("new").alias("root"))
        after = written(spread.join(jump, "new", "left").select("id", "component", F.least("new", "root").alias("new")), "labels")
        discard(labels)
        labels = after.select("id", F.col("new").alias("component"))
        labels._millrace_path = after._millrace_path
        if after.where("new < component").isEmpty():
            discard(both)
            return labels


def near_dedup(df: DataFrame, rank: str, text_col: str, fallback_col: str | None = None, *, threshold: float = 0.93, neighbors: int | None = 8, max_features: int | None = 45_000) -> DataFrame:
    """The best row, by least ``rank``, of each group of rows whose texts are linked by TF-IDF cosines of ``threshold``; an empty text is read from ``fallback_col``."""
    text = F.col(text_col) if fallback_col is None else F.when(F.col(text_col) != "", F.col(text_col)).otherwise(F.col(fallback_col))
    rows = df.select(F.col(rank).alias("id"), text.alias("text"))
    terms = written(char_ngrams(rows, "id", "text").sortWithinPartitions("id"), "terms")
    vectors = tfidf(terms, max_features=max_features, counted=True)
    if not neighbors:
        vectors = written(vectors, "vectors")
    pairs = cosine_pairs(vectors, threshold, max(2, neighbors) if neighbors else None)
    groups = linked_components(rows.select("id"), pairs)
    discard(terms, vectors, pairs)
    return owning(df.join(groups.where("id = component").select(F.col("id").alias("__best")), F.col(rank) == F.col("__best"), "left_semi"), groups)
