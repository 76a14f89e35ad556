"""Quality rules by robust multivariate outliers, with DataFrame functions alone.

Word statistics of whole texts come from array functions. Per language and source, location and scatter of the
transformed statistics are minimum-covariance-determinant estimates: from two deterministic starts, concentration
steps go on over the share of the vectors that lie nearest until the determinant falls no more, and the start with
the least determinant wins. A document is rejected where so great a Mahalanobis distance from its group's estimate is too rare.

Distances are counted in bins and sums taken over integers, so estimates do not depend on how rows are partitioned,
groups are only ever seen as partial aggregates, and nothing but one row a group is exchanged. Equal vectors count once in an
estimate, so copies give it no false certainty. Nothing is added to a scatter: a statistic that does not vary in a group says nothing there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Base rules: fewest words, greatest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Bins of a distance for each doubling, and steps of a statistic for each unit.
_BINS, _STEPS = 64, 10_000
#: The transformed statistics: an even number of them, for the closed forms of ``_tail`` and ``_chi_square``.
FEATURES = ("f_length", "f_variety", "f_other", "f_upper")
_P = len(FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
#: Counts of a row, as ``word_statistics`` gives them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_letters", "n_upper")


def word_statistics(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: columns ``keep`` and ``COUNTS`` (long) of the whole text; a null text has none of anything.

    n_distinct counts different words as they are written, n_letters and n_upper the letters and capital letters of the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*keep, text.alias("__text"))
    df = df.withColumn("__words", F.array_remove(F.split("__text", r"[ \t-\r]+", -1), ""))
    n = F.size("__words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__windows", windows)
    df = df.withColumn("__repeats", F.size("__windows") > F.size(F.array_distinct("__windows")))
    # Windows with their positions, sorted; those equal to a neighbour are repeated. Each covers three words, less what the next covers too.
    pairs = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__pairs", F.when(F.col("__repeats"), pairs))
    same = lambda p, k: F.get("__pairs", k)["h"] == p["h"]
    at = F.array_sort(F.transform(F.filter("__pairs", lambda p, k: F.coalesce(same(p, k - 1), F.lit(False)) | F.coalesce(same(p, k + 1), F.lit(False))), lambda p: p["i"]))
    df = df.withColumn("__at", at)
    covered = F.aggregate("__at", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")))["n"]
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda line: F.rlike(line, F.lit(r"[^ \t-\r]"))))
    df = df.withColumn("__letters", F.regexp_replace("__text", r"[^\p{L}]+", ""))
    found = (
        n,
        F.length(F.array_join("__words", "")),
        F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")),
        F.size("__lines") - F.size(F.array_distinct("__lines")),
        F.coalesce(covered, F.lit(0)),
        F.size(F.array_distinct("__words")),
        F.length("__letters"),
        F.length(F.regexp_replace("__letters", r"[^\p{Lu}]+", "")),
    )
    return df.select(*keep, *(value.cast("long").alias(name) for name, value in zip(COUNTS, found)))


def transformed(stats: DataFrame) -> DataFrame:
    """``stats`` with ``FEATURES`` in whole 1/10,000, null without words: the logarithm of the mean word length, that of the distinct words by that of all (which long and short
    texts share), and the logits of the shares of characters that are no letters, and capital letters; half a character is added to both sides of a logit, as is usual."""
    n, letters, upper = F.col("n_words"), F.col("n_letters"), F.col("n_upper")
    logit = lambda part, whole: F.log((part + 0.5) / (whole - part + 0.5))
    values = (
        F.log(F.col("word_chars") / n),
        F.log1p("n_distinct") / F.log1p("n_words"),
        logit(F.col("word_chars") - letters, F.col("word_chars")),
        logit(upper, F.col("word_chars")),
    )
    return stats.withColumns({name: F.when(n > 0, F.round(value * _STEPS).cast("long")) for name, value in zip(FEATURES, values)})


def _chi_square(x: float, even: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, even // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def _quantile(p: float, even: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square(middle, even) < p else (low, middle)
    return low


def _consistency(share: float, even: int) -> float:
    """What the covariance of the nearest ``share`` of normal vectors must be multiplied by."""
    return share / _chi_square(_quantile(share, even), even + 2)


def _factored(df: DataFrame, scatter: dict[tuple[int, int], Column]) -> DataFrame:
    """Adds the inverse Cholesky factor ``w_i_j`` of the scatter, and ``rank`` and ``log_det`` over the statistics that vary. ``df`` has a row for each estimate.

    A statistic whose variance, given those before it, is below that of rounding has zeros in the factor: it says nothing in this group.
    """
    least = 1.0 / _STEPS**2
    varies = [F.col(f"d_{j}") > least for j in range(_P)]
    for j in range(_P):
        df = df.withColumn(f"d_{j}", scatter[j, j] - sum((F.col(f"l_{j}_{k}") ** 2 for k in range(j)), F.lit(0.0)))
        df = df.withColumn(f"l_{j}_{j}", F.when(varies[j], F.sqrt(F.greatest(f"d_{j}", F.lit(least)))).otherwise(1.0))
        below = {f"l_{i}_{j}": (scatter[i, j] - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}") for i in range(j + 1, _P)}
        df = df.withColumns({name: F.when(varies[j], e).otherwise(0.0) for name, e in below.items()}) if below else df
    for i in range(_P):
        row = {f"w_{i}_{j}": -sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l_{i}_{i}") for j in range(i)} | {f"w_{i}_{i}": 1 / F.col(f"l_{i}_{i}")}
        df = df.withColumns({name: F.when(varies[i], e).otherwise(0.0) for name, e in row.items()})
    return df.withColumns({"rank": sum((v.cast("int") for v in varies), F.lit(0)), "log_det": 2 * sum((F.log(F.col(f"l_{i}_{i}")) for i in range(_P)), F.lit(0.0))})


_ESTIMATE = ["key", "start", "n_subset", "rank", "log_det", *(f"mu_{i}" for i in range(_P)), *(f"w_{i}_{j}" for i, j in _PAIRS)]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row with features and an estimate."""
    centred = [F.col(name) / _STEPS - F.col(f"mu_{i}") for i, name in enumerate(FEATURES)]
    parts = [sum((F.col(f"w_{i}_{j}") * centred[j] for j in range(i + 1)), F.lit(0.0)) for i in range(_P)]
    return sum((part * part for part in parts), F.lit(0.0))


def _tail(distance: Column, n: Column, rank: Column) -> Column:
    """Probability of so great a distance from an estimate over ``n`` normal vectors: that of Hotelling's statistic for a new vector, chi-square's for large ``n``. An odd ``rank`` counts as the next even one."""

    def even(p: int) -> Column:
        m = n - p
        f = distance * (n * m / (n * n - 1.0))  # p times an F variable with p and m degrees of freedom
        rest = f / (m + f)
        term = total = F.lit(1.0)
        for k in range(1, p // 2):
            term = term * (m / 2 + (k - 1)) / k * rest
            total = total + term
        return F.exp(-m / 2 * F.log1p(f / m)) * total

    out = even(_P)
    for p in range(_P - 2, 0, -2):
        out = F.when(rank <= p, even(p)).otherwise(out)
    return out


def _median(rows: DataFrame, names: list[str]) -> DataFrame:
    """Medians (key, one column a name) of whole numbers, exact to 1/1,000: counts by value first, then a running sum over the values of a key."""
    cells = rows.select("key", F.posexplode(F.array(*(F.floor(F.col(n) / (_STEPS // 1000)) for n in names))).alias("i", "value")).groupBy("key", "i", "value").count()
    whole = Window.partitionBy("key", "i")
    running = cells.withColumn("below", F.sum("count").over(whole.orderBy("value"))).withColumn("all", F.sum("count").over(whole))
    middle = running.where("2 * below >= all").groupBy("key", "i").agg(F.min("value").alias("value"))
    return middle.groupBy("key").agg(*(F.max(F.when(F.col("i") == k, F.col("value"))).alias(n) for k, n in enumerate(names)))


_WIDE = lambda e: F.sum(e.cast("decimal(20,0)"))
_SUMS = ["n", *(f"s_{i}" for i in range(_P)), *(f"s_{i}_{j}" for i, j in _PAIRS)]


def _sums() -> list[Column]:
    """Integer sums of the features and their products."""
    return [F.count("*").alias("n"), *(_WIDE(F.col(x)).alias(f"s_{i}") for i, x in enumerate(FEATURES)), *(_WIDE(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s_{i}_{j}") for i, j in _PAIRS)]


def _moments() -> list[Column]:
    """Means ``mu_i`` and covariances ``c_i_j`` of a row of sums."""
    n = F.col("n").cast("double")
    mean = {i: F.col(f"s_{i}").cast("double") / n / _STEPS for i in range(_P)}
    return [*(m.alias(f"mu_{i}") for i, m in mean.items()), *((F.col(f"s_{i}_{j}").cast("double") / n / _STEPS**2 - mean[i] * mean[j]).alias(f"c_{i}_{j}") for i, j in _PAIRS)]


def _scatter() -> dict[tuple[int, int], Column]:
    return {p: F.col(f"c_{p[0]}_{p[1]}") for p in _PAIRS}


def estimates(members: DataFrame, *, share: float = 0.75) -> DataFrame:
    """Minimum-covariance-determinant estimates of ``members`` (key, features): a row for each key with location ``mu_i``, inverse factor ``w_i_j`` and ``n_subset``, the vectors that it rests on.

    The subset of a concentration step is all vectors in the distance bins up to the one that reaches ``share`` of the key's;
    a bin is 1/64 of a doubling. Starts: median and median deviations; mean and covariance of all. Steps of a key and
    start end when the determinant falls no more, so their number has no limit but is finite. The scatter gets the factor that makes it consistent for normal
    data, and nothing else. Statistics that do not vary within a key, or follow from the others, are left out of its factor, and ``rank`` counts the rest; a key where none varies has no row.
    """
    middle = written(_median(members, list(FEATURES)), "outlier-medians")
    named = middle.select("key", *(F.col(n).alias(f"m_{i}") for i, n in enumerate(FEATURES)))
    gap = {n: F.abs(F.col(n) - F.col(f"m_{i}") * (_STEPS // 1000)) for i, n in enumerate(FEATURES)}
    spread = _median(members.join(named, "key").select("key", *(e.alias(n) for n, e in gap.items())), list(FEATURES))
    centre = named.join(spread, "key").select("key", F.lit(0).alias("start"), *(((F.col(f"m_{i}") + 0.5) / 1000).alias(f"mu_{i}") for i in range(_P)), *(((1.4826 * F.col(FEATURES[i]) / 1000) ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS))
    whole = members.groupBy("key").agg(*_sums()).select("key", F.lit(1).alias("start"), *_moments())
    moments = written(centre.unionByName(whole), "outlier-moments")
    # A start is no subset: any step from it is accepted.
    starts = _factored(moments, _scatter()).withColumns({"rank": F.lit(_P + 1), "log_det": F.lit(0.0), "n_subset": F.lit(0).cast("long")})
    now = written(starts.select(*_ESTIMATE, F.lit(True).alias("open")), "outlier-estimates")
    group = Window.partitionBy("key", "start")
    while now.where("open").limit(1).count():
        near = members.join(now.where("open"), "key").withColumn("bin", F.floor(F.log2(_distance() + 2.0**-20) * _BINS))
        cells = near.groupBy("key", "start", "bin").agg(*_sums())
        running = cells.withColumn("all", F.sum("n").over(group)).withColumns({c: F.sum(c).over(group.orderBy("bin")) for c in _SUMS})
        reached = running.where(F.col("n") >= share * F.col("all")).withColumn("first", F.row_number().over(group.orderBy("bin"))).where("first = 1")
        stepped = _factored(reached.select("key", "start", F.col("n").alias("n_subset"), *_moments()), _scatter()).select(_ESTIMATE)
        before = now.select("key", "start", F.struct(*_ESTIMATE).alias("old"), "open")
        both = before.join(stepped.select("key", "start", F.struct(*_ESTIMATE).alias("new")), ["key", "start"], "left")
        falls = F.col("open") & ((F.col("new.rank") < F.col("old.rank")) | ((F.col("new.rank") == F.col("old.rank")) & (F.col("new.log_det") < F.col("old.log_det") - 1e-9)))
        chosen = both.select(F.when(falls, F.col("new")).otherwise(F.col("old")).alias("e"), (falls & (F.col("new.rank") > 0)).alias("open"))
        after = written(chosen.select("e.*", "open"), "outlier-estimates")
        discard(now)
        now = after
    best = now.groupBy("key").agg(F.min_by(F.struct(*(c for c in _ESTIMATE if c != "key")), F.struct("rank", "log_det", "start")).alias("e")).select("key", "e.*")
    factor = F.lit(_consistency(share, _P))
    for p in range(_P - 2, 0, -2):
        factor = F.when(F.col("rank") <= p, _consistency(share, p)).otherwise(factor)
    out = written(best.where("rank > 0").withColumns({f"w_{i}_{j}": F.col(f"w_{i}_{j}") / F.sqrt(factor) for i, j in _PAIRS}), "outlier-best")
    discard(middle, moments, now)
    return out


def _marks(*columns: str) -> dict[str, Column]:
    """Two digests of a row's ``columns``; a null differs from all values."""
    said = F.to_json(F.struct(*(F.isnull(c).alias(f"n{k}") for k, c in enumerate(columns))))
    return {"h1": F.xxhash64(said, *columns), "h2": F.xxhash64(F.lit("second"), said, *columns)}


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source"), vectors_per_statistic: int = 5, cutoff: float = 0.99999, share: float = 0.75, marks: bool = False) -> DataFrame:
    """Per row of ``docs``: id, ``COUNTS``, ``base_failed``, ``distance`` (squared) and ``tail`` (the probability of one so great), both null where nothing was estimated, ``level`` and ``kept``.

    Base rules: at least 50 words, and at most half of the words in three-word windows that occur twice or more.
    Rows that pass them are estimated per language and source. ``level`` says whose estimate a row was held against: that of its
    ``group``, of its ``language`` or of ``all`` rows; the next is taken where one does not vary at all or has too few different vectors, fewer than five for each statistic, below which such
    estimates are held to be unsound. Without any (null level) the base rules decide. A row is kept if it passes the base rules and its tail is at least 1 - ``cutoff``.
    Null languages and sources are groups of their own; a null or empty text has no words and fails. Null and repeated ids are rows of their own; of other
    columns nothing is read. An empty table gives an empty result. ``marks``: adds the digests ``h1`` and ``h2`` of what a verdict hangs on besides all other rows.
    """
    language, source = group_cols
    named = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), F.to_json(F.struct(F.col(language).alias("l"))).alias("__l"), F.to_json(F.struct(F.col(language).alias("l"), F.col(source).alias("s"))).alias("__g"), *(mark.alias(name) for name, mark in (_marks(text_col, language, source).items() if marks else ())))
    extra = ["h1", "h2"] if marks else []
    stats = transformed(word_statistics(named, text_col="__t", keep=("__id", "__l", "__g", *extra)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = written(stats.withColumn("base_failed", failed), "outlier-statistics")
    fit = stats.where("not base_failed")
    pending = written(fit.select("__g", "__l").distinct(), "outlier-groups")
    old, taken = [pending], []
    for level, key in (("group", F.col("__g")), ("language", F.col("__l")), ("all", F.lit("*"))):
        if not pending.limit(1).count():
            break
        keys = pending.select(key.alias("key")).distinct()
        vectors = written(fit.select(key.alias("key"), *FEATURES).join(keys, "key", "left_semi").distinct(), "outlier-vectors")
        enough = vectors.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= vectors_per_statistic * _P).select("key")
        found = estimates(vectors.join(enough, "key", "left_semi"), share=share)
        taken.append(pending.withColumn("key", key).join(found, "key").withColumn("level", F.lit(level)).drop("key", "__l"))
        rest = written(pending.withColumn("key", key).join(found.select("key"), "key", "left_anti").select("__g", "__l"), "outlier-groups")
        discard(vectors)
        old += [rest, found]
        pending = rest
    scored = stats
    if taken:
        takes = taken[0]
        for more in taken[1:]:
            takes = takes.unionByName(more)
        takes = written(takes, "outlier-taken")
        scored = stats.join(takes, "__g", "left")
        distance = F.when(~F.col("base_failed"), _distance())
        scored = scored.withColumn("distance", distance).withColumn("tail", _tail(F.col("distance"), F.col("n_subset").cast("double"), F.col("rank"))).withColumn("level", F.when(~F.col("base_failed"), F.col("level")))
    else:
        scored = scored.withColumns({"distance": F.lit(None).cast("double"), "tail": F.lit(None).cast("double"), "level": F.lit(None).cast("string")})
    discard(*old)
    kept = ~F.col("base_failed") & F.coalesce(F.col("tail") >= 1 - cutoff, F.lit(True))
    return scored.select(F.col("__id").alias(id_col), *COUNTS, "base_failed", "distance", "tail", "level", kept.alias("kept"), *extra)


def without_outliers(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source"), **settings) -> DataFrame:
    """``docs`` less the rows that ``judge`` does not keep. A verdict is found again by the text, language and source that it was made for, so it holds for
    all rows with them and lands on no other row, however rows are split and whatever their ids."""
    gone = judge(docs, id_col=id_col, text_col=text_col, group_cols=group_cols, marks=True, **settings).where("not kept").select("h1", "h2").distinct()
    own = _marks(*(docs[c] for c in (text_col, *group_cols)))
    return docs.join(gone, (own["h1"] == gone["h1"]) & (own["h2"] == gone["h2"]), "left_anti")
