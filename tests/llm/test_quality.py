"""The robust estimate of the quality rules held against a plain one in NumPy."""

import collections
import math
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from millrace.llm import outliers

SF = "/root/testdata/sf0.01"


def plain_estimate(vectors, share=0.75):
    """Location, covariance of the subset, its size: concentration steps from two starts over distinct whole vectors, subsets closed by bins of 1/64 doubling."""
    x = np.asarray(sorted(set(vectors)))
    lower = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
    middle = lower(x // 10)
    spread = lower(np.abs(x - middle * 10) // 10)
    y = x / 10_000
    found = []
    for mean, scatter in (((middle + 0.5) / 1000, np.diag((1.4826 * spread / 1000) ** 2)), (y.mean(0), np.cov(y.T, bias=True))):
        last = math.inf
        while True:
            d = y - mean
            bins = np.floor(np.log2(np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter), d) + 2.0**-20) * 64)
            subset = y[bins <= np.sort(bins)[math.ceil(share * len(y)) - 1]]
            new = subset.mean(0), np.cov(subset.T, bias=True)
            det = np.linalg.slogdet(new[1])[1]
            if not det < last - 1e-9:
                break
            last, (mean, scatter), n = det, new, len(subset)
        found.append((last, mean, scatter, n))
    return min(found, key=lambda e: e[0])[1:]


def test_estimates_and_verdicts_are_those_of_a_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = outliers.judge(docs).join(docs, "doc_id").collect()
    stats = {}
    for r in rows:
        words = regex.findall("[^\x20\x09-\x0d]+", r.text or "")
        letters, upper, n, chars = len(regex.findall(r"\p{L}", r.text or "")), len(regex.findall(r"\p{Lu}", r.text or "")), len(words), sum(map(len, words))
        assert (r.n_distinct, r.n_letters, r.n_upper) == (len(set(words)), letters, upper)
        if not r.base_failed:
            values = (math.log(chars / n), math.log1p(len(set(words))) / math.log1p(n), math.log((chars - letters + 0.5) / (letters + 0.5)), math.log((upper + 0.5) / (chars - upper + 0.5)))
            stats[r.doc_id] = tuple(round(v * 10_000) for v in values)
    groups, languages = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        if not r.base_failed:
            groups[r.lang, r.source].append(stats[r.doc_id])
            languages[r.lang].append(stats[r.doc_id])
    made, levels = {}, collections.Counter()
    for r in rows:
        if r.base_failed:
            assert r.level is None and r.distance is None and not r.kept
            continue
        own = len(set(groups[r.lang, r.source])) >= 20
        assert r.level == ("group" if own else "language")
        levels[r.level] += 1
        key = (r.lang, r.source) if own else r.lang
        if key not in made:
            made[key] = plain_estimate((groups if own else languages)[key])
        mean, scatter, n = made[key]
        p, share = 4, 0.75
        low, high = 0.0, 100.0  # the quantile of chi-square with 4 degrees, for the factor of consistency
        for _ in range(80):
            low, high = ((low + high) / 2, high) if 1 - math.exp(-(low + high) / 4) * (1 + (low + high) / 4) < share else (low, (low + high) / 2)
        factor = share / (1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8))
        d = np.asarray(stats[r.doc_id]) / 10_000 - mean
        distance = d @ np.linalg.inv(scatter * factor) @ d
        assert r.distance == pytest.approx(distance, rel=1e-6)
        m = n - p
        x = m / (m + distance * n * m / (n * n - 1))
        tail = x ** (m / 2) * (1 + m / 2 * (1 - x))
        assert r.tail == pytest.approx(tail, rel=1e-5, abs=1e-300) and r.kept == (tail >= 1e-5)
    assert levels["group"] > 100 and levels["language"] > 100


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def prose(rng, n):
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    words = [word().capitalize() if rng.random() < 0.1 else word() + rng.choice(["", "", "", ",", "."]) for _ in range(n)]
    return " ".join(words)


def test_copies_give_no_certainty_and_small_groups_borrow(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(60, 400)), "en", "a") for i in range(60)]
    copy = prose(rng, 200)
    rows += [(1000 + i, copy, "en", "a") for i in range(600)]  # nine of ten rows of the group are copies
    rows += [(2000 + i, prose(rng, 100), "en", "b") for i in range(5)] + [(3000 + i, copy, None, None) for i in range(40)]
    rows += [(4000, None, "en", "a"), (4001, "", "en", None), (4002, " ".join(w + "$$$$$$" for w in prose(rng, 150).split()), "en", "a")]
    found = {r.doc_id: r for r in outliers.judge(documents(spark, rows)).collect()}
    assert sum(found[i].kept for i in range(60)) >= 58 and found[1000].kept and found[1599].kept
    assert found[0].level == "group" and found[2000].level == "language" and found[3000].level == "all" and not found[4002].kept
    assert not found[4000].kept and not found[4001].kept and found[4000].base_failed


def test_statistics_that_do_not_vary_are_left_out(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(3, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(60, 300))), "en", "s") for i in range(100)]  # no capitals, no marks
    rows += [(1000, " ".join(word() + "###" for _ in range(100)), "en", "s")]
    found = {r.doc_id: r for r in outliers.judge(documents(spark, rows)).collect()}
    assert not found[1000].kept and sum(found[i].kept for i in range(100)) >= 98
    same = documents(spark, [(i, " ".join(f"w{k:03}" for k in range(80)), "en", "s") for i in range(40)])
    assert [(r.level, r.kept) for r in outliers.judge(same).select("level", "kept").distinct().collect()] == [(None, True)]


def test_verdicts_land_on_their_own_rows(spark):
    rng = random.Random(3)
    rows = [(k % 3 or None, prose(rng, 30 + k), rng.choice(["en", None]), "a") for k in range(60)]
    docs = documents(spark, rows).withColumns({"distance": F.lit("x"), "kept": F.lit("y"), "key": F.lit(1), "h1": F.lit("z"), "__id": F.lit(2)})
    out = outliers.without_outliers(docs)
    assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == sorted(t for _, t, *_ in rows if len(t.split()) >= 50)
