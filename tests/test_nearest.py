"""Nearest neighbours by blocks, held against all products."""

import random

import numpy as np
import pytest

from millrace.operators import dedup


def vectors(draw, n, template, copies):
    """Unit vectors: some of one template with a term or two of their own, some free, some copies."""
    out = {}
    for k in range(n):
        if k and draw.random() < copies:
            out[k] = dict(out[draw.randrange(k)])
            continue
        terms = {f"t{j}": 1.0 + j % 3 for j in range(20)} if draw.random() < template else {f"f{draw.randrange(40)}": draw.choice([1.0, 2.0]) for _ in range(6)}
        for _ in range(draw.randint(0, 2)):
            terms[f"x{draw.randrange(60)}"] = draw.choice([0.5, 1.0])
        norm = sum(w * w for w in terms.values()) ** 0.5
        out[k] = {t: w / norm for t, w in terms.items()}
    return out


def brute(found, threshold, k):
    rows = {}
    for a, x in found.items():
        near = sorted((-round(sum(w * y.get(t, 0.0) for t, w in x.items()), 9), b) for b, y in found.items() if b != a)
        rows[a] = [(b, -s) for s, b in near if -s >= threshold - 1e-12][:k]
    return rows


def test_products():
    draw = np.random.default_rng(1)
    made = []
    for _ in range(2):
        made.append([(np.sort(draw.choice(300, draw.integers(1, 40), replace=False)).astype(np.int64), draw.random(0)) for _ in range(120)])
        made[-1] = [(t, draw.random(len(t))) for t, _ in made[-1]]
    full = [np.zeros((120, 300)) for _ in made]
    for matrix, side in zip(full, made):
        for row, (t, w) in enumerate(side):
            matrix[row, t] = w
    assert np.allclose(dedup.products(*made), full[0] @ full[1].T)


@pytest.mark.parametrize("template, copies, lists, block", [(0.8, 0.0, 5, 16), (0.5, 0.4, 5, 1000), (0.3, 0.2, 1000, 16)])
def test_nearest_are_those_of_all_products(spark, monkeypatch, template, copies, lists, block):
    monkeypatch.setattr(dedup, "LIST", lists)
    monkeypatch.setattr(dedup, "BLOCK", block)
    made = vectors(random.Random(lists + block), 150, template, copies)
    df = spark.createDataFrame([(i, t, w) for i, v in made.items() for t, w in v.items()], "id long, term string, weight double")
    wanted = brute(made, 0.9, 7)
    found = {}
    for r in dedup.nearest(df, 0.9, 7).collect():
        found.setdefault(r["a"], []).append((r["b"], r["similarity"]))
    for a, near in wanted.items():
        got = sorted(found.get(a, []), key=lambda x: (-round(x[1], 9), x[0]))
        assert [(b, round(s, 6)) for b, s in got] == [(b, round(s, 6)) for b, s in near], a


def test_a_hot_template_gives_rows_in_proportion(spark, monkeypatch):
    """1,500 prompts of one template that differ in a short word: each has its neighbours, and no step gives out their pairs."""
    monkeypatch.setattr(dedup, "BLOCK", 400)
    draw = random.Random(2)
    text = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 9))) for _ in range(130))
    rows = [(k, f"{text} {draw.choice('abcdefghijklmnopqrstuvwxyz')}{draw.choice('abcdefghijklmnopqrstuvwxyz')}") for k in range(1500)]
    terms = dedup.char_ngrams(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    near = dedup.nearest(dedup.tfidf(terms), 0.93, 7)
    assert near.count() == 7 * 1500 and near.select("a").distinct().count() == 1500
