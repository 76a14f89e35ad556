"""Bounds that keep vectors from being sent for every two that share a rare term."""

import numpy as np

from millrace.operators import dedup


def test_sketches_bound_products():
    draw = np.random.default_rng(4)
    vectors = []
    for n in (1, 3, 40, 400, 400):
        t, w = draw.choice(2**62, n, replace=False).astype(np.int64), draw.random(n)
        vectors.append((t, w / np.sqrt((w * w).sum())))
    vectors += [(vectors[-1][0], vectors[-1][1][::-1].copy()), vectors[-1], (np.array([-5, 7]), np.array([0.6, 0.8]))]
    exact = dedup.products(vectors, vectors)
    made = [dedup.sketch(*v) for v in vectors]
    bound = np.array([[float(a.astype(float) @ b.astype(float)) * s * t for b, t in made] for a, s in made])
    assert (bound >= exact - 1e-9).all() and bound.max() < 1.3 and bound[3, 0] < 0.5


def test_vectors_that_share_rare_terms_alone_are_not_sent(spark, monkeypatch):
    """300 vectors, each two of a list share its rare terms and little else: only the one near pair is multiplied."""
    made, kept = {}, dedup.written

    def written(df, label):
        out = kept(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(dedup, "written", written)
    draw = np.random.default_rng(9)
    rows = []
    for k in range(300):
        terms = {f"rare{k % 3}": 0.4} | {f"w{t}": 1.0 for t in draw.choice(900, 60, replace=False)}
        if k == 299:
            terms = last | {"own": 0.1}
        last = terms
        norm = sum(w * w for w in terms.values()) ** 0.5
        rows += [(k, t, w / norm) for t, w in terms.items()]
    near = dedup.nearest(spark.createDataFrame(rows, "id long, term string, weight double"), 0.93, 7).collect()
    assert sorted((r.a, r.b) for r in near) == [(298, 299), (299, 298)]
    assert made["vector-some"] == 2 and made["vector-bounded"] < 60
