"""The risk, its gradients and the class prior of the quality classifier against plain versions."""

import math

import numpy as np
import pytest

from loomstead.llm import quality_classifier as q


def plain_risk(w, p, u, prior):
    s = lambda x: 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, w, strict=True))))
    up = prior * sum(-math.log(s(x)) for x in p) / len(p)
    return up, sum(-math.log(1 - s(x)) for x in u) / len(u) - prior * sum(-math.log(1 - s(x)) for x in p) / len(p)


def test_gradients_are_those_of_the_risk():
    rnd = np.random.default_rng(1)
    p, u, w = rnd.normal(1, 1, (7, 3)), rnd.normal(0, 1, (11, 3)), rnd.normal(0, 1, 3)
    up, negative, down = q.gradients(w, p, u, 0.4)
    assert negative == pytest.approx(plain_risk(w, p, u, 0.4)[1])
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        a, b = plain_risk(w + e, p, u, 0.4), plain_risk(w - e, p, u, 0.4)
        assert up[k] == pytest.approx((a[0] - b[0]) / 2e-6, abs=1e-5) and down[k] == pytest.approx((a[1] - b[1]) / 2e-6, abs=1e-5)


def test_least_ratio_counts_scores_above_each_cut():
    rnd = np.random.default_rng(2)
    p, u = rnd.integers(0, 9, 40).astype(float), rnd.integers(0, 7, 60).astype(float)
    margin = sum(math.sqrt(math.log(4 / q.DOUBT) / (2 * n)) for n in (40, 60))
    share = lambda x, c: sum(v >= c for v in x) / len(x)
    best = min(set(p), key=lambda c: (share(u, c) + margin) / share(p, c))
    assert q.least_ratio(p, u) == pytest.approx(share(u, best) / share(p, best))


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_prior_is_found_without_negatives(prior):
    rnd = np.random.default_rng(3)
    good, bad = (lambda n: rnd.normal(2, 1, (n, 4))), (lambda n: rnd.normal(-2, 1, (n, 4)))
    n = int(2000 * prior)
    u = np.concatenate([good(n), bad(2000 - n)])
    assert abs(q.class_prior(good(1500), u[rnd.permutation(2000)]) - prior) < 0.06
    assert q.class_prior(good(1), u) == 0.5


def test_repeated_rows_and_ids_give_the_same_scores(spark):
    good, bad = "The river runs past the old mill and the town beyond it. ", "buy $$$ now ### click *** "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5)) for i in range(80)]
    labels = spark.createDataFrame([(i, 1) for i in range(1, 80, 4)], "doc_id long, quality int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    twice = once.union(once).union(spark.createDataFrame([(4, None), (None, good), (200, "")], "doc_id long, text string")).repartition(7)
    a = {r["doc_id"]: r for r in q.quality_scores(once, labels).collect()}
    assert all(a[i]["predicted"] == i % 2 for i in range(80))
    b = q.quality_scores(twice, labels).collect()
    again = q.quality_scores(twice.repartition(3), labels).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["score"])
    assert len(b) == 163 and sorted(b, key=key) == sorted(again, key=key)
    assert [r["predicted"] for r in b if r["doc_id"] is None] == [1]
