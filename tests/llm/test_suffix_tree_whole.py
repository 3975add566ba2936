"""The suffix tree's size isn't bounded by the corpus size, and its contexts can be longer than two words."""

import math
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from test_llm_operators import corpus, frame, words

from loomstead.llm import suffix_tree
from loomstead.llm.scratch import Scratch


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def plain_model(train, depth):
    end = "</>"
    seqs = [[*words(t), end] for t in train]
    n = Counter(w for s in seqs for w in s)
    total, size = sum(n.values()), len(n)
    states = {}

    def prob(context, w):
        if not context:
            return (n[w] + 0.5) / (total + 0.5 * (size + 1))
        weight, p = states.get(context, (1.0, {}))
        return p.get(w, weight * prob(context[1:], w))

    counts = {(w,): c for w, c in n.items()}
    for k in range(1, depth + 1):
        longer = Counter()
        for s in seqs:
            longer.update(tuple(x) for x in zip(*[[end, *s][i:] for i in range(k + 1)]))
        longer = {g: c for g, c in longer.items() if c >= suffix_tree.LEAST}
        by = defaultdict(dict)
        for g, c in longer.items():
            by[g[:-1]][g[-1]] = c
        found = {}
        for s, nexts in by.items():
            weight = 1 - sum(c - suffix_tree.DISCOUNT for c in nexts.values()) / counts[s]
            p = {w: (c - suffix_tree.DISCOUNT) / counts[s] + weight * prob(s[1:], w) for w, c in nexts.items()}
            gain = sum(c * math.log(p[w] / prob(s[1:], w)) for w, c in nexts.items()) + (counts[s] - sum(nexts.values())) * math.log(weight)
            if gain / counts[s] >= suffix_tree.DIVERGENCE:
                found[s] = (weight, p)
        states.update(found)
        counts = longer
    return prob, states, end


def test_contexts_of_four_words(spark):
    rows = corpus()
    prob, states, end = plain_model([t for i, t in rows if not held(i)], 4)
    assert any(len(s) == 4 for s in states)
    want = []
    for i, t in rows:
        s, score = [end, *words(t), end], 0.0
        for k in range(1, len(s)):
            score += math.log10(prob(tuple(s[max(0, k - 4) : k]), s[k]))
        want.append((i if i is not None else 10**9, score))
    got = [(10**9 if r.doc_id is None else r.doc_id, r.score) for r in suffix_tree.score_texts(frame(spark, rows), depth=4).collect()]
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], rel=1e-9)


def test_few_counts_are_kept_in_a_large_corpus(spark):
    train = [i for i in range(50) if not held(i)][:4]
    new = next(i for i in range(50) if held(i))
    rows = [(train[0], "a " * 4_500_000), *[(i, "seldom pair") for i in train[1:]], (new, "seldom pair")]
    r = next(r for r in suffix_tree.score_texts(frame(spark, rows)).collect() if r.doc_id == new)
    assert r.score - r.base_score > 10


def test_a_shuffle_is_gone_before_the_next_one_writes(spark, monkeypatch):
    top = [Path(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {p: p.stat().st_size for d in top for p in d.rglob("shuffle_*.data") if p.exists()}
    save, made, left, before = Scratch.save, {}, [], files()
    stays = lambda: sum(n for p, n in files().items() if p in made and n > 100)  # noqa: E731  totals of one row are smaller

    def watched(self, frame):
        end = time.time() + 2
        while stays() and time.time() < end:  # files go a moment after their shuffle
            time.sleep(0.05)
        left.append(stays())
        out = save(self, frame)
        made.update({p: n for p, n in files().items() if p not in before})
        return out

    monkeypatch.setattr(Scratch, "save", watched)
    suffix_tree.score_texts(frame(spark, corpus()))
    assert sum(n > 100 for n in made.values()) > 8 and left == [0] * len(left)


def test_parts_change_no_score(spark):
    rows = corpus()
    of = lambda n: sorted((r.doc_id is None, r.doc_id, r.n_known, round(r.score, 9)) for r in suffix_tree.score_texts(frame(spark, rows), depth=3, rounds=n).collect())
    assert of(1) == of(None)
