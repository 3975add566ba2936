"""Quality classifier by positive-unlabelled learning (operator 9).

Trusted positives are labelled rows of quality 1; the web text of all training
rows, without its labels, is unlabelled. A logistic model minimises the
non-negative unbiased risk  p R+(positives) + max(0, R-(unlabelled) - p R-(positives))
where p, the class prior, is estimated from positives and unlabelled text alone:
on rows that a first model didn't see, the smallest ratio of the unlabelled
share to the positive share above a cut. Rows of quality 0 are never told apart
from other text. Features are statistics of the text and hashed words; labels,
lang, source and doc_id are no inputs.

The fit uses at most ``FIT_ROWS`` rows of both kinds, those with the smallest
keyed hashes; rows whose crc32 remainder is 0 are in none of them. All documents
are scored, each on its whole text.

Results for odd input: null and empty texts are scored as empty; without
trusted positives every score is the prior 0.5; rows are scored one by one,
repeated or not, and of a repeated doc_id the smallest text is learnt from; a null
doc_id is not held out; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import mix
from .scratch import remainder, texts
from .text_stats import shape, stats

FIT_ROWS, WORDS, STEPS, RATE, CUT = 4000, 256, 400, 0.05, 0.3
#: Chance that a share in the prior's estimate is farther from the truth than its margin.
DOUBT = 0.1


def features(column: pa.Array) -> np.ndarray:
    """Of each text: shape ratios, their squares, and log shares of hashed words."""
    out = []
    for i, j, counts, h, begin in stats(column):
        n = j - i
        text_of = np.repeat(np.arange(n), np.diff(begin))
        bucket = (mix(h) % np.uint64(WORDS)).astype(np.int64)
        words = np.bincount(text_of * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS)
        s = shape(counts)
        out.append(np.hstack([s, s * s, np.sqrt(words / np.maximum(counts[:, :1], 1))]).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, 22 + WORDS), np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradients(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Of logistic losses: the gradient of the positive part of the risk, its negative part, and that part's gradient."""
    sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
    negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
    return -prior * p.T @ (1 - sp) / len(p), float(negative), u.T @ su / len(u) - prior * p.T @ sp / len(p)


class Model:
    """A linear scorer over standardised features."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float):
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(0), np.maximum(both.std(0), 1e-3)
        p, u = self._scaled(positive), self._scaled(unlabelled)
        w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
        for t in range(1, STEPS + 1):
            up, negative, down = gradients(w, p, u, prior)
            g = (up + down if negative >= 0 else -down) + 1e-3 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w = w

    def _scaled(self, x):
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([x, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._scaled(x) @ self.w)


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of unlabelled over share of positive scores at or above a cut, at the cut where it is surely least."""
    at = np.sort(positive)[::-1]
    above = np.arange(1, len(at) + 1) / len(at)
    mixed = np.searchsorted(-np.sort(unlabelled)[::-1], -at, "right") / len(unlabelled)
    margin = sum(np.sqrt(np.log(4 / DOUBT) / (2 * n)) for n in (len(positive), len(unlabelled)))
    best = int(np.argmin((mixed + margin) / above))
    return float(mixed[best] / above[best])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled text: each half is scored by a model of the other half; 0.5 of fewer than two rows."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    found = []
    for k in (0, 1):
        model = Model(positive[k::2], unlabelled[k::2], 0.5)
        found.append(least_ratio(*(model._scaled(x[1 - k :: 2]) @ model.w for x in (positive, unlabelled))))
    return float(np.clip(np.mean(found), 0.01, 0.99))


def _made(rows: DataFrame) -> np.ndarray:
    """Features of the texts of a bounded number of rows."""

    def made(batches):
        for batch in batches:
            f = features(batch.column("text"))
            at = pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32))
            yield pa.record_batch([pa.ListArray.from_arrays(at, pa.array(f.ravel()))], names=["f"])

    f = rows.select("text").mapInArrow(made, "f array<float>").toArrow().column("f").combine_chunks()
    return np.asarray(f.flatten(), np.float32).reshape(len(f), -1) if len(f) else np.zeros((0, 22 + WORDS), np.float32)


def fit(rows: DataFrame, labels: DataFrame) -> Model | None:
    rows = rows.where("fold <> 0")
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1")
    # The ids are drawn before texts move: a join of ids, then of the drawn ids with the texts.
    ids = rows.select("doc_id").where("doc_id is not null").distinct()

    def drawn(ids: DataFrame, name: str) -> np.ndarray:
        order = [F.xxhash64(F.lit(name), "doc_id"), F.col("doc_id")]
        few = ids.orderBy(*order).limit(FIT_ROWS)
        # in the same order wherever the rows were, so that halves and sums are the same
        return _made(rows.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(*order))

    positive, unlabelled = drawn(ids.join(good.select("doc_id"), "doc_id"), "positive"), drawn(ids, "unlabelled")
    return Model(positive, unlabelled, class_prior(positive, unlabelled)) if len(positive) and len(unlabelled) else None


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = texts(docs).select("doc_id", "text", remainder(F.col("doc_id")).alias("fold"))
    told = docs.sparkSession.sparkContext.broadcast(fit(rows, labels))

    def scored(batches):
        for batch in batches:
            score = told.value.score(features(batch.column("text"))).astype(float) if told.value else np.full(batch.num_rows, 0.5)
            held = np.asarray(batch.column("fold")) == 0
            yield pa.record_batch([batch.column("doc_id"), pa.array(held), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
