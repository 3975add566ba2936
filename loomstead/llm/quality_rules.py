"""Quality rules with an isolation forest on rule statistics (operator 6).

Every text gives rule statistics (counts, and ratios made of them). A forest of
random splits is grown on at most ``FIT_ROWS`` labelled clean documents, those with
the smallest keyed hashes, in a box that also holds as many labelled bad ones;
a document's anomaly grows as its mean path gets shorter. The threshold is
calibrated on all labelled rows, from counts of each score: it makes
``CLEAN_WEIGHT`` times the share of clean rows lost plus the share of bad rows
missed least. A document is kept if it passes the base rules and stays below it.

Results for odd input: null and empty texts have no words and fail the base
rules; without labelled rows only the base rules decide; rows are judged one by
one, repeated or not, null doc_ids too; extra columns are ignored, and pass
through ``keep_good`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, texts
from .text_stats import COUNTS, REST, shape, stats

FIT_ROWS, TREES, SAMPLE = 4096, 128, 256
#: A share of clean rows lost counts as so many times that share of the others missed.
CLEAN_WEIGHT = 10
BINS = 2000
MIN_WORDS, MAX_REPEAT = 20, 30
_EULER = 0.5772156649015329


def view(counts: np.ndarray) -> np.ndarray:
    """The ratios that the forest sees: none that tells a short text from a long one."""
    return shape(counts)[:, [1, 2, 4, 5, 7, 8, 9]]


def _mean_path(n) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + _EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Random axis splits of a box that holds all of ``around``, until they part samples of ``rows``.

    anomaly() is 2 ** -(mean path / expected path). As splits fall anywhere in the box, a statistic in
    which all rows agree still parts them from texts that differ in it.
    """

    def __init__(self, rows: np.ndarray, around: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7):
        random = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.deep = 2 * max(1, int(np.ceil(np.log2(max(2, self.sample)))))
        box = np.stack([around.min(0), around.max(0)])
        self.trees = [self._tree(rows[random.choice(len(rows), self.sample, replace=False)], box, random) for _ in range(trees)]

    def _tree(self, rows, box, random):
        feature, value, child, path = [], [], [], []

        def grow(part, box, depth):
            at = len(feature)
            feature.append(-1), value.append(0.0), child.append(0), path.append(depth + float(_mean_path(len(part))))
            wide = np.flatnonzero(box[1] > box[0])
            if depth < self.deep and len(part) > 1 and len(wide):
                f = int(random.choice(wide))
                v = float(random.uniform(box[0, f], box[1, f]))
                feature[at], value[at] = f, v
                low, high = box.copy(), box.copy()
                low[1, f] = high[0, f] = v
                below = part[:, f] < v
                grow(part[below], low, depth + 1)
                child[at] = len(feature)
                grow(part[~below], high, depth + 1)

        grow(rows, box, 0)
        return np.array(feature), np.array(value), np.array(child), np.array(path)

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, value, child, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.deep):
                f = feature[at]
                go = f >= 0
                less = rows[np.arange(len(rows)), np.maximum(f, 0)] < value[at]
                at = np.where(go, np.where(less, at + 1, child[at]), at)
            total += path[at]
        return 2.0 ** -(total / len(self.trees) / max(float(_mean_path(self.sample)), 1e-9))


NAMES = COUNTS + REST
_TYPES = [pa.int64()] * len(NAMES)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [c for _, _, c, _, _ in stats(batch.column("text"))]
        c = np.concatenate(parts) if parts else np.zeros((0, len(NAMES)), np.int64)
        yield pa.record_batch([batch.column("doc_id"), *[pa.array(c[:, k]) for k in range(c.shape[1])]], names=["doc_id", *NAMES])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text."""
    return texts(docs).select("doc_id", "text").mapInArrow(_counted, "doc_id long, " + ", ".join(f"{n} long" for n in NAMES))


def _matrix(batch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(n)) for n in NAMES], 1) if batch.num_rows else np.zeros((0, len(NAMES)), np.int64)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT * counts[:, 0])


def fit(counted: DataFrame, labels: DataFrame):
    """(forest, threshold) from the labelled rows; (None, infinity) without clean ones."""
    spark = counted.sparkSession
    known = counted.join(labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")), "doc_id")
    clean = f"quality = 1 and n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT} * n_words"

    def drawn(rule: str) -> np.ndarray:
        return view(_matrix(known.where(rule).orderBy(F.xxhash64(F.lit("forest"), "doc_id"), "doc_id", *NAMES).limit(FIT_ROWS).toArrow()))

    rows = drawn(clean)
    if not len(rows):
        return None, np.inf
    forest = Forest(rows, np.concatenate([rows, drawn("quality = 0")]))
    told = spark.sparkContext.broadcast(forest)

    def binned(batches):
        for batch in batches:
            c = _matrix(batch)
            at = np.minimum((told.value.anomaly(view(c)) * BINS).astype(np.int64), BINS - 1)
            use = ~base_failed(c)
            yield pa.record_batch([pa.array(at[use]), batch.column("quality").cast(pa.int32()).filter(pa.array(use))], names=["bin", "quality"])

    counts = known.mapInArrow(binned, "bin long, quality int").groupBy("bin", "quality").count().collect()  # 2 x BINS rows at most
    at = np.zeros((2, BINS + 1))
    for r in counts:
        at[int(r.quality == 1), r.bin] += r["count"]
    # With the threshold at a bin's lower edge: clean rows lost, others missed.
    lost = np.cumsum(at[1][::-1])[::-1] / max(at[1].sum(), 1)
    missed = np.concatenate(([0], np.cumsum(at[0])[:-1])) / max(at[0].sum(), 1)
    cost = CLEAN_WEIGHT * lost + missed
    return forest, float(np.flatnonzero(cost <= cost.min() + 1e-12)[-1] / BINS)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and anomaly of every document."""
    spark, store = docs.sparkSession, Scratch(docs.sparkSession)
    counted = store.save(statistics(docs))
    forest, threshold = fit(counted, labels)
    told = spark.sparkContext.broadcast((forest, threshold))

    def judged(batches):
        forest, threshold = told.value
        for batch in batches:
            c = _matrix(batch)
            failed = base_failed(c)
            anomaly = forest.anomaly(view(c)) if forest else np.zeros(len(c))
            yield pa.record_batch([batch.column("doc_id"), *[batch.column(n) for n in COUNTS], pa.array(failed), pa.array(~failed & (anomaly < threshold)), pa.array(anomaly)], names=["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    return counted.mapInArrow(judged, "doc_id long, " + ", ".join(f"{n} long" for n in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    spark, store = docs.sparkSession, Scratch(docs.sparkSession)
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    counted = store.save(statistics(docs).join(wanted, "doc_id", "left_semi"))
    told = spark.sparkContext.broadcast(fit(counted, labels))
    store.drop(counted)

    def kept(batches):
        forest, threshold = told.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
            parts = [c for _, _, c, _, _ in stats(column)]
            c = np.concatenate(parts) if parts else np.zeros((0, len(NAMES)), np.int64)
            good = ~base_failed(c)
            if forest:
                good &= forest.anomaly(view(c)) < threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(kept, docs.schema)
