"""Benchmark decontamination by greedy string tiling (operator 7).

Tokens are lower-cased runs of letters and digits. A document and a benchmark
item that share ``MIN_MATCH`` consecutive tokens (found by rolling hashes) are
tiled: maximal matches are taken longest first, each marks its tokens in both
texts, and what of a match is still unmarked goes back to be taken later. The
item's coverage is the share of its tokens under tiles, whatever their order
in the document, so reordered passages count. A document is contaminated by an
item whose coverage reaches ``COVERAGE``.

The benchmark is taken in blocks of at most about ``BLOCK`` tokens, each small
enough for every executor, and all documents are read for each block; no text
is shuffled.

Results for odd input: null and empty documents and items match nothing; an
item under ``MIN_MATCH`` tokens has to stand as a whole; repeated documents and
items give repeated pairs; a null doc_id may be reported and is never dropped
by its id, but by its text; extra columns pass through as they are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import NOT_ALNUM, slices, spans, hashes, windows

MIN_MATCH, COVERAGE, BLOCK = 4, 0.6, 1 << 22


def tokens(column: pa.Array):
    """Word hashes and where each text's words begin, for slices (first row, end row)."""
    for i, j, data, offsets in slices(pc.utf8_lower(column.cast(pa.string()).fill_null(""))):
        starts, ends, begin = spans(data, offsets, NOT_ALNUM)
        yield i, j, hashes(data, starts, ends), begin


def tile(a: np.ndarray, b: np.ndarray, k: int, seeds: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiles (length, place in a, place in b) of at least k tokens, longest first, then leftmost.

    ``seeds`` are the places (in a, in b) of equal k-token windows, if already known.
    """
    if seeds is None:
        where: dict[bytes, list[int]] = {}
        for j in range(len(b) - k + 1):
            where.setdefault(b[j : j + k].tobytes(), []).append(j)
        seeds = [(i, j) for i in range(len(a) - k + 1) for j in where.get(a[i : i + k].tobytes(), ())]
    runs = []
    for i, j in sorted(seeds, key=lambda s: (s[0] - s[1], s[0])):
        if runs and runs[-1][1] - runs[-1][2] == i - j and runs[-1][1] + runs[-1][0] - k + 1 == i:
            runs[-1][0] += 1
        else:
            runs.append([k, i, j])
    heap = [(-n, i, j) for n, i, j in runs]
    heapq.heapify(heap)
    in_a, in_b, out = np.zeros(len(a), bool), np.zeros(len(b), bool), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = in_a[i : i + n] | in_b[j : j + n]
        if not taken.any():
            in_a[i : i + n] = in_b[j : j + n] = True
            out.append((n, i, j))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            if e - s >= k:
                heapq.heappush(heap, (-int(e - s), i + int(s), j + int(s)))
    return out


class Index:
    """Windows of a block of items: hash to (item, place)."""

    def __init__(self, ids: list, texts: list, k: int):
        self.ids, self.k, self.words = ids, k, []
        for _, _, h, begin in tokens(pa.array(texts, pa.string())):
            self.words += [h[begin[t] : begin[t + 1]] for t in range(len(begin) - 1)]
        sizes = {min(k, len(w)) for w in self.words if len(w)}
        self.by_size = {}
        for size in sizes:
            rows = [(t, w) for t, w in enumerate(self.words) if len(w) and min(k, len(w)) == size]
            h = np.concatenate([w for _, w in rows])
            begin = np.concatenate(([0], np.cumsum([len(w) for _, w in rows])))
            hashed, at, first = windows(h, begin, size)
            item = np.repeat([t for t, _ in rows], np.diff(first))
            place = at - np.repeat(begin[:-1], np.diff(first))
            order = np.argsort(hashed, kind="stable")
            near = np.zeros(1 << 22, bool)
            near[(hashed & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.by_size[size] = (hashed[order], item[order], place[order], near)

    def matches(self, h: np.ndarray, begin: np.ndarray, coverage: float):
        """(text, item, tiles, covered tokens) of the slice's texts that reach the coverage."""
        for size, (keys, item, place, near) in self.by_size.items():
            w, at, first = windows(h, begin, size)
            hit = np.flatnonzero(near[(w & np.uint64((1 << 22) - 1)).astype(np.int64)])
            low, high = np.searchsorted(keys, w[hit]), np.searchsorted(keys, w[hit], "right")
            hit, low, high = hit[high > low], low[high > low], high[high > low]
            if not len(hit):
                continue
            text = np.searchsorted(first, hit, "right") - 1
            pair: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for t, i, lo, hi in zip(text.tolist(), at[hit].tolist(), low.tolist(), high.tolist(), strict=True):
                for x in range(lo, hi):
                    pair.setdefault((t, int(item[x])), []).append((i - int(begin[t]), int(place[x])))
            for (t, x), seeds in sorted(pair.items()):
                b = self.words[x]
                reach = np.zeros(len(b) + 1, np.int64)
                js = np.array(sorted({j for _, j in seeds}))
                np.add.at(reach, js, 1)
                np.add.at(reach, js + size, -1)
                if (np.cumsum(reach) > 0).sum() < coverage * len(b):  # tiles cover no more than the seeds
                    continue
                tiles = tile(h[begin[t] : begin[t + 1]], b, size, seeds)
                covered = sum(n for n, _, _ in tiles)
                if covered >= coverage * len(b):
                    yield t, x, tiles, covered


def _indexes(benchmark: DataFrame, k: int):
    """Indexes of blocks of the benchmark, each of a bounded number of tokens (or one item)."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = size // (4 * BLOCK) + 1
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        if part:
            yield Index([r.item_id for r in part], [r.text for r in part], k)


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, k: int = MIN_MATCH) -> DataFrame:
    """doc_id, item_id, n_tiles, covered_tokens, item_tokens, coverage and tiles of every contaminated pair."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id long, item_id {kind}, n_tiles long, covered_tokens long, item_tokens long, coverage double, tiles array<struct<doc_word:long,item_word:long,length:long>>"
    out = None
    for index in _indexes(benchmark, k):
        told = spark.sparkContext.broadcast(index)

        def found(batches, told=told):
            index = told.value
            for batch in batches:
                ids, rows = batch.column("doc_id"), []
                for i, _, h, begin in tokens(batch.column("text")):
                    for t, x, tiles, covered in index.matches(h, begin, coverage):
                        n = len(index.words[x])
                        rows.append({"doc_id": ids[i + t].as_py(), "item_id": index.ids[x], "n_tiles": len(tiles), "covered_tokens": covered, "item_tokens": n, "coverage": covered / n, "tiles": [{"doc_word": p, "item_word": q, "length": m} for m, p, q in tiles]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

        part = rows.mapInArrow(found, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, k: int = MIN_MATCH) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    out = docs
    for index in _indexes(benchmark, k):
        told = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches, told=told):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, _, h, begin in tokens(batch.column(batch.schema.get_field_index("text"))):
                    for t, *_ in told.value.matches(h, begin, coverage):
                        keep[i + t] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out
