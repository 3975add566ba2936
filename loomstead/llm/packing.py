"""Packing by shortest-pack-first over the length histogram (operator 8).

A document's ids, and the end id, are cut at every 2,048; each cut is a full
sequence, the rest is a piece to be packed. Only the histogram of piece lengths
(2,048 counts at most) comes to the driver. Lengths are placed longest first,
each into the shortest open pack if it fits, else into a new one; equal packs
are one pattern with a count. Every slot of a pattern stands for a range of
ranks among the pieces of its length. A piece's rank is its place among those
of its length in its task, counted as ids are made, plus a prefix sum over the
tasks, so documents find their slots by rank without a shuffle of texts.

The pieces are stored before ranks are used, so a lost executor can't change
a rank.

Results for odd input: null and empty texts have the end id alone; rows are
packed one by one, repeated or not, a null doc_id too; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import BYTES, SPACES, folded, grouped, hashes, slices, spans
from .scratch import Scratch, texts

SEQUENCE, END = 2048, 1
#: Words whose ids a worker keeps; with more it begins anew.
CACHE = 600_000
# The pattern by which the tokenizer splits texts, and its step that makes white space one blank.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE_STEP = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
#: Signs that this pattern always parts from a letter before them.
SIGNS = b".,;:!?#*$%&()[]"
SIGN = np.isin(BYTES, list(SIGNS))
_made: dict[str, tuple] = {}


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_words(path: str) -> bool:
    """Whether the tokenizer is known never to join what stands on the two sides of white space, or a letter and a sign of SIGNS after it."""
    with open(path) as f:
        made = json.load(f)
    steps = made.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = steps.get("normalizers", [steps])
    known = all(x["type"] in ("NFC", "Lowercase") or x == SPACE_STEP for x in steps)
    first = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return known and any(x["type"] == "Lowercase" for x in steps) and first.get("pattern", {}).get("Regex") == PRE_SPLIT and first.get("behavior") == "Removed" and first.get("invert") is True


class Ids:
    """Ids of texts. Where the tokenizer is known to split at white space and signs, ids are made once per word and kept; else per text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.splits = Tokenizer.from_file(path), splits_words(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}  # a word's hash to its place in ends
        self.ends, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        ids, sizes = [np.zeros(0, np.uint32)], []
        for a in range(0, len(texts), 4096):
            made = [x.ids for x in self.tokenizer.encode_batch_fast(texts[a : a + 4096], add_special_tokens=False)]
            sizes += map(len, made)
            ids.append(np.fromiter(chain.from_iterable(made), np.uint32))
        return np.concatenate(ids), np.array(sizes, np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encode, for words of letters alone: many are one text, as the last id of each is one that ends a word."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), 256):
            some = words[a : a + 256]
            made = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.closing[made])
            if len(last) == len(some) and last[-1] == len(made) - 1:
                many = np.diff(last, prepend=-1)
            else:  # a step of the tokenizer has made several words of one
                made, many = self._encode(some)
            ids.append(made)
            sizes.append(many)
        return np.concatenate(ids), np.concatenate(sizes)

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of the texts: the first row, all ids, and where each text's ids begin."""
        if not self.splits:
            for i in range(0, len(column), 256):
                ids, sizes = self._encode(column.slice(i, 256).to_pylist())
                yield i, ids, np.concatenate(([0], np.cumsum(sizes)))
            return
        for i, _, data, offsets in slices(column, 1 << 20):
            raw = data.tobytes()
            if b"<|" not in raw:  # lower case is the tokenizer's own step, and may come first unless special tokens may be meant
                data = folded(data)
                raw = data.tobytes()
            # The pattern always parts an ASCII letter and a sign of SIGNS after it.
            letter, sign = data - np.uint8(0x61) < 26, SIGN[data]
            edges = np.sort(np.concatenate([offsets, np.flatnonzero(letter[:-1] & sign[1:]) + 1]))
            starts, ends, _ = spans(data, edges, SPACES)
            begin = np.searchsorted(starts, offsets)
            h = hashes(data, starts, ends)
            order, first = grouped(h)
            word = np.empty(len(h), np.int64)
            word[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
            at = self._places(raw, h[order[first]].tolist(), starts[order[first]].tolist(), ends[order[first]].tolist())[word]
            sizes = self.ends[at + 1] - self.ends[at]
            to = np.concatenate(([0], np.cumsum(sizes)))
            yield i, self.pool[np.arange(to[-1]) + np.repeat(self.ends[at] - to[:-1], sizes)], to[begin]

    def _places(self, raw: bytes, keys: list[int], starts: list[int], ends: list[int]) -> np.ndarray:
        """Of distinct words, their places among those kept; new ones are encoded."""
        known = self.known
        if len(known) + len(keys) > CACHE:
            new = sum(k not in known for k in keys)
            if len(known) + new > CACHE:
                self._clear()
                known = self.known
        new = [k for k, x in enumerate(keys) if x not in known]
        if new:
            words = [raw[starts[k] : ends[k]].decode("utf-8", "replace") for k in new]
            for alone, encode in ((True, self._encode_words), (False, self._encode)):
                some = [(k, w) for k, w in zip(new, words, strict=True) if w.isalpha() == alone]
                if some:
                    ids, sizes = encode([w for _, w in some])
                    for k, _ in some:
                        known[keys[k]] = len(known)
                    self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
                    self.pool = np.concatenate([self.pool, ids])
        return np.array([known[x] for x in keys], np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _made:
        _made[path] = Ids(path)
    ids, task, count = _made[path], TaskContext.get().partitionId(), np.zeros(SEQUENCE + 1, np.int64)
    end = np.array([END], np.uint32).tobytes()
    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for i, found, begin in ids(batch.column("text")):
            rows, begin = [], begin.tolist()
            for doc, a, b in zip(doc_ids[i:], begin, begin[1:], strict=False):
                data = found[a:b].tobytes() + end
                n = b - a + 1
                for start in range(0, n, SEQUENCE):
                    length = min(SEQUENCE, n - start)
                    rows.append((doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, task, count[length]))
                    count[length] += 1
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"])


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths) that hold all pieces of the histogram in packs of at most ``size``."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    totals: list[int] = []  # a heap of the totals with open packs

    def put(total, count, pattern):
        if not open_packs[total]:
            heapq.heappush(totals, total)
        open_packs[total].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        while left:
            while totals and not open_packs[totals[0]]:
                heapq.heappop(totals)
            if totals and totals[0] + length <= size:
                total = totals[0]
                count, pattern = open_packs[total].pop()
                used = min(count, left)
                if count > used:
                    open_packs[total].append((count - used, pattern))
                elif not open_packs[total]:
                    heapq.heappop(totals)
                left -= used
                put(total + length, used, (*pattern, length))
            else:
                put(length, left, (length,))
                left = 0
    return [x for total in sorted(open_packs) for x in open_packs[total]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) of its slots in order of rank."""
    used: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            out[length].append((used[length], base, offset))
            used[length] += count
            offset += length
        base += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    spark, store = docs.sparkSession, Scratch(docs.sparkSession)
    path = tokenizer or _default_tokenizer()
    names = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long"
    pieces = store.save(texts(docs).select("doc_id", "text").mapInArrow(lambda it: _pieces(it, path), names))
    counts = store.save(pieces.groupBy("task", "length").agg((F.max("nth") + 1).alias("n")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # 2,048 rows at most
    told = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram)))

    def placed(batches):
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(np.concatenate(([-1], length[order], [-1]))))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                who = order[s:e]
                table = told.value[int(length[who[0]])]
                at = np.searchsorted(table[:, 0], rank[who], "right") - 1
                sequence[who], offset[who] = table[at, 1] + rank[who] - table[at, 0], table[at, 2]
            yield pa.record_batch([*[batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # Ranks by task and length grow with the tasks, so they are never broadcast.
    ranked = pieces.join(offsets.hint("shuffle_hash"), ["task", "length"]).withColumn("rank", F.col("nth") + F.col("ranks"))
    return ranked.mapInArrow(placed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
