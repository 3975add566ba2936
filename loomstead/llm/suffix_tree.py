"""Language-model scoring with a probabilistic suffix tree (operator 1).

Symbols are words (A-Z lower-cased) and an end symbol that closes every text
and stands before its first word. The root's distribution is that of all words
of the training texts, (c + 1/2) / (N + (V + 1) / 2). Contexts of up to
``depth`` words are states of the tree if a divergence test finds that their
next words differ from those of their suffix:
sum over next words of p(w | s) ln (p(w | s) / p(w | suffix)) >= DIVERGENCE.
A state's distribution keeps next words seen often enough (LEAST times),
discounts each, and gives what is left to the distribution of its longest
suffix in the tree. A text's score is the sum of log10 p(word | longest suffix
state).

Counts go over all training texts. LEAST doesn't depend on the corpus, so the
tree grows with it; it is held as tables, and neither words nor states come to
the driver or are broadcast. log p(word | longest suffix state) is the sum of
the root's log p(word), the log weights of the states that end before the word,
and, for each kept next word, what it adds to its suffix's log p less that
weight. Every such term belongs to one run of words. For each length of runs,
the places of all runs are shuffled by the run's hash, packed per source (texts
that lie together) and bucket; where they meet, runs are counted, and places of
runs seen too seldom to matter are dropped. The places left meet the terms of
their runs once these are known, and their sums go back to the texts. Runs of
several words are counted in parts (ROUNDS) by ranges of their hashes, so that no
more than a part of them is in a shuffle at a time; a shuffle's files are let go
of before the next one writes its own.

Results for odd input: a null text is empty, that is one end symbol; a null
doc_id is in the training texts and not held out; rows are scored one by one,
repeated or not, and repeated rows count as often; without training texts all
probabilities are 1; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import SPACES, grouped, mix, packed, slices, spans, word_hashes
from .scratch import Scratch, remainder, texts

LEAST, DISCOUNT, DIVERGENCE = 3, 0.75, 0.02
#: Words in the longest contexts of the query.
DEPTH = 3
#: The end symbol's hash; no word has it but by chance.
END = np.uint64(0x8F1BBCDC5A827999)
#: Places that a task packs at a time (under 1 << 22), and about how many make a bucket.
BLOCK, BUCKET = 1 << 20, 1 << 19
#: Texts with the same uid >> RUN are one source. A place is RUN bits, HELD if the text is held out, and NEXT if
#: it belongs to the same run as the place before it.
RUN, HELD, NEXT = 13, 0x8000, 0x4000
#: Bytes of a hash that are shuffled with places.
WIDTH = 7
#: Parts by hash in which runs of 1, 2, ... words are counted, the last for all longer ones: most for runs of three,
#: as the places of pairs, the most that are stored, lie beside them.
ROUNDS = (1, 2, 3, 2)
#: Buckets of counting that are one when terms meet their places.
MERGED = 12
_ODD, _MASK = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 8 * WIDTH) - 1)


def sequences(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, where each text begins) with an end symbol after every text."""
    for i, j, data, offsets in slices(column):
        h, begin, _, _ = word_hashes(data, offsets)
        out = np.insert(h, begin[1:], END)
        yield i, j, out, begin + np.arange(len(begin))


def runs(h: np.ndarray, begin: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of ``order`` symbols end, and the hashes of each run, of it without its last and without its first symbol."""
    h = h & _MASK
    key, left, right = h, h, h
    for n in range(2, order + 1):
        left, right = np.empty_like(key), key
        left[1:] = key[:-1]
        if n == 2:
            left[begin[:-1]] = END & _MASK
        key = joined(left, right)
    if order < 3:
        at = np.arange(len(h))
    else:
        whole = np.ones(len(h), bool)
        for n in range(order - 2):
            whole[np.minimum(begin[:-1] + n, begin[1:] - 1)] = False
        at = np.flatnonzero(whole)
    return at, key[at], left[at], right[at]


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _ODD + right) & _MASK


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by ranges of the keys' low 42 bits, so that places sorted by them lie in order of bucket."""
    return ((keys << np.uint64(22)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _schema(names: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split(" ") for x in names.split(", "))])


def _rows(names: str, n: int, **columns) -> pa.RecordBatch:
    """n rows with the given columns, nulls elsewhere."""
    schema = _schema(names)
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _packed_rows(names: str, rows: list[tuple], **same) -> pa.RecordBatch:
    """Rows of values of the columns that ``same`` doesn't give."""
    columns = [x.split(" ")[0] for x in names.split(", ")]
    given = dict(zip([c for c in columns if c not in same], zip(*rows, strict=True), strict=False))
    return _rows(names, len(rows), **given, **{k: [v] * len(rows) for k, v in same.items()})


SENT = "bucket long, kind int, source long, lefts binary, rights binary, places binary"


def _short(x: np.ndarray) -> bytes:
    """The low WIDTH bytes of each number."""
    x = np.ascontiguousarray(x)
    return np.ndarray((len(x),), f"V{WIDTH}", x, strides=(8,)).tobytes() if len(x) else b""


def _long(x: bytes) -> np.ndarray:
    if not x:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(x) // WIDTH,), "<u8", x + b"\0", strides=(WIDTH,)) & _MASK


def _places(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(source, symbols, where each text begins, places) of texts of one source that lie together."""
    for batch in batches:
        uid, fold = np.asarray(batch.column("uid")), np.asarray(batch.column("fold"))
        source, place = uid >> RUN, (uid & ((1 << RUN) - 1) | np.where(fold == 1, HELD, 0)).astype(np.uint16)
        for i, j, h, begin in sequences(batch.column("text")):
            cuts = [i, *(i + 1 + np.flatnonzero(source[i + 1 : j] != source[i : j - 1])).tolist(), j]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield int(source[a]), h[begin[a - i] : begin[b - i]], begin[a - i : b - i + 1] - begin[a - i], place[a:b]


def _sent(batches, order: int, buckets: int, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Kind 1: runs of ``order`` symbols with their places, packed by source and bucket, of one part of all buckets."""
    held, size, now = [], 0, None
    low, high = buckets * part // parts, buckets * (part + 1) // parts

    def flush():
        nonlocal held, size
        key, left, right, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held, size = [], 0
        for a in range(0, len(key), 1 << 22):
            yield _packed_rows(SENT, list(_by_bucket(key[a : a + (1 << 22)], left, right, place, a, order, buckets)), kind=1, source=now)

    for source, h, begin, place in _places(batches):
        if held and (size >= BLOCK or source != now):
            yield from flush()
        now = source
        at, key, left, right = runs(h, begin, order)
        place = np.repeat(place, np.diff(begin))[at]
        if parts > 1:
            bucket = bucket_of(key, buckets)
            take = np.flatnonzero((bucket >= low) & (bucket < high))
            key, left, right, place = key[take], left[take], right[take], place[take]
        if len(key):
            held.append((key, left, right, place))
            size += len(key)
    if held:
        yield from flush()


def _by_bucket(key, left, right, place, a: int, order: int, buckets: int):
    """(bucket, lefts, rights, places): each run once, and its places."""
    both = np.sort(key << np.uint64(22) | np.arange(len(key), dtype=np.uint64))
    at = (both & np.uint64((1 << 22) - 1)).astype(np.int64)
    key = key[at]
    at += a
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(new)
    bucket, start = bucket_of(key[first], buckets).astype(np.int64), at[first]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(first)]))
    lefts, rights = _short(left[start] if order > 1 else left[:0]), _short(right[start])
    places = place[at] | np.where(new, 0, NEXT).astype(np.uint16)
    ends = np.append(first, len(key))
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        mine = slice(WIDTH * s, WIDTH * e)
        yield int(bucket[s]), lefts[mine], rights[mine], packed(places[ends[s] : ends[e]])


def _cut(column: list[bytes], width: int) -> np.ndarray:
    """Where the values of each row begin when all are put together."""
    return np.concatenate(([0], np.cumsum([len(x) // width for x in column], dtype=np.int64)))


MET = "kind int, key long, ctx long, suffix long, c long, bucket long, source long, keys binary, places binary"


def _met(table: pa.Table, order: int, least: float) -> pa.Table:
    """Of one bucket, kind 0: runs counted at least ``least`` times in training texts; kind 1: the places of these runs."""
    rights = table.column("rights").to_pylist()
    cut, right = _cut(rights, WIDTH), _long(b"".join(rights))
    left = _long(b"".join(table.column("lefts").to_pylist()))
    del rights
    places = table.column("places").to_pylist()
    place_cut, places = _cut(places, 2), np.concatenate([np.frombuffer(x, np.uint16) for x in places])
    key = joined(left, right) if order > 1 else right
    run_of = np.cumsum((places & NEXT) == 0) - 1
    seen = np.bincount(run_of, (places < HELD).astype(float), len(key)).astype(np.int64)
    at, first = grouped(mix(key))
    c = np.add.reduceat(seen[at], first)
    kept, lead = c >= least, at[first]
    stays = np.empty(len(key), bool)
    stays[at] = np.repeat(kept, np.diff(np.append(first, len(key))))
    lead, c = lead[kept], c[kept]
    more = {"ctx": left[lead].view(np.int64), "suffix": right[lead].view(np.int64)} if order > 1 else {}
    counted = _rows(MET, len(lead), kind=np.zeros(len(lead), np.int32), key=key[lead].view(np.int64), c=c, **more)
    place_stays = stays[run_of]
    rows, bucket = [], table.column("bucket")[0].as_py()
    for r, source in enumerate(table.column("source").to_pylist()):
        mine, where = slice(cut[r], cut[r + 1]), slice(place_cut[r], place_cut[r + 1])
        take = stays[mine]
        if take.any():
            rows.append((bucket, source, _short(key[mine][take]), packed(places[where][place_stays[where]])))
    out = [counted] + ([_packed_rows(MET, [(1, None, None, None, None, *r) for r in rows])] if rows else [])
    return pa.Table.from_batches(out)


def grown(nexts: DataFrame, below: DataFrame) -> DataFrame:
    """Next words (key, c, logp, value) of contexts that are runs in ``below`` (key, c, logp), with ctx.

    One of a context's rows has its ln weight as w if the context is a state; others have null.
    """
    rows = nexts.join(below.select(F.col("key").alias("suffix"), F.col("logp").alias("lower")), "suffix")
    rows = rows.join(below.select(F.col("key").alias("ctx"), F.col("c").alias("context")), "ctx")
    of_ctx = Window.partitionBy("ctx")
    rows = rows.withColumn("weight", 1 - F.sum(F.col("c") - DISCOUNT).over(of_ctx) / F.col("context"))
    rows = rows.withColumn("upper", F.ln((F.col("c") - DISCOUNT) / F.col("context") + F.col("weight") * F.exp("lower")))
    rest = F.col("context") - F.sum("c").over(of_ctx)
    gain = F.sum(F.expr("c * (upper - lower)")).over(of_ctx) + rest * F.ln("weight")
    rows = rows.withColumn("lead", F.col("key") == F.min("key").over(of_ctx)).withColumn("w", F.when(gain / F.col("context") >= DIVERGENCE, F.ln("weight")))
    logp = F.when(F.col("w").isNotNull(), F.col("upper")).otherwise(F.col("lower"))
    return rows.select("key", "c", logp.alias("logp"), F.coalesce(F.col("upper") - F.col("lower") - F.col("w"), F.lit(0.0)).alias("value"), "ctx", F.when(F.col("lead"), F.col("w")).alias("w"))


ASKED = "bucket long, kind int, source long, keys binary, places binary"
BACK = "source long, docs binary, known binary, base binary, score binary"
TEXTS = "source long, uid long, doc_id long, held_out boolean, n_tokens long"


def _values(batches, buckets: int) -> Iterator[pa.RecordBatch]:
    """Kind 2: (key, value) rows packed by bucket."""
    held, size = [], 0

    def block():
        nonlocal held, size
        keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
        held, size = [], 0
        order = np.argsort(keys << np.uint64(22))
        keys, values = keys[order], values[order]
        bucket = bucket_of(keys, buckets).astype(np.int64)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)])).tolist()
        return _packed_rows(ASKED, [(int(bucket[s]), _short(keys[s:e]), packed(values[s:e])) for s, e in zip(edges, edges[1:], strict=False)], kind=2, source=0)

    for batch in batches:
        if batch.num_rows:
            held.append((np.asarray(batch.column("key")).view(np.uint64), np.asarray(batch.column("value")).astype(float)))
            size += batch.num_rows
        if size >= BLOCK:
            yield block()
    if held:
        yield block()


def _texts(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uid, fold = np.asarray(batch.column("uid")), np.asarray(batch.column("fold"))
        for i, j, data, offsets in slices(batch.column("text")):
            _, _, begin = spans(data, offsets, SPACES)
            yield _rows(TEXTS, j - i, source=uid[i:j] >> RUN, uid=uid[i:j], doc_id=batch.column("doc_id").slice(i, j - i), held_out=fold[i:j] == 1, n_tokens=np.diff(begin) + 1)


def _answer(table: pa.Table, order: int, space: float) -> pa.Table:
    """Packed places become packed sums of what their runs add to their texts, a row for a source.

    Values of kind 2 are the runs' terms, those of kind 3 the counts of words (order 1), as values.
    """
    kind = np.asarray(table.column("kind"))
    asked = table.filter(pa.array(kind == 1))
    keys = asked.column("keys").to_pylist()
    cut, own = _cut(keys, WIDTH), _long(b"".join(keys))
    found = []
    for k in (2, 3):
        known = table.filter(pa.array(kind == k))
        every = np.concatenate([own, _long(b"".join(known.column("keys").to_pylist()))])
        value = np.concatenate([np.zeros(len(own)), np.frombuffer(b"".join(known.column("places").to_pylist()), np.float64)])
        sums = np.zeros(len(every))
        if len(every) > len(own):
            at, first = grouped(mix(every))
            sums[at] = np.repeat(np.add.reduceat(value[at], first), np.diff(np.append(first, len(at))))
        found.append(sums[: len(own)])
    score, count = found
    base = np.log10((count + 0.5) / space) if order == 1 else np.zeros(len(own))
    score = score + base
    source, places = (asked.column(c).to_pylist() for c in ("source", "places"))
    out, rows = [], sorted(range(len(source)), key=source.__getitem__)
    for name, same in groupby(rows, key=source.__getitem__):
        times, sums = np.zeros(1 << RUN, np.int64), np.zeros((2, 1 << RUN))
        for r in same:
            place = np.frombuffer(places[r], np.uint16)
            run, place = np.cumsum((place & NEXT) == 0) - 1 + cut[r], place & np.uint16(NEXT - 1)
            for to, x in zip((sums[0], sums[1]), (score, base), strict=True):
                if x is score or order == 1:
                    n = np.bincount(place, x[run])
                    to[: len(n)] += n
            n = np.bincount(place)
            times[: len(n)] += n
        docs = np.flatnonzero(times)
        first = (packed(times[docs].astype(np.uint32)), packed(sums[1][docs])) if order == 1 else (None, None)
        out.append((name, packed(docs.astype(np.uint16)), *first, packed(sums[0][docs])))
    return pa.Table.from_batches([_packed_rows(BACK, out)] if out else [], schema=_schema(BACK))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _whole(table: pa.Table, bottom: float) -> pa.Table:
    """The texts of one source with what all buckets have added; ``bottom`` is log10 p of a word never seen."""
    is_text = table.column("uid").is_valid()
    own = table.filter(is_text).combine_chunks()
    known, base, score = (np.zeros(1 << RUN) for _ in range(3))
    for r in table.filter(table.column("docs").is_valid()).select(["docs", "known", "base", "score"]).to_pylist():
        at = np.frombuffer(r["docs"], np.uint16)
        score[at] += np.frombuffer(r["score"], np.float64)
        if r["known"] is not None:
            known[at] += np.frombuffer(r["known"], np.uint32)
            base[at] += np.frombuffer(r["base"], np.float64)
    place = np.asarray(own.column("uid")) & ((1 << RUN) - 1)
    columns = {c: own.column(c).combine_chunks() for c in ("doc_id", "held_out", "n_tokens")}
    unknown = (np.bincount(place, np.asarray(own.column("n_tokens")), 1 << RUN) - known) * bottom
    base, score = base + unknown, score + unknown
    return pa.Table.from_batches([_rows(SCORED, len(own), **columns, n_known=known[place].astype(np.int64), base_score=base[place], score=score[place])])


def score_texts(docs: DataFrame, p_min: float = 0.0, depth: int = 2, rounds: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``depth`` is the number of words in the longest contexts; each word more is one more level, made by the same
    step. With p_min, words, states and next words also need that share of the training symbols. ``rounds`` is the
    number of parts in which runs of several words are counted, ROUNDS if None.
    """
    spark, store = docs.sparkSession, Scratch(docs.sparkSession)
    rows = texts(docs).select("doc_id", "uid", "text", remainder(F.col("doc_id")).alias("fold"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, size // (4 * BUCKET) + 1)

    def save(frame):
        out = store.save(frame)
        del frame
        for _ in range(2):  # Python's end of the frame reaches the JVM a little later, and only then do the shuffle's files go
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)
        return out

    def met(order, least):
        """Tables of runs of a length that are seen often enough, and of their places."""
        parts = rounds if rounds and order > 1 else ROUNDS[min(order, len(ROUNDS)) - 1]
        for part in range(parts):
            sent = rows.select("uid", "fold", "text").mapInArrow(lambda it, part=part: _sent(it, order, buckets, part, parts), SENT)
            yield save(sent.groupBy("bucket").applyInArrow(lambda t: _met(t, order, least), MET))

    def union(frames):
        out = frames[0]
        for x in frames[1:]:
            out = out.unionByName(x)
        return out

    def answered(order, places, terms):
        """Table of the sums that the places of runs of a length add to their texts; MERGED buckets at a time."""
        sent = union(places).where("kind = 1").select("bucket", "kind", "source", "keys", "places")
        for kind, x in terms:
            sent = sent.unionByName(x.mapInArrow(lambda it: _values(it, buckets), ASKED).withColumn("kind", F.lit(kind)))
        sent = sent.withColumn("bucket", F.expr(f"bucket div {MERGED}"))
        return save(sent.groupBy("bucket").applyInArrow(lambda t: _answer(t, order, space), BACK))

    places = list(met(1, 1))
    words = union(places).where("kind = 0").select("key", "c")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(LEAST, p_min * total)
    space = total + 0.5 * (distinct + 1)
    level, kept = words.where(F.col("c") >= least).withColumn("logp", F.log((F.col("c") + 0.5) / space)), None
    as_values = lambda x: x.select("key", (F.col("value") / math.log(10)).alias("value"))
    counts = [(3, words.select("key", F.col("c").cast("double").alias("value")))]
    sums = []
    for order in range(1, depth + 2):
        terms, more, after = counts if order == 1 else [(2, as_values(kept))], [], None
        if order <= depth:
            more = list(met(order + 1, least))
            nexts = union(more).where("kind = 0").select("key", "ctx", "suffix", "c")
            after = save(grown(nexts, level))
            states = after.where("w is not null").select(F.col("ctx").alias("key"), F.col("w").alias("value"))
            terms = [*terms, (2, as_values(states))]
        sums.append(answered(order, places, terms))
        store.drop(*places, *([] if kept is None else [kept]))
        places, kept = more, after
        if after is not None:
            level = after
    bottom = math.log10(0.5 / space)

    every = rows.mapInArrow(_texts, TEXTS)
    for x in sums:
        every = every.unionByName(x, allowMissingColumns=True)
    scored = every.groupBy("source").applyInArrow(lambda t: _whole(t, bottom), SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
