"""N-gram Jaccard join by parity sketches (operator 10).

A text's set holds its distinct k-word shingles. Every set is XOR-hashed into
parity sketches: a dense one of 1,024 bits (and one that grows with large sets),
whose Hamming distance is at most the symmetric difference of two sets, and, for
each size band, a long one cut into parts. If two sets reach the Jaccard threshold t, their symmetric
difference is at most (1 - t) / (1 + t) of the sum of their sizes, d. A part
that differs holds an element of the difference, so at most d of the occupied
parts of either set differ. By the pigeonhole principle the two share a part
among the first d + 1 of each in any order that is the same for all sets; the
order puts parts last in which only frequent shingles lie. Those parts are the
join's keys. Candidate pairs then pass the sizes, the Hamming distance of the
dense sketches and an exact count of the shared shingles.

Equal sets are one node. In a key's group, all nodes are first compared with
the smallest one; only in groups that then lie in two or more components are
the remaining pairs across components compared. So a group of n near copies
costs about n comparisons, and no link that joins components is lost.

Results for odd input: null and empty texts, and texts without words, have
empty sets and are linked with nothing; a null doc_id is its own row with a
null component; rows with one doc_id are one document with the sets of each;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import mix, packed, shingle_sets
from .scratch import Scratch

SHINGLE = 5
#: The threshold as a fraction, 75 / 100.
NUMERATOR, DENOMINATOR = 75, 100
#: A shingle is frequent if it is in more than one of so many documents; so there are at most
#: FREQUENT x (mean shingles of a document) frequent ones.
FREQUENT = 500
#: Shingles in one block of local counts, keys in one packed bucket.
BLOCK, BUCKET = 1 << 21, 1 << 21
SKETCH_WORDS = 16
#: Sets over this size also have a sketch that grows with them.
WIDE = 512


def band_limits(top: int = 1 << 40) -> np.ndarray:
    """Smallest size of each band; a set's partners lie in its own band and its two neighbours."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, -(-out[-1] * DENOMINATOR // NUMERATOR)))
    return np.array(out, np.int64)


LIMITS = band_limits()


def parts_of(high: int) -> int:
    """Parts of the long sketch of a band.

    The fewer, the more shingles meet in a part and the less often it equals another set's by
    chance; but a set must fill more than d of them. So few are for large sets alone: with these,
    a set fills d or fewer with odds under 1e-20.
    """
    return 4 * high if high <= 256 else high if high <= 1024 else high // 2


def keys_of(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The join keys of a set: for its band and the next, the first d + 1 occupied parts."""
    a, out = len(tokens), []
    band = int(np.searchsorted(LIMITS, a, "right")) - 1
    most = a * DENOMINATOR // NUMERATOR
    for key_band in (band, band + 1):
        high = int(LIMITS[key_band + 1])
        other = min(high - 1, most)
        if other < LIMITS[key_band]:
            continue
        d = (a + other) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
        heat = None
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
            heat = np.where(frequent[at] == tokens, rank[at], 0)
        if high <= 64:  # each shingle has a part of its own
            word = mix(tokens)
        else:
            part = mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(parts_of(high))
            order = np.argsort(part, kind="stable")
            part = part[order]
            edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            word = mix(np.bitwise_xor.reduceat(mix(tokens[order]), edge) + part[edge] * np.uint64(0xD6E8FEB86659FD93))
            if heat is not None:
                heat = np.minimum.reduceat(heat[order], edge)
        word = mix(word + np.uint64((key_band + 1) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))
        if d + 1 < len(word):
            if heat is not None and heat.any():
                word = word[np.lexsort((word, heat))[: d + 1]]
            else:
                word = np.partition(word, d)[: d + 1]
        out.append(word)
    return np.concatenate(out)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """1,024 bits: the parity of the number of shingles that fall on each."""
    bits = np.bincount((tokens >> np.uint64(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_sketch(tokens: np.ndarray) -> bytes | None:
    """For a set over WIDE, the parities of as many bits as it has shingles, or up to twice as many."""
    if len(tokens) <= WIDE:
        return None
    size = 1 << int(len(tokens)).bit_length()
    bits = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def far_apart(a: bytes, b: bytes, total: int) -> bool:
    """Whether wide sketches show that sets of ``total`` shingles together differ in too many; halves of the longer are XORed until sizes agree."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return (DENOMINATOR + NUMERATOR) * int(np.bitwise_count(x ^ y).sum()) > (DENOMINATOR - NUMERATOR) * total


def _wide_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n = (batch.column(c).to_pylist() for c in ("a", "b", "total"))
        keep = pa.array([x is None or y is None or not far_apart(x, y, t) for x, y, t in zip(a, b, n, strict=True)], pa.bool_())
        yield batch.select(["u", "v"]).filter(keep)


FACTS = "kind int, doc_id long, n long, sig binary, sketch array<long>, wide binary"


def _facts(batches: Iterator[pa.RecordBatch], k: int, frequent: int) -> Iterator[pa.RecordBatch]:
    """kind 0: a row for each text; kind 1: shingles (sig) that many texts of a block hold, and how many (n)."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("sketch", pa.list_(pa.int64())), ("wide", pa.binary())])
    held, size, texts = [], 0, 0

    def block():
        nonlocal held, size, texts
        if held:
            tokens, count = np.unique(np.concatenate(held), return_counts=True)
            take = count >= max(3, texts / frequent)
            n = int(take.sum())
            out = pa.record_batch([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(count[take].astype(np.int64)), pa.array([packed(x) for x in tokens[take]], pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())], schema=schema)
            held, size, texts = [], 0, 0
            return out
        return None

    for batch in batches:
        ns, sigs, sketches, wide = [], [], [], []
        for tokens in shingle_sets(batch.column("text"), k):
            ns.append(len(tokens))
            sigs.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
            sketches.append(sketch(tokens))
            wide.append(wide_sketch(tokens))
            if len(tokens):
                held.append(tokens)
                size, texts = size + len(tokens), texts + 1
            if size >= BLOCK and (out := block()) is not None:
                yield out
        n = len(ns)
        flat = pa.array(np.concatenate(sketches) if n else np.zeros(0, np.int64))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, SKETCH_WORDS * n + 1, SKETCH_WORDS, dtype=np.int32)), flat)
        yield pa.record_batch([pa.array(np.zeros(n, np.int32)), batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), rows, pa.array(wide, pa.binary())], schema=schema)
    if (out := block()) is not None:
        yield out


KEYS = "bucket long, keys binary, high binary, doc binary, ids binary"


def _keys(batches: Iterator[pa.RecordBatch], k: int, buckets: int, frequent) -> Iterator[pa.RecordBatch]:
    """Keys of every set, packed by bucket: 40 bits of the key and the place of the id in a list of ids."""
    hot, rank = frequent.value
    schema = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("high", pa.binary()), ("doc", pa.binary()), ("ids", pa.binary())])
    seen: set[bytes] = set()
    held, ids, size = [], [], 0

    def flush():
        nonlocal held, ids, size
        key, doc = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held])
        bucket = (key >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        key, doc, names = key[order], doc[order], np.array(ids, np.int64)
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            who, doc_at = np.unique(doc[part], return_inverse=True)
            rows.append((int(b), packed(key[part].astype(np.uint32)), packed((key[part] >> np.uint64(32)).astype(np.uint8)), packed(doc_at.astype(np.uint16)), packed(names[who])))
        held, ids, size = [], [], 0
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)

    for batch in batches:
        for doc, tokens in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), k), strict=True):
            if doc is None or not len(tokens):
                continue
            sig = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
            if sig in seen:  # equal sets are one node; once a task is enough
                continue
            if len(seen) < 1 << 19:
                seen.add(sig)
            held.append(keys_of(tokens, hot, rank))
            ids.append(doc)
            size += len(held[-1])
            if size >= BLOCK or len(ids) == 1 << 16:
                yield flush()
    if held:
        yield flush()


def _groups(table: pa.Table) -> pa.Table:
    """Of one bucket, the (key, lead, node) rows of keys that two or more documents have; lead is the smallest, node another."""
    key, doc = [], []
    for r in table.to_pylist():
        key.append(np.frombuffer(r["keys"], np.uint32).astype(np.uint64) | np.frombuffer(r["high"], np.uint8).astype(np.uint64) << np.uint64(32))
        doc.append(np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["doc"], np.uint16)])
    bucket = table.column("bucket")[0].as_py()
    key, doc = np.concatenate(key), np.concatenate(doc)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    lead = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    take = doc != lead
    take[1:] &= new[1:] | (doc[1:] != doc[:-1])
    gid = (np.uint64(bucket) << np.uint64(40) | key[take]).astype(np.int64)
    return pa.table({"gid": pa.array(gid), "lead": pa.array(lead[take]), "node": pa.array(doc[take])})


def _verified(table: pa.Table, k: int) -> pa.Table:
    """Of one leader's rows and those compared with it, the pairs that reach the threshold."""
    table = table.sort_by([("lead", "descending")])
    docs, lead, leader, sets = table.column("doc_id").to_pylist(), table.column("lead").to_pylist(), [], shingle_sets(table.column("text"), k)
    out = []
    for doc, first, b in zip(docs, lead, sets, strict=True):
        if first:
            leader.append(b)
            continue
        for a in leader:
            both = len(np.intersect1d(a, b, assume_unique=True))
            if DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both):
                out.append(doc)
                break
    return pa.table({"u": pa.array([docs[0]] * len(out), pa.int64()), "v": pa.array(out, pa.int64())})


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node that it reaches.

    Alternating large-star and small-star steps; each is two aggregations on the shuffled edges,
    and nothing of the graph comes to the driver but a count and a checksum.
    """
    now = keep.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        step = keep.save(small.where("u <> v").distinct())
        keep.drop(now)
        now = step
        is_now = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if is_now == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = is_now


def _near(x: str, y: str) -> F.Column:
    """Sizes and the dense sketches' Hamming distance allow the pair."""
    size = f"{DENOMINATOR} * least({x}.n, {y}.n) >= {NUMERATOR} * greatest({x}.n, {y}.n)"
    far = " + ".join(f"bit_count({x}.sketch[{i}] ^ {y}.sketch[{i}])" for i in range(SKETCH_WORDS))
    return F.expr(f"{size} and {DENOMINATOR + NUMERATOR} * cast({far} as bigint) <= {DENOMINATOR - NUMERATOR} * ({x}.n + {y}.n)")


def jaccard_join(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark, keep = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    frequent = FREQUENT
    all_facts = keep.save(rows.mapInArrow(lambda it: _facts(it, k, frequent), FACTS))
    facts = all_facts.where("kind = 0").select("doc_id", "n", "sig", "sketch")
    n_docs, n_keys = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    # At most FREQUENT x mean shingles rows: each stands for over n_docs / FREQUENT of them.
    hot = all_facts.where("kind = 1").groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") > max(20, n_docs / frequent)).collect()
    tokens = np.array([np.frombuffer(r.sig, np.uint64)[0] for r in hot], np.uint64)
    order = np.argsort(tokens)
    rank = np.array([1 + r.n.bit_length() for r in hot], np.int8)[order]
    told = spark.sparkContext.broadcast((tokens[order], rank))

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_keys // BUCKET + 1)
    keys = rows.mapInArrow(lambda it: _keys(it, k, buckets, told), KEYS)
    groups = keep.save(keys.groupBy("bucket").applyInArrow(_groups, "gid long, lead long, node long"))

    # Equal sets: the smallest id stands for all.
    equal = keep.save(facts.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sig", "rep"))
    copies = keep.save(facts.where("n > 0").join(equal, "sig").where("doc_id <> rep").select("doc_id", "rep").distinct())
    sized = facts.where("doc_id is not null").select(F.col("doc_id").alias("node"), "n", "sketch")

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs that an exact count confirms; a leader's partners are dealt out in groups of about 64."""
        parts = pairs.groupBy("u").agg((F.count(F.lit(1)) / 64).cast("long").alias("parts"))
        dealt = pairs.join(parts, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts") + 1))
        want = dealt.select("u", "part", F.col("v").alias("doc_id"), F.lit(0).alias("lead")).unionByName(dealt.select("u", "part", F.col("u").alias("doc_id"), F.lit(1).alias("lead")).distinct())
        # One exchange of the texts by id at every size, however few pairs there are; only those compared move on.
        return rows.join(want.hint("merge"), "doc_id").groupBy("u", "part").applyInArrow(lambda t: _verified(t, k), "u long, v long")

    def standing(frame: DataFrame, *names: str) -> DataFrame:
        """The frame with the ids of equal sets' documents replaced by the smallest."""
        for name in names:
            rep = copies.select(F.col("doc_id").alias("__id"), F.col("rep").alias("__rep"))
            frame = frame.join(rep, frame[name] == rep["__id"], "left").withColumn(name, F.coalesce("__rep", name)).drop("__id", "__rep")
        return frame

    big = all_facts.where("kind = 0 and wide is not null and doc_id is not null").select("doc_id", "wide")

    def wide_near(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v, small, total) that the wide sketches allow."""
        both = pairs.where(F.col("small") > WIDE).join(big.select(F.col("doc_id").alias("u"), F.col("wide").alias("a")), "u")
        both = both.join(big.select(F.col("doc_id").alias("v"), F.col("wide").alias("b")), "v").select("u", "v", "a", "b", "total")
        return pairs.where(F.col("small") <= WIDE).select("u", "v").unionByName(both.mapInArrow(_wide_near, "u long, v long").distinct())

    first = standing(groups.select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct(), "u", "v").where("u <> v")
    first = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    with_v = sized.alias("y").join(first, F.col("y.node") == F.col("v")).select("y.*", "u")
    near = sized.alias("x").join(with_v.alias("y"), F.expr("x.node = y.u")).where(_near("x", "y"))
    pairs = keep.save(wide_near(near.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), F.least("x.n", "y.n").alias("small"), (F.col("x.n") + F.col("y.n")).alias("total")).distinct()))
    # Those that the sketches refuse would be refused again, so only those left are remembered as compared.
    tested = pairs
    edges = keep.save(links(pairs))
    roots = components(edges, keep)

    # All have been compared with their leaders. Groups whose others still lie in several components: compare those across.
    placed = standing(groups, "node").join(roots, "node", "left").select("gid", "node", F.coalesce("root", "node").alias("root"))
    open_ = placed.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("gid")
    rest = keep.save(placed.join(open_, "gid", "left_semi").distinct().join(sized, "node"))
    across = rest.alias("x").join(rest.alias("y"), F.expr("x.gid = y.gid and x.node < y.node and x.root <> y.root") & _near("x", "y"))
    more = across.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), F.least("x.n", "y.n").alias("small"), (F.col("x.n") + F.col("y.n")).alias("total")).distinct()
    more = keep.save(wide_near(more.join(tested, ["u", "v"], "left_anti")))
    if not more.isEmpty():
        more_edges = keep.save(links(more).unionByName(edges))
        keep.drop(edges)
        roots = components(more_edges, keep)

    final = facts.join(copies, "doc_id", "left").withColumn("node", F.coalesce("rep", "doc_id"))
    final = final.join(roots, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("component_id"))
    keep.drop(rest, groups, pairs, more)
    return final


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without all but the smallest doc_id of each component; columns as they are.

    Documents with a null doc_id stay.
    """
    drop = jaccard_join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__drop")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["__drop"], "left_anti")
