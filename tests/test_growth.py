"""Work that must not grow faster than the input."""

import hashlib
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from loomstead import plans
from loomstead.operators import catalog, graphs, integrity, simulations


def test_parts_of_one_name_meet_no_pairs(spark, tmp_path):
    # 60,000 parts of one name would be 3.6 billion pairs; a line break belongs to a name.
    rows = spark.range(60000).selectExpr("id as p_partkey", "case when id < 3 then 'a\\nb' else 'blue' end as p_name")
    rows.write.parquet(str(tmp_path / "part.parquet"))
    got = plans.QUERIES["jon_12_test_edges"](spark, str(tmp_path))
    assert {(r.dst, r["count"]) for r in got.groupBy("dst").count().collect()} == {(0, 3), (3, 59997)}


def plain_ttl_lru(accesses, capacity, ttl):
    """(hit, evicted) of each access (key, wall), with a walk over all entries for every victim."""
    held, out = {}, []
    for k, now in accesses:
        hit, evicted = k in held and (ttl == 0 or now - held[k][0] <= ttl), 0
        if not hit:
            evicted += held.pop(k, None) is not None
            stale = [(a, x) for x, (t, a) in held.items() if now - t >= ttl]
            if len(held) >= capacity and stale:
                del held[min(stale)[1]]
                evicted += 1
            held[k] = [now, now]
        held[k][1] = now
        out.append((hit, evicted))
    return out


def fold_ttl_lru(accesses, capacity, ttl):
    step = simulations.ttl_lru_cache(capacity, ttl)()
    return [(r["hit"], r["evicted"]) for r in (step({"bucket": "x", "event_id": i, "key": k, "wall": now}) for i, (k, now) in enumerate(accesses))]


def test_ttl_lru_is_exact_when_time_steps_back():
    rnd = random.Random(3)
    for capacity, ttl, keys, back in [(5, 20, 30, 0), (5, 20, 30, 25), (3, 0, 12, 15), (20, 100, 60, 25), (1, 5, 4, 3), (0, 9, 9, 28)]:
        now, accesses = 0, []
        for _ in range(3000):
            now += rnd.randrange(4) - (rnd.randrange(back) if back and rnd.random() < 0.1 else 0)
            accesses.append((rnd.randrange(keys), now))
        want = plain_ttl_lru(accesses, capacity, ttl)
        assert fold_ttl_lru(accesses, capacity, ttl) == want and sum(e for _, e in want) > 50, (capacity, ttl)


def test_ttl_lru_walks_over_no_fresh_entries():
    # 40,000 entries that are all fresh: a walk over them for each miss took 800 million steps.
    start = time.process_time()
    assert fold_ttl_lru([(i, i // 100) for i in range(40000)], 20, 3600) == [(False, 0)] * 40000
    assert time.process_time() - start < 5


def test_a_sample_is_drawn_without_a_limit_over_all_rows(spark, tmp_path):
    ids = [7] * 500 + [5] * 40 + list(range(100, 1555)) + [None] * 3
    rows = spark.createDataFrame([(i,) for i in ids], "segment_id long").repartition(5)
    hashed = F.sha2(F.concat(F.col("segment_id").cast("string"), F.lit(":42")), 256)
    want = sorted((hashlib.sha256(f"{i}:42".encode()).hexdigest(), i) for i in ids if i is not None) + [(None, None)] * 3
    for part in (1, 2, 3, 10, 3000):
        got = catalog.smallest(rows.select(hashed.alias("hash"), "segment_id"), "hash", "segment_id", part)
        assert [tuple(r) for r in got.collect()] == want[: -(-len(ids) // part)]
    assert catalog.smallest(rows.limit(0).select(hashed.alias("hash"), "segment_id"), "hash", "segment_id", 10).count() == 0
    rows.selectExpr("segment_id as o_orderkey", "'O' as o_orderstatus", "timestamp '2024-01-01' as o_orderdate", "1.0D as o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    drawn = plans.QUERIES["top_06_random_sample"](spark, str(tmp_path))
    assert "Limit" not in drawn._jdf.queryExecution().analyzed().toString() and [r.segment_id for r in drawn.collect()] == [i for _, i in want[:200]]


def test_stripes_are_coded_in_pieces_whatever_the_blob(spark):
    some = pa.array([bytes(range(256)) * 4 * 1500, b"", b"abc", b"z" * 1024 * 700])
    got = list(integrity.pieces(some, 1024))
    assert [[x[:3] for x in p] for p in got] == [[(0, 0, 1024)], [(0, 1024, 476), (1, 0, 1), (2, 0, 1), (3, 0, 546)], [(3, 546, 154)]]
    blobs = spark.createDataFrame([("a", bytearray(some[0].as_py())), ("b", bytearray(b"q" * 1500))], "object_key string, data binary")
    shards = integrity.erasure_encode(blobs)
    back = {r.object_key: bytes.fromhex(r.data) for r in integrity.joined(integrity.erasure_decode(shards.where("(shard_idx + stripe) % 3 <> 0"))).collect()}
    assert back == {"a": some[0].as_py(), "b": (b"q" * 1500).ljust(2048, b"\0")}


def test_parity_and_repair_make_no_row_of_a_word_and_no_join(spark):
    text = lambda df: df._jdf.queryExecution().analyzed().toString()
    blobs = spark.createDataFrame([("a", bytearray(b"x" * 9))], "object_key string, data binary")
    shards = integrity.erasure_encode(blobs, strip=2)
    marks = shards.select("object_key", "stripe", "shard_idx", F.sha2("data", 256).alias("hash"))
    assert "Generate" not in text(integrity.xor_parity(shards))
    # Shard 1 of the first stripe is lost and shard 5 spoilt; three of the second are.
    now = shards.where("not (stripe = 0 and shard_idx = 1)").withColumn("data", F.expr("case when stripe = 0 and shard_idx = 5 or stripe = 1 and shard_idx < 3 then x'3f' else data end"))
    per, back = integrity.verify_and_repair(now, marks)
    assert "Join" not in text(per) + text(back)
    assert sorted((r.stripe, r.corrupt, r.repairable) for r in per.collect()) == [(0, 2, True), (1, 3, False)]
    assert [(r.stripe, bytes(r.data)) for r in back.collect()] == [(0, b"x" * 8)]


def test_proofs_bring_a_tree_together_once(spark):
    base = spark.createDataFrame([("t", 0, i, hashlib.sha256(bytes([i])).hexdigest()) for i in range(6)], "object_key string, level int, idx int, hash string")
    proofs = integrity.merkle_proofs(base)
    assert "Join" not in proofs._jdf.queryExecution().analyzed().toString()
    # Places 4 and 5 have no neighbour on level 1.
    assert {(r.idx, tuple(s.level for s in r.siblings)) for r in proofs.collect()} == {(i, (0, 1, 2) if i < 4 else (0, 2)) for i in range(6)}


def test_repeated_edges_are_looked_for_after_dealing(spark):
    rows = spark.range(1500000).selectExpr("id % 300000 as src", "id % 7 as dst")
    edges = catalog.hierarchy_edges(rows, rows.selectExpr("dst as src", "src as dst"), "calls")
    assert edges.rdd.getNumPartitions() == 4 and edges.count() == edges.distinct().count() > 2000000


def test_pairs_of_blocks_are_scored_in_place(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(400, 0, -1)], "vec_id long, embedding array<float>")
    want = sorted(map(tuple, graphs.vector_topk_of_all(rows, rows.where("vec_id % 9 = 0")).collect()))
    monkeypatch.setattr(graphs, "SCORES", 1)  # a query at a time
    assert len(want) == 44 * 8 and sorted(map(tuple, graphs.vector_topk_of_all(rows, rows.where("vec_id % 9 = 0")).collect())) == want
