"""Ordered folds, trees, graphs and symbols against plain versions."""

import hashlib
import json
import os
import random
import zlib

from loomstead import plans
from loomstead.operators import catalog, graphs, integrity, simulations

SF = "/root/testdata/sf0.001"


def ordered(rows, *names):
    return sorted((r.asDict() for r in rows), key=lambda r: tuple(r[n] for n in names))


def test_clock_update_follows_received_clocks_and_keeps_32_bits(spark):
    top = 0xFFFFFFFF
    rows = [("a", 0, 5, 9, 3), ("a", 1, 20, 4, 7), ("a", 2, 6, 20, top), ("a", 3, 1, 1, 1), ("b", 0, 1, 0, 0)]
    got = simulations.fold_by_key(spark.createDataFrame(rows, "node_id string, event_id long, wall long, received_wall long, received_logical long"), "node_id", ["event_id"], simulations.clock_update, "node_id string, event_id long, clock_wall long, clock_logical long")
    # 9 is later than 0: 3 + 1; then 4 is earlier: max(4, 7) + 1; then beyond 32 bits: a later time and 0; then on from there
    want = [("a", 0, 9, 4), ("a", 1, 20, 8), ("a", 2, 21, 0), ("a", 3, 21, 2), ("b", 0, 1, 1)]
    assert [tuple(r.values()) for r in ordered(got.collect(), "node_id", "event_id")] == want


def test_gdsf_evicts_the_least_priority(spark):
    rnd = random.Random(4)
    rows = [("x", i, rnd.randrange(12), 0, rnd.randrange(1, 30)) for i in range(300)]
    size_of = {k: 1 + (k * 5) % 29 for k in range(12)}
    rows = [(b, i, k, w, size_of[k]) for b, i, k, w, _ in rows]
    got = simulations.fold_by_key(spark.createDataFrame(rows, "bucket string, event_id long, key long, wall long, size long"), "bucket", ["event_id"], simulations.gdsf_cache(60), "bucket string, event_id long, hit boolean, evicted int")
    clock, held, want = 0.0, {}, []
    for _, i, k, _, size in rows:
        hit, evicted = k in held, 0
        if not hit:
            while sum(size_of[x] for x in held) + size > 60:
                victim = min(held, key=lambda x: (held[x][0], x))
                clock, evicted = held.pop(victim)[0], evicted + 1
        times = held[k][1] + 1 if hit else 1
        held[k] = (clock + times / size, times)
        want.append((i, hit, evicted))
    assert [(r["event_id"], r["hit"], r["evicted"]) for r in ordered(got.collect(), "event_id")] == want
    assert sum(h for _, h, _ in want) > 20 and sum(e for _, _, e in want) > 20


def test_ttl_lru_takes_stale_entries_alone(spark):
    rows = [("x", 0, 1, 0, 1), ("x", 1, 2, 1, 1), ("x", 2, 3, 2, 1), ("x", 3, 1, 9, 1), ("x", 4, 4, 10, 1), ("x", 5, 2, 12, 1), ("x", 6, 1, 12, 1)]
    got = simulations.fold_by_key(spark.createDataFrame(rows, "bucket string, event_id long, key long, wall long, size long"), "bucket", ["event_id"], simulations.ttl_lru_cache(2, 10), "bucket string, event_id long, hit boolean, evicted int")
    # 2: full, nothing stale, no victim; 4: key 1 is stale (age 10) and goes; 5: key 2 is past its time, and key 3 is stale; 6: nothing is stale
    want = [(0, False, 0), (1, False, 0), (2, False, 0), (3, True, 0), (4, False, 1), (5, False, 2), (6, False, 0)]
    assert [(r["event_id"], r["hit"], r["evicted"]) for r in ordered(got.collect(), "event_id")] == want


def test_lifecycle_of_segments(spark):
    got = plans.QUERIES["str_01_lifecycle_fold"](spark, SF)
    by = {}
    for r in ordered(got.collect(), "segment_id", "seq"):
        by.setdefault(r["segment_id"], []).append((r["state"], r["outcome"]))
    assert {tuple(x) for x in by.values()} == {
        (("Reserved", "ok"),),
        (("Reserved", "ok"), ("Sealed", "ok"), ("Sealed", "AlreadySealed")),
        ((None, "Missing"), ("Reserved", "ok"), ("Deleted", "ok"), ("Deleted", "NotReserved")),
    }


def test_membership_accepts_in_order(spark):
    claims = [
        ("Dead", 0, 1, "a", False), ("Alive", 1, 1, "a", True), ("Suspect", 0, 9, "a", False), ("Suspect", 1, 1, "b", True),
        ("Suspect", 1, 9, "c", False), ("Suspect", 1, 2, "b", True), ("Alive", 1, 9, "b", False), ("Dead", 1, 1, "c", True),
        ("Alive", 1, 9, "c", False), ("Alive", 2, 1, "c", True), ("Left", 2, 1, "c", True), ("Alive", 2, 5, "c", False),
    ]
    rows = [("n", i, s, inc, v, o) for i, (s, inc, v, o, _) in enumerate(claims)]
    got = simulations.fold_by_key(spark.createDataFrame(rows, "node_id string, seq long, state string, incarnation long, version long, origin string"), "node_id", ["seq"], simulations.membership, "node_id string, seq long, accepted boolean, state string, incarnation long")
    assert [r["accepted"] for r in ordered(got.collect(), "seq")] == [c[-1] for c in claims]


def test_checksums_and_blob_lists(spark):
    for r in plans.QUERIES["fun_04_crc32"](spark, SF).collect():
        assert r.crc == zlib.crc32(r.object_key.encode())
    names = {str(x) for r in plans.QUERIES["src_12_blob_list"](spark, SF).collect() for x in r if str(x).endswith(".parquet")}
    assert {os.path.basename(n) for n in names} == {n for n in os.listdir(SF) if n.endswith(".parquet")}


def plain_root(hashes):
    while len(hashes) > 1:
        pairs = [(hashes[i], hashes[min(i + 1, len(hashes) - 1)]) for i in range(0, len(hashes), 2)]
        hashes = [hashlib.sha256(bytes.fromhex(a) + bytes.fromhex(b)).hexdigest() for a, b in pairs]
    return hashes[0]


def test_roots_and_levels_of_any_size(spark):
    sizes = [1, 2, 3, 5, 8, 300, 1025]
    leaf = lambda n, i: hashlib.sha256(f"{n}:{i}".encode()).hexdigest()
    base = spark.createDataFrame([(str(n), 0, i, leaf(n, i)) for n in sizes for i in range(n)], "object_key string, level int, idx int, hash string")
    want = {str(n): plain_root([leaf(n, i) for i in range(n)]) for n in sizes}
    assert {r.object_key: r.root for r in integrity.merkle_roots(base).collect()} == want
    top = {}
    for r in integrity.merkle_levels(base.where("object_key <> '1025'")).collect():
        top.setdefault(r.object_key, {})[r.level, r.idx] = r.hash
    for n in sizes[:-1]:
        level = max(x for x, _ in top[str(n)])
        assert top[str(n)][level, 0] == want[str(n)] and len(top[str(n)]) < 2 * n + 10
    proofs = integrity.merkle_proofs(base.where("object_key in ('8', '300', '1')")).withColumn("root", integrity.proven_root())
    got = {(r.object_key, r.idx): (len(r.siblings), r.root) for r in proofs.collect()}
    assert got["1", 0] == (0, want["1"]) and all(got["8", i] == (3, want["8"]) for i in range(8))
    assert all(got["300", i] == (9, want["300"]) for i in range(256))  # the last leaves lack siblings further up


def test_plans_grow_by_a_constant_a_level(spark):
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    edges = spark.createDataFrame([("a", "calls", "b")], "src string, predicate string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    counts = [scans(graphs.reach(edges, start, n)) for n in (2, 4, 6)]
    assert counts[2] - counts[1] == counts[1] - counts[0] <= 4


def test_reach_gives_least_levels(spark):
    rnd = random.Random(8)
    pairs = [(f"v{rnd.randrange(40)}", f"v{rnd.randrange(40)}") for _ in range(70)]
    edges = spark.createDataFrame([(a, "calls", b) for a, b in pairs + pairs[:5]] + [("v0", "uses_type", "t")], "src string, predicate string, dst string")
    for forward in (True, False):
        next_ = {}
        for a, b in pairs if forward else [(b, a) for a, b in pairs]:
            next_.setdefault(a, set()).add(b)
        level, now = {}, {pairs[0][not forward]}
        for n in range(1, 5):
            now = {y for x in now for y in next_.get(x, ())} - set(level)
            level.update(dict.fromkeys(now, n))
        start = spark.createDataFrame([(pairs[0][not forward],)], "node string")
        assert {r.node: r.level for r in graphs.reach(edges, start, 4, forward=forward).collect()} == level


def test_symbols_of_any_depth(spark):
    nested = None
    for n in range(12, 0, -1):
        nested = [{"name": f"s{n}", "line": n, "children": nested}] if nested else [{"name": f"s{n}", "line": n}]
    files = spark.createDataFrame([("f.rs", json.dumps(nested)), ("empty.rs", "[]")], "uri string, symbols string")
    got = catalog.flat_symbols(files).collect()
    assert sorted((r.line, r.name, r.parent) for r in got) == [(n + 1, f"s{n}", f"s{n - 1}" if n > 1 else None) for n in range(1, 13)]
    assert catalog.flat_symbols(files, 3).count() == 3


def test_delete_guard_has_all_outcomes(spark):
    got = {r.bucket: r.outcome for r in plans.QUERIES["dur_12_bucket_delete_guard"](spark, SF).collect()}
    assert got["nowhere"] == "unknown" and got["empty"] == "delete" and set(got.values()) == {"unknown", "delete", "not empty"}
