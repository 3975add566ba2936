"""Proofs, parity sections, trees and logs against plain versions."""

import hashlib

from pyspark.sql import functions as F

from loomstead import plans
from loomstead.operators import integrity
from loomstead.sources import logs

SF = "/root/testdata/sf0.001"


def times(a: int, b: int) -> int:
    """A product in GF(256), bit by bit."""
    out = 0
    while b:
        out, a, b = out ^ (a if b & 1 else 0), (a << 1) ^ (0x11D if a & 0x80 else 0), b >> 1
    return out


def plain_shards(data: bytes, k: int = 4, m: int = 2, strip: int = 256) -> dict[tuple[int, int], bytes]:
    size, out = k * strip, {}
    products = {}
    for i in range(m):
        for j in range(k):
            c = next(x for x in range(1, 256) if times(x, (j + 1) ^ (k + i + 1)) == 1)
            products[i, j] = bytes(times(b, c) for b in range(256))
    for s in range(max(1, -(-len(data) // size))):
        part = data[s * size : (s + 1) * size].ljust(size, b"\0")
        rows = [part[j * strip : (j + 1) * strip] for j in range(k)]
        for i in range(m):
            total = 0
            for j in range(k):
                total ^= int.from_bytes(rows[j].translate(products[i, j]), "big")
            rows.append(total.to_bytes(strip, "big"))
        out.update({(s, j): x for j, x in enumerate(rows)})
    return out


def test_all_documents_have_the_shards_of_a_plain_encoder(spark):
    texts = {str(r.doc_id): (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = {(key, *at): x for key, data in texts.items() for at, x in plain_shards(data).items()}
    assert any(s > 5 for _, s, _ in want)
    got = plans.QUERIES["fun_08_rs_encode"](spark, SF).collect()
    assert len(got) == len(want) and all(bytes.fromhex(r.data) == want[r.object_key, r.stripe, r.shard_idx] for r in got)
    got = plans.QUERIES["agg_23_rs_parity"](spark, SF).collect()
    assert len(got) == len({x[:2] for x in want})
    assert all((bytes.fromhex(r.parity_0), bytes.fromhex(r.parity_1)) == (want[r.object_key, r.stripe, 4], want[r.object_key, r.stripe, 5]) for r in got)
    got = plans.QUERIES["dur_02_parity_section"](spark, SF).collect()
    assert {(r.object_key, r.stripe, r.shard_idx): r.hash for r in got} == {at: hashlib.sha256(x).hexdigest() for at, x in want.items() if at[1] < len(texts[at[0]]) // 1024}


def test_shards_of_odd_blobs_and_any_loss_of_two(spark):
    blobs = {"": b"", "zeros": bytes(9), "bytes": bytes(range(256)) * 3, "one": b"\xff"}
    frame = spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()], "object_key string, data binary")
    shards = integrity.erasure_encode(frame, strip=7)
    want = {(key, *at): x for key, data in blobs.items() for at, x in plain_shards(data, strip=7).items()}
    assert {(r.object_key, r.stripe, r.shard_idx): bytes(r.data) for r in shards.collect()} == want
    parity = integrity.xor_parity(shards).collect()
    assert len(parity) == len(want) // 6 and all(bytes.fromhex(r.parity_1) == want[r.object_key, r.stripe, 5] for r in parity)
    lost = "shard_idx <> stripe % 6 and shard_idx <> (stripe * 5 + 2) % 6"
    for r in integrity.erasure_decode(shards.where(lost)).collect():
        assert bytes(r.data) == b"".join(want[r.object_key, r.stripe, j] for j in range(4))
    none = spark.createDataFrame([], "object_key string, data binary")
    assert integrity.erasure_decode(integrity.erasure_encode(none)).count() == integrity.xor_parity(integrity.erasure_encode(none)).count() == 0


def test_proofs_of_full_trees_lead_to_the_root(spark):
    rows = [("full", i, hashlib.sha256(bytes([i])).hexdigest()) for i in range(8)] + [("odd", i, hashlib.sha256(bytes([i])).hexdigest()) for i in range(5)]
    base = spark.createDataFrame([(k, 0, i, h) for k, i, h in rows], "object_key string, level int, idx int, hash string")
    proofs = integrity.merkle_proofs(base, 4).join(integrity.merkle_roots(base), "object_key")
    got = {(r.object_key, r.idx): (len(r.siblings), r.ok) for r in proofs.withColumn("ok", integrity.proven_root() == F.col("root")).collect()}
    assert all(got["full", i] == (3, True) for i in range(8))
    assert all(got["odd", i] == (3, True) for i in range(4)) and got["odd", 4][0] == 1  # siblings that are missing give none


def test_parity_sections_hold_complete_stripes_alone(spark):
    blobs = spark.createDataFrame([("a", bytearray(b"x" * 33)), ("b", bytearray(b"y" * 15)), ("c", bytearray(b""))], "object_key string, data binary")
    got = sorted((r.object_key, r.stripe, r.shard_idx) for r in integrity.parity_section(blobs, strip=4).collect())
    assert got == [("a", s, i) for s in range(2) for i in range(6)]


def test_divergent_leaves_of_heap_trees(spark):
    ours = spark.createDataFrame([(1, i, f"h{i}") for i in range(7)] + [(2, i, f"h{i}") for i in range(7)], "tree int, node long, hash string")
    theirs = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, "h2"), (1, 3, "x"), (1, 4, "h4"), (1, 5, "x"), (2, 0, "h0"), (2, 1, "x"), (2, 3, "x")], "tree int, node long, hash string")
    assert [tuple(r) for r in integrity.tree_divergence(ours, theirs).collect()] == [(1, 3)]


def test_log_is_appended_and_replayed(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 10), (0, 2, 5), (1, 1, 7)], "file_seq int, seq int, length int")
    placed = logs.positions(rows, "file_seq", ["seq"]).withColumn("checksum", logs.checksum("file_seq", "seq", "length"))
    for k in range(2):
        logs.append(placed.where(f"file_seq = {k}").withColumn("checksum", F.col("checksum") + F.when(F.col("seq") == 2, 1).otherwise(0)), str(tmp_path / "log"))
    back = logs.replay(spark.read.parquet(str(tmp_path / "log")), "file_seq", "seq", "length").collect()
    assert sorted((r.file_seq, r.seq, r.offset) for r in back) == [(0, 1, 0), (1, 1, 0)]
