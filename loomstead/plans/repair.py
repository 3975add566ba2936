"""Logs, repair of shards, proofs, admission and the rest of the cluster's cycles."""

from pyspark.sql import functions as F

from ..operators import graphs, integrity, simulations
from ..registry import query
from ..sources import logs
from ..sources.tables import BLOBS, PADDED, STRIPES, blobs, edges, op_log, read, sql

WAL = "SELECT event_id, key % 10 AS file_seq, event_id AS seq, latency_us % 1000 AS length FROM op_log"
PLACED = f"SELECT *, (coalesce(sum(length + 64) OVER (PARTITION BY file_seq ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM ({WAL})"


def _wal(spark, d):
    rows = op_log(spark, d).select((F.col("key") % 10).alias("file_seq"), F.col("event_id").alias("seq"), (F.col("latency_us") % 1000).alias("length"))
    return logs.positions(rows, "file_seq", ["seq"])


@query("src_10_wal_positions_scan", sql(f'SELECT file_seq, seq, length, "offset" FROM ({PLACED})', "op_log"))
def wal_positions_scan(spark, d):
    return _wal(spark, d)


@query("src_09_wal_replay_scan", sql(f'SELECT file_seq, seq, length, "offset" FROM ({PLACED}) WHERE seq % 13 <> 0', "op_log"))
def wal_replay_scan(spark, d):
    whole = logs.checksum("file_seq", "seq", "length")
    log = _wal(spark, d).withColumn("checksum", F.when(F.col("seq") % 13 == 0, whole + 1).otherwise(whole))
    return logs.replay(log, "file_seq", "seq", "length").drop("checksum")


@query("snk_04_wal_append", sql("SELECT file_seq, max(\"offset\" + length + 64)::BIGINT AS end FROM (" + PLACED + ") GROUP BY file_seq", "op_log"))
def wal_append(spark, d):
    return _wal(spark, d).groupBy("file_seq").agg(F.max(F.col("offset") + F.col("length") + logs.HEADER).alias("end"))


@query("src_12_blob_list")
def blob_list(spark, d):
    return logs.blob_list(spark, d, "*.parquet")


@query("dur_02_parity_section")
def parity_section(spark, d):
    return integrity.parity_section(blobs(spark, d))


def _repair(spark, d):
    """Shards of complete and last stripes, one or three of some stripes spoilt."""
    shards = integrity.erasure_encode(blobs(spark, d))
    hashes = shards.select("object_key", "stripe", "shard_idx", F.sha2("data", 256).alias("hash"))
    key = F.col("object_key").cast("long")
    spoilt = ((key % 3 == 1) & (F.col("shard_idx") == 0)) | ((key % 3 == 2) & (F.col("shard_idx") < 3))
    now = shards.withColumn("data", F.when(spoilt, F.encode(F.lit("?"), "UTF-8")).otherwise(F.col("data")))
    return integrity.verify_and_repair(now, hashes)


@query("dur_03_verify_and_repair", f"SELECT object_key, unnest(range({STRIPES}))::INT AS stripe, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS corrupt, doc_id % 3 <> 2 AS repairable FROM {BLOBS}")
def verify_and_repair(spark, d):
    return _repair(spark, d)[0].withColumn("stripe", F.col("stripe").cast("int"))


@query("dur_04_heal_execute", f"SELECT object_key, {PADDED} AS data FROM {BLOBS} WHERE doc_id % 3 <> 2")
def heal_execute(spark, d):
    return integrity.joined(_repair(spark, d)[1])


def _leaves(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("object_key"), F.coalesce("text", F.lit("")).alias("text"))
    return integrity.leaves(docs, 256)


@query("fun_10_merkle_proof")
def merkle_proof(spark, d):
    """Every leaf's proof and whether it leads to the root."""
    base = _leaves(spark, d)
    # Proofs are followed before roots are met, so no sibling is moved.
    proofs = integrity.merkle_proofs(base).select("object_key", "idx", F.size("siblings").alias("n_siblings"), integrity.proven_root().alias("proven"))
    return proofs.join(integrity.merkle_roots(base), "object_key").select("object_key", "idx", "n_siblings", (F.col("proven") == F.col("root")).alias("verified"))


@query("str_12_incremental_merkle")
def incremental_merkle(spark, d):
    """Roots after some leaves are written again: the newest of each place counts."""
    base = _leaves(spark, d).withColumn("v", F.lit(0))
    new = base.where("idx % 4 = 1").withColumns({"hash": F.sha2("hash", 256), "v": F.lit(1)})
    now = base.unionByName(new).groupBy("object_key", "level", "idx").agg(F.max_by("hash", "v").alias("hash"))
    return integrity.merkle_roots(now)


DIFFERS = "(node % 7 = 3 OR node % 5 = 0 OR node < 40)"


@query("dur_08_incremental_diff", f"WITH RECURSIVE t AS (SELECT vec_id AS node, {DIFFERS.replace('node', 'vec_id')} AS differs, vec_id % 11 <> 10 AS known FROM embeddings), n AS (SELECT max(node) + 1 AS n FROM t), r AS (SELECT node FROM t WHERE node = 0 UNION ALL SELECT c.node FROM r JOIN t c ON c.node IN (2 * r.node + 1, 2 * r.node + 2) WHERE c.differs OR NOT c.known) SELECT 0 AS tree, r.node FROM r JOIN t USING (node), n WHERE 2 * r.node + 1 >= n AND t.known")
def incremental_diff(spark, d):
    ours = read(spark, d, "embeddings").select(F.lit(0).alias("tree"), F.col("vec_id").alias("node"), F.col("vec_id").cast("string").alias("hash"))
    theirs = ours.where("node % 11 <> 10").withColumn("hash", F.when(F.expr(DIFFERS), "x").otherwise(F.col("hash")))
    return integrity.tree_divergence(ours, theirs)


@query("fun_03_content_digest", "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def content_digest(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


SIZES = "CASE WHEN roll < 15 THEN 1 + u % 4096 WHEN roll < 50 THEN 4097 + u % 258048 WHEN roll < 85 THEN 262145 + u % 3932160 ELSE 4194305 + u % 12582912 END"


@query("fun_15_blob_size_sample", sql(f"SELECT event_id, {SIZES} AS size FROM (SELECT event_id, latency_us % 100 AS roll, latency_us * 7919 + event_id AS u FROM op_log)", "op_log"))
def blob_size_sample(spark, d):
    """A weighted roll for the tier, then a place within its bounds."""
    return op_log(spark, d).selectExpr("event_id", "latency_us % 100 as roll", "latency_us * 7919 + event_id as u").select("event_id", F.expr(SIZES).alias("size"))


@query("cac_04_cache_admission", sql("SELECT event_id, CASE WHEN size > 800000 THEN 'rejected' WHEN first = event_id THEN 'inserted' ELSE 'updated' END AS outcome FROM (SELECT event_id, latency_us AS size, min(event_id) FILTER (WHERE latency_us <= 800000) OVER (PARTITION BY node_id, key) AS first FROM op_log)", "op_log"))
def cache_admission(spark, d):
    """What the size gate says of each put, before evictions: too large, new, or a replacement."""
    from pyspark.sql import Window

    first = F.min(F.when(F.col("latency_us") <= 800000, F.col("event_id"))).over(Window.partitionBy("node_id", "key"))
    out = F.when(F.col("latency_us") > 800000, "rejected").when(F.col("event_id") == first, "inserted").otherwise("updated")
    return op_log(spark, d).select("event_id", out.alias("outcome"))


@query("win_14_event_fold", "SELECT o_orderkey AS segment_id, CASE o_orderstatus WHEN 'O' THEN 'Reserved' WHEN 'F' THEN 'Sealed' ELSE 'Deleted' END AS state FROM orders")
def event_fold(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("segment_id"), "o_orderstatus")
    kinds = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("Reserve"))).when(F.col("o_orderstatus") == "F", F.array(F.lit("Reserve"), F.lit("Seal"))).otherwise(F.array(F.lit("Reserve"), F.lit("Delete")))
    rows = simulations.fold_by_key(o.select("segment_id", F.posexplode(kinds).alias("seq", "event_type")), "segment_id", ["seq"], simulations.lifecycle, "segment_id long, seq int, state string, outcome string")
    return rows.groupBy("segment_id").agg(F.max_by("state", "seq").alias("state"))


@query("top_04_hotspots", sql("SELECT src AS symbol_id, count(*) AS degree FROM edges GROUP BY src ORDER BY degree DESC, symbol_id LIMIT 20", "edges"))
def outgoing_hotspots(spark, d):
    turned = edges(spark, d).select(F.col("dst").alias("src"), "predicate", F.col("src").alias("dst"))
    return graphs.hotspots(turned)


@query("txt_02_embed", "SELECT vec_id, len(embedding)::INT AS dimension FROM embeddings")
def embed(spark, d):
    """No model is at hand: the vectors given stand for a model's."""
    return read(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dimension"))
