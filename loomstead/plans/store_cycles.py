"""Merging, garbage collection, compaction, placement and repair."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog, placement, stores
from ..registry import query
from ..sources.tables import chunk_refs, objects, op_log, read, segments, sql

NOW, TTL = 1104537600000, 86400000
WINNER = "SELECT key, max(struct_pack(wall, event_id, node_id)) AS w FROM op_log GROUP BY key"


@query("win_01_lww_latest", sql(f"SELECT key, w.wall, w.event_id, w.node_id FROM ({WINNER})", "op_log"))
def lww_latest(spark, d):
    return stores.newest(op_log(spark, d).select("key", "wall", "event_id", "node_id"), ["key"], ["wall", "event_id", "node_id"])


@query("win_02_resolution_label", sql("SELECT key, CASE WHEN a >= b THEN 'AcceptLocal' ELSE 'AcceptRemote' END AS resolution FROM (SELECT key, max(wall) FILTER (WHERE node_id = 'node-0') AS a, max(wall) FILTER (WHERE node_id <> 'node-0') AS b FROM op_log GROUP BY key) WHERE a IS NOT NULL AND b IS NOT NULL", "op_log"))
def resolution_label(spark, d):
    o = op_log(spark, d)
    local = F.col("node_id") == "node-0"
    sides = o.groupBy("key").agg(F.max(F.when(local, F.col("wall"))).alias("a"), F.max(F.when(~local, F.col("wall"))).alias("b")).where("a is not null and b is not null")
    return sides.select("key", F.when(F.col("a") >= F.col("b"), "AcceptLocal").otherwise("AcceptRemote").alias("resolution"))


@query("jon_09_quorum_compare", sql(f"SELECT key, w.wall, w.node_id, n.replies FROM ({WINNER}) JOIN (SELECT key AS k, count(DISTINCT node_id) AS replies FROM op_log GROUP BY key) n ON k = key", "op_log"))
def quorum_compare(spark, d):
    o = op_log(spark, d).select("key", "wall", "event_id", "node_id")
    return stores.quorum_winner(o).join(o.groupBy("key").agg(F.countDistinct("node_id").alias("replies")), "key").select("key", "wall", "node_id", "replies")


@query("dur_06_read_repair_plan", sql(f"SELECT m.key, m.node_id, m.w.wall, m.w.event_id FROM (SELECT key, node_id, max(struct_pack(wall, event_id)) AS w FROM op_log GROUP BY key, node_id) m JOIN ({WINNER}) x ON x.key = m.key WHERE m.w < struct_pack(wall := x.w.wall, event_id := x.w.event_id)", "op_log"))
def read_repair_plan(spark, d):
    return stores.read_repair(op_log(spark, d).select("key", "wall", "event_id", "node_id")).select("key", "node_id", "wall", "event_id")


@query("dur_11_write_ack_quorum", sql("SELECT key, 1 + count(*) FILTER (WHERE status < 300) AS acks, 1 + count(*) FILTER (WHERE status < 300) >= 60 AS met FROM op_log GROUP BY key", "op_log"))
def write_ack_quorum(spark, d):
    acks = F.count_if(F.col("status") < 300) + 1
    return op_log(spark, d).groupBy("key").agg(acks.alias("acks"), (acks >= 60).alias("met"))


@query("jon_02_gc_object_tombstone", sql("WITH t AS (SELECT DISTINCT bucket, object_key FROM chunk_refs WHERE dead AND deleted_at < 930000000000) SELECT c.segment_id, sum(CASE WHEN t.bucket IS NULL THEN length ELSE 0 END)::BIGINT AS live, sum(CASE WHEN t.bucket IS NULL THEN 0 ELSE length END)::BIGINT AS dead FROM chunk_refs c LEFT JOIN t ON t.bucket = c.bucket AND t.object_key = c.object_key GROUP BY c.segment_id", "chunk_refs"))
def gc_object_tombstone(spark, d):
    c = chunk_refs(spark, d)
    t = c.where("dead and deleted_at < 930000000000").select("bucket", "object_key").distinct().withColumn("gone", F.lit(True))
    joined = c.drop("dead").join(t, ["bucket", "object_key"], "left").withColumn("dead", F.col("gone").isNotNull())
    return stores.liveness(joined).select("segment_id", "live", "dead")


ORPHANS = f"SELECT segment_id FROM segments s WHERE state = 'Sealed' AND {NOW} - sealed_at > {TTL} AND NOT EXISTS (SELECT 1 FROM chunk_refs c WHERE c.segment_id = s.segment_id)"


@query("jon_03_orphan_registered", sql(ORPHANS, "segments", "chunk_refs"))
def orphan_registered(spark, d):
    return stores.orphans(segments(spark, d), chunk_refs(spark, d), NOW, TTL).select("segment_id")


@query("jon_04_orphan_on_disk", sql(f"SELECT segment_id + 100 AS segment_id FROM segments s WHERE sealed_at > 0 AND {NOW} - sealed_at > {TTL} AND NOT EXISTS (SELECT 1 FROM segments x WHERE x.segment_id = s.segment_id + 100) AND NOT EXISTS (SELECT 1 FROM chunk_refs c WHERE c.segment_id = s.segment_id + 100)", "segments", "chunk_refs"))
def orphan_on_disk(spark, d):
    s = segments(spark, d)
    files = s.select((F.col("segment_id") + 100).alias("segment_id"), F.col("sealed_at").alias("mtime"))
    return stores.disk_orphans(files, s, chunk_refs(spark, d), NOW, TTL).select("segment_id")


@query("jon_05_objects_in_segment", sql("SELECT DISTINCT bucket, object_key FROM chunk_refs WHERE segment_id = 7", "chunk_refs"))
def objects_in_segment(spark, d):
    return chunk_refs(spark, d).where("segment_id = 7").select("bucket", "object_key").distinct()


@query("jon_06_compaction_remap", sql("SELECT bucket, object_key, CASE WHEN segment_id % 4 = 0 THEN segment_id + 1000000 ELSE segment_id END AS segment_id, length FROM chunk_refs WHERE segment_id % 4 <> 0 OR NOT dead", "chunk_refs"))
def compaction_remap(spark, d):
    c = stores_offsets(chunk_refs(spark, d))
    old = c.where("segment_id % 4 = 0").select("segment_id").distinct()
    mapping = stores.repacked(c.where("segment_id % 4 = 0")).select("segment_id", "offset", "length", (F.col("segment_id") + 1000000).alias("new_segment"), "new_offset")
    return stores.remapped(c, mapping, old).select("bucket", "object_key", "segment_id", "length")


def stores_offsets(refs):
    """Chunks with their offset in the segment."""
    w = Window.partitionBy("segment_id").orderBy("ordinal", "object_key", "bucket", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return refs.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


@query("jon_15_compaction_recovery", sql("SELECT o.segment_id, CASE WHEN r.segment_id IS NULL THEN 'SweepNewOrphan' WHEN p.state = 'Sealed' THEN 'FinishOldDeletion' WHEN p.state = 'Reserved' THEN 'None' ELSE 'SweepOldDat' END AS action FROM segments o LEFT JOIN (SELECT DISTINCT segment_id FROM chunk_refs) r ON r.segment_id = o.segment_id LEFT JOIN segments p ON p.segment_id = o.segment_id - 1 WHERE o.segment_id % 5 = 0", "segments", "chunk_refs"))
def compaction_recovery(spark, d):
    s = segments(spark, d)
    new = s.where("segment_id % 5 = 0").select("segment_id", (F.col("segment_id") - 1).alias("repacked_from"))
    used = chunk_refs(spark, d).select("segment_id").distinct().withColumn("used", F.lit(True))
    old = s.select(F.col("segment_id").alias("repacked_from"), F.col("state").alias("old"))
    j = new.join(used, "segment_id", "left").join(old, "repacked_from", "left")
    action = F.when(F.col("used").isNull(), "SweepNewOrphan").when(F.col("old") == "Sealed", "FinishOldDeletion").when(F.col("old") == "Reserved", "None").otherwise("SweepOldDat")
    return j.select("segment_id", action.alias("action"))


@query("jon_16_manifest_verify", sql("WITH m AS (SELECT key, list(DISTINCT latency_us) AS versions FROM op_log WHERE op = 'PUT' GROUP BY key) SELECT event_id, m.versions IS NOT NULL AND list_contains(m.versions, latency_us) AS known FROM op_log LEFT JOIN m ON m.key = op_log.key WHERE op IN ('GET', 'PUT')", "op_log"))
def manifest_verify(spark, d):
    o = op_log(spark, d)
    m = o.where("op = 'PUT'").select("key", "latency_us").distinct().withColumn("known", F.lit(True))
    return o.where("op in ('GET', 'PUT')").join(m, ["key", "latency_us"], "left").select("event_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("jon_17_delta_vs_watermark", sql("WITH k AS (SELECT key, max(event_id) AS known FROM op_log WHERE event_id % 3 = 0 GROUP BY key) SELECT event_id FROM op_log LEFT JOIN k ON k.key = op_log.key WHERE k.known IS NULL OR event_id > known", "op_log"))
def delta_vs_watermark(spark, d):
    o = op_log(spark, d)
    k = o.where("event_id % 3 = 0").groupBy("key").agg(F.max("event_id").alias("known"))
    return o.join(k, "key", "left").where("known is null or event_id > known").select("event_id")


LIVE = "SELECT segment_id, sum(CASE WHEN dead THEN 0 ELSE length END)::BIGINT AS live, sum(CASE WHEN dead THEN length ELSE 0 END)::BIGINT AS dead FROM chunk_refs GROUP BY segment_id"


@query("agg_01_liveness", sql(f"SELECT *, CASE WHEN live + dead = 0 THEN 1.0::DOUBLE ELSE round(live / (live + dead), 9) END AS ratio FROM ({LIVE})", "chunk_refs"))
def liveness(spark, d):
    return stores.liveness(chunk_refs(spark, d)).withColumn("ratio", F.round("ratio", 9))


@query("agg_02_compaction_candidates", sql(f"SELECT segment_id FROM ({LIVE}) WHERE live + dead > 0 AND live / (live + dead) < 0.5", "chunk_refs"))
def compaction_candidates(spark, d):
    return stores.compaction_candidates(chunk_refs(spark, d)).select("segment_id")


@query("agg_03_gc_stats", sql(f"SELECT count(*) AS scanned, sum(live)::BIGINT AS live, sum(dead)::BIGINT AS dead, count(*) FILTER (WHERE live < dead) AS compacted, coalesce(sum(dead) FILTER (WHERE live < dead), 0)::BIGINT AS reclaimed FROM ({LIVE})", "chunk_refs"))
def gc_stats(spark, d):
    low = F.col("live") < F.col("dead")
    return stores.liveness(chunk_refs(spark, d)).agg(F.count(F.lit(1)).alias("scanned"), F.sum("live").alias("live"), F.sum("dead").alias("dead"), F.count_if(low).alias("compacted"), F.coalesce(F.sum(F.when(low, F.col("dead"))), F.lit(0)).alias("reclaimed"))


@query("agg_04_segment_report", sql("SELECT CASE WHEN size <= 512 THEN 'inline' WHEN size <= 2048 THEN 'small' WHEN size <= 8192 THEN 'standard' ELSE 'multi' END AS tier, count(*) AS total, sum(size)::BIGINT AS bytes FROM objects GROUP BY 1", "objects"))
def segment_report(spark, d):
    from ..functions.scalars import size_tier

    return objects(spark, d).groupBy(size_tier(F.col("size"), (512, 2048, 8192)).alias("tier")).agg(F.count(F.lit(1)).alias("total"), F.sum("size").alias("bytes"))


@query("agg_04_segment_states", sql("SELECT count(*) AS total, count(*) FILTER (WHERE state = 'Sealed') AS sealed, count(*) FILTER (WHERE state <> 'Sealed') AS unsealed FROM segments", "segments"))
def segment_states(spark, d):
    return segments(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "Sealed").alias("sealed"), F.count_if(F.col("state") != "Sealed").alias("unsealed"))


@query("agg_14_pending_hints", sql("SELECT node_id, count(*) AS pending FROM op_log WHERE status >= 500 GROUP BY node_id", "op_log"))
def pending_hints(spark, d):
    return op_log(spark, d).where("status >= 500").groupBy("node_id").agg(F.count(F.lit(1)).alias("pending"))


@query("agg_13_replay_summary", sql("SELECT count(*) AS entries, sum(length)::BIGINT AS bytes, count(DISTINCT c.segment_id) AS segments, max(deleted_at) AS last FROM chunk_refs c WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.segment_id = c.segment_id AND s.state = 'Sealed')", "chunk_refs", "segments"))
def replay_summary(spark, d):
    sealed = segments(spark, d).where("state = 'Sealed'").select("segment_id")
    return chunk_refs(spark, d).join(sealed, "segment_id", "left_anti").agg(F.count(F.lit(1)).alias("entries"), F.sum("length").alias("bytes"), F.countDistinct("segment_id").alias("segments"), F.max("deleted_at").alias("last"))


@query("agg_19_version_vector", sql("SELECT node_id, op AS origin, max(event_id) AS version FROM op_log GROUP BY node_id, op", "op_log"))
def version_vector(spark, d):
    vector = op_log(spark, d).groupBy("node_id", F.col("op").alias("origin")).agg(F.max("event_id").alias("version")).groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("origin", "version"))).alias("v"))
    return vector.select("node_id", F.explode("v").alias("origin", "version"))


@query("agg_15_manifest_summary", sql("SELECT count(*) AS written, count(*) FILTER (WHERE status >= 500) AS mismatches, count(*) FILTER (WHERE status < 500) AS verified, count(*) FILTER (WHERE op <> 'DELETE') AS active FROM op_log", "op_log"))
def manifest_summary(spark, d):
    bad = F.count_if(F.col("status") >= 500)
    return op_log(spark, d).agg(F.count(F.lit(1)).alias("written"), bad.alias("mismatches"), F.greatest(F.lit(0), F.count(F.lit(1)) - bad).alias("verified"), F.count_if(F.col("op") != "DELETE").alias("active"))


@query("agg_21_heal_stats", sql("SELECT count(*) AS attempted, count(*) FILTER (WHERE status < 300) AS succeeded, count(*) FILTER (WHERE status >= 300) AS failed, coalesce(sum(latency_us) FILTER (WHERE status < 300), 0)::BIGINT AS bytes FROM op_log", "op_log"))
def heal_stats(spark, d):
    ok = F.col("status") < 300
    return op_log(spark, d).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("latency_us"))), F.lit(0)).alias("bytes"))


@query("win_05_chunk_split", sql("WITH c AS (SELECT object_key, size, unnest(range(0, size, 1000)) AS \"offset\" FROM objects WHERE size > 0) SELECT object_key, \"offset\" // 1000 AS chunk, \"offset\", least(1000, size - \"offset\") AS length FROM c", "objects"))
def chunk_split(spark, d):
    return stores.chunk_split(objects(spark, d), 1000).select("object_key", F.col("chunk").cast("long").alias("chunk"), "offset", "length")


@query("win_06_segment_pack", sql("""WITH o AS (SELECT bucket, object_key, size, row_number() OVER (PARTITION BY bucket ORDER BY object_key) AS n FROM objects),
r AS (SELECT bucket, n, object_key, size, 0::BIGINT AS segment, 0::BIGINT AS "offset" FROM o WHERE n = 1
UNION ALL SELECT o.bucket, o.n, o.object_key, o.size, CASE WHEN r."offset" + r.size >= 20000 THEN r.segment + 1 ELSE r.segment END, CASE WHEN r."offset" + r.size >= 20000 THEN 0 ELSE r."offset" + r.size END FROM r JOIN o ON o.bucket = r.bucket AND o.n = r.n + 1)
SELECT bucket, object_key, segment, "offset" FROM r""", "objects", recursive=True))
def segment_pack(spark, d):
    return stores.pack_segments(objects(spark, d), 20000).select("bucket", "object_key", "segment", "offset")


@query("win_07_repack_offsets", sql("SELECT segment_id, bucket, object_key, ordinal, tie, (sum(length) OVER (PARTITION BY segment_id ORDER BY bucket, object_key, ordinal, tie ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS new_offset FROM chunk_refs WHERE NOT dead", "chunk_refs"))
def repack_offsets(spark, d):
    return stores.repacked(chunk_refs(spark, d)).select("segment_id", "bucket", "object_key", "ordinal", "tie", "new_offset")


@query("win_09_neighbors_after", sql("SELECT * FROM (SELECT bucket, object_key, lead(object_key) OVER w AS next, lead(object_key, 2) OVER w AS after FROM objects WINDOW w AS (PARTITION BY bucket ORDER BY object_key)) WHERE next IS NOT NULL", "objects"))
def neighbors_after(spark, d):
    w = Window.partitionBy("bucket").orderBy("object_key")
    return objects(spark, d).select("bucket", "object_key", F.lead("object_key").over(w).alias("next"), F.lead("object_key", 2).over(w).alias("after")).where("next is not null")


@query("win_11_contiguous_partition", sql("SELECT segment_id, (ntile(7) OVER (ORDER BY segment_id) - 1)::INT AS part FROM segments", "segments"))
def contiguous_partition(spark, d):
    return stores.contiguous_parts(segments(spark, d).select("segment_id"), "segment_id", 7).select("segment_id", "part")


@query("win_12_batching", sql("SELECT segment_id, (row_number() OVER (ORDER BY segment_id) - 1) // 50 AS batch FROM segments", "segments"))
def batching(spark, d):
    return stores.global_rank(segments(spark, d).select("segment_id"), "segment_id").select("segment_id", F.floor(F.col("rank") / 50).alias("batch"))


@query("win_13_hint_batch", sql("SELECT node_id, count(*) AS n, sum(cost)::BIGINT AS bytes FROM (SELECT node_id, cost, row_number() OVER w AS k, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT node_id, event_id, CASE op WHEN 'PUT' THEN latency_us % 1000 + 128 WHEN 'DELETE' THEN 128 ELSE 256 END AS cost FROM op_log) WINDOW w AS (PARTITION BY node_id ORDER BY event_id)) WHERE k <= 100 AND run <= 16384 GROUP BY node_id", "op_log"))
def hint_batch(spark, d):
    cost = F.when(F.col("op") == "PUT", F.col("latency_us") % 1000 + 128).when(F.col("op") == "DELETE", 128).otherwise(256)
    w = Window.partitionBy("node_id").orderBy("event_id")
    rows = op_log(spark, d).select("node_id", "event_id", cost.cast("long").alias("cost"))
    rows = rows.withColumn("k", F.row_number().over(w)).withColumn("run", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("k <= 100 and run <= 16384").groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("bytes"))


@query("win_16_replay_queue", sql("SELECT segment_id, ordinal, tie, object_key, run >= 100000 AS complete FROM (SELECT *, sum(length) OVER (PARTITION BY segment_id ORDER BY ordinal, object_key, bucket, tie ROWS UNBOUNDED PRECEDING) AS run FROM chunk_refs)", "chunk_refs"))
def replay_queue(spark, d):
    w = Window.partitionBy("segment_id").orderBy("ordinal", "object_key", "bucket", "tie").rowsBetween(Window.unboundedPreceding, 0)
    return chunk_refs(spark, d).select("segment_id", "ordinal", "tie", "object_key", (F.sum("length").over(w) >= 100000).alias("complete"))


def _ring(spark, n=5, vnodes=16):
    return placement.ring_positions(spark.createDataFrame([(f"node-{i}",) for i in range(n)], "node_id string"), vnodes)


RING = "ring AS (SELECT sha256(encode(node) || '\\x3A'::BLOB || from_hex(lpad(to_hex(v), 2, '0') || '000000')) AS pos, node AS node_id FROM (SELECT 'node-' || n AS node FROM range({n}) t(n)), range(16) u(v))"
WALK = """, cand AS (SELECT object_key, node_id, min(CASE WHEN pos >= sha256(object_key) THEN '0' ELSE '1' END || pos) AS rank FROM (SELECT DISTINCT object_key FROM objects), ring GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY object_key ORDER BY rank) AS n FROM cand)"""


@query("jon_01_ring_lookup", sql(f"WITH {RING.format(n=5)}{WALK} SELECT object_key, string_agg(node_id, ',' ORDER BY n) AS nodes FROM ranked WHERE n <= 3 GROUP BY object_key", "objects"))
def ring_lookup(spark, d):
    o = objects(spark, d).select("object_key").distinct()
    return placement.ring_lookup(o, "object_key", _ring(spark), 3).select("object_key", F.array_join("nodes", ",").alias("nodes"))


@query("dur_09_route", sql(f"WITH {RING.format(n=5)}{WALK} SELECT object_key, bool_or(node_id = 'node-0') AS is_local, max(node_id) FILTER (WHERE n = 1) AS forward FROM ranked WHERE n <= 3 GROUP BY object_key", "objects"))
def route(spark, d):
    o = placement.ring_lookup(objects(spark, d).select("object_key").distinct(), "object_key", _ring(spark), 3)
    return o.select("object_key", F.array_contains("nodes", "node-0").alias("is_local"), F.get("nodes", F.lit(0)).alias("forward"))


@query("set_05_ring_delta", f"WITH {RING.format(n=6)} SELECT pos, node_id, 'added' AS change FROM ring WHERE node_id = 'node-5'")
def ring_delta(spark, d):
    return placement.ring_delta(_ring(spark, 5), _ring(spark, 6))


@query("fun_02_vnode_hash", f"WITH {RING.format(n=5)} SELECT pos, node_id FROM ring")
def vnode_hash(spark, d):
    return _ring(spark)


def _pools(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 == 0, "Failed").otherwise("Healthy").alias("status"), (F.col("s_suppkey") % 5 == 0).alias("write_degraded"), (F.floor(F.col("s_acctbal")).cast("long") * 65536).alias("free_bytes"), (F.col("s_nationkey") + 1).cast("long").alias("weight"))


POOLS = "(SELECT s_suppkey AS id, floor(s_acctbal)::BIGINT * 65536 AS free_bytes, (s_nationkey + 1)::BIGINT AS weight FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 AND floor(s_acctbal)::BIGINT * 65536 > 67108864)"


@query("prj_09_pool_eligible", f"SELECT id, free_bytes FROM {POOLS}")
def pool_eligible(spark, d):
    return placement.eligible_pools(_pools(spark, d)).select("id", "free_bytes")


@query("top_02_placement_top1", f"SELECT id, free_bytes // greatest(weight, 1) AS score FROM {POOLS} ORDER BY score DESC, id LIMIT 1")
def placement_top1(spark, d):
    return placement.best_pool(_pools(spark, d)).select("id", "score")


OWNED = sql("SELECT node_id, string_agg(shard, ',' ORDER BY shard) AS shards FROM (SELECT DISTINCT key::VARCHAR AS shard, node_id FROM op_log WHERE key IS NOT NULL) GROUP BY node_id", "op_log")


@query("jon_10_group_by_owner", OWNED)
@query("jon_10_group_by_owner_all", OWNED)
def group_by_owner(spark, d):
    """The shards of every owner, over all keys."""
    o = op_log(spark, d).select(F.col("key").cast("string").alias("shard"), "node_id").distinct()
    return placement.by_owner(o.select("shard").distinct(), o).select("node_id", F.array_join("shards", ",").alias("shards"))


@query("top_06_random_sample", sql("SELECT segment_id FROM segments ORDER BY sha256(segment_id::VARCHAR || ':42'), segment_id LIMIT (SELECT ceil(count(*) * 0.1)::BIGINT FROM segments)", "segments"))
def random_sample(spark, d):
    """A tenth of the segments, rounded up, by a keyed hash: which are drawn."""
    hashed = F.sha2(F.concat(F.col("segment_id").cast("string"), F.lit(":42")), 256)
    return catalog.smallest(segments(spark, d).select(hashed.alias("hash"), "segment_id"), "hash", "segment_id", 10).select("segment_id")
