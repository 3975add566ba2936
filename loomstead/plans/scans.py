"""Scans, sinks, projections and set operations."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import stores
from ..registry import query
from ..sources.tables import chunk_refs, objects, op_log, read, segments, sql

TIER_SQL = "CASE WHEN size <= 4096 THEN 'inline' WHEN size <= 262144 THEN 'small' WHEN size <= 4194304 THEN 'standard' ELSE 'multi' END"
SCALED_SQL = "CASE WHEN size <= 512 THEN 'inline' WHEN size <= 2048 THEN 'small' WHEN size <= 8192 THEN 'standard' ELSE 'multi' END"


@query("src_01_point_get", sql("SELECT * FROM objects WHERE bucket = 'src0' AND object_key = (SELECT min(object_key) FROM objects WHERE bucket = 'src0' AND object_key LIKE 'en/%')", "objects"))
def point_get(spark, d):
    o = objects(spark, d)
    key = o.where("bucket = 'src0' and object_key like 'en/%'").agg(F.min("object_key")).first()[0]
    return stores.point_get(o, "src0", key)


@query("src_02_prefix_list", sql("SELECT bucket, object_key, size FROM objects WHERE bucket = 'src0' AND object_key LIKE 'fr/%'", "objects"))
def prefix_list(spark, d):
    return stores.prefix_list(objects(spark, d), "src0", "fr/").select("bucket", "object_key", "size")


@query("src_03_full_scan", sql("SELECT * FROM objects", "objects"))
def full_scan(spark, d):
    return objects(spark, d)


@query("src_04_full_scan_with_bucket", sql("SELECT split_part(bucket || chr(1) || object_key, chr(1), 1) AS bucket, object_key, size FROM objects", "objects"))
def full_scan_with_bucket(spark, d):
    o = objects(spark, d)
    both = S.split_key(S.composite_key(F.col("bucket"), F.col("object_key")))
    return o.select(both["bucket"].alias("bucket"), both["object_key"].alias("object_key"), "size")


TOMBS = "SELECT DISTINCT bucket, object_key, deleted_at FROM chunk_refs WHERE dead"


def tombstones(spark, d):
    return chunk_refs(spark, d).where("dead").select("bucket", "object_key", "deleted_at").distinct()


@query("src_05_tombstone_scan", sql(f"SELECT * FROM ({TOMBS}) WHERE bucket = 3", "chunk_refs"))
def tombstone_scan(spark, d):
    return tombstones(spark, d).where("bucket = 3")


@query("src_06_tombstone_scan_all", sql(TOMBS, "chunk_refs"))
def tombstone_scan_all(spark, d):
    return tombstones(spark, d)


@query("src_07_tombstone_has", sql(f"SELECT count(*) > 0 AS has FROM ({TOMBS}) WHERE bucket = 3 AND object_key = 5", "chunk_refs"))
def tombstone_has(spark, d):
    return tombstones(spark, d).where("bucket = 3 and object_key = 5").agg((F.count(F.lit(1)) > 0).alias("has"))


@query("src_08_list_object_keys", sql("SELECT bucket, object_key FROM objects", "objects"))
def list_object_keys(spark, d):
    return objects(spark, d).select("bucket", "object_key")


@query("src_11_event_log_read_from", sql("SELECT event_id, op, wall FROM op_log WHERE (event_id // 1000, event_id % 1000) > (2, 500)", "op_log"))
def event_log_read_from(spark, d):
    pos = F.struct(F.floor(F.col("event_id") / 1000).cast("long").alias("file_seq"), (F.col("event_id") % 1000).alias("offset"))
    return op_log(spark, d).where(pos > F.struct(F.lit(2).cast("long").alias("file_seq"), F.lit(500).cast("long").alias("offset"))).select("event_id", "op", "wall")


@query("src_13_segment_file_list", sql("SELECT segment_id, sealed_at AS mtime, pool_id FROM segments WHERE state = 'Sealed'", "segments"))
def segment_file_list(spark, d):
    return segments(spark, d).where("state = 'Sealed'").select("segment_id", F.col("sealed_at").alias("mtime"), "pool_id")


@query("src_14_segment_range_read", "SELECT doc_id, substr(coalesce(text, ''), 11, 40) AS part FROM documents")
def segment_range_read(spark, d):
    return read(spark, d, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 11, 40).alias("part"))


@query("src_18_config_layering", "SELECT o_orderkey AS k, coalesce(CASE WHEN o_orderkey % 7 = 0 THEN 'cli' END, CASE WHEN o_orderkey % 5 = 0 THEN 'env' END, CASE WHEN o_orderkey % 3 = 0 THEN 'file' END, 'default') AS v FROM orders")
def config_layering(spark, d):
    k = F.col("o_orderkey")
    layers = [F.when(k % n == 0, name) for n, name in ((7, "cli"), (5, "env"), (3, "file"))]
    return read(spark, d, "orders").select(k.alias("k"), F.coalesce(*layers, F.lit("default")).alias("v"))


@query("snk_05_wal_truncate", sql("SELECT event_id, op FROM op_log WHERE event_id > 5000", "op_log"))
def wal_truncate(spark, d):
    return op_log(spark, d).where("event_id > 5000").select("event_id", "op")


@query("snk_12_mark_deleted", sql("SELECT bucket, object_key, CASE WHEN object_key LIKE 'de/%' THEN 'deleted' ELSE 'active' END AS status FROM objects", "objects"))
def mark_deleted(spark, d):
    return objects(spark, d).select("bucket", "object_key", F.when(F.col("object_key").startswith("de/"), "deleted").otherwise("active").alias("status"))


@query("prj_01_size_tier", sql(f"SELECT object_key, {TIER_SQL} AS tier, {SCALED_SQL} AS scaled FROM objects", "objects"))
def size_tier(spark, d):
    return objects(spark, d).select("object_key", S.size_tier(F.col("size")).alias("tier"), S.size_tier(F.col("size"), (512, 2048, 8192)).alias("scaled"))


@query("prj_02_tier_target", sql(f"SELECT segment_id, (CASE {TIER_SQL} WHEN 'inline' THEN 0 WHEN 'small' THEN 4194304 WHEN 'standard' THEN 67108864 ELSE 268435456 END)::BIGINT AS target FROM segments", "segments"))
def tier_target(spark, d):
    return segments(spark, d).select("segment_id", S.tier_target(S.size_tier(F.col("size"))).alias("target"))


@query("prj_03_read_outcome", sql("SELECT bucket, object_key, CASE WHEN sum(length) <= 20000 THEN 'InlineHit' WHEN count(*) = 1 THEN 'SingleChunk' ELSE 'MultiChunk(' || count(*)::VARCHAR || ')' END AS outcome FROM chunk_refs GROUP BY ALL", "chunk_refs"))
def read_outcome(spark, d):
    n = F.count(F.lit(1))
    return chunk_refs(spark, d).groupBy("bucket", "object_key").agg(F.when(F.sum("length") <= 20000, "InlineHit").when(n == 1, "SingleChunk").otherwise(F.concat(F.lit("MultiChunk("), n.cast("string"), F.lit(")"))).alias("outcome"))


@query("prj_04_mime_guess", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'application/gzip' ELSE 'application/octet-stream' END AS media FROM pages")
def mime_guess(spark, d):
    name = F.expr("'a.b/' || page_id || case page_id % 4 when 0 then '.html' when 1 then '.HTML' when 2 then '.tar.gz' else '' end")
    return read(spark, d, "pages").select("page_id", S.media_type(name).alias("media"))


@query("prj_05_composite_key", sql("SELECT bucket, object_key FROM objects", "objects"))
def composite_key(spark, d):
    return objects(spark, d).select(S.split_key(S.composite_key(F.col("bucket"), F.col("object_key"))).alias("k")).select("k.*")


@query("prj_07_tombstone_expired", sql("SELECT bucket, object_key, deleted_at FROM chunk_refs WHERE dead AND 915148800000 - deleted_at > 259200 * 1000", "chunk_refs"))
def tombstone_expired(spark, d):
    return chunk_refs(spark, d).where(F.col("dead") & stores.expired(F.col("deleted_at"), 915148800000, 259200)).select("bucket", "object_key", "deleted_at")


@query("prj_08_hint_expired", sql("SELECT event_id FROM op_log WHERE (SELECT max(wall) FROM op_log) // 1000000 - wall // 1000000 >= 3600", "op_log"))
def hint_expired(spark, d):
    o = op_log(spark, d).select("event_id", F.floor(F.col("wall") / 1000000).alias("s"))
    now = o.agg(F.max("s")).first()[0]
    return o.where(F.lit(now) - F.col("s") >= 3600).select("event_id")


@query("prj_10_quorum_validate", "SELECT o_orderkey AS k, CASE WHEN w < 1 OR r < 1 OR n < 1 THEN 'below one' WHEN w > n THEN 'w over n' WHEN r > n THEN 'r over n' END AS error FROM (SELECT o_orderkey, o_orderkey % 4 AS w, o_orderkey % 5 AS r, o_orderkey % 3 AS n FROM orders)")
def quorum_validate(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(k.alias("k"), S.quorum_error(k % 4, k % 5, k % 3).alias("error"))


@query("prj_11_counter_name", sql("SELECT DISTINCT op || CASE WHEN op = 'GET' THEN '_total' ELSE '' END AS name, op || '_total' AS full_name FROM op_log", "op_log"))
def counter_name(spark, d):
    o = op_log(spark, d).select("op").distinct().select(F.concat("op", F.when(F.col("op") == "GET", "_total").otherwise("")).alias("name"))
    return o.select("name", S.counter_name(F.col("name")).alias("full_name"))


@query("prj_12_series_key", sql("SELECT DISTINCT 'ops{op=\"' || op || '\",node=\"' || node_id || '\"}' AS series FROM op_log", "op_log"))
def series_key(spark, d):
    return op_log(spark, d).select(F.concat(F.lit('ops{op="'), "op", F.lit('",node="'), "node_id", F.lit('"}')).alias("series")).distinct()


@query("prj_13_shard_count", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 ELSE greatest(1, least(s_suppkey % 16, 8)) END AS shards FROM supplier")
def shard_count(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(k.alias("k"), S.shard_count(k % 3, k % 16, F.lit(8)).alias("shards"))


@query("prj_14_slugify", "SELECT p_partkey AS k, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' # ' || p_type), '[^a-z0-9_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)")
def slugify(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), S.slug(F.concat_ws(" # ", "p_name", "p_type")).alias("slug"))


@query("prj_17_module_api", sql("SELECT symbol_id, symbol_name FROM symbols WHERE symbol_module = 'm3' AND symbol_kind = 'part'", "symbols"))
def module_api(spark, d):
    from ..sources.tables import symbols

    return symbols(spark, d).where("symbol_module = 'm3' and symbol_kind = 'part'").select("symbol_id", "symbol_name")


@query("prj_18_fuzzy_find", sql("SELECT symbol_id, symbol_name FROM symbols WHERE regexp_matches(symbol_name, '(?i)0+1') ORDER BY symbol_id LIMIT 20", "symbols"))
def fuzzy_find(spark, d):
    from ..sources.tables import symbols

    return symbols(spark, d).where(F.col("symbol_name").rlike("(?i)0+1")).select("symbol_id", "symbol_name").orderBy("symbol_id").limit(20)


@query("prj_19_module_tree", sql("SELECT symbol_module, string_agg(symbol_id, ',' ORDER BY symbol_id) AS first_five FROM (SELECT *, row_number() OVER (PARTITION BY symbol_module ORDER BY symbol_id) AS n FROM symbols) WHERE n <= 5 GROUP BY symbol_module", "symbols"))
def module_tree(spark, d):
    from pyspark.sql import Window

    from ..sources.tables import symbols

    w = Window.partitionBy("symbol_module").orderBy("symbol_id")
    top = symbols(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 5")
    return top.groupBy("symbol_module").agg(F.array_join(F.sort_array(F.collect_list("symbol_id")), ",").alias("first_five"))


@query("prj_20_status_class", sql("SELECT event_id, CASE WHEN status = 404 THEN 'NoSuchKey' WHEN status >= 500 THEN 'InternalError' ELSE 'OK' END AS code FROM op_log", "op_log"))
def status_class(spark, d):
    s = F.col("status")
    return op_log(spark, d).select("event_id", F.when(s == 404, "NoSuchKey").when(s >= 500, "InternalError").otherwise("OK").alias("code"))


@query("set_01_referenced", sql("SELECT DISTINCT segment_id FROM chunk_refs WHERE NOT dead", "chunk_refs"))
def referenced(spark, d):
    return chunk_refs(spark, d).where("not dead").select("segment_id").distinct()


@query("set_02_except", sql("SELECT segment_id FROM segments EXCEPT SELECT segment_id FROM chunk_refs", "segments", "chunk_refs"))
def except_(spark, d):
    return segments(spark, d).select("segment_id").join(chunk_refs(spark, d).select("segment_id"), "segment_id", "left_anti").distinct()


@query("set_03_union", sql("SELECT DISTINCT dst FROM edges WHERE predicate IN ('calls', 'uses_type')", "edges"))
def union(spark, d):
    from ..sources.tables import edges

    e = edges(spark, d)
    return e.where("predicate = 'calls'").select("dst").unionByName(e.where("predicate = 'uses_type'").select("dst")).distinct()


@query("set_04_intersect", sql("SELECT DISTINCT key FROM op_log WHERE op = 'GET' INTERSECT SELECT key FROM op_log WHERE op = 'PUT'", "op_log"))
def intersect(spark, d):
    o = op_log(spark, d)
    return o.where("op = 'GET'").select("key").intersect(o.where("op = 'PUT'").select("key"))


@query("fun_01_ring_key_hash", sql("SELECT object_key, sha256(object_key) AS h FROM objects", "objects"))
def ring_key_hash(spark, d):
    return objects(spark, d).select("object_key", F.sha2("object_key", 256).alias("h"))


@query("fun_04_crc32")
def crc32(spark, d):
    return objects(spark, d).select("object_key", F.crc32(F.encode("object_key", "UTF-8")).alias("crc"))


@query("fun_07_stripe_layout", sql("SELECT segment_id, (size + 1023) // 1024 AS stripes, (size + 1023) // 1024 * 1024 AS padded FROM segments WHERE size > 0", "segments"))
def stripe_layout(spark, d):
    n = F.floor((F.col("size") + 1023) / 1024)
    return segments(spark, d).where("size > 0").select("segment_id", n.alias("stripes"), (n * 1024).alias("padded"))


@query("dur_12_bucket_delete_guard", sql("WITH b AS (SELECT DISTINCT bucket FROM objects UNION ALL SELECT 'empty'), a AS (SELECT bucket FROM b UNION ALL SELECT 'nowhere') SELECT a.bucket, CASE WHEN b.bucket IS NULL THEN 'unknown' WHEN n > 0 THEN 'not empty' ELSE 'delete' END AS outcome FROM a LEFT JOIN b USING (bucket) LEFT JOIN (SELECT bucket, count(*) AS n FROM objects GROUP BY bucket) USING (bucket)", "objects"))
def bucket_delete_guard(spark, d):
    """Outcome of a delete of every known bucket, one of them without objects, and of one that nobody knows."""
    one = lambda name: spark.range(1).select(F.lit(name).alias("bucket"))
    held = objects(spark, d).select("bucket").distinct()
    known = held.unionByName(one("empty"))
    outcome = F.when(~F.col("known"), "unknown").when(F.col("held"), "not empty").otherwise("delete")
    flags = known.unionByName(one("nowhere")).join(known.withColumn("k", F.lit(True)), "bucket", "left").join(held.withColumn("h", F.lit(True)), "bucket", "left")
    return flags.select("bucket", F.coalesce("k", F.lit(False)).alias("known"), F.coalesce("h", F.lit(False)).alias("held")).select("bucket", outcome.alias("outcome"))


@query("dur_13_bucket_list", sql("SELECT DISTINCT bucket FROM objects", "objects"))
def bucket_list(spark, d):
    return objects(spark, d).select("bucket").distinct()


@query("dur_14_pool_resolve", sql("SELECT segment_id, coalesce('/pool/' || nullif(pool_id, 2)::VARCHAR, '/legacy') AS root FROM segments", "segments"))
def pool_resolve(spark, d):
    pools = spark.createDataFrame([(0, "/pool/0"), (1, "/pool/1")], "pool_id int, root string")
    return segments(spark, d).join(F.broadcast(pools), "pool_id", "left").select("segment_id", F.coalesce("root", F.lit("/legacy")).alias("root"))
