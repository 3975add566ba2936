"""Metrics, integrity, graph, search and ordered folds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs, integrity, simulations, telemetry
from ..registry import query
from ..sources.tables import BLOBS, PADDED, blobs, edges, objects, op_log, read, sql, symbols

BOUNDS = [1000, 5000, 10000, 50000, 100000, 500000]


@query("agg_06_histogram", sql(f"WITH b AS (SELECT unnest({BOUNDS})::BIGINT AS le) SELECT op, le, count(*) FILTER (WHERE latency_us <= le) AS cumulative, sum(latency_us)::BIGINT AS sum, count(*) AS count FROM op_log, b GROUP BY op, le", "op_log"))
def histogram(spark, d):
    return telemetry.histogram(op_log(spark, d), "latency_us", BOUNDS, "op")


@query("snk_08_prometheus_render", sql(f"WITH b AS (SELECT unnest({BOUNDS})::BIGINT AS le) SELECT le, 'latency_bucket{{le=\"' || le::VARCHAR || '\"}} ' || (count(*) FILTER (WHERE latency_us <= le))::VARCHAR AS line FROM op_log, b GROUP BY le", "op_log"))
def prometheus_render(spark, d):
    return telemetry.render(telemetry.histogram(op_log(spark, d), "latency_us", BOUNDS), "latency")


POW2 = "CASE WHEN latency_us <= 1 THEN 0 ELSE least(length(bin(latency_us)) - 1, 31) END"


@query("agg_07_latency_pow2_histogram", sql(f"SELECT op, ({POW2})::INT AS bucket, count(*) AS n FROM op_log GROUP BY 1, 2", "op_log"))
def latency_histogram(spark, d):
    return telemetry.latency_histogram(op_log(spark, d), "latency_us", "op")


@query("agg_08_percentile_interp", sql(f"WITH h AS (SELECT op, {POW2} AS bucket, count(*) AS n FROM op_log GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY op ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS run, ceil((sum(n) OVER (PARTITION BY op))::DOUBLE * 0.95) AS need FROM h) SELECT op, floor(CASE WHEN bucket = 0 THEN 0 ELSE 1::BIGINT << bucket END + ((1::BIGINT << (bucket + 1)) - CASE WHEN bucket = 0 THEN 0 ELSE 1::BIGINT << bucket END) * (need - (run - n)) / n::DOUBLE)::BIGINT AS value FROM r WHERE run >= need AND run - n < need", "op_log"))
def percentile_interp(spark, d):
    return telemetry.percentile(telemetry.latency_histogram(op_log(spark, d), "latency_us", "op"), 0.95, "op")


@query("agg_09_worker_merge", sql("SELECT count(*) FILTER (WHERE op = 'PUT') AS puts, count(*) FILTER (WHERE op = 'GET') AS gets, count(*) FILTER (WHERE op = 'DELETE') AS deletes, count(*) FILTER (WHERE op = 'HEAD') AS heads, count(*) FILTER (WHERE op <> 'ERROR') AS ops_total FROM op_log", "op_log"))
def worker_merge(spark, d):
    n = lambda op: F.count_if(F.col("op") == op)
    per = op_log(spark, d).groupBy("node_id").agg(n("PUT").alias("puts"), n("GET").alias("gets"), n("DELETE").alias("deletes"), n("HEAD").alias("heads"))
    names = ["puts", "gets", "deletes", "heads"]
    out = per.agg(*[F.sum(c).alias(c) for c in names])
    return out.withColumn("ops_total", sum((F.col(c) for c in names[1:]), F.col(names[0])))


@query("agg_10_status_class_counts", sql("SELECT op, count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS ok, count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client, count(*) FILTER (WHERE status >= 500) AS server FROM op_log GROUP BY op", "op_log"))
def status_class_counts(spark, d):
    s = F.col("status")
    return op_log(spark, d).groupBy("op").agg(F.count_if(s.between(200, 299)).alias("ok"), F.count_if(s.between(400, 499)).alias("client"), F.count_if(s >= 500).alias("server"))


@query("agg_11_hit_rate", sql("SELECT node_id, round(coalesce(count(*) FILTER (WHERE status = 200) / nullif(count(*) FILTER (WHERE op = 'GET' OR status = 200), 0), 0.0), 9) AS rate FROM op_log GROUP BY node_id", "op_log"))
def hit_rate(spark, d):
    hits, asked = F.count_if(F.col("status") == 200), F.count_if((F.col("op") == "GET") | (F.col("status") == 200))
    return op_log(spark, d).groupBy("node_id").agg(F.round(F.coalesce(F.try_divide(hits, asked), F.lit(0.0)), 9).alias("rate"))


@query("agg_12_cache_stats_by_tier", sql("SELECT t.tier, count(*) FILTER (WHERE status < 300) AS hits, count(*) FILTER (WHERE status >= 300) AS misses FROM (SELECT unnest(['l1', 'l2', 'l3', 'l4']) AS tier) t LEFT JOIN (SELECT status, 'l' || (key % 3 + 1)::VARCHAR AS tier FROM op_log) o ON o.tier = t.tier GROUP BY t.tier", "op_log"))
def cache_stats_by_tier(spark, d):
    tiers = spark.createDataFrame([("l1",), ("l2",), ("l3",), ("l4",)], "tier string")
    per = op_log(spark, d).groupBy(F.concat(F.lit("l"), (F.col("key") % 3 + 1).cast("string")).alias("tier")).agg(F.count_if(F.col("status") < 300).alias("h"), F.count_if(F.col("status") >= 300).alias("m"))
    return tiers.join(per, "tier", "left").select("tier", F.coalesce("h", F.lit(0)).alias("hits"), F.coalesce("m", F.lit(0)).alias("misses"))


SERIES = "SELECT op AS name, wall // 3600000000 AS ts, count(*) AS value FROM op_log GROUP BY 1, 2"


@query("win_08_metric_delta", sql(f"SELECT * FROM (SELECT name, ts, value - lag(value) OVER (PARTITION BY name ORDER BY ts) AS delta FROM ({SERIES})) WHERE delta IS NOT NULL", "op_log"))
def metric_delta(spark, d):
    s = op_log(spark, d).groupBy(F.col("op").alias("name"), F.floor(F.col("wall") / 3600000000).alias("ts")).agg(F.count(F.lit(1)).alias("value"))
    return telemetry.deltas(s, "name").select("name", "ts", "delta")


@query("str_09_metric_scrape_series", sql(SERIES, "op_log"))
def metric_scrape_series(spark, d):
    return op_log(spark, d).groupBy(F.col("op").alias("name"), F.floor(F.col("wall") / 3600000000).alias("ts")).agg(F.count(F.lit(1)).alias("value"))


@query("src_15_metrics_scrape", sql("SELECT op || '{key=\"' || key::VARCHAR || '\"}' AS name, max_by(latency_us, event_id)::DOUBLE AS value FROM op_log GROUP BY op, key", "op_log"))
def metrics_scrape(spark, d):
    o = op_log(spark, d).select(F.col("event_id").alias("line_no"), F.concat("op", F.lit('{key="'), F.col("key").cast("string"), F.lit('"} '), F.col("latency_us").cast("string")).alias("line"))
    noise = o.where("line_no % 10 = 0").select("line_no", F.concat(F.lit("# "), "line").alias("line")).unionByName(o.where("line_no % 17 = 0").select("line_no", F.concat("line", F.lit("x")).alias("line")))
    return telemetry.parse_prometheus(o.unionByName(noise))


@query("fun_09_merkle_root")
def merkle_root(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("object_key"), "text")
    return integrity.merkle_roots(integrity.leaves(docs, 512))


LEAVES = "SELECT doc_id, idx, sha256(unhex(substr(x, idx * 1024 + 1, 1024))) AS hash FROM (SELECT doc_id, x, unnest(range(0, (length(x) + 1023) // 1024)) AS idx FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents))"
LEAF_DIFF = f"""WITH a AS ({LEAVES}), b AS (SELECT doc_id, idx, CASE WHEN (doc_id + idx) % 3 = 0 THEN 'x' ELSE hash END AS hash FROM a),
f AS (SELECT a.doc_id, a.idx, a.idx - row_number() OVER (PARTITION BY a.doc_id ORDER BY a.idx) AS g FROM a JOIN b ON a.doc_id = b.doc_id AND a.idx = b.idx WHERE a.hash <> b.hash)
SELECT doc_id::VARCHAR AS object_key, min(idx)::INT AS "start", (max(idx) + 1)::INT AS "end" FROM f GROUP BY doc_id, g"""


@query("jon_08_merkle_leaf_diff", LEAF_DIFF)
@query("jon_08_merkle_leaf_diff_all", LEAF_DIFF)
def merkle_leaf_diff(spark, d):
    """Differing leaves of all documents, in leaves of bytes; a null text is empty and has no leaf."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("object_key"), F.coalesce("text", F.lit("")).alias("text"))
    a = integrity.leaves(docs, 512)
    b = a.withColumn("hash", F.when((F.col("object_key").cast("long") + F.col("idx")) % 3 == 0, "x").otherwise(F.col("hash")))
    return integrity.leaf_diff(a, b)


@query("win_10_range_coalesce", sql("SELECT node_id, min(h) AS \"start\", max(h) + 1 AS \"end\" FROM (SELECT node_id, h, h - row_number() OVER (PARTITION BY node_id ORDER BY h) AS g FROM (SELECT DISTINCT node_id, wall // 600000000 AS h FROM op_log)) GROUP BY node_id, g", "op_log"))
def range_coalesce(spark, d):
    return integrity.ranges(op_log(spark, d).select("node_id", F.floor(F.col("wall") / 600000000).alias("h")).distinct(), "node_id", "h")


@query("jon_07_merkle_root_compare", "SELECT doc_id::VARCHAR AS object_key FROM documents WHERE octet_length(encode(coalesce(text, ''))) > 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0)")
def merkle_root_compare(spark, d):
    """Objects whose Merkle roots differ, or that one side lacks: a replica with some first leaves spoilt and some objects lost."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("object_key"), F.coalesce("text", F.lit("")).alias("text"))
    leaves, key = integrity.leaves(docs, 512), F.col("object_key").cast("long")
    spoilt = leaves.where(key % 11 != 0).withColumn("hash", F.when((key % 7 == 0) & (F.col("idx") == 0), F.sha2("hash", 256)).otherwise(F.col("hash")))
    ours, theirs = (integrity.merkle_roots(x).select("object_key", F.col("root").alias(n)) for x, n in ((leaves, "ours"), (spoilt, "theirs")))
    return ours.join(theirs, "object_key", "full").where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("object_key")


@query("agg_05_scrub_report", sql("SELECT count(*) AS total, count(*) FILTER (WHERE o = 'healthy') AS healthy, count(*) FILTER (WHERE o IN ('corrupt', 'healed')) AS corrupt, count(*) FILTER (WHERE o = 'healed') AS healed, sum(size)::BIGINT AS bytes FROM (SELECT size, CASE created_at % 10 WHEN 0 THEN 'skipped' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'healed' ELSE 'healthy' END AS o FROM objects)", "objects"))
def scrub_report(spark, d):
    r = F.col("created_at") % 10
    return integrity.scrub_report(objects(spark, d).withColumn("outcome", F.when(r == 0, "skipped").when(r == 1, "corrupt").when(r == 2, "healed").otherwise("healthy")))


@query("fun_08_rs_encode")
def rs_encode(spark, d):
    return integrity.erasure_encode(blobs(spark, d)).select("object_key", "stripe", "shard_idx", F.hex("data").alias("data"))


@query("fun_08_rs_decode", f"SELECT object_key, {PADDED} AS data FROM {BLOBS}")
def rs_decode(spark, d):
    left = integrity.erasure_encode(blobs(spark, d)).where("(shard_idx + stripe) % 3 <> 0")
    return integrity.joined(integrity.erasure_decode(left))


@query("grf_02_callees", sql("WITH r(node, level) AS (SELECT dst, 1 FROM edges WHERE predicate = 'calls' AND src = 'p:5' UNION ALL SELECT e.dst, level + 1 FROM r JOIN edges e ON e.src = r.node WHERE predicate = 'calls' AND level < 2) SELECT node, min(level)::INT AS level FROM r GROUP BY node", "edges", recursive=True))
def callees(spark, d):
    return graphs.reach(edges(spark, d), spark.createDataFrame([("p:5",)], "node string"), 2)


@query("grf_01_callers", sql("WITH r(node, level) AS (SELECT src, 1 FROM edges WHERE predicate = 'calls' AND dst = 'n:3' UNION SELECT e.src, level + 1 FROM r JOIN edges e ON e.dst = r.node WHERE predicate = 'calls' AND level < 2) SELECT node, min(level)::INT AS level FROM r GROUP BY node", "edges", recursive=True))
def callers(spark, d):
    return graphs.reach(edges(spark, d), spark.createDataFrame([("n:3",)], "node string"), 2, forward=False)


@query("grf_03_edit_surface", sql("WITH c AS (SELECT * FROM edges WHERE predicate = 'calls'), a AS (SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS callees FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM c) WHERE n <= 30 GROUP BY src), b AS (SELECT dst AS id, string_agg(src, ',' ORDER BY src) AS callers FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM c) WHERE n <= 30 GROUP BY dst) SELECT coalesce(a.id, b.id) AS symbol_id, callees, callers FROM a FULL JOIN b ON a.id = b.id", "edges"))
def edit_surface(spark, d):
    return graphs.edit_surface(edges(spark, d)).select("symbol_id", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"))


@query("agg_16_coupling_hotspots", sql("SELECT dst AS symbol_id, count(*) AS degree FROM edges GROUP BY dst ORDER BY degree DESC, symbol_id LIMIT 20", "edges"))
def hotspots(spark, d):
    return graphs.hotspots(edges(spark, d))


@query("agg_17_graph_stats", sql("SELECT count(*) AS symbols, count(DISTINCT symbol_module) AS modules FROM symbols", "symbols"))
def graph_stats(spark, d):
    return symbols(spark, d).agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("symbol_module").alias("modules"))


@query("jon_13_cross_module_boundary", sql("SELECT src, predicate, dst FROM edges JOIN symbols a ON a.symbol_id = src JOIN symbols b ON b.symbol_id = dst WHERE a.symbol_module = 'm2' AND b.symbol_module = 'm1'", "edges", "symbols"))
def cross_module_boundary(spark, d):
    return graphs.boundary(edges(spark, d), symbols(spark, d), "m2", "m1")


@query("jon_14_edge_1hop", sql("SELECT src AS symbol_id FROM edges WHERE predicate = 'uses_type' AND dst = 'r:1'", "edges"))
def edge_1hop(spark, d):
    return edges(spark, d).where("predicate = 'uses_type' and dst = 'r:1'").select(F.col("src").alias("symbol_id"))


@query("jon_11_reference_container", sql("SELECT key AS file, wall AS line, event_id::VARCHAR AS ref, (SELECT max_by(s.event_id, (s.wall, s.event_id)) FROM op_log s WHERE s.key = o.key AND s.op = 'PUT' AND s.wall <= o.wall)::VARCHAR AS container FROM op_log o WHERE op = 'GET' AND container IS NOT NULL", "op_log"))
def reference_container(spark, d):
    o = op_log(spark, d)
    starts = o.where("op = 'PUT'").select(F.col("key").alias("file"), F.col("wall").alias("line"), F.col("event_id").cast("string").alias("symbol"))
    refs = o.where("op = 'GET'").select(F.col("key").alias("file"), F.col("wall").alias("line"), F.col("event_id").cast("string").alias("ref"))
    return graphs.containers(refs, starts)


@query("jon_12_test_edges", "SELECT a.p_partkey AS src, min(b.p_partkey) AS dst FROM part a JOIN part b ON 'test_' || b.p_name = 'test_' || a.p_name GROUP BY a.p_partkey")
def test_edges(spark, d):
    p = read(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("src"), F.regexp_extract(F.concat(F.lit("test_"), "p_name"), "(?s)^tests?_(.*)$", 1).alias("name"))
    # The least part of a name is found before parts meet, so a name shared by many gives no pairs of them.
    least = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("dst"))
    return a.join(least, "name").groupBy("src").agg(F.min("dst").alias("dst"))


@query("agg_18_list_active_docs", "SELECT lang AS type, source AS domain, min(doc_id) AS doc_id FROM documents WHERE lang <> 'de' GROUP BY lang, source")
def list_active_docs(spark, d):
    return read(spark, d, "documents").where("lang <> 'de'").groupBy(F.col("lang").alias("type"), F.col("source").alias("domain")).agg(F.min("doc_id").alias("doc_id"))


@query("win_03_hlc_now", sql("SELECT node_id, event_id, max(wall) OVER w AS clock_wall, row_number() OVER w AS clock_logical FROM op_log WINDOW w AS (PARTITION BY node_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)", "op_log"))
def hlc_now(spark, d):
    return simulations.fold_by_key(op_log(spark, d).select("node_id", "event_id", "wall"), "node_id", ["event_id"], simulations.hybrid_clock, "node_id string, event_id long, clock_wall long, clock_logical long")


@query("win_04_hlc_update")
def hlc_update(spark, d):
    o = op_log(spark, d).select("node_id", "event_id", "wall", (F.col("wall") + F.col("latency_us") % 977 * 1000).alias("received_wall"), (F.col("latency_us") % 13).alias("received_logical"))
    return simulations.fold_by_key(o, "node_id", ["event_id"], simulations.clock_update, "node_id string, event_id long, clock_wall long, clock_logical long")


def _accesses(spark, d):
    return op_log(spark, d).select(F.col("node_id").alias("bucket"), "event_id", "key", F.floor(F.col("wall") / 1000000).alias("wall"), (F.col("key") * 7 % 50 + 1).alias("size"))


CACHE = "bucket string, event_id long, hit boolean, evicted int"


@query("cac_01_gdsf")
def gdsf(spark, d):
    return simulations.fold_by_key(_accesses(spark, d), "bucket", ["event_id"], simulations.gdsf_cache(400), CACHE)


@query("cac_02_ttl_lru")
def ttl_lru(spark, d):
    return simulations.fold_by_key(_accesses(spark, d), "bucket", ["event_id"], simulations.ttl_lru_cache(20, 3600), CACHE)


@query("cac_05_ttl_expiry", sql("SELECT event_id, prev IS NOT NULL AND wall - prev <= 600000000 AS hit FROM (SELECT event_id, wall, lag(wall) OVER (PARTITION BY key ORDER BY wall, event_id) AS prev FROM op_log)", "op_log"))
def ttl_expiry(spark, d):
    prev = F.lag("wall").over(Window.partitionBy("key").orderBy("wall", "event_id"))
    return op_log(spark, d).select("event_id", F.coalesce(F.col("wall") - prev <= 600000000, F.lit(False)).alias("hit"))


@query("fun_11_bloom_k", "SELECT p_partkey AS k, greatest(1, least(16, ceil(-ln(1.0 / (p_partkey + 2)) / ln(2))))::INT AS hashes FROM part")
def bloom_k(spark, d):
    n = F.ceil(-F.log(F.lit(1.0) / (F.col("p_partkey") + 2)) / F.log(F.lit(2.0)))
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.greatest(F.lit(1), F.least(F.lit(16), n)).cast("int").alias("hashes"))


@query("str_01_lifecycle_fold")
def lifecycle_fold(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("segment_id"), "o_orderstatus")
    kinds = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("Reserve"))).when(F.col("o_orderstatus") == "F", F.array(F.lit("Reserve"), F.lit("Seal"), F.lit("Seal"))).otherwise(F.array(F.lit("Seal"), F.lit("Reserve"), F.lit("Delete"), F.lit("Seal")))
    return simulations.fold_by_key(o.select("segment_id", F.posexplode(kinds).alias("seq", "event_type")), "segment_id", ["seq"], simulations.lifecycle, "segment_id long, seq int, state string, outcome string")


@query("str_02_membership_merge")
def membership_merge(spark, d):
    o = op_log(spark, d)
    state = F.element_at(F.array(*map(F.lit, ("Alive", "Suspect", "Dead", "Left"))), (F.col("latency_us") % 4 + 1).cast("int"))
    rows = o.select(F.concat(F.lit("n"), (F.col("key") % 20).cast("string")).alias("node_id"), F.col("event_id").alias("seq"), state.alias("state"), F.floor(F.col("event_id") / 500).alias("incarnation"), F.col("latency_us").alias("version"), F.col("node_id").alias("origin"))
    return simulations.fold_by_key(rows, "node_id", ["seq"], simulations.membership, "node_id string, seq long, accepted boolean, state string, incarnation long")


@query("str_10_cache_invalidation", sql("SELECT object_key FROM objects WHERE created_at NOT IN (SELECT key FROM op_log WHERE op = 'PUT')", "objects", "op_log"))
def cache_invalidation(spark, d):
    gone = op_log(spark, d).where("op = 'PUT'").select(F.col("key").alias("created_at"))
    return objects(spark, d).join(gone, "created_at", "left_anti").select("object_key")
