"""Cluster views, logs and their replay, codes over GF(256), documents and symbols."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, graphs, integrity, placement
from ..registry import query
from ..sources.tables import blobs, chunk_refs, edges, objects, op_log, read, segments, sql, symbols
from .store_cycles import RING, _ring

NODES = "(SELECT 'n' || s_suppkey::VARCHAR AS node_id, CASE s_suppkey % 3 WHEN 0 THEN 'Alive' WHEN 1 THEN 'Suspect' ELSE 'Dead' END AS state, s_nationkey::BIGINT AS incarnation, '10.0.0.' || s_suppkey::VARCHAR AS address FROM supplier)"


def _nodes(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(F.concat(F.lit("n"), k.cast("string")).alias("node_id"), F.when(k % 3 == 0, "Alive").when(k % 3 == 1, "Suspect").otherwise("Dead").alias("state"), F.col("s_nationkey").cast("long").alias("incarnation"), F.concat(F.lit("10.0.0."), k.cast("string")).alias("address"))


@query("agg_22_cluster_view", f"SELECT *, 256 AS vnodes, 0 AS generation FROM {NODES}")
def cluster_view(spark, d):
    return _nodes(spark, d).withColumns({"vnodes": F.lit(256), "generation": F.lit(0)})


@query("agg_20_ring_view", f"WITH {RING.format(n=5)} SELECT count(DISTINCT node_id) AS node_count, count(*) AS positions FROM ring")
def ring_view(spark, d):
    return _ring(spark).agg(F.countDistinct("node_id").alias("node_count"), F.count(F.lit(1)).alias("positions"))


SELF = "WITH {ring}, f AS (SELECT node_id, pos FROM (SELECT node_id, pos, row_number() OVER (PARTITION BY node_id ORDER BY pos) AS n FROM ring) WHERE n = 1), o AS (SELECT f.node_id, r.node_id AS other, row_number() OVER (PARTITION BY f.node_id ORDER BY r.pos < f.pos, r.pos) AS n FROM f JOIN ring r ON r.node_id <> f.node_id) SELECT node_id, other AS successor FROM o WHERE n = 1"


@query("dur_10_successor_of", SELF.format(ring=RING.format(n=5)))
def successor_of(spark, d):
    # A ring is nodes x vnodes rows; walks of each arc give the next other node.
    walks = placement.ring_walks(_ring(spark), 2)
    first = _ring(spark).groupBy("node_id").agg(F.min("pos").alias("high"))
    return walks.join(first, "high").where(F.get("nodes", F.lit(0)) == F.col("node_id")).select("node_id", F.get("nodes", F.lit(1)).alias("successor"))


@query("prj_06_is_garbage", sql("SELECT segment_id, CASE state WHEN 'Deleted' THEN true WHEN 'Sealed' THEN size >= 1000000 ELSE false END AS garbage FROM (SELECT segment_id, size, CASE WHEN segment_id % 9 = 0 THEN 'Deleted' ELSE state END AS state FROM segments)", "segments"))
def is_garbage(spark, d):
    s = segments(spark, d).withColumn("state", F.when(F.col("segment_id") % 9 == 0, "Deleted").otherwise(F.col("state")))
    return s.select("segment_id", F.when(F.col("state") == "Deleted", True).when(F.col("state") == "Sealed", F.col("size") >= 1000000).otherwise(False).alias("garbage"))


GF = """WITH RECURSIVE n AS (SELECT unnest(range(256)) AS b), m AS (
SELECT a.b AS a, n.b AS b, 0 AS i, a.b AS x, 0 AS p FROM n a, n UNION ALL
SELECT a, b, i + 1, xor((x << 1) & 255, CASE WHEN x >= 128 THEN 29 ELSE 0 END), CASE WHEN (b >> i) & 1 = 1 THEN xor(p, x) ELSE p END FROM m WHERE i < 8), gf AS (SELECT a, b, p FROM m WHERE i = 8)"""


def _gf(spark):
    log, exp = F.array(*map(F.lit, S.GF_LOG.tolist())), F.array(*map(F.lit, S.GF_EXP.tolist()))
    t = spark.range(65536).select(F.shiftright("id", 8).cast("int").alias("a"), (F.col("id") % 256).cast("int").alias("b"))
    return t.withColumn("p", F.when((F.col("a") == 0) | (F.col("b") == 0), 0).otherwise(F.get(exp, F.get(log, F.col("a")) + F.get(log, F.col("b")))))


@query("fun_05_gf_mul", f"{GF} SELECT a::INT AS a, b::INT AS b, p::INT AS p FROM gf")
def gf_mul(spark, d):
    return _gf(spark)


@query("fun_05_gf_inv", f"{GF} SELECT a::INT AS a, b::INT AS inverse FROM gf WHERE p = 1")
def gf_inv(spark, d):
    exp, log = F.array(*map(F.lit, S.GF_EXP.tolist())), F.array(*map(F.lit, S.GF_LOG.tolist()))
    return spark.range(1, 256).select(F.col("id").cast("int").alias("a"), F.get(exp, 255 - F.get(log, F.col("id").cast("int"))).alias("inverse"))


@query("fun_06_cauchy_coeff", f"{GF}, w AS (SELECT i, j, xor(j + 1, 4 + i + 1) AS v FROM (SELECT unnest(range(2)) AS i), (SELECT unnest(range(4)) AS j)) SELECT i::INT AS parity, j::INT AS shard, gf.b::INT AS coefficient FROM w JOIN gf ON gf.a = v AND gf.p = 1")
def cauchy_coeff(spark, d):
    return spark.createDataFrame([(i, j, int(c)) for i, row in enumerate(S.cauchy(4, 2)) for j, c in enumerate(row)], "parity int, shard int, coefficient int")


@query("agg_23_rs_parity")
def rs_parity(spark, d):
    """Parity bytes as an XOR aggregate of products, from the data shards of every stripe."""
    return integrity.xor_parity(integrity.erasure_encode(blobs(spark, d)))


@query("fun_14_zipf_weight", "SELECT r::INT AS rank, round(1.0 / r, 9) AS weight FROM (SELECT unnest(range(1, 101)) AS r)")
def zipf_weight(spark, d):
    return spark.range(1, 101).select(F.col("id").cast("int").alias("rank"), F.round(F.lit(1.0) / F.pow(F.col("id").cast("double"), F.lit(1.0)), 9).alias("weight"))


@query("fun_12_compress_decompress", "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS hash, true AS bounded FROM documents")
def compress_decompress(spark, d):
    """Texts through zstd and back, in Arrow batches; no result is over n + n / 16 + 64 bytes."""
    def run(batches):
        import pyarrow as pa
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # so that memory doesn't grow with the batch
                batch = whole.slice(at, 512)
                small = [pack.compress(x.as_buffer()) for x in batch.column("data")]
                yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) for x in small], pa.int64()), pa.array([unpack.decompress(x) for x in small], pa.binary())], names=["doc_id", "packed", "data"])

    rows = read(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    n = F.octet_length("data")
    return rows.mapInArrow(run, "doc_id long, packed long, data binary").select("doc_id", n.cast("long").alias("size"), F.sha2("data", 256).alias("hash"), (F.col("packed") <= n + n / 16 + 64).alias("bounded"))


@query("grf_04_edges_from_call_hierarchy", "SELECT DISTINCT s AS src, 'calls' AS predicate, t AS dst FROM (SELECT l_partkey AS s, l_suppkey AS t FROM lineitem UNION ALL SELECT l_suppkey, l_partkey FROM lineitem) WHERE s <> t")
def edges_from_call_hierarchy(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return catalog.hierarchy_edges(x, x.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "calls")


@query("grf_05_edges_from_type_hierarchy", "SELECT DISTINCT 'n' || n_nationkey::VARCHAR AS src, 'implements' AS predicate, 'r' || n_regionkey::VARCHAR AS dst FROM nation")
def edges_from_type_hierarchy(spark, d):
    up = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    return catalog.hierarchy_edges(up, up, "implements")


NAMED = "(SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'test_' WHEN 1 THEN 'tests_' ELSE '' END || p_name AS name, CASE p_partkey % 5 WHEN 0 THEN '#[test] fn' WHEN 1 THEN 'Pub fn' WHEN 2 THEN 'private fn' WHEN 3 THEN 'protected fn' ELSE 'fn' END AS detail, CASE p_partkey % 3 WHEN 0 THEN 'function' ELSE 'method' END AS kind FROM part)"
IS_TEST = "(starts_with(name, 'test_') OR starts_with(name, 'tests_') OR contains(detail, '#[test]'))"


def _named(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 4 == 0, "test_").when(k % 4 == 1, "tests_").otherwise(""), F.col("p_name"))
    detail = F.when(k % 5 == 0, "#[test] fn").when(k % 5 == 1, "Pub fn").when(k % 5 == 2, "private fn").when(k % 5 == 3, "protected fn").otherwise("fn")
    return read(spark, d, "part").select(k.alias("id"), name.alias("name"), detail.alias("detail"), F.when(k % 3 == 0, "function").otherwise("method").alias("kind"))


@query("prj_15_visibility", f"SELECT id, CASE WHEN {IS_TEST} THEN 'private' WHEN contains(lower(detail), 'pub ') THEN 'pub' WHEN contains(lower(detail), 'private') THEN 'private' WHEN contains(lower(detail), 'protected') THEN 'protected' WHEN kind = 'function' THEN 'pub' ELSE 'private' END AS visibility FROM {NAMED}")
def symbol_visibility(spark, d):
    return _named(spark, d).select("id", catalog.visibility(F.col("detail"), F.col("kind"), catalog.is_test(F.col("name"), F.col("detail"))).alias("visibility"))


@query("prj_16_tested_symbol", f"SELECT id, {IS_TEST} AS test, CASE WHEN starts_with(name, 'test_') THEN substr(name, 6) WHEN starts_with(name, 'tests_') THEN substr(name, 7) END AS tested FROM {NAMED}")
def tested_symbol(spark, d):
    return _named(spark, d).select("id", catalog.is_test(F.col("name"), F.col("detail")).alias("test"), catalog.tested_symbol(F.col("name")).alias("tested"))


@query("dur_16_get_signature", sql("SELECT symbol_id, symbol_kind || ' ' || symbol_name AS signature FROM symbols WHERE symbol_id = 'p:7'", "symbols"))
def get_signature(spark, d):
    return symbols(spark, d).where("symbol_id = 'p:7'").select("symbol_id", F.concat_ws(" ", "symbol_kind", "symbol_name").alias("signature"))


@query("src_16_markdown_source", "SELECT doc_id, lang AS type, 'global' AS domain, 'none' AS feature, CASE WHEN doc_id % 2 = 0 THEN 'superseded' ELSE 'active' END AS status, sha256(coalesce(text, '')) AS body FROM documents")
def markdown_source(spark, d):
    head = F.concat(F.lit("---\ntype: "), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "\nstatus: superseded").otherwise(""), F.lit("\n---\n"))
    docs = read(spark, d, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    fields, body = catalog.front_matter(F.col("text"))
    return docs.select("doc_id", *[fields[c].alias(c) for c in ("type", "domain", "feature", "status")], F.sha2(body, 256).alias("body"))


@query("src_17_doc_versions", sql("SELECT object_key, CASE WHEN created_at % 3 = 0 THEN 'blob' WHEN created_at % 5 = 0 THEN 'tree' WHEN created_at % 7 = 0 THEN 'indexed' END AS content FROM objects", "objects"))
def doc_versions(spark, d):
    o = objects(spark, d).select("object_key", "created_at")
    one = lambda n, name: o.where(F.col("created_at") % n == 0).select("object_key", F.lit(name).alias(name))
    all_ = o.join(one(3, "blob"), "object_key", "left").join(one(5, "tree"), "object_key", "left").join(one(7, "indexed"), "object_key", "left")
    return all_.select("object_key", F.coalesce("blob", "tree", "indexed").alias("content"))


@query("src_19_lsp_symbols", "WITH r AS (SELECT 'r' || r_regionkey::VARCHAR || '.rs' AS uri, r_name AS name, NULL AS parent, r_regionkey + 1 AS line, r_regionkey AS k FROM region) SELECT uri, name, parent, line::BIGINT AS line, substr(sha256(uri || '::' || name || '::' || line::VARCHAR), 1, 16) AS id FROM (SELECT uri, name, parent, line FROM r UNION ALL SELECT uri, n_name, name, n_nationkey + 1 FROM r JOIN nation ON n_regionkey = k)")
def lsp_symbols(spark, d):
    n = read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("line")))).alias("children"))
    r = read(spark, d, "region").join(n, "r_regionkey", "left")
    files = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(".rs")).alias("uri"), F.to_json(F.array(F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").alias("line"), "children"))).alias("symbols"))
    return catalog.flat_symbols(files)


@query("snk_11_vector_upsert", "SELECT label::BIGINT AS path, vec_id FROM embeddings WHERE label % 2 = 0 UNION ALL SELECT label::BIGINT, vec_id + 1000000 FROM embeddings WHERE label % 2 = 1 AND vec_id % 2 = 0 UNION ALL SELECT label::BIGINT, vec_id FROM embeddings WHERE label % 2 = 1 AND label NOT IN (SELECT label FROM embeddings WHERE vec_id % 2 = 0)")
def vector_upsert(spark, d):
    old = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("path"), "vec_id")
    new = old.where("path % 2 = 1 and vec_id % 2 = 0").withColumn("vec_id", F.col("vec_id") + 1000000)
    return catalog.replace_by_key(old, new, "path")


@query("snk_11_point_id")
def point_ids(spark, d):
    return read(spark, d, "embeddings").select("vec_id", catalog.point_id(F.concat_ws("::", F.col("label").cast("string"), F.lit("a"), F.col("vec_id").cast("string"))).alias("point_id"))


@query("snk_13_graph_upsert", sql("SELECT symbol_id, CASE WHEN symbol_kind = 'supplier' THEN 'new ' || symbol_name ELSE symbol_name END AS symbol_name FROM symbols WHERE symbol_kind <> 'region'", "symbols"))
def graph_upsert(spark, d):
    s = symbols(spark, d).select("symbol_id", "symbol_name", "symbol_kind", F.lit(0).alias("v"))
    new = s.where("symbol_kind = 'supplier'").withColumns({"symbol_name": F.concat(F.lit("new "), F.col("symbol_name")), "v": F.lit(1)})
    gone = s.where("symbol_kind = 'region'").select("symbol_id")
    return catalog.newest_symbols(s.unionByName(new), "v").join(gone, "symbol_id", "left_anti").select("symbol_id", "symbol_name")


@query("snk_10_report_json", sql("SELECT op, '{\"op\":\"' || op || '\",\"ops\":' || count(*)::VARCHAR || ',\"errors\":' || (count(*) FILTER (WHERE status >= 500))::VARCHAR || '}' AS line FROM op_log GROUP BY op", "op_log"))
def report_json(spark, d):
    per = op_log(spark, d).groupBy("op").agg(F.count(F.lit(1)).alias("ops"), F.count_if(F.col("status") >= 500).alias("errors"))
    return per.select("op", F.to_json(F.struct("op", "ops", "errors")).alias("line"))


@query("top_03_pinned_pool", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 <> 0 AND s_nationkey = 3")
def pinned_pool(spark, d):
    pools = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 == 0, "Failed").otherwise("Healthy").alias("status"), F.col("s_nationkey").alias("role"))
    return pools.where("role = 3 and status = 'Healthy'").select("id")


@query("top_05_first_n", sql("SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM edges) WHERE n <= 5", "edges"))
def first_n(spark, d):
    return catalog.first_n(edges(spark, d), "src", ["dst"], 5).select("src", "dst")


@query("top_07_eviction_victim", sql("SELECT node_id, min_by(key, (used * 1000000 + key)) AS victim FROM (SELECT node_id, key, max(event_id) AS used FROM op_log GROUP BY node_id, key) GROUP BY node_id", "op_log"))
def eviction_victim(spark, d):
    used = op_log(spark, d).groupBy("node_id", "key").agg(F.max("event_id").alias("used"))
    return used.groupBy("node_id").agg(F.min_by("key", F.struct("used", "key")).alias("victim"))


#: Queries are the rows whose id is divisible by 50, against all rows.
NEAREST = "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[])), 4) AS score FROM embeddings, q) SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 8"


@query("txt_03_vector_search", NEAREST)
@query("txt_03_vector_search_all", NEAREST)
def vector_search_all(spark, d):
    """The eight nearest rows of each query."""
    v = read(spark, d, "embeddings")
    return graphs.vector_topk_of_all(v, v.where("vec_id % 50 = 0"))


@query("str_04_wal_replay", sql("SELECT segment_id, count(*) AS entries, sum(length)::BIGINT AS bytes, max(deleted_at) AS newest FROM chunk_refs WHERE segment_id NOT IN (SELECT segment_id FROM segments WHERE state = 'Sealed') GROUP BY segment_id", "chunk_refs", "segments"))
def wal_replay(spark, d):
    sealed = segments(spark, d).where("state = 'Sealed'").select("segment_id")
    left = chunk_refs(spark, d).join(sealed, "segment_id", "left_anti")
    return left.groupBy("segment_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("length").alias("bytes"), F.max("deleted_at").alias("newest"))


@query("str_03_suspicion_timeout", sql("SELECT key, event_id FROM (SELECT key, event_id, wall, status, lead(wall) OVER (PARTITION BY key ORDER BY wall, event_id) AS next FROM op_log) WHERE status >= 500 AND (next IS NULL OR next - wall > 3600000000)", "op_log"))
def suspicion_timeout(spark, d):
    """Failed probes after which nothing was heard of the node within an hour."""
    from pyspark.sql import Window

    heard = F.lead("wall").over(Window.partitionBy("key").orderBy("wall", "event_id"))
    return op_log(spark, d).withColumn("next", heard).where("status >= 500 and (next is null or next - wall > 3600000000)").select("key", "event_id")


LAST = "max_by(op, event_id) AS op, max(event_id) AS event_id"


@query("str_11_checkpoint_resume", sql(f"SELECT key, {LAST} FROM op_log GROUP BY key", "op_log"))
def checkpoint_resume(spark, d):
    """State at a snapshot, then the events after it: the same as all events."""
    o = op_log(spark, d).select("key", "op", "event_id")
    fold = lambda rows: rows.groupBy("key").agg(F.max_by("op", "event_id").alias("op"), F.max("event_id").alias("event_id"))
    return fold(fold(o.where("event_id < 400")).unionByName(o.where("event_id >= 400")))


@query("snk_07_checkpoint_write", sql(f"SELECT key, {LAST} FROM op_log WHERE event_id < 400 GROUP BY key", "op_log"))
def checkpoint_write(spark, d):
    o = op_log(spark, d).where("event_id < 400")
    return o.groupBy("key").agg(F.max_by("op", "event_id").alias("op"), F.max("event_id").alias("event_id"))


@query("str_06_hint_queue", sql("SELECT node_id, key, event_id FROM (SELECT node_id, key, event_id, wall, row_number() OVER (PARTITION BY node_id, key ORDER BY event_id DESC) AS n FROM op_log WHERE op = 'PUT') WHERE n = 1 AND event_id >= 100", "op_log"))
def hint_queue(spark, d):
    """Hints that stand for delivery: the newest of each target and key that is not too old."""
    rows = op_log(spark, d).where("op = 'PUT'").groupBy("node_id", "key").agg(F.max("event_id").alias("event_id"))
    return rows.where("event_id >= 100")


@query("str_07_seal_timeout", sql("SELECT segment_id, CASE WHEN size >= 4000000 THEN 'full' ELSE 'timeout' END AS why FROM segments WHERE state = 'Reserved' AND (size >= 4000000 OR sealed_at + 86400000 < 1000000000000)", "segments"))
def seal_timeout(spark, d):
    due = "state = 'Reserved' and (size >= 4000000 or sealed_at + 86400000 < 1000000000000)"
    return segments(spark, d).where(due).select("segment_id", F.when(F.col("size") >= 4000000, "full").otherwise("timeout").alias("why"))
