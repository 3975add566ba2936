"""Writes, deletes, listings, assembly and heals of objects; caches and commits; sections and search of documents."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, graphs, integrity, simulations, stores
from ..registry import query
from ..sources.tables import chunk_refs, objects, op_log, read, segments, sql

UPSERT = """WITH w AS (SELECT bucket, object_key, size + 1 AS size FROM objects WHERE created_at % 3 = 0)
SELECT 'object' AS kind, bucket, object_key, size FROM objects WHERE created_at % 3 <> 0 UNION ALL SELECT 'object', * FROM w
UNION ALL SELECT 'tombstone', bucket, object_key, NULL FROM objects WHERE created_at % 2 = 0 AND created_at % 3 <> 0"""


@query("snk_01_upsert_object", sql(UPSERT, "objects"))
def upsert(spark, d):
    """Objects after a third was written again; of the tombstones of every second key those of written keys go."""
    o = objects(spark, d)
    writes = o.where("created_at % 3 = 0").withColumn("size", F.col("size") + 1)
    now, tombs = stores.upsert(o, o.where("created_at % 2 = 0").select("bucket", "object_key"), writes)
    row = lambda rows, kind, size: rows.select(F.lit(kind).alias("kind"), "bucket", "object_key", size.cast("long").alias("size"))
    return row(now, "object", F.col("size")).unionByName(row(tombs, "tombstone", F.lit(None)))


DELETE = """WITH o AS (SELECT bucket, object_key, string_agg(segment_id::VARCHAR || ':' || ordinal::VARCHAR || ':' || length::VARCHAR, ',' ORDER BY segment_id, ordinal, length) AS chunks FROM chunk_refs GROUP BY ALL),
k AS (SELECT bucket, object_key FROM o WHERE object_key % 3 = 0 UNION ALL SELECT DISTINCT -1, object_key FROM o WHERE object_key % 50 = 0)
SELECT 'object' AS kind, bucket, object_key, NULL::BIGINT AS deletion_time, NULL::BIGINT AS clock_wall, NULL::BIGINT AS clock_logical, chunks FROM o WHERE object_key % 3 <> 0
UNION ALL SELECT 'tombstone', k.bucket, k.object_key, 1700000000000, 1700000000001, 7, coalesce(o.chunks, '') FROM k LEFT JOIN o ON o.bucket = k.bucket AND o.object_key = k.object_key"""


@query("snk_02_delete_object", sql(DELETE, "chunk_refs"))
def delete(spark, d):
    """Objects that are left and the tombstones of deleted ones with their chunks; some keys never had an object."""
    chunk = F.struct("segment_id", "ordinal", "length")
    o = chunk_refs(spark, d).groupBy("bucket", "object_key").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))
    missing = o.where("object_key % 50 = 0").select(F.lit(-1).cast("long").alias("bucket"), "object_key")
    left, tombs = stores.delete(o, o.where("object_key % 3 = 0").select("bucket", "object_key").unionByName(missing), 1700000000000, (1700000000001, 7))
    text = F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["segment_id"].cast("string"), c["ordinal"].cast("string"), c["length"].cast("string"))), ",")
    stamps = ["deletion_time", "clock_wall", "clock_logical"]
    kept = left.select(F.lit("object").alias("kind"), "bucket", "object_key", *[F.lit(None).cast("long").alias(c) for c in stamps], text.alias("chunks"))
    return kept.unionByName(tombs.select(F.lit("tombstone").alias("kind"), "bucket", "object_key", *stamps, text.alias("chunks")))


KINDS = {"PUT": "PutObject", "DELETE": "DeleteObject", "GET": "PutTombstone", "HEAD": "DeleteTombstone"}
BATCH = """WITH b AS (SELECT key, event_id, op IN ('PUT', 'DELETE') AS of_objects, op IN ('PUT', 'GET') AS puts, latency_us AS value FROM op_log WHERE op IN ('PUT', 'DELETE', 'GET', 'HEAD') AND key IS NOT NULL),
l AS (SELECT key, of_objects, max_by(puts, event_id) AS puts, max_by(value, event_id) AS value FROM b GROUP BY ALL)
SELECT 'object' AS kind, 'b' AS bucket, c_custkey AS object_key, c_nationkey::BIGINT AS value FROM customer WHERE c_custkey NOT IN (SELECT key FROM l WHERE of_objects)
UNION ALL SELECT 'tombstone', 'b', c_custkey, -1 FROM customer WHERE c_custkey % 4 = 0 AND c_custkey NOT IN (SELECT key FROM l WHERE NOT of_objects)
UNION ALL SELECT CASE WHEN of_objects THEN 'object' ELSE 'tombstone' END, 'b', key, value FROM l WHERE puts"""


@query("snk_03_batch_write", sql(BATCH, "op_log"))
def batch_write(spark, d):
    """Objects and tombstones after a batch of puts and deletes of both."""
    named = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    ops = op_log(spark, d).where(F.col("op").isin(*KINDS)).where("key is not null").select(F.lit("b").alias("bucket"), F.col("key").alias("object_key"), F.col("event_id").alias("seq"), named[F.col("op")].alias("op"), F.col("latency_us").alias("value"))
    held = read(spark, d, "customer").select(F.lit("b").alias("bucket"), F.col("c_custkey").cast("long").alias("object_key"), F.col("c_nationkey").cast("long").alias("value"))
    now, tombs = stores.batch_write(held, held.where("object_key % 4 = 0").withColumn("value", F.lit(-1).cast("long")), ops)
    return now.select(F.lit("object").alias("kind"), "*").unionByName(tombs.select(F.lit("tombstone").alias("kind"), "*"))


ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;')"
LIST = f"""WITH p AS (SELECT bucket, split_part(object_key, '/', 1) || '/''&' AS prefix, object_key, size, hash, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY bucket, split_part(object_key, '/', 1)) AS n_all FROM objects WINDOW w AS (PARTITION BY bucket, split_part(object_key, '/', 1) ORDER BY object_key)),
g AS (SELECT bucket, prefix, n // 20 AS page, count(*) AS keys, max(object_key) AS last, (n // 20 + 1) * 20 < any_value(n_all) AS more, string_agg(chr(10) || '  <Contents>' || chr(10) || '    <Key>' || {ESCAPED.format("object_key")} || '</Key>' || chr(10) || '    <Size>' || size::VARCHAR || '</Size>' || chr(10) || '    <ETag>&quot;' || hash || '&quot;</ETag>' || chr(10) || '    <StorageClass>STANDARD</StorageClass>' || chr(10) || '  </Contents>', '' ORDER BY object_key) AS body FROM p GROUP BY bucket, prefix, n // 20)
SELECT bucket, prefix, page, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">' || chr(10) || '  <Name>' || bucket || '</Name>' || chr(10) || '  <Prefix>' || {ESCAPED.format("prefix")} || '</Prefix>' || chr(10) || '  <KeyCount>' || keys::VARCHAR || '</KeyCount>' || chr(10) || '  <MaxKeys>1000</MaxKeys>' || chr(10) || '  <IsTruncated>' || CASE WHEN more THEN 'true' ELSE 'false' END || '</IsTruncated>' || CASE WHEN more THEN chr(10) || '  <NextContinuationToken>' || {ESCAPED.format("last")} || '</NextContinuationToken>' ELSE '' END || body || chr(10) || '</ListBucketResult>' AS xml FROM g"""


@query("snk_09_list_xml", sql(LIST, "objects"))
def list_xml(spark, d):
    """Every page of twenty keys of each bucket and prefix, as XML."""
    o = objects(spark, d).select("bucket", F.concat(F.substring_index("object_key", "/", 1), F.lit("/'&")).alias("prefix"), "object_key", "size", F.col("hash").alias("etag"))
    xml = S.list_xml(F.col("bucket"), F.col("prefix"), F.col("contents"), F.col("token"))
    return stores.list_pages(o, 20).select("bucket", "prefix", "page", xml.alias("xml"))


ASSEMBLED = """SELECT doc_id::VARCHAR AS object_key, outcome, CASE WHEN outcome = 'ok' THEN octet_length(encode(t))::INT END AS size FROM (SELECT doc_id, t,
CASE WHEN doc_id % 7 IN (1, 4) AND n > 1 THEN 'out of order' WHEN doc_id % 7 IN (2, 4) AND n > 0 THEN 'incomplete' WHEN doc_id % 7 = 3 THEN 'hash mismatch' ELSE 'ok' END AS outcome
FROM (SELECT doc_id, coalesce(text, '') AS t, (length(coalesce(text, '')) + 999) // 1000 AS n FROM documents))"""


@query("dur_01_assemble_chunks", ASSEMBLED)
def assemble_chunks(spark, d):
    """Documents put together from chunks of which some came swapped, without the first or last, or spoilt."""
    r, text = F.col("doc_id") % 7, F.coalesce("text", F.lit(""))
    docs = read(spark, d, "documents").select("doc_id", text.alias("text"), F.ceil(F.char_length(text) / 1000).cast("int").alias("n"))
    objs = docs.select(F.col("doc_id").cast("string").alias("object_key"), F.col("n").alias("chunk_count"), F.sha2(F.when(r == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    at = docs.where("n > 0").select("doc_id", "n", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    sent = at.where(~((r == 2) & (F.col("idx") == F.col("n") - 1)) & ~((r == 4) & (F.col("idx") == 0)))
    arrival = F.when((r == 1) & (F.col("idx") < 2), 1 - F.col("idx")).otherwise(F.col("idx"))
    part = F.encode(F.substring(F.col("text"), F.col("idx") * 1000 + 1, F.lit(1000)), "UTF-8")
    chunks = sent.select(F.col("doc_id").cast("string").alias("object_key"), arrival.alias("arrival"), "idx", part.alias("data"))
    return integrity.assembled(chunks, objs).select("object_key", "outcome", F.octet_length("data").alias("size"))


@query("dur_05_heal_retry", sql("SELECT event_id, latency_us % 6 < 4 AS requeued, latency_us % 6 + (latency_us % 6 < 4)::INT AS retry_count FROM op_log WHERE status >= 500", "op_log"))
def heal_retry(spark, d):
    failed = op_log(spark, d).where("status >= 500").select("event_id", (F.col("latency_us") % 6).alias("retry_count"))
    return integrity.requeued(failed, 4)


@query("dur_07_continuous_root_compare", sql("SELECT segment_id, node_id FROM segments, (VALUES ('n0', 0), ('n1', 1), ('n3', 3)) n(node_id, k) WHERE state = 'Sealed' AND (segment_id % 100 = k OR segment_id % 97 = 0)", "segments"))
def continuous_root_compare(spark, d):
    """Every sealed segment's root as each live member of a small cluster answers it."""
    sealed = segments(spark, d).where("state = 'Sealed'").select("segment_id", F.sha2(F.col("segment_id").cast("string"), 256).alias("root"))
    alive = F.array(*[F.struct(F.lit(f"n{k}").alias("node_id"), F.lit(k).alias("k")) for k in (0, 1, 3)])
    asked = sealed.withColumn("peer", F.explode(alive))
    answer = F.when(F.col("segment_id") % 100 == F.col("peer.k"), "x").when(F.col("segment_id") % 97 != 0, F.col("root"))
    return integrity.root_mismatches(sealed, asked.select("segment_id", "peer.node_id", answer.alias("root")))


ABSENT = "SELECT node_id AS bucket, key, event_id, op, op = 'GET' AND coalesce(last_value(CASE WHEN op IN ('PUT', 'DELETE') THEN op END IGNORE NULLS) OVER (PARTITION BY node_id, key ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 'DELETE', false) AS absent FROM op_log"


def _requests(spark, d):
    return op_log(spark, d).select(F.col("node_id").alias("bucket"), "key", "event_id", "op")


@query("cac_03_negative_cache", sql(ABSENT, "op_log"))
def negative_cache(spark, d):
    """What is known to be absent without a bound on keys written since."""
    return stores.known_absent(_requests(spark, d))


@query("cac_03_negative_cache_bounded")
def negative_cache_bounded(spark, d):
    """The same with all of a bucket forgotten beyond twenty keys written since: one ordered fold per bucket."""
    return simulations.fold_by_key(_requests(spark, d), "bucket", ["event_id"], simulations.negative_cache(20), "bucket string, key long, event_id long, op string, absent boolean")


@query("str_05_group_commit", sql("SELECT segment_id, batch, count(*) AS entries, sum(length)::BIGINT AS bytes FROM (SELECT segment_id, length, (row_number() OVER (PARTITION BY segment_id ORDER BY ordinal, tie, bucket, object_key) - 1) // 4 AS batch FROM chunk_refs) GROUP BY segment_id, batch", "chunk_refs"))
def group_commit(spark, d):
    """Waiters of a segment that came at once, at most four to a commit."""
    rows = chunk_refs(spark, d).select("segment_id", "ordinal", "tie", "bucket", "object_key", "length", F.lit(0).cast("long").alias("at"))
    made = simulations.fold_by_key(rows, "segment_id", ["at", "ordinal", "tie", "bucket", "object_key"], simulations.group_commit(4, 5), "segment_id long, ordinal long, tie long, bucket long, object_key long, length long, at long, commit long, starts long")
    return made.groupBy("segment_id", F.col("commit").alias("batch")).agg(F.count(F.lit(1)).alias("entries"), F.sum("length").alias("bytes"))


@query("str_05_group_commit_times")
def group_commit_times(spark, d):
    """Commits of each node's operations as they came, of five milliseconds and sixty-four waiters at the most."""
    rows = op_log(spark, d).select(F.col("node_id").alias("log"), "event_id", F.floor(F.col("wall") / 1000).alias("at"))
    return simulations.fold_by_key(rows, "log", ["at", "event_id"], simulations.group_commit(64, 5), "log string, event_id long, at long, commit long, starts long")


def _markdown(spark, d):
    """Documents of which some lines were made headings."""
    line = lambda x, i: F.when(i % 10 == 6, "# Notes").when(i % 5 == 3, F.concat(F.lit("### "), F.substring(x, 1, 20))).otherwise(x)
    return read(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


SECTIONS = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, n, CASE WHEN n % 10 = 6 THEN '# Notes' WHEN n % 5 = 3 THEN '### ' || substr(raw, 1, 20) ELSE raw END AS line FROM l),
h AS (SELECT *, regexp_matches(line, '^#{1,6}\s+') AS head FROM m), c AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM h),
s AS (SELECT doc_id, section, coalesce(max(CASE WHEN head THEN trim(regexp_replace(line, '^#{1,6}\s+', '')) END), '(preamble)') AS title, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT head), ''), '^\s+|\s+$', '', 'g') AS body FROM c GROUP BY doc_id, section),
t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\pL\pM\pN_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM s WHERE title <> '(preamble)' OR body <> ''),
u AS (SELECT *, coalesce(nullif(base, ''), 'section') AS slug FROM t),
sections AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1)::INT AS "index", title, slug || CASE WHEN row_number() OVER (PARTITION BY doc_id, slug ORDER BY section) > 1 THEN '-' || (row_number() OVER (PARTITION BY doc_id, slug ORDER BY section) - 1)::VARCHAR ELSE '' END AS anchor, body FROM u)
"""


@query("txt_01_chunk_blocks", SECTIONS + 'SELECT doc_id, "index", title, body FROM sections')
def chunk_blocks(spark, d):
    return catalog.markdown_sections(_markdown(spark, d), "doc_id").drop("anchor")


@query("win_15_anchor_dedup", SECTIONS + 'SELECT doc_id, "index", anchor FROM sections')
def anchor_dedup(spark, d):
    return catalog.markdown_sections(_markdown(spark, d), "doc_id").select("doc_id", "index", "anchor")


POINTS = "SELECT vec_id, embedding, CASE vec_id % 7 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'superseded' WHEN 3 THEN 'draft' ELSE 'active' END AS status, lang AS type, 'd' || (vec_id % 3)::VARCHAR AS domain, coalesce(text, '') AS chunk_text FROM embeddings LEFT JOIN documents ON doc_id = vec_id"
SEARCH = "WITH p AS ({points}), s AS (SELECT q.vec_id AS query_id, p.vec_id, round(list_dot_product(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 4) AS score, status, type, domain, substr(chunk_text, 1, 300) || CASE WHEN length(chunk_text) > 300 THEN '…' ELSE '' END AS snippet FROM p, embeddings q WHERE q.vec_id % 50 = 0 AND {where}) SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 8"


def _points(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("type"), F.col("text").alias("chunk_text"))
    r = F.col("vec_id") % 7
    status = F.when(r == 0, "deprecated").when(r == 1, "superseded").when(r == 3, "draft").otherwise("active")
    return read(spark, d, "embeddings").select("vec_id", "embedding").join(docs, "vec_id", "left").withColumns({"status": status, "domain": F.concat(F.lit("d"), (F.col("vec_id") % 3).cast("string"))})


@query("top_01_vector_topk", SEARCH.format(points=POINTS, where="status = 'active' AND type = 'en'"))
def vector_topk(spark, d):
    """The eight nearest active points of one type of each query; queries are all rows whose id is divisible by 50."""
    return graphs.vector_search(_points(spark, d), read(spark, d, "embeddings").where("vec_id % 50 = 0"), doc_type="en")


@query("top_01_vector_topk_tiers", SEARCH.format(points=POINTS, where="status IN ('active', 'superseded', 'deprecated', 'deleted') AND domain = 'd1'"))
def vector_topk_tiers(spark, d):
    """The same among points of one domain, deprecated ones too."""
    return graphs.vector_search(_points(spark, d), read(spark, d, "embeddings").where("vec_id % 50 = 0"), domain="d1", include_deprecated=True)
