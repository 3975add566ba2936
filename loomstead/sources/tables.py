"""Logical tables over the driver's files; ``CTE`` has the same tables for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(c: str) -> F.Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with their bucket, key, size in bytes and content hash."""
    d = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(F.col("source").alias("bucket"), F.concat("lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("object_key"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("hash"), F.col("doc_id").alias("created_at"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blobs of bytes; a null text is empty."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("object_key"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


#: The same in SQL, the number of stripes of 1,024 bytes of a blob, and its bytes in hex, padded to whole stripes.
BLOBS = "(SELECT doc_id, doc_id::VARCHAR AS object_key, encode(coalesce(text, '')) AS data FROM documents)"
STRIPES = "greatest(1, (octet_length(data) + 1023) // 1024)"
PADDED = f"rpad(upper(hex(data)), (2048 * {STRIPES})::INT, '0')"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with state, sealing time and target size."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("segment_id"), F.when(F.col("o_orderstatus") == "O", "Reserved").otherwise("Sealed").alias("state"), millis("o_orderdate").alias("sealed_at"), F.floor(F.col("o_totalprice") * 20).cast("long").alias("size"), (F.col("o_orderkey") % 3).cast("int").alias("pool_id"))


def chunk_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of objects (bucket = supplier, key = part) in segments; dead ones have a deletion time that counts."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("segment_id"), F.col("l_suppkey").alias("bucket"), F.col("l_partkey").alias("object_key"), F.col("l_linenumber").cast("long").alias("ordinal"),
        F.floor(F.col("l_quantity") * 1000).cast("long").alias("length"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("tie"), (F.col("l_returnflag") == "R").alias("dead"), millis("l_shipdate").alias("deleted_at"),
    )


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations with their time, latency and key."""
    e = read(spark, sf_dir, "events")
    kind = F.expr("case event_type when 'purchase' then 'PUT' when 'view' then 'GET' when 'click' then 'HEAD' when 'signup' then 'DELETE' else 'ERROR' end")
    status = F.expr("case when event_type = 'error' then 500 + event_id % 4 when event_id % 11 = 0 then 404 when event_type = 'signup' then 204 else 200 end")
    return e.select("event_id", kind.alias("op"), status.cast("long").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("wall"), F.col("user_id").alias("key"), F.floor(F.col("value") * 1000 + 0.5).cast("long").alias("latency_us"), F.concat(F.lit("node-"), (F.col("event_id") % 5).cast("string")).alias("node_id"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of a graph: parts, suppliers, nations and regions."""
    p, s, n, r = (read(spark, sf_dir, t) for t in ("part", "supplier", "nation", "region"))
    row = lambda d, kind, key, name, module: d.select(F.concat(F.lit(kind[0] + ":"), F.col(key).cast("string")).alias("symbol_id"), F.col(name).cast("string").alias("symbol_name"), F.lit(kind).alias("symbol_kind"), F.concat(F.lit("m"), module).alias("symbol_module"))
    return row(p, "part", "p_partkey", "p_name", (F.col("p_partkey") % 7).cast("string")).unionByName(row(s, "supplier", "s_suppkey", "s_name", (F.col("s_suppkey") % 5).cast("string"))).unionByName(row(n, "nation", "n_nationkey", "n_name", F.lit("0"))).unionByName(row(r, "region", "r_regionkey", "r_name", F.lit("0")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, predicate, dst) between symbols."""
    x, s, n = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    at = lambda k, c: F.concat(F.lit(k + ":"), F.col(c).cast("string"))
    calls = x.select(at("p", "l_partkey").alias("src"), F.lit("calls").alias("predicate"), at("s", "l_suppkey").alias("dst")).distinct()
    uses = s.select(at("s", "s_suppkey").alias("src"), F.lit("calls").alias("predicate"), at("n", "s_nationkey").alias("dst"))
    kinds = n.select(at("n", "n_nationkey").alias("src"), F.lit("uses_type").alias("predicate"), at("r", "n_regionkey").alias("dst"))
    return calls.unionByName(uses).unionByName(kinds)


CTE = {
    "objects": "SELECT source AS bucket, lang || '/' || lpad(doc_id::VARCHAR, 10, '0') AS object_key, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS hash, doc_id AS created_at FROM documents",
    "segments": "SELECT o_orderkey AS segment_id, CASE WHEN o_orderstatus = 'O' THEN 'Reserved' ELSE 'Sealed' END AS state, epoch_ms(o_orderdate) AS sealed_at, floor(o_totalprice * 20)::BIGINT AS size, (o_orderkey % 3)::INT AS pool_id FROM orders",
    "chunk_refs": "SELECT l_orderkey AS segment_id, l_suppkey AS bucket, l_partkey AS object_key, l_linenumber::BIGINT AS ordinal, floor(l_quantity * 1000)::BIGINT AS length, floor(l_extendedprice * 100 + 0.5)::BIGINT AS tie, l_returnflag = 'R' AS dead, epoch_ms(l_shipdate) AS deleted_at FROM lineitem",
    "op_log": "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'PUT' WHEN 'view' THEN 'GET' WHEN 'click' THEN 'HEAD' WHEN 'signup' THEN 'DELETE' ELSE 'ERROR' END AS op, (CASE WHEN event_type = 'error' THEN 500 + event_id % 4 WHEN event_id % 11 = 0 THEN 404 WHEN event_type = 'signup' THEN 204 ELSE 200 END)::BIGINT AS status, epoch_us(ts) AS wall, user_id AS key, floor(value * 1000 + 0.5)::BIGINT AS latency_us, 'node-' || (event_id % 5)::VARCHAR AS node_id FROM events",
    "symbols": "SELECT 'p:' || p_partkey::VARCHAR AS symbol_id, p_name::VARCHAR AS symbol_name, 'part' AS symbol_kind, 'm' || (p_partkey % 7)::VARCHAR AS symbol_module FROM part UNION ALL SELECT 's:' || s_suppkey::VARCHAR, s_name, 'supplier', 'm' || (s_suppkey % 5)::VARCHAR FROM supplier UNION ALL SELECT 'n:' || n_nationkey::VARCHAR, n_name, 'nation', 'm0' FROM nation UNION ALL SELECT 'r:' || r_regionkey::VARCHAR, r_name, 'region', 'm0' FROM region",
    "edges": "SELECT DISTINCT 'p:' || l_partkey::VARCHAR AS src, 'calls' AS predicate, 's:' || l_suppkey::VARCHAR AS dst FROM lineitem UNION ALL SELECT 's:' || s_suppkey::VARCHAR, 'calls', 'n:' || s_nationkey::VARCHAR FROM supplier UNION ALL SELECT 'n:' || n_nationkey::VARCHAR, 'uses_type', 'r:' || n_regionkey::VARCHAR FROM nation",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """SQL with the named logical tables in front."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    rest = body.strip()
    tables = ", ".join(f"{n} AS ({CTE[n]})" for n in names)
    return f"{head}{tables}{', ' + rest[4:].strip() if rest[:4].upper() == 'WITH' else ' ' + rest}"
