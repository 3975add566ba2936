"""Keyed reads and writes, merging and garbage collection of an object store, as DataFrame operators."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_get(objects: DataFrame, bucket: str, key: str) -> DataFrame:
    return objects.where((F.col("bucket") == bucket) & (F.col("object_key") == key))


def prefix_list(objects: DataFrame, bucket: str, prefix: str, marker: str | None = None, limit: int | None = None) -> DataFrame:
    """Keys with a prefix in binary order; marker and limit page through them."""
    out = objects.where((F.col("bucket") == bucket) & F.col("object_key").startswith(prefix))
    out = out.where(F.col("object_key") > marker) if marker is not None else out
    out = out.orderBy("object_key")
    return out.limit(limit) if limit else out


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last writer wins: of each key the row with the greatest order columns; a map-side combinable maximum."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col("__best")[c].alias(c) for c in rest])


def upsert(objects: DataFrame, tombstones: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects after writes, and the tombstones that the writes leave."""
    keys = ["bucket", "object_key"]
    return objects.join(writes, keys, "left_anti").unionByName(writes), tombstones.join(writes, keys, "left_anti")


def delete(objects: DataFrame, keys: DataFrame, now: int, clock: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Objects without the keys, and a tombstone for each key with the chunks its object had.

    A key that no object has gets a tombstone without chunks. ``objects`` has bucket, object_key and an array, chunks.
    """
    by, none = ["bucket", "object_key"], F.array().cast(objects.schema["chunks"].dataType)
    keys = keys.select(*by).distinct()
    found = keys.join(objects.select(*by, "chunks"), by, "left")
    stamp = [F.lit(x).cast("long").alias(n) for x, n in ((now, "deletion_time"), (clock[0], "clock_wall"), (clock[1], "clock_logical"))]
    return objects.join(keys, by, "left_anti"), found.select(*by, *stamp, F.coalesce("chunks", none).alias("chunks"))


#: Operations of a batch: the table each is on, and whether it puts a row or takes one away.
BATCH = {"PutObject": ("objects", True), "DeleteObject": ("objects", False), "PutTombstone": ("tombstones", True), "DeleteTombstone": ("tombstones", False)}


def batch_write(objects: DataFrame, tombstones: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after a batch; in each the last operation on a key (seq orders them) wins.

    All three have (bucket, object_key, value); ``ops`` also has seq and op, one of BATCH.
    """
    by, out = ["bucket", "object_key"], []
    for name, table in (("objects", objects), ("tombstones", tombstones)):
        puts = [op for op, (of, put) in BATCH.items() if of == name and put]
        last = newest(ops.where(F.col("op").isin([op for op, (of, _) in BATCH.items() if of == name])), by, ["seq"])
        out.append(table.select(*by, "value").join(last, by, "left_anti").unionByName(last.where(F.col("op").isin(puts)).select(*by, "value")))
    return out[0], out[1]


def list_pages(objects: DataFrame, size: int = 1000) -> DataFrame:
    """One listing per bucket, prefix and page of ``size`` keys, in binary order of keys.

    ``contents`` are the page's (object_key, size, etag); ``token`` is the last key of a page that isn't the last, else null.
    Places come from global ranks, so that no task has to hold a bucket.
    """
    ranked = global_rank(objects.select("bucket", "prefix", "object_key", "size", "etag"), "bucket", "prefix", "object_key")
    group = ranked.groupBy("bucket", "prefix").agg(F.min("rank").alias("__first"), F.count(F.lit(1)).alias("__n"))
    placed = ranked.join(group, ["bucket", "prefix"]).withColumn("page", F.floor((F.col("rank") - F.col("__first")) / size).cast("long"))
    pages = placed.groupBy("bucket", "prefix", "page", "__n").agg(F.sort_array(F.collect_list(F.struct("object_key", "size", "etag"))).alias("contents"))
    more = (F.col("page") + 1) * size < F.col("__n")
    return pages.select("bucket", "prefix", "page", "contents", F.when(more, F.element_at("contents", -1)["object_key"]).alias("token"))


def known_absent(accesses: DataFrame) -> DataFrame:
    """Accesses (bucket, key, event_id, op) and whether a GET meets a key last deleted, not written since: one window per key."""
    w = Window.partitionBy("bucket", "key").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("op").isin("PUT", "DELETE"), F.col("op")), ignorenulls=True).over(w)
    return accesses.withColumn("absent", F.coalesce((F.col("op") == "GET") & (last == "DELETE"), F.lit(False)))


def liveness(refs: DataFrame) -> DataFrame:
    """Live and dead bytes and their ratio per segment; 1 without bytes."""
    live = F.sum(F.when(~F.col("dead"), F.col("length")).otherwise(0))
    dead = F.sum(F.when(F.col("dead"), F.col("length")).otherwise(0))
    out = refs.groupBy("segment_id").agg(live.alias("live"), dead.alias("dead"))
    total = F.col("live") + F.col("dead")
    return out.withColumn("ratio", F.when(total == 0, 1.0).otherwise(F.col("live") / total))


def compaction_candidates(refs: DataFrame, below: float = 0.5) -> DataFrame:
    return liveness(refs).where(F.col("ratio") < below)


def expired(deleted_at: Column, now: int, ttl_s: int) -> Column:
    """Strictly older than the time to live."""
    return F.lit(now) - deleted_at > ttl_s * 1000


def orphans(segments: DataFrame, refs: DataFrame, now: int, ttl_ms: int) -> DataFrame:
    """Sealed segments that no object refers to and that are older than the time to live."""
    old = segments.where((F.col("state") == "Sealed") & (F.lit(now) - F.col("sealed_at") > ttl_ms))
    return old.join(refs.select("segment_id"), "segment_id", "left_anti")


def disk_orphans(files: DataFrame, segments: DataFrame, refs: DataFrame, now: int, ttl_ms: int) -> DataFrame:
    """Files of segments that are neither registered nor referred to."""
    old = files.where((F.col("mtime") > 0) & (F.lit(now) - F.col("mtime") > ttl_ms))
    return old.join(segments.select("segment_id"), "segment_id", "left_anti").join(refs.select("segment_id"), "segment_id", "left_anti")


def repacked(refs: DataFrame) -> DataFrame:
    """New offsets of a segment's live chunks: a running sum in (object, chunk) order."""
    w = Window.partitionBy("segment_id").orderBy("bucket", "object_key", "ordinal", "tie")
    return refs.where(~F.col("dead")).withColumn("new_offset", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def remapped(refs: DataFrame, mapping: DataFrame, compacted: DataFrame) -> DataFrame:
    """Chunks after compaction: mapped ones move, unmapped ones of compacted segments go, others stay."""
    keys = ["segment_id", "offset", "length"]
    marked = refs.join(compacted.select("segment_id", F.lit(True).alias("__old")), "segment_id", "left")
    joined = marked.join(mapping, keys, "left")
    return joined.where(F.col("__old").isNull() | F.col("new_segment").isNotNull()).withColumn("segment_id", F.coalesce("new_segment", "segment_id")).withColumn("offset", F.coalesce("new_offset", "offset")).drop("__old", "new_segment", "new_offset")


def chunk_split(objects: DataFrame, size: int) -> DataFrame:
    """Fixed-size chunks of each object, the last one short."""
    at = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))
    out = objects.where("size > 0").select("*", F.posexplode(at).alias("chunk", "offset"))
    return out.withColumn("length", F.least(F.lit(size).cast("long"), F.col("size") - F.col("offset")))


def pack_segments(blobs: DataFrame, target: int) -> DataFrame:
    """Sequential packing per bucket: a segment is full once its size reaches the target, the last blob may overflow.

    The rule depends on the blobs before, so each bucket's blobs are streamed in order through one fold.
    """

    def per_bucket(batches):
        state: dict = {}
        for pdf in batches:
            for bucket, part in pdf.groupby("bucket", sort=False):
                segment, at = state.get(bucket, (0, 0))
                seg, off = [], []
                for n in part["size"]:
                    if at >= target:
                        segment, at = segment + 1, 0
                    seg.append(segment)
                    off.append(at)
                    at += int(n)
                state = {bucket: (segment, at)}
                yield part.assign(segment=seg, offset=off)

    ordered = blobs.select("bucket", "object_key", "size").repartition("bucket").sortWithinPartitions("bucket", "object_key")
    return ordered.mapInPandas(per_bucket, "bucket string, object_key string, size long, segment long, offset long")


def quorum_winner(replicas: DataFrame) -> DataFrame:
    """The winning version per key among replicas, by (wall, logical, node)."""
    return newest(replicas, ["key"], ["wall", "event_id", "node_id"])


def read_repair(replicas: DataFrame) -> DataFrame:
    """Per node and key, the node's newest version that is older than the winner and so needs a push."""
    mine = newest(replicas, ["key", "node_id"], ["wall", "event_id"])
    best = quorum_winner(replicas).select("key", F.col("wall").alias("best_wall"), F.col("event_id").alias("best_event"))
    return mine.join(best, "key").where(F.struct("wall", "event_id") < F.struct(F.col("best_wall").alias("wall"), F.col("best_event").alias("event_id")))


def contiguous_parts(ids: DataFrame, column: str, parts: int) -> DataFrame:
    """Sorted ids in ``parts`` runs, the first ones longer by one.

    Global ranks come from per-range counts, not from one window over all rows.
    """
    ranked = global_rank(ids, column)
    n = ids.count()
    size, more = divmod(n, parts)
    edge = more * (size + 1)
    part = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (size + 1))).otherwise(more + F.floor((F.col("rank") - edge) / max(size, 1)))
    return ranked.withColumn("part", part.cast("int"))


def global_rank(rows: DataFrame, *order: str) -> DataFrame:
    """0-based rank over all rows: range partitions, ranks inside each, and the counts of those before.

    The ranged rows are kept on disk: both their ranks and their counts must come from one sampling of the ranges.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    inside = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return inside.join(F.broadcast(before), "__part").withColumn("rank", (F.col("__in") + F.col("__before")).cast("long")).drop("__part", "__in", "__before")
