"""Graph traversal over edges (src, predicate, dst), and vector search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from .catalog import first_n


def reach(edges: DataFrame, start: DataFrame, depth: int, predicate: str = "calls", forward: bool = True) -> DataFrame:
    """(node, level): every symbol within ``depth`` hops and its least level.

    One table of nodes and levels grows by a join and an aggregation a hop, so the plan is linear in the
    depth. Only the last hop's nodes meet the edges, and a node keeps its least level, so cycles end.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    hops = edges.where(F.col("predicate") == predicate).select(F.col(a).alias("at"), F.col(b).alias("next"))
    seen = start.select("node", F.lit(0).alias("level")).distinct()
    for level in range(1, depth + 1):
        met = seen.join(hops, (F.col("node") == F.col("at")) & (F.col("level") == level - 1), "left")
        both = F.array(F.struct("node", "level"), F.struct(F.col("next").alias("node"), F.lit(level).alias("level")))
        rows = met.select(F.inline(both)).where("node is not null")
        # The start may be met again, and then has a level beside 0.
        seen = rows.groupBy("node", (F.col("level") == 0).alias("start")).agg(F.min("level").alias("level")).drop("start")
    return seen.where("level > 0")


def hotspots(edges: DataFrame, n: int = 20) -> DataFrame:
    """Symbols with the most callers and type users."""
    by = edges.where(F.col("predicate").isin("calls", "uses_type")).groupBy(F.col("dst").alias("symbol_id")).agg(F.count(F.lit(1)).alias("degree"))
    return by.orderBy(F.desc("degree"), "symbol_id").limit(n)


def boundary(edges: DataFrame, symbols: DataFrame, a: str, b: str) -> DataFrame:
    """Edges from module a into module b."""
    s = symbols.select(F.col("symbol_id").alias("src"), F.col("symbol_module").alias("ma"))
    d = symbols.select(F.col("symbol_id").alias("dst"), F.col("symbol_module").alias("mb"))
    return edges.where(F.col("predicate").isin("calls", "uses_type")).join(s.where(F.col("ma") == a), "src").join(d.where(F.col("mb") == b), "dst").select("src", "predicate", "dst")


def edit_surface(edges: DataFrame, callees: int = 30, callers: int = 30) -> DataFrame:
    """Per symbol, its first callees and callers in order of id."""
    calls = edges.where("predicate = 'calls'")

    def first(a, b, n, name):
        w = Window.partitionBy(a).orderBy(b)
        return calls.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).groupBy(F.col(a).alias("symbol_id")).agg(F.sort_array(F.collect_list(b)).alias(name))

    return first("src", "dst", callees, "callees").join(first("dst", "src", callers, "callers"), "symbol_id", "full")


def containers(references: DataFrame, starts: DataFrame) -> DataFrame:
    """As-of join per file: for each reference line the symbol with the greatest start line at or before it.

    One pass over the union of both, sorted per file, instead of a range join.
    """
    a = starts.select("file", "line", F.col("symbol").alias("symbol"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("ref"))
    b = references.select("file", "line", F.lit(None).cast("string").alias("symbol"), F.lit(1).alias("kind"), "ref")
    w = Window.partitionBy("file").orderBy("line", "kind", "symbol").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("container", F.last("symbol", ignorenulls=True).over(w)).where("kind = 1 and container is not null").select("file", "line", "ref", "container")


def vector_topk(vectors: DataFrame, query: list[float], k: int = 8) -> DataFrame:
    """The k most similar rows by cosine, ids first in ties; a top-k, so no full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", F.round(cosine(F.col("embedding"), q), 4)).orderBy(F.desc("score"), "vec_id").limit(k)


BLOCKS = "ids binary, vectors binary"
SCORES = 1 << 19


def _packed_vectors(batches):
    for batch in batches:
        if batch.num_rows:
            ids = np.asarray(batch.column("vec_id")).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            v = batch.column("embedding")
            vectors = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            yield pa.record_batch([pa.array([ids[order].tobytes()], pa.binary()), pa.array([vectors[order].tobytes()], pa.binary())], names=["ids", "vectors"])


def vector_topk_of_all(vectors: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, vec_id, score): the k most similar rows of each query by cosine, ids first in ties.

    Blocks of queries meet blocks of rows, in order of id; each pair of blocks gives k rows a query, of which the best k
    are kept. Pairs are read where Arrow holds them, and half a million scores are made at a time.
    """
    pack = lambda rows: rows.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_packed_vectors, BLOCKS)
    asked = pack(queries).toDF("query_ids", "queries")

    def best(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                held = lambda name, kind: np.frombuffer(batch.column(name)[r].as_buffer(), kind)  # noqa: B023, E731
                ids, asking = held("ids", np.int64), held("query_ids", np.int64)
                rows, q = held("vectors", np.float64).reshape(len(ids), -1), held("queries", np.float64).reshape(len(asking), -1)
                most = max(1, SCORES // len(ids))
                for i in range(0, len(q), most):
                    scores = np.round(q[i : i + most] @ rows.T, 4)
                    n = min(k, len(ids))
                    least = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
                    take = [(at := np.flatnonzero(s >= x))[np.argsort(-s[at], kind="stable")[:n]] for s, x in zip(scores, least, strict=True)]
                    count = [len(t) for t in take]
                    row = np.repeat(np.arange(len(take)), count)
                    at = np.concatenate(take)
                    yield pa.record_batch([pa.array(asking[i : i + most][row]), pa.array(ids[at]), pa.array(scores[row, at] + 0.0)], names=["query_id", "vec_id", "score"])

    found = asked.crossJoin(pack(vectors)).mapInArrow(best, "query_id long, vec_id long, score double")
    return first_n(found, "query_id", [F.desc("score"), "vec_id"], k)


# The status of points that searches see, and those seen when deprecated ones are asked for.
ACTIVE = "active"
ANY_TIER = ["active", "superseded", "deprecated", "deleted"]


def vector_search(points: DataFrame, queries: DataFrame, doc_type: str | None = None, domain: str | None = None, include_deprecated: bool = False, k: int = 8) -> DataFrame:
    """The k nearest points of each query among those whose payload (status, type, domain) fits, with a snippet of chunk_text.

    The payload is filtered before any score; texts are joined to the k rows of a query alone.
    """
    fits = points.where(F.col("status").isin(ANY_TIER) if include_deprecated else F.col("status") == ACTIVE)
    fits = fits.where(F.col("type") == doc_type) if doc_type else fits
    fits = fits.where(F.col("domain") == domain) if domain else fits
    text = F.coalesce("chunk_text", F.lit(""))
    shown = F.concat(F.substring(text, 1, 300), F.when(F.char_length(text) > 300, "\u2026").otherwise(""))
    found = vector_topk_of_all(fits.select("vec_id", "embedding"), queries, k)
    return found.join(fits.select("vec_id", "status", "type", "domain", shown.alias("snippet")), "vec_id")
