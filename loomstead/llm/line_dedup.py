"""Line deduplication across documents (operator 3, DataFrame functions only).

Lines are exploded with their positions; a line's key is the line stripped of
``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Keys are hashed to 128 bits,
distinct documents are counted per hash, and keys in ``min_docs`` or more
documents lose all lines but those of the smallest doc_id that holds them.
The rest of each document is put together again by position.

Hashes, ids and positions of all lines are stored once; only
they are shuffled by key; equal (hash, document)
pairs are combined before. The common keys are stored as a table, so that the
join of all lines with them is of two plain exchanges and a hot key is split
by adaptive execution. Texts move once, by doc_id.

Results for odd input: a null or empty text is one empty line; a row with a
null doc_id keeps all its lines and counts for no key; rows with one doc_id
are one document where documents are counted, and each loses its own lines
alone (a row is known by its id and a hash of its text); keys under ``min_chars`` code points always stay; extra
columns pass through ``dedup_lines`` as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\f\r"


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("of"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(BLANK)), UPPER, LOWER)
    rows = rows.where("id is not null").select("id", "of", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    return rows.select("id", "of", "pos", F.unhex(F.md5("key")).alias("hash"))


def _with_kept(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    keep = Scratch(docs.sparkSession)
    lines = keep.save(_lines(docs, min_chars))
    counted = lines.select("hash", "id").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first"))
    common = keep.save(counted.where(F.col("docs") >= min_docs).select("hash", "first"))
    dropped = lines.join(common, "hash").where("id <> first").groupBy(F.col("id").alias("__id"), F.col("of").alias("__of")).agg(F.collect_set("pos").alias("__drop"))
    all_lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__drop"))
    kept = F.when(F.col("__drop").isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).otherwise(F.array_join(F.transform(rest, lambda i: F.get(all_lines, i)), "\n"))
    joined = docs.join(dropped, (docs["doc_id"].cast("long") == dropped["__id"]) & (F.xxhash64(docs["text"].cast("string")) == dropped["__of"]), "left")
    return joined.select(*[docs[c] for c in docs.columns], F.size(all_lines).cast("long").alias("__n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("__n_dropped"), kept.alias("__kept"))


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """The documents with their repeated lines taken out of ``text``; ``n_chars``, if there, follows."""
    out = _with_kept(docs, min_docs, min_chars)
    kept = F.col("__kept")
    now = {"text": kept.alias("text")} | ({"n_chars": F.char_length(kept).cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {})
    return out.select(*[now.get(c, docs[c]) for c in docs.columns])


def line_report(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    docs = docs.select("doc_id", "text")
    return _with_kept(docs, min_docs, min_chars).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("__kept"), 256).alias("kept_sha256"))
