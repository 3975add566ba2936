"""Scalar functions as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper limits of the size tiers, in bytes, and their target segment sizes.
TIERS = [("inline", 4096, 0), ("small", 262144, 4194304), ("standard", 4194304, 67108864)]
MULTI = ("multi", 268435456)
# Media types by extension.
MEDIA = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "application/javascript", "json": "application/json", "xml": "application/xml",
    "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "svg": "image/svg+xml", "webp": "image/webp", "ico": "image/x-icon", "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip",
    "tar": "application/x-tar", "mp3": "audio/mpeg", "mp4": "video/mp4",
}
UNKNOWN_MEDIA = "application/octet-stream"


def size_tier(size: Column, limits: tuple[int, int, int] = (4096, 262144, 4194304)) -> Column:
    """Tier of a size; limits are inclusive."""
    a, b, c = limits
    return F.when(size <= a, "inline").when(size <= b, "small").when(size <= c, "standard").otherwise("multi")


def tier_target(tier: Column) -> Column:
    out = F.when(tier == TIERS[0][0], F.lit(TIERS[0][2]))
    for name, _, target in TIERS[1:]:
        out = out.when(tier == name, F.lit(target))
    return out.otherwise(F.lit(MULTI[1])).cast("long")


def media_type(name: Column) -> Column:
    """By what follows the last dot, case-sensitive."""
    ending = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("")
    table = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ending), F.lit(UNKNOWN_MEDIA))


def composite_key(bucket: Column, key: Column) -> Column:
    return F.concat(bucket, F.char(F.lit(0)), key)


def split_key(both: Column) -> Column:
    """(bucket, key) at the first NUL."""
    bucket = F.substring_index(both, "\0", 1)
    return F.struct(bucket.alias("bucket"), both.substr(F.char_length(bucket) + 2, F.char_length(both)).alias("object_key"))


def slug(title: Column) -> Column:
    plain = F.regexp_replace(F.lower(title), r"(?U)[^\w\s-]", "")
    out = F.regexp_replace(F.regexp_replace(plain, r"[\s_]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "section").otherwise(out)


def counter_name(name: Column) -> Column:
    return F.when(F.endswith(name, F.lit("_total")), name).otherwise(F.concat(name, F.lit("_total")))


def quorum_error(w: Column, r: Column, n: Column) -> Column:
    """Why a quorum is invalid, or null."""
    return F.when((w < 1) | (r < 1) | (n < 1), "below one").when(w > n, "w over n").when(r > n, "r over n")


def shard_count(explicit: Column, cpus: Column, most: Column) -> Column:
    return F.when(explicit > 0, explicit).otherwise(F.greatest(F.lit(1), F.least(cpus, most)))


def xml_escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def pow2_bucket(micros: Column) -> Column:
    """0 up to 1 microsecond, else floor(log2), at most 31; from the binary digits, so exact."""
    return F.when(micros <= 1, 0).otherwise(F.least(F.char_length(F.bin(micros)) - 1, F.lit(31))).cast("int")


def vnode_hash(node: Column, vnode: Column) -> Column:
    """SHA-256 of the name, a colon and the number as four little-endian bytes, in hex."""
    big = F.lpad(F.hex(vnode), 8, "0")
    little = F.concat(*[F.substring(big, i, 2) for i in (7, 5, 3, 1)])
    return F.sha2(F.concat(F.encode(node, "UTF-8"), F.unhex(F.lit("3A")), F.unhex(little)), 256)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def bloom_hashes(false_positives: float) -> int:
    return 1 if false_positives <= 0 else int(min(16, max(1, np.ceil(-np.log(false_positives) / np.log(2)))))


def gf_tables(polynomial: int = 0x11D) -> tuple[np.ndarray, np.ndarray]:
    """exp (twice over) and log of GF(256)."""
    exp, log, x = np.zeros(512, np.int32), np.zeros(256, np.int32), 1
    for i in range(255):
        exp[i], log[x] = x, i
        x = (x << 1) ^ (polynomial if x & 0x80 else 0)
    exp[255:510] = exp[:255]
    return exp, log


GF_EXP, GF_LOG = gf_tables()


def gf_mul(a, b):
    a, b = np.asarray(a, np.int32), np.asarray(b, np.int32)
    return np.where((a == 0) | (b == 0), 0, GF_EXP[GF_LOG[a] + GF_LOG[b]]).astype(np.uint8)


def gf_inv(a: int) -> int:
    return int(GF_EXP[255 - GF_LOG[a]])


def cauchy(k: int, m: int) -> np.ndarray:
    """Coefficients of m parity rows over k data shards."""
    return np.array([[gf_inv((j + 1) ^ (k + i + 1)) for j in range(k)] for i in range(m)], np.uint8)


def list_xml(bucket: Column, prefix: Column, contents: Column, token: Column) -> Column:
    """A page of a listing, its contents (object_key, size, etag), as XML; a token tells that more follow."""
    # The elements of a listing and their layout.
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">\n  <Name>'
    entry = "\n  <Contents>\n    <Key>{}</Key>\n    <Size>{}</Size>\n    <ETag>&quot;{}&quot;</ETag>\n    <StorageClass>STANDARD</StorageClass>\n  </Contents>"
    a, b, c, d = entry.split("{}")
    lit = F.lit
    keys = F.transform(contents, lambda x: F.concat(lit(a), xml_escaped(x["object_key"]), lit(b), x["size"].cast("string"), lit(c), xml_escaped(x["etag"]), lit(d)))
    next_token = F.when(token.isNotNull(), F.concat(lit("\n  <NextContinuationToken>"), xml_escaped(token), lit("</NextContinuationToken>"))).otherwise("")
    truncated = F.when(token.isNotNull(), "true").otherwise("false")
    top = (lit(head), xml_escaped(bucket), lit("</Name>\n  <Prefix>"), xml_escaped(prefix), lit("</Prefix>\n  <KeyCount>"), F.size(contents).cast("string"))
    return F.concat(*top, lit("</KeyCount>\n  <MaxKeys>1000</MaxKeys>\n  <IsTruncated>"), truncated, lit("</IsTruncated>"), next_token, F.array_join(keys, ""), lit("\n</ListBucketResult>"))
