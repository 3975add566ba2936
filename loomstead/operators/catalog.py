"""Documents and code symbols: front matter, nested symbols, visibility, upserts by path and by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import slug

# Fields of a document's front matter and what they are if absent.
FRONT = {"type": "unknown", "domain": "global", "feature": "none", "status": "active", "date": "unknown", "superseded_by": "none", "superseded_date": "none"}
# Fixed value: the namespace of point ids.
NAMESPACE = "8f1a0b6e-2c3d-4e5f-9a7b-1c2d3e4f5a6b"
# Kinds of symbol that are public unless told otherwise.
PUBLIC_KINDS = ["function", "class", "struct", "trait", "interface", "module", "const", "enum", "type_alias"]


def front_matter(text: Column) -> tuple[dict[str, Column], Column]:
    """The fields of the block between --- lines at the start, with defaults, and the text after it."""
    head = F.regexp_extract(text, r"^---\n((?s:.*?))\n---(?:\n|$)", 1)
    fields = {}
    for name, absent in FRONT.items():
        value = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
        fields[name] = F.when(value == "", absent).otherwise(value)
    return fields, F.regexp_replace(text, r"^---\n(?s:.*?)\n---(?:\n|$)", "")


def is_test(name: Column, detail: Column) -> Column:
    return F.startswith(name, F.lit("test_")) | F.startswith(name, F.lit("tests_")) | F.contains(detail, F.lit("#[test]")) | F.contains(detail, F.lit("#[tokio::test]"))


def tested_symbol(name: Column) -> Column:
    """What a test's name says it tests; null if nothing."""
    rest = F.regexp_extract(name, "^tests?_(?s:(.+))$", 1)
    return F.when(rest != "", rest)


def visibility(detail: Column, kind: Column, test: Column) -> Column:
    low = F.lower(detail)
    return (
        F.when(test, "private")
        .when(F.contains(low, F.lit("pub ")) | F.contains(low, F.lit("public ")), "pub")
        .when(F.contains(low, F.lit("private")) | F.contains(low, F.lit("priv ")), "private")
        .when(F.contains(low, F.lit("protected")), "protected")
        .when(kind.isin(PUBLIC_KINDS), "pub")
        .otherwise("private")
    )


def symbol_id(uri: Column, name: Column, line: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", uri, name, line.cast("string")), 256), 1, 16)


def point_id(label: Column) -> Column:
    """The version 5 UUID of path::anchor::index: SHA-1 of namespace and label, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.replace("-", ""))), F.encode(label, "UTF-8")))
    part = lambda i, n: F.substring(h, i, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def flat_symbols(files: DataFrame, depth: int | None = None) -> DataFrame:
    """uri, name, parent, line and id of all symbols of nested JSON, or of those to a depth.

    Every level is one explode of the children that the level above left as JSON, until a level is empty; nothing is shuffled.
    """
    level = "array<struct<name:string,line:bigint,children:string>>"
    now = files.select("uri", F.lit(None).cast("string").alias("parent"), F.from_json("symbols", level).alias("s"))
    out, done = None, 0
    while out is None or done < depth if depth is not None else out is None or not now.isEmpty():
        rows = now.select("uri", "parent", F.explode("s").alias("s"))
        made = rows.select("uri", F.col("s.name").alias("name"), "parent", (F.col("s.line") + 1).alias("line"), symbol_id(F.col("uri"), F.col("s.name"), F.col("s.line") + 1).alias("id"))
        out, done = made if out is None else out.unionByName(made), done + 1
        now = rows.where("s.children is not null").select("uri", F.col("s.name").alias("parent"), F.from_json("s.children", level).alias("s"))
    return out


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of old whose key new doesn't have, and those of new: delete by key, then insert."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def newest_symbols(symbols: DataFrame, order: str) -> DataFrame:
    """One row per symbol_id, the last in the order; a combining aggregate, no window."""
    rest = [c for c in symbols.columns if c != "symbol_id"]
    return symbols.groupBy("symbol_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("symbol_id", "r.*")


def hierarchy_edges(outgoing: DataFrame, incoming: DataFrame, predicate: str) -> DataFrame:
    """Edges (src, predicate, dst) seen from either end, without self loops and repeats.

    Edges are dealt before repeats are looked for, to more tasks the more there are, so no task's table grows with them.
    """
    both = outgoing.select("src", "dst").unionByName(incoming.select("src", "dst"))
    both = both.repartition(1 + both.count() // 1000000, "src", "dst").where("src <> dst").distinct()
    return both.select("src", F.lit(predicate).alias("predicate"), "dst")


def first_n(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of every key; Spark keeps n a task and key before it shuffles."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def smallest(rows: DataFrame, hashed: str, key: str, part: int) -> DataFrame:
    """(hashed, key) of one in ``part`` rows, rounded up: those of the smallest hashes (in hex, nulls last), in that order.

    Rows are counted by four digits of the hash, which tells the group that is drawn in part; its keys alone are ranked.
    """
    rows = rows.select(hashed, key, F.coalesce(F.substring(hashed, 1, 4), F.lit("~")).alias("__group"))
    counts = sorted((r["__group"], r["count"]) for r in rows.groupBy("__group").count().collect())
    left, last = -(-sum(n for _, n in counts) // part), ""
    for last, n in counts:
        if n >= left:
            break
        left -= n
    w = Window.orderBy(F.col(hashed).asc_nulls_last(), F.col(key).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.where(F.col("__group") == last).groupBy(hashed, key).agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.withColumn("n", F.least("n", F.lit(left) - F.coalesce(F.sum("n").over(w), F.lit(0)))).where("n > 0")
    drawn = rows.where(F.col("__group") < last).select(hashed, key)
    drawn = drawn.unionByName(ranked.select(hashed, key, F.explode(F.sequence(F.lit(1), "n")).alias("__copy")).drop("__copy"))
    return drawn.orderBy(F.col(hashed).asc_nulls_last(), F.col(key).asc_nulls_last())


#: Ends of lines, and white space at both ends of a text, as a Markdown section is cut.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
HEADING = r"(?U)^(#{1,6})\s+(.*)$"


def markdown_sections(docs: DataFrame, key: str) -> DataFrame:
    """(key, index, title, anchor, body) of the sections of each text, cut at its headings.

    What stands before the first heading is "(preamble)" and goes if it is empty; a section with a heading stays even if
    empty. The n-th repeat of an anchor in a text ends in -n. A null text has no section. Lines are partitioned by key;
    a text is a unit.
    """
    lines = docs.where("text is not null").select(key, F.posexplode(F.split("text", LINE_END, -1)).alias("n", "line"))
    heads = F.rlike("line", F.lit(HEADING))
    running = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    cut = lines.withColumn("head", heads).withColumn("section", F.sum(F.col("head").cast("long")).over(running))
    plain = F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("n", "line")))), lambda x: x["line"])
    title = F.max(F.when(F.col("head"), F.regexp_replace(F.regexp_extract("line", HEADING, 2), ENDS, "")))
    parts = cut.groupBy(key, "section").agg(title.alias("title"), F.regexp_replace(F.array_join(plain, "\n"), ENDS, "").alias("body"))
    parts = parts.withColumn("title", F.coalesce("title", F.lit("(preamble)"))).where("title <> '(preamble)' or body <> ''").withColumn("slug", slug(F.col("title")))
    again = F.row_number().over(Window.partitionBy(key, "slug").orderBy("section")) - 1
    index = F.row_number().over(Window.partitionBy(key).orderBy("section")) - 1
    anchor = F.concat("slug", F.when(again > 0, F.concat(F.lit("-"), again.cast("string"))).otherwise(""))
    return parts.select(key, index.alias("index"), "title", anchor.alias("anchor"), "body")
