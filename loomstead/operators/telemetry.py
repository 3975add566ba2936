"""Metrics: parsing, histograms, percentiles, deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pow2_bucket


def parse_prometheus(lines: DataFrame) -> DataFrame:
    """(name, value) of an exposition text: blank and comment lines skipped, split at the last space, last duplicate wins."""
    text = F.btrim("line")
    name = F.regexp_extract(text, r"^(.*) [^ ]*$", 1)
    value = F.expr("try_cast(regexp_extract(trim(line), ' ([^ ]*)$', 1) as double)")
    kept = lines.where((text != "") & ~text.startswith("#")).select("line_no", F.btrim(name).alias("name"), value.alias("value")).where("value is not null and name <> ''")
    return kept.groupBy("name").agg(F.max_by("value", "line_no").alias("value"))


def histogram(rows: DataFrame, value: str, bounds: list[int], *by: str) -> DataFrame:
    """Cumulative counts per bound (le), with sum and count; what is over the last bound is in +Inf alone."""
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    first = F.array_min(F.filter(edges, lambda b: b >= F.col(value)))
    counts = rows.groupBy(*by, first.alias("le")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("count"), F.sum("s").alias("sum"), F.map_from_entries(F.collect_list(F.when(F.col("le").isNotNull(), F.struct("le", "n")))).alias("m"))
    out = totals.select(*by, "count", "sum", "m", F.explode(edges).alias("le"))
    below = F.aggregate(F.filter(edges, lambda b: b <= F.col("le")), F.lit(0).cast("long"), lambda s, b: s + F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long")))
    return out.select(*by, "le", below.alias("cumulative"), "sum", "count")


def latency_histogram(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Counts per power-of-two bucket."""
    return rows.groupBy(*by, pow2_bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def percentile(buckets: DataFrame, p: float, *by: str) -> DataFrame:
    """Percentile from power-of-two buckets: the first whose running count reaches ceil(n p), interpolated and cut to an integer."""
    w = Window.partitionBy(*by).orderBy("bucket")
    total = F.sum("n").over(Window.partitionBy(*by))
    rows = buckets.withColumn("run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("need", F.ceil(total * p))
    hit = rows.where((F.col("run") >= F.col("need")) & (F.col("run") - F.col("n") < F.col("need")))
    start = F.when(F.col("bucket") == 0, 0).otherwise(F.expr("shiftleft(1L, bucket)"))
    end = F.expr("shiftleft(1L, bucket + 1)")
    part = (F.col("need") - (F.col("run") - F.col("n"))) / F.col("n")
    return hit.select(*by, F.floor(start + (end - start) * part).cast("long").alias("value"))


def deltas(series: DataFrame, *keys: str) -> DataFrame:
    """Value minus the one before, where there is one; falls stay negative."""
    w = Window.partitionBy(*keys).orderBy("ts")
    return series.withColumn("delta", F.col("value") - F.lag("value").over(w)).where("delta is not null")


def render(rows: DataFrame, name: str) -> DataFrame:
    """Exposition lines of a cumulative histogram (le, cumulative, sum, count)."""
    line = F.concat(F.lit(name + '_bucket{le="'), F.col("le").cast("string"), F.lit('"} '), F.col("cumulative").cast("string"))
    return rows.select("le", line.alias("line"))
