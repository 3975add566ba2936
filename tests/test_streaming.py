"""A stream in several batches gives what one batch gives."""

from pyspark.sql import functions as F

from loomstead.sources.tables import op_log
from loomstead.streaming import stores

SF = "/root/testdata/sf0.001"


def run(spark, tmp_path, rows, make, mode):
    path = str(tmp_path / "in")
    rows.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = {}

    def take(batch, _):
        for r in batch.collect():
            out[r[0]] = r

    make(stream).writeStream.foreachBatch(take).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    return out


def test_latest_versions(spark, tmp_path):
    rows = op_log(spark, SF)
    got = run(spark, tmp_path, rows, stores.latest_versions, "update")
    assert got == {r[0]: r for r in stores.latest_versions(rows).collect()}


def test_segment_states(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 20).alias("segment_id"), F.floor(F.col("id") / 20).alias("seq"), F.expr("case floor(id / 20) when 0 then 'Reserve' when 1 then 'Seal' else case when id % 3 = 0 then 'Delete' else 'Reserve' end end").alias("event_type"))
    path = str(tmp_path / "in")
    for k in range(3):  # one file for each step, in order
        rows.where(f"seq = {k}").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = {}
    stores.segment_states(stream).writeStream.foreachBatch(lambda b, _: out.update({r.segment_id: r.state for r in b.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert out == {i: "Deleted" if (i + 40) % 3 == 0 else "Sealed" for i in range(20)}


def test_events_are_appended_once(spark, tmp_path):
    source, log, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))
    for k in range(2):  # a cycle takes only what came since the last
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(source)
        stores.append_events(spark.readStream.schema("id long").parquet(source), log, mark).awaitTermination(120)
        assert sorted(r.id for r in spark.read.parquet(log).collect()) == list(range(10 * k + 10))
