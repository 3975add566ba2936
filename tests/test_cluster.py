"""What SQL can't say of plans.cluster, against plain versions."""

import uuid

from pyspark.sql import functions as F

from loomstead.operators import catalog


def test_point_ids_are_version_5_uuids(spark):
    labels = ["a::b::0", "", "über::ä::12"]
    rows = spark.createDataFrame([(x,) for x in labels], "x string").select("x", catalog.point_id(F.col("x")).alias("id")).collect()
    assert {r.x: r.id for r in rows} == {x: str(uuid.uuid5(uuid.UUID(catalog.NAMESPACE), x)) for x in labels}


def test_front_matter_has_defaults(spark):
    texts = ["---\ntype: adr\ndate: 2024-01-01 \n---\nbody\n---\nmore", "no head\n---\ntype: x\n---\n", "", "---\n\n---\n"]
    fields, body = catalog.front_matter(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*[c.alias(n) for n, c in fields.items()], body.alias("body")).collect()
    assert (rows[0].type, rows[0].date, rows[0].domain, rows[0].body) == ("adr", "2024-01-01", "global", "body\n---\nmore")
    assert all(r.type == "unknown" and r.status == "active" for r in rows[1:]) and [r.body for r in rows[1:]] == [texts[1], "", ""]
