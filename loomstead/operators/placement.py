"""Consistent-hash placement and pool choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import vnode_hash


def ring_positions(nodes: DataFrame, vnodes: int) -> DataFrame:
    """(pos, node_id) of every virtual node."""
    return nodes.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("vnode")).select(vnode_hash(F.col("node_id"), F.col("vnode")).alias("pos"), "node_id")


def ring_walks(positions: DataFrame, replicas: int) -> DataFrame:
    """For each arc (low, high] of the ring, the first distinct nodes clockwise.

    The ring is nodes x vnodes rows whatever the number of keys, so its walks are worked out once,
    as one sorted array, and keys only look up their arc.
    """
    ring = positions.agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("r")).where(F.size("r") > 0)
    arc = ring.select("r", F.posexplode("r").alias("i", "p"))
    turned = F.concat(F.slice("r", F.col("i") + 1, F.size("r")), F.slice("r", F.lit(1), F.col("i")))
    walk = F.slice(F.array_distinct(F.transform(turned, lambda x: x["node_id"])), 1, replicas)
    return arc.select(F.col("i").alias("arc"), F.col("p.pos").alias("high"), walk.alias("nodes"))


def ring_lookup(keys: DataFrame, column: str, positions: DataFrame, replicas: int) -> DataFrame:
    """The keys with their replica nodes: first position at or after the key's hash, wrapping around."""
    walks = ring_walks(positions, replicas)
    table = walks.agg(F.sort_array(F.collect_list(F.struct("high", "nodes"))).alias("arcs"))
    hashed = keys.withColumn("__h", F.sha2(F.col(column).cast("string"), 256)).crossJoin(F.broadcast(table))  # one row: the ring
    # binary search for the first arc whose upper end is not below the hash
    n = F.size("arcs")
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(24)), F.struct(F.lit(0).alias("lo"), n.alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
            F.when(F.get(F.col("arcs"), F.floor((s["lo"] + s["hi"]) / 2).cast("int"))["high"] < F.col("__h"), F.struct((F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi")))
            .otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))
        ), lambda s: F.when(n > 0, s["lo"] % n),
    )
    return hashed.withColumn("nodes", F.coalesce(F.get("arcs", found)["nodes"], F.array().cast("array<string>"))).drop("__h", "arcs")


def eligible_pools(pools: DataFrame, headroom: int = 64 << 20) -> DataFrame:
    return pools.where((F.col("status") == "Healthy") & ~F.col("write_degraded") & (F.col("free_bytes") > headroom))


def best_pool(pools: DataFrame) -> DataFrame:
    """Most free space per weight (integer division), lowest id first."""
    scored = eligible_pools(pools).withColumn("score", F.expr("free_bytes div greatest(weight, 1)"))
    return scored.orderBy(F.desc("score"), "id").limit(1)


def by_owner(shards: DataFrame, owners: DataFrame) -> DataFrame:
    """Shards grouped by owning node; unresolved ones dropped."""
    return shards.join(owners, "shard").groupBy("node_id").agg(F.sort_array(F.collect_list("shard")).alias("shards"))


def ring_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Positions that came or went."""
    added = new.join(old, ["pos", "node_id"], "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.join(new, ["pos", "node_id"], "left_anti").withColumn("change", F.lit("removed")))
