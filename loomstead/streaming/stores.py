"""Streaming twins of the ordered and merging operators; each converges to its batch answer.

No watermarks: a late but newer version has to win, so state is compared and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stores import newest


def latest_versions(stream: DataFrame) -> DataFrame:
    """Last writer wins per key, kept as one maximum per key; for update or complete mode."""
    return newest(stream.select("key", "wall", "event_id", "node_id"), ["key"], ["wall", "event_id", "node_id"])


def metric_series(stream: DataFrame, micros: int = 3_600_000_000) -> DataFrame:
    """Operations per kind and period."""
    return stream.groupBy(F.col("op").alias("name"), F.floor(F.col("wall") / micros).alias("ts")).agg(F.count(F.lit(1)).alias("value"))


# What each event does to each state.
NEXT = {(None, "Reserve"): "Reserved", ("Reserved", "Reserve"): "Reserved", ("Reserved", "Seal"): "Sealed", ("Reserved", "Delete"): "Deleted", ("Sealed", "Delete"): "Deleted"}


def segment_states(events: DataFrame) -> DataFrame:
    """State of each segment after its events (segment_id, seq, event_type), which may arrive in several batches, in order within a batch by seq."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = (state.get[0] or None) if state.exists else None
        for event in pd.concat(list(batches)).sort_values("seq")["event_type"]:
            now = NEXT.get((now, event), now)
        state.update((now or "",))
        yield pd.DataFrame({"segment_id": [key[0]], "state": [now or ""]})

    return events.groupBy("segment_id").applyInPandasWithState(step, "segment_id long, state string", "state string", "update", GroupStateTimeout.NoTimeout)


def append_events(stream: DataFrame, path: str, checkpoint: str):
    """Add a stream's events to a log of Parquet files, each exactly once; ends when all there are is written.

    Run again and again, it is a periodic cycle: each run takes what came since the last.
    """
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
