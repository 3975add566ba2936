"""Ordered folds: clocks, caches, lifecycles, membership. Each key's rows are one ordered stream."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def fold_by_key(rows: DataFrame, key: str, order: list[str], make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Feed each key's rows, in order, to a fresh step function; one row out per row in.

    Rows are streamed in batches sorted within partitions, so no key has to fit in memory.
    """

    def run(batches):
        now, step = None, None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if step is None or row[key] != now:
                    now, step = row[key], make()
                out.append(step(row))
            if out:
                yield pd.DataFrame(out)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def hybrid_clock():
    """Local clock readings: wall is the greatest time so far, logical always grows."""
    wall, logical = 0, 0

    def step(row):
        nonlocal wall, logical
        wall, logical = max(wall, row["wall"]), logical + 1
        if logical > 0xFFFFFFFF:
            wall, logical = wall + 1, 0
        return {"node_id": row["node_id"], "event_id": row["event_id"], "clock_wall": wall, "clock_logical": logical}

    return step


def clock_update():
    """Clock readings when each row carries a received clock."""
    wall, logical = 0, 0

    def step(row):
        nonlocal wall, logical
        logical = row["received_logical"] + 1 if row["received_wall"] > wall else max(logical, row["received_logical"]) + 1
        wall = max(wall, row["received_wall"], row["wall"])
        if logical > 0xFFFFFFFF:
            wall, logical = wall + 1, 0
        return {"node_id": row["node_id"], "event_id": row["event_id"], "clock_wall": wall, "clock_logical": logical}

    return step


def gdsf_cache(capacity: int):
    """Greedy-dual-size-frequency: hits, and evictions of the least clock + frequency / size."""

    def make():
        clock, used, heap, held = 0.0, 0, [], {}

        def step(row):
            nonlocal clock, used
            k, size, evicted = row["key"], max(1, int(row["size"])), 0
            hit = k in held
            if hit:
                held[k][1] += 1
            elif size <= capacity:
                while used + size > capacity and heap:
                    p, victim = heapq.heappop(heap)
                    if victim in held and abs(held[victim][2] - p) < 1e-10:
                        clock = p
                        used -= held.pop(victim)[0]
                        evicted += 1
                held[k] = [size, 1, 0.0]
                used += size
            if k in held:
                held[k][2] = clock + held[k][1] / held[k][0]
                heapq.heappush(heap, (held[k][2], k))
            return {"bucket": row["bucket"], "event_id": row["event_id"], "hit": hit, "evicted": evicted}

        return step

    return make


def ttl_lru_cache(capacity: int, ttl: int):
    """Least recently used among stale entries; nothing stale, no victim.

    Entries wait in a heap by their time of arrival until they are stale, then in one by their last access, so a victim
    takes no walk over all entries. Where time steps back, those that it makes fresh again return to the first heap. A
    heap's rows of entries that have changed since are passed over, and dropped when they are most of it.
    """

    def make():
        held: dict = {}  # key: time of arrival, last access, whether it waits among the stale
        fresh, stale, back = [], [], []

        def valid(heap, row):
            e = held.get(row[1])
            return e is not None and (row[0] == e[0] and not e[2] if heap is fresh else e[2] and (row[0] == e[1] if heap is stale else row[0] == -e[0]))

        def add(heap, at, k):
            if len(heap) > 2 * len(held) + 64:
                heap[:] = {row for row in heap if valid(heap, row)}
                heapq.heapify(heap)
            heapq.heappush(heap, (at, k))

        def victim(limit):
            """The stale entry (arrived by the limit) of the smallest last access, the smallest key in ties."""
            while fresh and fresh[0][0] <= limit:
                row = heapq.heappop(fresh)
                if valid(fresh, row):
                    held[row[1]][2] = True
                    add(stale, held[row[1]][1], row[1])
                    add(back, -row[0], row[1])
            while back and -back[0][0] > limit:
                row = heapq.heappop(back)
                if valid(back, row):
                    held[row[1]][2] = False
                    add(fresh, -row[0], row[1])
            while stale:
                row = heapq.heappop(stale)
                if valid(stale, row):
                    return row[1]
            return None

        def step(row):
            k, now = row["key"], int(row["wall"])
            hit = k in held and (ttl == 0 or now - held[k][0] <= ttl)
            evicted = 0
            if k in held and not hit:
                del held[k]
                evicted += 1
            if not hit:
                if len(held) >= capacity and (gone := victim(now - ttl)) is not None:
                    del held[gone]
                    evicted += 1
                held[k] = [now, now, False]
                add(fresh, now, k)
            elif held[k][1] != now:
                held[k][1] = now
                if held[k][2]:
                    add(stale, now, k)
            return {"bucket": row["bucket"], "event_id": row["event_id"], "hit": hit, "evicted": evicted}

        return step

    return make


def lifecycle():
    """State of one segment after each event, and what the event met."""
    state = None

    def step(row):
        nonlocal state
        kind, outcome = row["event_type"], "ok"
        if kind == "Reserve":
            if state is None:
                state = "Reserved"
            elif state != "Reserved":
                outcome = "Already" + state
        elif kind == "Seal":
            if state == "Reserved":
                state = "Sealed"
            else:
                outcome = "Missing" if state is None else "AlreadySealed" if state == "Sealed" else "NotReserved"
        elif kind == "Delete":
            if state in ("Reserved", "Sealed"):
                state = "Deleted"
            else:
                outcome = "Missing" if state is None else "AlreadyDeleted"
        return {"segment_id": row["segment_id"], "seq": row["seq"], "state": state, "outcome": outcome}

    return step


# Authority of a claim, greater wins at one incarnation.
AUTHORITY = {"Alive": 1, "Suspect": 2, "Dead": 3, "Left": 4}


def membership():
    """Whether each claim about a node is accepted, and the view after it, in order of arrival."""
    view = None

    def step(row):
        nonlocal view
        new = (row["incarnation"], AUTHORITY[row["state"]])
        if view is None:
            accepted = row["state"] not in ("Dead", "Left") or row["incarnation"] > 0
        elif view["state"] in ("Dead", "Left") and row["state"] == "Alive":
            accepted = row["incarnation"] > view["incarnation"]
        elif row["incarnation"] != view["incarnation"]:
            accepted = row["incarnation"] > view["incarnation"]
        else:
            old = AUTHORITY[view["state"]]
            accepted = new[1] > old or (new[1] == old and row["origin"] == view["origin"] and row["version"] > view["version"])
        if accepted:
            view = row
        return {"node_id": row["node_id"], "seq": row["seq"], "accepted": bool(accepted), "state": view["state"] if view else None, "incarnation": int(view["incarnation"]) if view else None}

    return step


def negative_cache(most: int = 0):
    """Whether a key is known to be absent, for each access of a bucket: deleted, and not written since.

    Beyond ``most`` keys written since (0: no bound) all that is known of the bucket is forgotten. The set is exact: a key
    that was never deleted is never taken for one that was.
    """

    def make():
        gone, written = set(), set()

        def step(row):
            k, op = row["key"], row["op"]
            absent = op == "GET" and k in gone and k not in written
            if op == "DELETE":
                gone.add(k)
                written.discard(k)
            elif op == "PUT":
                written.add(k)
                if most and len(written) > most:
                    gone.clear()
                    written.clear()
            return {**row, "absent": absent}

        return step

    return make


def group_commit(most: int, flush: int):
    """The commit that each waiter (at: its time of arrival) of a log is in, and when that starts.

    A commit takes the first waiter and all that wait by the time it starts, ``most`` at the most, and lasts ``flush``;
    the next starts when it has ended and somebody waits.
    """

    def make():
        commit, held, start = -1, 0, None

        def step(row):
            nonlocal commit, held, start
            if start is None or row["at"] > start or held >= most:
                start = row["at"] if start is None else max(row["at"], start + flush)
                commit, held = commit + 1, 0
            held += 1
            return {**row, "commit": commit, "starts": start}

        return step

    return make
