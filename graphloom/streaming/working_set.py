"""A sliding working set over a stream of arrivals, kept in state: the newest ids, and all pinned ones.

Arrivals are (id, seq, op): ``arrive`` puts an id at place ``seq`` (of several the greatest
counts, in whatever order they come), ``pin`` and ``unpin`` exempt it from age-out or no longer.
Ids are dealt over shards by hash, each shard with state of its own that holds at most ``limit``
ids without a pin; as each of the newest ``limit`` ids of all is among the newest of its shard,
the set of all follows from the shards' sets. State is recovered from the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.streaming.changes import last_changes, recent

FEED = "shard int, version long, op string, id string, seq long, pinned boolean"


class _Shard(StatefulProcessor):
    """One shard's ids in state; emits what enters, moves or leaves, numbered in order."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "id string", "seq long, pinned boolean")
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()}
        now = dict(before)
        for batch in rows:
            for i, seq, op in zip(batch["id"], batch["seq"], batch["op"], strict=True):
                at, pinned = now.get(i, (None, False))
                if op == "arrive":
                    now[i] = (seq if at is None else max(at, seq), pinned)
                elif op == "pin" or i in now:
                    now[i] = (at, op == "pin")
        free = sorted((i for i, (_, pinned) in now.items() if not pinned), key=lambda i: (-1 if now[i][0] is None else now[i][0], i))
        # a pinned id that never arrived has no place once its pin goes
        gone = {i for i in free if now[i][0] is None}
        kept = [i for i in free if i not in gone]
        gone.update(kept[: max(0, len(kept) - self.limit)])
        version = (self.version.get() or (0,))[0]
        out = []
        for i in sorted(set(before) | set(now)):
            after = None if i in gone or i not in now else now[i]
            if after == before.get(i):
                continue
            version += 1
            if after is None:
                if i in before:
                    self.held.removeKey((i,))
                out.append((key[0], version, "remove", i, None, None))
            else:
                self.held.updateValue((i,), after)
                out.append((key[0], version, "upsert", i, *after))
        self.version.update((version,))
        frame = pd.DataFrame(out, columns=["shard", "version", "op", "id", "seq", "pinned"])
        yield frame.astype({"shard": "int32", "version": "int64", "seq": "Int64", "pinned": "boolean"})

    def close(self) -> None:
        pass


def working_set_feed(arrivals: DataFrame, *, limit: int = 500, shards: int = 16) -> DataFrame:
    """A stream of changes (shard, version, op, id, seq, pinned) to the shards' sets.

    Needs a state store with column families: ``spark.sql.streaming.stateStore.providerClass`` set to RocksDB's.
    """
    dealt = arrivals.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", F.col("seq").cast("long").alias("seq"), "op")
    return dealt.groupBy("shard").transformWithStateInPandas(statefulProcessor=_Shard(limit), outputStructType=FEED, outputMode="Update", timeMode="None")


def current(feed: DataFrame, *, limit: int = 500) -> DataFrame:
    """(id, seq): the working set that a feed (as far as it was written) leads to."""
    last = last_changes(feed.select("id", F.col("version").alias("seq"), "op", F.col("seq").alias("at"), "pinned")).filter("op = 'upsert'")
    held = last.select("id", F.col("at").alias("seq"), "pinned")
    return recent(held.select("id", "seq"), limit, pinned=held.filter("pinned"))
