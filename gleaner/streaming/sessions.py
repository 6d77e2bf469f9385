"""Sessions of keyed events: gaps in batch, the same fold as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.runtime import stored

OUT = "key long, started timestamp, ended timestamp, events long, total double"
#: Gaps that make up a slice of time.
SLICE_GAPS = 16
_STATE = "started timestamp, ended timestamp, events long, total double"


def sessions(events: DataFrame, key: str, at: str, value: str, event_id: str, gap_seconds: int = 120) -> DataFrame:
    """(key, started, ended, events, total): runs of events of one key without a gap longer than ``gap_seconds``.

    Repeated event ids count once; events without key or time are left out, null values add nothing. The events of a key
    are cut into slices of time that are numbered apart, and only one row a slice is brought together by key, so a key that
    holds a large part of all events is not one task's work.
    """
    e = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.coalesce(F.col(value), F.lit(0.0)).alias("value"), F.col(event_id).alias("id")).where("key is not null and at is not null").dropDuplicates(["id"])
    gap = gap_seconds * 1_000_000
    e = stored(e.withColumn("t", F.unix_micros("at")).withColumn("slice", F.floor(F.col("t") / (SLICE_GAPS * gap))), "session-events")
    w = Window.partitionBy("key", "slice").orderBy("t", "id")
    inside = e.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(0))).withColumn("local", F.sum("new").over(w))
    edges = inside.groupBy("key", "slice").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.sum("new").alias("news"))
    by = Window.partitionBy("key").orderBy("slice")
    opens = F.coalesce((F.col("first") - F.lag("last").over(by) > gap).cast("int"), F.lit(1))
    edges = edges.withColumn("opens", opens).withColumn("base", F.sum(F.col("opens") + F.col("news")).over(by) - F.col("news"))
    numbered = inside.join(edges.select("key", "slice", "base"), ["key", "slice"]).withColumn("session", F.col("base") + F.col("local"))
    return numbered.groupBy("key", "session").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).drop("session")


def stream_sessions(events: DataFrame, key: str, at: str, value: str, gap_seconds: int = 120, delay: str = "10 minutes") -> DataFrame:
    """The same over a stream: a session comes out once the watermark has passed its end by the gap.

    Events must not be later than ``delay``. A session is one row of state per key, so state grows with active keys only.
    """
    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gap = pd.Timedelta(seconds=gap_seconds)
        if state.hasTimedOut:
            s = state.get
            state.remove()
            yield pd.DataFrame([(k[0], *s)], columns=["key", "started", "ended", "events", "total"])
            return
        done, cur = [], list(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("at")
        for t, v in zip(rows["at"], rows["value"]):
            if cur is not None and t - pd.Timestamp(cur[1]) <= gap:
                cur = [cur[0], max(pd.Timestamp(cur[1]), t), cur[2] + 1, cur[3] + v]
            else:
                if cur is not None:
                    done.append((k[0], *cur))
                cur = [t, t, 1, v]
        state.update((pd.Timestamp(cur[0]).to_pydatetime(), pd.Timestamp(cur[1]).to_pydatetime(), int(cur[2]), float(cur[3])))
        state.setTimeoutTimestamp(int(max(pd.Timestamp(cur[1]).timestamp() * 1000 + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1)))
        if done:
            yield pd.DataFrame(done, columns=["key", "started", "ended", "events", "total"])

    e = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.coalesce(F.col(value), F.lit(0.0)).alias("value")).where("key is not null and at is not null")
    return e.withWatermark("at", delay).groupBy("key").applyInPandasWithState(fold, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def folded(edits: DataFrame, session: str, line: str, kind: str, path: str, value: str) -> DataFrame:
    """(session, path, value): the last value of every path of a log of edits; kind 0 starts the session anew, 1 sets a path."""
    last = Window.partitionBy(session)
    since = F.max(F.when(F.col(kind) == 0, F.col(line))).over(last)
    kept = edits.withColumn("_since", since).where((F.col(kind) == 1) & (F.col("_since").isNull() | (F.col(line) > F.col("_since"))))
    return kept.groupBy(session, path).agg(F.max_by(value, line).alias("value"))
