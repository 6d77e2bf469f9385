"""State of chat sessions from their edit logs: in batch by plain aggregates, and as a stream with keyed state and timers.

An edit (session, line, kind, k, v, offset, at) is a record of a log: kind 0 a snapshot, 1 sets the value v (JSON) at the
path k, 2 splices the list v in at ``offset``. Request numbers stand second in the path.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds without an edit after which a session counts as completed, and as stale; a title where there is none.
QUIET_SECONDS, STALE_SECONDS = 120, 300
NO_TITLE = "Chat"
STATES = "session string, last_request int, active boolean, title string, preview string, started timestamp, changed timestamp, edits long"


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def chat_states(edits: DataFrame, now: Column, quiet_seconds: int = STALE_SECONDS) -> DataFrame:
    """One row of STATES per session, as it stands at ``now``.

    The last request is the greatest number in a path or at the end of a splice; a session is active while its last
    request is not done (a modelState other than 2) and it was edited within ``quiet_seconds``. The title is the last one
    set, else the beginning of the first prompt; the preview the last invocation, else the last progress message. Values
    that are no JSON count as edits only. Everything is an aggregate that is combined before the shuffle, so a long
    session is no task of its own; a repeated line counts once.
    """
    e = edits.where("session is not null").dropDuplicates(["session", "line"]).withColumn("v", F.try_parse_json("v")).withColumn("at", F.col("at").cast("timestamp"))
    head, number, third = F.get("k", F.lit(0)), F.get("k", F.lit(1)).try_cast("int"), F.get("k", F.lit(2))
    at_request = head == "requests"
    items = F.try_variant_get("v", "$", "array<variant>")
    spliced = (F.col("kind") == 2) & (F.size("k") == 1) & at_request & items.isNotNull()
    last = F.greatest(F.when(at_request, number), F.when(spliced, F.coalesce("offset", F.lit(0)) + F.size(items) - 1))
    done = F.when(at_request & (third == "modelState") & (F.try_variant_get("v", "$.value", "double") != 2), number)
    title = F.when((F.col("kind") == 1) & (head == "customTitle"), F.try_variant_get("v", "$", "string"))
    prompts = F.filter(F.transform(items, lambda x: F.trim(F.coalesce(_text(x, "$.message.text"), _text(x, "$.text"), _text(x, "$.prompt")))), lambda s: s != "")
    prompt = F.when(spliced, F.substring(F.try_element_at(prompts, F.lit(1)), 1, 80))
    of_last = lambda get: F.coalesce(get(F.col("v")), F.try_element_at(F.filter(F.transform(items, get), lambda s: s.isNotNull()), F.lit(-1)))
    said = F.col("kind").isin(1, 2)
    call = F.when(said, of_last(lambda x: _text(x, "$.invocationMessage")))
    progress = F.when(said, of_last(lambda x: F.when(_text(x, "$.kind") == "progressMessage", _text(x, "$.content"))))
    latest = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line")))
    g = e.groupBy(F.col("session").cast("string").alias("session")).agg(
        F.coalesce(F.max(last), F.lit(-1)).cast("int").alias("last_request"), F.max(done).alias("done"), latest(title).alias("title"), F.min_by(prompt, F.when(prompt.isNotNull(), F.col("line"))).alias("prompt"),
        latest(call).alias("call"), latest(progress).alias("progress"), F.min("at").alias("started"), F.max("at").alias("changed"), F.count(F.lit(1)).alias("edits"),
    )
    fresh = F.unix_micros(now.cast("timestamp")) - F.unix_micros("changed") <= quiet_seconds * 1_000_000
    active = (F.col("last_request") >= 0) & (F.coalesce("done", F.lit(-1)) < F.col("last_request")) & fresh
    return g.select("session", "last_request", active.alias("active"), F.coalesce("title", "prompt", F.lit(NO_TITLE)).alias("title"), F.coalesce("call", "progress").alias("preview"), "started", "changed", "edits")


def _value(text: Any) -> Any:
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def folded(state: dict, kind: int, k: list[str], v: str | None, offset: int | None) -> dict:
    """The state after one edit; keys last, done, title, prompt, call, progress, edits."""
    value, out = _value(v), dict(state)
    out["edits"] = out.get("edits", 0) + 1
    number = int(k[1]) if len(k) > 1 and k[1].lstrip("-").isdigit() else None
    if k[:1] == ["requests"]:
        if number is not None:
            out["last"] = max(out.get("last", -1), number)
            if k[2:3] == ["modelState"] and isinstance(value, dict) and isinstance(value.get("value"), (int, float)) and value["value"] != 2:
                out["done"] = max(out.get("done", -1), number)
        elif kind == 2 and len(k) == 1 and isinstance(value, list):
            out["last"] = max(out.get("last", -1), (offset or 0) + len(value) - 1)
            for x in value:
                said = x.get("message", {}).get("text") or x.get("text") or x.get("prompt") if isinstance(x, dict) and isinstance(x.get("message", {}), dict) else None
                if isinstance(said, str) and said.strip() and "prompt" not in out:
                    out["prompt"] = said.strip()[:80]
    if kind == 1 and k[:1] == ["customTitle"] and isinstance(value, str):
        out["title"] = value
    if kind in (1, 2):
        for x in value if isinstance(value, list) else [value]:
            if isinstance(x, dict) and isinstance(x.get("invocationMessage"), str):
                out["call"] = x["invocationMessage"]
            if isinstance(x, dict) and x.get("kind") == "progressMessage" and isinstance(x.get("content"), str):
                out["progress"] = x["content"]
    return out


class ChatProcessor(StatefulProcessor):
    """Keeps one small state per session; a session that has been quiet comes out once more, as completed, and is dropped."""

    def __init__(self, quiet_seconds: int = QUIET_SECONDS):
        self.quiet_ms = quiet_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chat", "json string, started long, changed long")

    def _row(self, key, held, active: bool) -> pd.DataFrame:
        s = json.loads(held[0])
        row = {"session": str(key[0]), "last_request": s.get("last", -1), "active": active, "title": s.get("title") or s.get("prompt") or NO_TITLE, "preview": s.get("call") or s.get("progress")}
        return pd.DataFrame([row | {"started": pd.Timestamp(held[1], unit="ms"), "changed": pd.Timestamp(held[2], unit="ms"), "edits": s.get("edits", 0)}])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else ("{}", None, None)
        s, started, changed = json.loads(held[0]), held[1], held[2]
        for r in pd.concat(list(rows)).sort_values("line").itertuples(index=False):
            s = folded(s, int(r.kind), list(r.k), r.v, None if pd.isna(r.offset) else int(r.offset))
            t = int(pd.Timestamp(r.at).timestamp() * 1000)
            started, changed = min(started or t, t), max(changed or t, t)
        self.state.update((json.dumps(s), started, changed))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(changed + self.quiet_ms)
        yield self._row(key, self.state.get(), s.get("last", -1) >= 0 and s.get("done", -1) < s["last"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        self.state.clear()
        yield self._row(key, held, False)

    def close(self) -> None:
        pass


def stream_chat_states(edits: DataFrame, delay: str = "10 seconds", quiet_seconds: int = QUIET_SECONDS) -> DataFrame:
    """The states of sessions after every batch of a stream of edits (event time ``at``); needs a state store that keeps several columns."""
    e = edits.where("session is not null").withWatermark("at", delay)
    return e.groupBy("session").transformWithStateInPandas(statefulProcessor=ChatProcessor(quiet_seconds), outputStructType=STATES, outputMode="update", timeMode="EventTime")
