"""Evaluation passages inside training documents, by a generalised suffix automaton over words.

The automaton of all passages is built once on the driver and sent to the executors; each document's words are streamed
through it while the longest matching length is tracked. Its size follows the evaluation set, never the corpus:
``MAX_ITEM_WORDS`` bounds one automaton, and a larger evaluation set is worked off in several passes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of evaluation passages in one automaton (about 300 bytes each).
MAX_ITEM_WORDS = 500_000
#: Consecutive words of a passage that make a leak; shorter passages leak as a whole.
LEAK_WORDS = 20
_WORD = re.compile("[a-z0-9]+")


class Automaton:
    """Suffix automaton of several word sequences, with the passages that hold each state's strings."""

    def __init__(self, passages: dict[int, list[str]], leak_words: int = LEAK_WORDS):
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        owners: list[set[int]] = [set()]
        finals: list[tuple[int, int]] = []
        for item, words in passages.items():
            state = 0
            for w in words:
                state = self._extend(state, self.words.setdefault(w, len(self.words)), owners)
                owners[state].add(item)
            if 0 < len(words) < leak_words:
                finals.append((item, len(words)))
        order = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        for s in order:
            if self.link[s] > 0:
                owners[self.link[s]] |= owners[s]
        self.need = {i: min(leak_words, len(w)) for i, w in passages.items() if w}
        self.least = min(self.need.values(), default=0)
        # a state's long passages: those of the ancestor that holds its suffix of leak_words words
        self.long: list[tuple[int, ...]] = [()] * len(self.length)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        ends: dict[int, list[tuple[int, int]]] = {}
        for item, n in finals:
            s = 0
            for w in passages[item]:
                s = self.next[s][self.words[w]]
            ends.setdefault(s, []).append((n, item))
        for s in reversed(order):
            up = self.link[s]
            self.short[s] = tuple(ends.get(s, ())) + (self.short[up] if up > 0 else ())
            if self.length[s] >= leak_words:
                if up >= 0 and self.length[up] >= leak_words:
                    self.long[s] = self.long[up]
                else:
                    self.long[s] = tuple(sorted(i for i in owners[s] if len(passages[i]) >= leak_words))
        self.leak_words = leak_words

    def _extend(self, last: int, w: int, owners: list[set[int]]) -> int:
        following = self.next[last].get(w)
        if following is not None:
            if self.length[following] == self.length[last] + 1:
                return following
            return self._split(last, following, w, owners)
        cur = self._state(self.length[last] + 1, {}, owners)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w, owners)
        return cur

    def _state(self, length: int, following: dict[int, int], owners: list[set[int]]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        owners.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int, owners: list[set[int]]) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), owners)
        self.link[copy] = self.link[q]
        owners[copy] |= owners[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def matches(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each leaked passage, the (start, end) character spans of the lower-cased text that leak it, merged."""
        known, step, link, length, least = self.words, self.next, self.link, self.length, self.least
        found: dict[int, list[tuple[int, int]]] = {}
        tokens = _WORD.findall(text)
        ids = [known.get(t, -1) for t in tokens]
        hits = []
        # stretches of known words that are too short for any passage are skipped
        start, n = 0, len(ids)
        while start < n:
            try:
                stop = ids.index(-1, start)
            except ValueError:
                stop = n
            if stop - start >= least:
                s, matched = 0, 0
                for k in range(start, stop):
                    w = ids[k]
                    while s and w not in step[s]:
                        s = link[s]
                        matched = length[s]
                    if w in step[s]:
                        s = step[s][w]
                        matched += 1
                    if matched >= least:
                        hits.append((k, s, matched))
            start = stop + 1
        if not hits:
            return found
        spans = [m.span() for m in _WORD.finditer(text)]
        for k, s, matched in hits:
            up = s
            if matched >= self.leak_words:
                for item in self.long[s]:
                    self._note(found, item, spans[k - self.leak_words + 1][0], spans[k][1])
            for size, item in self.short[up]:
                if size <= matched:
                    self._note(found, item, spans[k - size + 1][0], spans[k][1])
        return found

    @staticmethod
    def _note(found: dict[int, list[tuple[int, int]]], item: int, a: int, b: int) -> None:
        held = found.setdefault(item, [])
        if held and held[-1][1] >= a:
            held[-1] = (held[-1][0], max(b, held[-1][1]))
        else:
            held.append((a, b))


def automata(items: DataFrame, item_col: str, passage_col: str, leak_words: int, max_words: int) -> Iterator[Automaton]:
    """One automaton for each ``max_words`` words of passages; the passages come to the driver one block at a time."""
    block: dict[int, list[str]] = {}
    size = 0
    once = items.where(F.col(passage_col).isNotNull()).select(F.col(item_col).alias("i"), F.col(passage_col).alias("p")).dropDuplicates(["i"])
    for row in once.toLocalIterator():
        words = _WORD.findall(row["p"].lower())
        if words:
            block[row["i"]] = words
            size += len(words)
        if size >= max_words:
            yield Automaton(block, leak_words)
            block, size = {}, 0
    if block:
        yield Automaton(block, leak_words)


def _in_original(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the lower-cased text as spans of the text, of which some letters grow in lower case."""
    ends = [0, *accumulate(len(c.lower()) for c in text)]
    return [(bisect_right(ends, a) - 1, bisect_left(ends, b)) for a, b in spans]


def leaks(docs: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str, leak_words: int = LEAK_WORDS, max_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, spans ARRAY<STRUCT<start,end>>, words): one row for each document and each item that leaked into it.

    A document holds ``leak_words`` consecutive words of the passage, or all of a shorter one. ``spans`` are offsets in the
    document's text that leak the item, overlapping ones merged, ``words`` the words in them. Null or empty texts and
    passages without words leak nothing; repeated rows of one item count once, repeated documents once each. An empty
    table on either side gives no row. The corpus is read once per automaton and never shuffled.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, spans array<struct<start:int,end:int>>, words int"
    base = docs.where(F.col(text_col).isNotNull()).select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for auto in automata(items, item_col, passage_col, leak_words, max_words):
        shared = spark.sparkContext.broadcast(auto)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            a = shared.value
            for pdf in batches:
                rows = []
                for doc, text in zip(pdf["doc_id"], pdf["text"]):
                    low = text.lower()
                    for item, spans in a.matches(low).items():
                        n = sum(len(_WORD.findall(low[x:y])) for x, y in spans)
                        spans = spans if len(low) == len(text) else _in_original(text, spans)
                        rows.append((doc, item, [{"start": x, "end": y} for x, y in spans], n))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "spans", "words"])

        part = base.mapInPandas(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def cleaned(docs: DataFrame, doc_col: str, text_col: str, found: DataFrame, max_share: float = 0.5) -> DataFrame:
    """(doc_id, text, removed_chars, dropped): documents with their leaked spans cut out.

    A document of which more than ``max_share`` of the characters leaks is dropped whole: its text is null. Documents
    without a leak stay as they are.
    """
    spans = found.select("doc_id", F.explode("spans").alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("cut"))
    base = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # spans of different items may overlap: keep what lies outside all of them, walking from left to right
    walk = F.aggregate(
        "cut",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("kept")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] > acc["at"], F.concat(acc["kept"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]))).otherwise(acc["kept"]).alias("kept"),
        ),
    )
    joined = base.join(spans, "doc_id", "left").withColumn("w", walk)
    kept = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.concat(F.col("w.kept"), F.substring("text", F.col("w.at") + 1, F.length("text"))))
    gone = F.length("text") - F.length(kept)
    drop = F.coalesce(F.col("cut").isNotNull() & ((gone > F.length("text") * F.lit(max_share))), F.lit(False))
    return joined.select("doc_id", F.when(~drop, kept).alias("text"), gone.cast("int").alias("removed_chars"), drop.alias("dropped"))
