"""Long passages that stand verbatim in several documents, by hashing content-defined lines.

A shared passage may begin and end in the middle of a line, so hashing lines or paragraphs as they stand would lose it.
Here a line begins at an anchor that the text itself defines: the positions whose SEED-character hash is smallest in
some stretch of WINDOW positions. A line is the LINE = span - WINDOW + 1 characters after an anchor. Any passage of
``span`` characters holds a whole line, the same in every document, because its first WINDOW positions choose an anchor
that depends on nothing outside the passage. Digests of lines are grouped over all documents; what they pair is
verified on the texts: every stretch that is reported has been compared as it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.skew import block_pairs, repeated_only
from gleaner.runtime import stored

SPAN = 400
WINDOW = 150
SEED = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each w consecutive values, by running picks from both ends of blocks of w."""
    n = len(values)
    pad = (-n) % w
    padded = np.concatenate([values, np.repeat(values[-1:], pad)]) if pad else values
    rows = padded.reshape(-1, w)
    ahead = pick.accumulate(rows, axis=1).ravel()
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - w + 1], ahead[w - 1 : n])


def _mixed(points: np.ndarray) -> np.ndarray:
    return points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    power = np.full(n + 1, base, dtype=np.uint64)
    power[0] = 1
    return np.multiply.accumulate(power)


def _digests(x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit digests of the ``size`` values from each position of ``at`` on, from running sums."""
    n = len(x)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _powers(_BASE, n)[:n], dtype=np.uint64)])
    digest = (sums[at + size] - sums[at]) * _powers(_INVERSE, n)[at]
    digest ^= digest >> np.uint64(32)
    digest *= np.uint64(0xBF58476D1CE4E5B9)
    return digest ^ (digest >> np.uint64(29))


def lines(points: np.ndarray, stops: np.ndarray, span: int = SPAN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, offset, digest) of all lines of texts laid end to end; ``stops`` are the ends of the texts.

    Deterministic, and local: anchors depend on at most ``window`` positions on either side. Texts shorter than ``span``
    have no line.
    """
    size, n = span - window + 1, len(points)
    none = (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int64),)
    if n < span:
        return none
    x = _mixed(points)
    seed = np.zeros(n - SEED + 1, dtype=np.uint64)
    for i in range(SEED):
        seed = seed * np.uint64(0x100000001B3) + x[i : n - SEED + 1 + i]
    seed ^= seed >> np.uint64(31)
    seed *= np.uint64(0x94D049BB133111EB)
    seed ^= seed >> np.uint64(29)
    if len(seed) < window:
        return none
    low = _sliding(seed, window, np.minimum)
    # a position is an anchor if it is the smallest of one of the windows that hold it
    edge = np.zeros(window - 1, dtype=np.uint64)
    best = _sliding(np.concatenate([edge, low, edge]), window, np.maximum)
    at = np.flatnonzero(best == seed)
    doc = np.searchsorted(stops, at, side="right")
    inside = at + size <= stops[doc]
    at, doc = at[inside], doc[inside]
    digest = _digests(x, at, size)
    starts = np.concatenate([[0], stops[:-1]])
    return doc, at - starts[doc], digest.view(np.int64)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return points, np.cumsum([len(t) for t in texts])


def line_table(docs: DataFrame, doc_col: str, text_col: str, span: int = SPAN, window: int = WINDOW) -> DataFrame:
    """(digest, doc): the lines of each document that is at least ``span`` long."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids = list(pdf["text"]), pdf["doc"].to_numpy()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (size < 1_000_000 or stop == start):
                    size += len(texts[stop])
                    stop += 1
                which, _, digest = lines(*_points(texts[start:stop]), span, window)
                out = pd.DataFrame({"digest": digest, "doc": ids[start:stop][which]})
                yield out.drop_duplicates()
                start = stop

    base = docs.where(F.length(text_col) >= span).select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return base.mapInPandas(scan, "digest long, doc long")


def shared_stretches(a: str, b: str, span: int = SPAN) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The (start, end) stretches of a, and of b, that are made up of ``span``-character strings found in the other text."""
    (pa, _), (pb, _) = _points([a]), _points([b])
    if len(pa) < span or len(pb) < span:
        return [], []
    ha = _digests(_mixed(pa), np.arange(len(pa) - span + 1), span)
    hb = _digests(_mixed(pb), np.arange(len(pb) - span + 1), span)
    return _stretches(a, b, ha, hb, span), _stretches(b, a, hb, ha, span)


def _stretches(a: str, b: str, ha: np.ndarray, hb: np.ndarray, span: int) -> list[tuple[int, int]]:
    """The stretches of a whose digests occur in b; each run of both texts side by side is compared as it stands."""
    order = np.argsort(hb, kind="stable")
    at = np.minimum(np.searchsorted(hb[order], ha), len(hb) - 1)
    i = np.flatnonzero(hb[order][at] == ha)
    if not len(i):
        return []
    j = order[at[i]]
    cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    real = [x for x, y in zip(np.split(i, cut), np.split(j, cut)) if a[x[0] : x[-1] + span] == b[y[0] : y[-1] + span]]
    return _merged(np.concatenate(real), span) if real else []


def _merged(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(starts) > span) + 1
    return [(int(p[0]), int(p[-1]) + span) for p in np.split(starts, cut)]


#: So many candidate documents at most are sent to all executors as a list of ids (8 bytes each).
BROADCAST_IDS = 1_000_000
_SPANS = "array<struct<start:int,end:int>>"


def text_pairs(docs: DataFrame, doc_col: str, text_col: str, same: DataFrame, span: int = SPAN, window: int = WINDOW) -> DataFrame:
    """(a, b, a_spans, b_spans): documents with different texts that share ``span`` characters, and where they do.

    Of documents with one and the same text only that with the smallest id takes part; ``same`` (from ``copies``) has the
    others. Lines that only one text has fall away before anything is paired, and large groups are paired in blocks.
    """
    others = same.where("rep < doc").select("doc")
    once = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where(F.length("text") >= span)
    once = once.join(F.broadcast(others) if others.count() <= BROADCAST_IDS else others, "doc", "left_anti")
    table = stored(line_table(once, "doc", "text", span, window), "lines")
    several = stored(repeated_only(table, "digest", "doc").distinct(), "repeated-lines")
    cand = stored(block_pairs(several, "digest", "doc").distinct(), "span-candidates")
    ids = cand.select(F.col("a").alias("doc")).union(cand.select(F.col("b").alias("doc"))).distinct()
    few = ids.count() <= BROADCAST_IDS
    texts = once.join(F.broadcast(ids) if few else ids, "doc", "left_semi").dropDuplicates(["doc"])
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("at"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("bt"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["at"], pdf["bt"]):
                sa, sb = shared_stretches(x, y, span)
                if sa:
                    rows.append((a, b, [{"start": p, "end": q} for p, q in sa], [{"start": p, "end": q} for p, q in sb]))
            yield pd.DataFrame(rows, columns=["a", "b", "a_spans", "b_spans"])

    return cand.join(left, "a").join(right, "b").select("a", "b", "at", "bt").mapInPandas(verify, f"a long, b long, a_spans {_SPANS}, b_spans {_SPANS}")


def copies(docs: DataFrame, doc_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """(rep, doc): the documents of every text of at least ``span`` characters that several documents have; rep is the smallest."""
    keyed = docs.where(F.length(text_col) >= span).select(F.col(doc_col).cast("long").alias("doc"), F.unhex(F.md5(text_col)).alias("tk"))
    keyed = stored(keyed, "text-keys")
    return repeated_only(keyed, "tk", "doc").join(keyed.groupBy("tk").agg(F.min("doc").alias("rep"), F.max("doc").alias("hi")).where("rep < hi").drop("hi"), "tk").select("rep", "doc").distinct()


def sharing_documents(docs: DataFrame, doc_col: str, text_col: str, span: int = SPAN, window: int = WINDOW) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all documents whose texts share a string of ``span`` characters, copies included.

    Null texts and texts shorter than ``span`` share nothing; documents with one id count once; an empty table gives no
    row.
    """
    same = stored(copies(docs, doc_col, text_col, span), "text-copies")
    pairs = stored(text_pairs(docs, doc_col, text_col, same, span, window).select("a", "b"), "span-pairs")
    wide = pairs.join(same.select(F.col("rep").alias("a"), F.col("doc").alias("da")), "a", "left").join(same.select(F.col("rep").alias("b"), F.col("doc").alias("db")), "b", "left")
    wide = wide.select(F.coalesce("da", "a").alias("x"), F.coalesce("db", "b").alias("y"))
    inner = block_pairs(same, "rep", "doc")
    return wide.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).unionByName(inner.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")))


def shared_parts(docs: DataFrame, doc_col: str, text_col: str, span: int = SPAN, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, shared_chars, removed, kept_chars): what each document shares and what a clean corpus drops of it.

    ``shared_chars`` counts the characters that also stand in another document, in stretches of at least ``span``.
    ``removed`` lists the (start, end) stretches, in offsets of the original text, that an earlier document (with a
    smaller id) holds already: the earliest occurrence stays. All documents get a row; null texts have no characters.
    """
    same = stored(copies(docs, doc_col, text_col, span), "text-copies")
    pairs = stored(text_pairs(docs, doc_col, text_col, same, span, window), "span-stretches")
    own = pairs.select(F.col("a").alias("rep"), F.explode("a_spans").alias("s"), F.lit(False).alias("later")).unionByName(pairs.select(F.col("b").alias("rep"), F.explode("b_spans").alias("s"), F.lit(True).alias("later")))
    own = own.groupBy("rep", "s").agg(F.max("later").alias("later"))
    spread = own.join(same, "rep", "left").select(F.coalesce("doc", "rep").alias("doc"), "s", "later").distinct()
    lists = spread.groupBy("doc").agg(F.array_sort(F.collect_set("s")).alias("all"), F.array_sort(F.collect_set(F.when(F.col("later"), F.col("s")))).alias("late"))
    merged = lambda c: F.aggregate(
        c,
        F.array().cast(_SPANS),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    length = lambda c: F.aggregate(c, F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    base = docs.select(F.col(doc_col).cast("long").alias("doc"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"))
    out = base.join(lists, "doc", "left").join(same, "doc", "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_chars").alias("end"))).cast(_SPANS)
    none = F.array().cast(_SPANS)
    shared = F.when(F.col("rep").isNotNull(), whole).otherwise(F.coalesce(merged("all"), none))
    removed = F.when(F.col("rep") < F.col("doc"), whole).otherwise(F.coalesce(merged("late"), none))
    return out.select(F.col("doc").alias("doc_id"), "n_chars", length(shared).alias("shared_chars"), removed.alias("removed")).withColumn("kept_chars", F.col("n_chars") - length(F.col("removed")))
