"""Mixing sources to target shares along a time-varying curriculum.

Each source has a share of the mixture and a weight schedule over training time 0..1. The integral of its schedule is
its cumulative token demand; a document whose tokens begin at the c-th token of its source is placed at the time when
the demand reaches c, and the mixture is the documents range-sorted by that time.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.runtime import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Sources a plan may name; a plan is held on the driver, about 200 bytes a source.
MAX_PLAN = 1_000_000
#: Documents that one task sums up in order.
RUN_DOCS = 5_000
_ENCODINGS: dict[str, object] = {}


def source_key(column: str):
    """Source names in one spelling: trimmed, lower case, with ``-`` for any run of blanks, dashes and underscores."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s_-]+", "-")


def _encoding(path: str):
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _ENCODINGS[path] = tiktoken.Encoding("counting", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(docs: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with ``tokens`` in place of ``text``: the length of the whole text in tokens of the vocabulary file."""
    rest = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in rest]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for pdf in batches:
            out = pdf[names].copy()
            out["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text]]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", tokens long"
    return docs.mapInPandas(scan, schema)


def ramp(first: float, last: float) -> list[tuple[float, float]]:
    """A schedule that goes from ``first`` at time 0 to ``last`` at time 1, relative to the source's share."""
    return [(0.0, first), (1.0, last)]


def demand(available: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int | None) -> dict[str, float]:
    """Tokens that each source gives. With ``total``: its share of it, but no more than its repeated tokens. Without: the
    largest mixture in which every source that has documents gets exactly its share."""
    have = {s: n for s, n in available.items() if n > 0 and shares.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    if not have:
        return {}
    whole = sum(shares[s] for s in have)
    caps = {s: have[s] * repeats[s] for s in have}
    size = float(total) if total is not None else min(caps[s] * whole / shares[s] for s in have)
    return {s: min(shares[s] / whole * size, float(caps[s])) for s in have}


def segments(points: list[tuple[float, float]], tokens: float) -> list[tuple[float, float, float, float]]:
    """(t0, c0, w0, slope) of each piece of a piecewise linear schedule whose integral over 0..1 is ``tokens``."""
    pts = sorted(points)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    if not pts or pts[0][0] != 0 or pts[-1][0] != 1 or area <= 0 or min(w for _, w in pts) < 0:
        raise ValueError("a schedule runs from time 0 to 1 with weights that are not negative and not all 0")
    out, c = [], 0.0
    for (t0, w0), (t1, w1) in zip(pts, pts[1:]):
        k = tokens / area
        if t1 > t0:
            out.append((t0, c, w0 * k, (w1 - w0) * k / (t1 - t0)))
            c += (t1 - t0) * (w0 + w1) / 2 * k
    return out


def mixture(docs: DataFrame, id_col: str, plan: DataFrame, total: int | None = None, schedules: dict[str, list[tuple[float, float]]] | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(placed, report)`` of documents (id, source, tokens) under a plan (source_name, target_share, max_repeats).

    ``placed`` (position, source, doc_id, copy_no, tokens) is sorted by position. Within a source documents follow a
    hash of id and seed; a source that needs more than it has starts again, up to max_repeats times. A document is taken
    whole when its first token is demanded, so a source exceeds its demand by less than one document. ``report`` (source,
    target_share, actual_share, tokens, available_tokens, documents, times_used, max_repeats) has a row for every planned source, also
    for those without documents. Documents of no planned source, of a null source, or without tokens are not used;
    repeated ids count once. Plan rows without a name or share are passed over; of a repeated name the largest share counts.
    """
    spark = docs.sparkSession
    rows = plan.select(source_key("source_name").alias("s"), F.col("target_share").alias("p"), F.coalesce("max_repeats", F.lit(1)).alias("r")).where("s is not null and p is not null")
    named = rows.groupBy("s").agg(F.max("p").alias("p"), F.max("r").alias("r")).limit(MAX_PLAN + 1).collect()
    if len(named) > MAX_PLAN:
        raise ValueError(f"the plan names more than {MAX_PLAN} sources")
    shares, repeats = {x["s"]: float(x["p"]) for x in named}, {x["s"]: int(x["r"]) for x in named}
    names = spark.createDataFrame([(s,) for s in shares], "source string")
    once = docs.select(F.col(id_col).alias("doc_id"), source_key("source").alias("source"), "tokens").where("tokens > 0").join(F.broadcast(names), "source")
    once = stored(once.groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.*"), "mix-documents")
    sums = {x["source"]: x for x in once.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    have = {s: int(x["tokens"]) for s, x in sums.items()}
    want = demand(have, shares, repeats, total)
    schedules = schedules or {}
    table = [
        (s, want[s], have[s], max(1, math.ceil(sums[s]["n"] / RUN_DOCS)), math.ceil(want[s] / have[s]), [tuple(map(float, g)) for g in segments(schedules.get(s, ramp(1, 1)), want[s])]) for s in want
    ]
    sizes = F.broadcast(spark.createDataFrame(table, "source string, want double, have long, runs int, copies int, segs array<struct<t0:double,c0:double,w:double,k:double>>"))
    # running sums in two levels: within runs of RUN_DOCS documents, and over the runs of a source
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**40))
    cut = once.join(sizes.select("source", "runs"), "source").withColumn("u", u).withColumn("run", F.floor(F.col("u") * F.col("runs") / F.lit(float(2**40))))
    runs = cut.groupBy("source", "run").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("source", "run", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "run").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("part", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(runs, ["source", "run"]).join(sizes.drop("runs"), "source")
    placed = placed.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("c", (F.col("base") + F.col("part") + F.col("copy_no") * F.col("have")).cast("double")).where("c < want")
    g = F.element_at(F.filter("segs", lambda x: x["c0"] <= F.col("c")), -1)
    placed = placed.withColumn("g", g)
    d = F.col("c") - F.col("g.c0")
    step = F.when(F.abs("g.k") < 1e-9, d / F.col("g.w")).otherwise((F.sqrt(F.greatest(F.col("g.w") * F.col("g.w") + 2 * F.col("g.k") * d, F.lit(0.0))) - F.col("g.w")) / F.when(F.abs("g.k") < 1e-9, 1.0).otherwise(F.col("g.k")))
    placed = stored(placed.select((F.col("g.t0") + step).alias("position"), "source", "doc_id", "copy_no", "tokens"), "mix-placed")
    got = placed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copy_no").alias("last"))
    target = spark.createDataFrame([(s, shares[s], repeats[s], have.get(s, 0)) for s in shares], "source string, target_share double, max_repeats int, available_tokens long")
    every = float(placed.agg(F.sum("tokens")).first()[0] or 0)
    report = target.join(got, "source", "left").withColumn("all", F.lit(every))
    report = report.select(
        "source", "target_share", F.when(F.col("all") > 0, F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0))).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        "available_tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce(F.col("last") + 1, F.lit(0)).alias("times_used"), "max_repeats",
    )
    return placed.orderBy("position", "source", "doc_id", "copy_no"), report
