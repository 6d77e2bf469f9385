"""Site templates: parts of pages that recur across many pages of one host, found by hashed subtrees and cut out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import markup
from gleaner.runtime import stored

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*>")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLANK = re.compile(r"\n[ \t]*(?=\n)")
#: Source characters that a subtree has at least; shorter ones are words, not furniture.
LEAST = 20


def subtrees(text: str, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, hash) of every element of a page and of every block between blank lines, of ``least`` characters or more.

    The hash is that of the subtree's source with runs of white space made one space. Elements that are never closed end
    with the element around them. Code blocks and formulas are no markup inside; they are leaves of what holds them.
    """
    text = text.replace("\r", " ").replace("\0", " ")
    bare = markup.masked(text)
    spans, stack, at = [], [], 0
    for m in _BLANK.finditer(bare):
        spans.append((at, m.start()))
        at = m.end() + 1
    spans.append((at, len(bare)))
    opened: dict[str, int] = {}
    for m in _TAG.finditer(bare):
        name = m.group(2).lower()
        if not m.group(1):
            if name not in _VOID and m.group()[-2] != "/":
                stack.append((name, m.start()))
                opened[name] = opened.get(name, 0) + 1
        elif opened.get(name):
            while stack:
                n, start = stack.pop()
                opened[n] -= 1
                spans.append((start, m.end() if n == name else m.start()))
                if n == name:
                    break
    out = []
    for a, b in set(spans):
        body = " ".join(text[a:b].split()) if b - a >= least else ""
        if len(body) >= least:
            out.append((a, b, xxhash.xxh3_64_intdigest(body) - 2**63))
    return out


def holds_structure(text: str) -> bool:
    """Whether a subtree is or holds a heading, a list item, a code block or a formula, which are never cut."""
    return any(markup.parse(text).counts.values())


def template_cuts(pages: DataFrame, id_col: str, host_col: str, text_col: str, min_pages: int = 3, min_share: float = 0.02, least: int = LEAST) -> DataFrame:
    """(id, cuts ARRAY<STRUCT<start,end>>): for each page, the subtrees that recur on at least ``min_pages`` pages and on
    ``min_share`` of the pages of its host, unless they hold structure.

    Pages with a null host form a host of their own; null texts have no subtree; repeated ids count once. Counting sends
    one row per task, host and subtree, however large the host, and the text of a subtree is looked at only where it
    recurs.
    """
    base = pages.select(F.col(id_col).alias("id"), F.coalesce(F.lower(F.trim(host_col)), F.lit("")).alias("host"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, h, a, b, x) for i, h, t in zip(pdf["id"], pdf["host"], pdf["text"]) for a, b, x in subtrees(t, least)]
            yield pd.DataFrame(rows, columns=["id", "host", "start", "end", "part"])

    parts = stored(base.where("text is not null").mapInPandas(scan, "id long, host string, start int, end int, part long"), "page-parts")
    sizes = base.groupBy("host").agg(F.count_distinct("id").alias("pages"))
    seen = parts.select("host", "part", "id").distinct().groupBy("host", "part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where(F.col("n") >= min_pages)
    common = stored(seen.join(sizes, "host").where(F.col("n") >= F.col("pages") * F.lit(min_share)).select("host", "part", "id"), "recurring-parts")

    # one page shows what a part is
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [not holds_structure(t[a:b].replace("\r", "")) for t, a, b in zip(pdf["text"], pdf["start"], pdf["end"])]
            yield pdf.loc[keep, ["host", "part"]]

    shown = parts.join(common, ["host", "part", "id"]).groupBy("host", "part", "id").agg(F.min(F.struct("start", "end")).alias("s")).select("host", "part", "id", "s.*")
    cut_ids = shown.join(base.select("id", "text").dropDuplicates(["id"]), "id").select("host", "part", "text", "start", "end")
    gone = stored(cut_ids.mapInPandas(judge, "host string, part long"), "template-parts")
    hits = parts.join(gone, ["host", "part"], "left_semi")
    return hits.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))


def cut(text: str, cuts) -> str:
    """The text without the given (start, end) stretches, which may overlap and are sorted by start."""
    out, at = [], 0
    for a, b in cuts:
        if b > at:
            out.append(text[at : max(a, at)])
            at = b
    out.append(text[at:])
    return "".join(out)
