"""One surviving record per group, chosen field by field by a stated order of trust."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for a missing value, compared trimmed and in lower case. Fixed values.
PLACEHOLDERS = ("", "unknown", "n/a", "tbd", "-")
#: Support labels from best to worst. Fixed values.
SUPPORT = ("strong", "medium", "weak", "none")
#: Times before this are placeholders.
FIRST_TIME = "2000-01-01 00:00:00"


def usable(column: Column, kind: str) -> Column:
    """Whether a value says something; ``kind`` is text, count, time or flag."""
    if kind == "text":
        return F.coalesce(~F.lower(F.trim(column)).isin(*PLACEHOLDERS), F.lit(False))
    if kind == "count":
        return F.coalesce(column >= 0, F.lit(False))
    if kind == "time":
        return F.coalesce(column >= F.lit(FIRST_TIME).cast("timestamp"), F.lit(False))
    return column.isNotNull()


def support_rank(column: Column) -> Column:
    """0 for the best label, one more for each lower one; everything else comes last."""
    known = F.lower(F.trim(column))
    rank = F.lit(len(SUPPORT))
    for i, label in reversed(list(enumerate(SUPPORT))):
        rank = F.when(known == label, i).otherwise(rank)
    return rank


def best_values(records: DataFrame, group: str, record: str, fields: Sequence[tuple[str, str, str]], support: str, time: str) -> DataFrame:
    """(group, field_name, record_id, value): for each group and field, the record whose value survives.

    ``fields``: (name, kind, order) with order ``trust`` (support label, then latest time, then smallest id) or
    ``latest`` (latest value, then smallest id). Only usable values take part; a group whose field has none gives no row
    for it. Groups with fewer than two distinct records and null groups give nothing; repeated records count once.
    The choice is a minimum over a struct, so every task sends one candidate per group and field, however large the
    group is.
    """
    t = F.when(usable(F.col(time), "time"), F.col(time))
    rank, late = support_rank(F.col(support)), F.coalesce(-F.unix_micros(t), F.lit(2**62))
    found = []
    for name, kind, order in fields:
        c = F.col(name)
        if order == "latest":
            key = F.struct(F.lit(0).alias("r"), (-F.unix_micros(c)).alias("t"), F.col(record).alias("i"), c.cast("string").alias("v"))
        else:
            key = F.struct(rank.alias("r"), late.alias("t"), F.col(record).alias("i"), c.cast("string").alias("v"))
        found.append(F.min(F.when(usable(c, kind), key)).alias(f"best_{name}"))
    groups = records.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("grp")).agg(F.min(record).alias("lo"), F.max(record).alias("hi"), *found).where("lo < hi")
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(f"best_{n}").alias("b")) for n, _, _ in fields])).alias("s")
    return groups.select("grp", stack).where("s.b is not null").select(F.col("grp").alias(group), "s.field_name", F.col("s.b.i").alias("record_id"), F.col("s.b.v").alias("value"))
