"""Exact duplicates under layout differences, by dictionary encoding.

Every distinct raw value of a column is canonicalised once; every distinct canonical value gets an integer; each record
becomes a sorted tuple of (field, integer) pairs, here an integer array in the order of the field names, and records are
grouped by that compact tuple. Long values travel once per distinct value, not once per record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.skew import lookup_join
from gleaner.runtime import stored


#: A column's dictionary of at most this many entries (its size is counted first) is broadcast whole.
BROADCAST_ENTRIES = 50_000


def digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def copies(records: DataFrame, id_col: str, fields: list[str], canonical: Callable[[Column], Column]) -> DataFrame:
    """(first_id, copy_id): one row for every record that equals an earlier one in all ``fields``.

    Records are equal if each field is equal in canonical form; a null equals only a null. ``first_id`` is the smallest
    id of a set of equal records, ``copy_id`` another one. Repeated rows
    of one id count once. Records without a copy give no row; an empty table gives none.
    """
    names = sorted(fields)
    at = range(len(names))
    rows = records.select(F.col(id_col).alias("id"), *[F.col(n).cast("string").alias(f"f{i}") for i, n in enumerate(names)])
    # the dictionary: distinct raw values, each canonicalised once
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"f{i}").alias("raw")) for i in at])).alias("v")).select("v.*").where("raw is not null")
    values = pairs.groupBy("field", "raw").agg(F.count(F.lit(1)).alias("freq"))
    canon = stored(values.select("field", digest(F.col("raw")).alias("rk"), digest(canonical(F.col("raw"))).alias("ck"), "freq"), "dictionary-values")
    # written once: a partition that is computed again must not number anew
    numbered = stored(canon.groupBy("field", "ck").agg(F.sum("freq").alias("uses")).select("field", "ck", (F.monotonically_increasing_id() + 1).alias("code")), "dictionary-codes")
    entries = stored(canon.join(numbered, ["field", "ck"]).select("field", "rk", "freq", "code"), "dictionary")
    sizes = {r["field"]: r["n"] for r in entries.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = None
    coded = rows.select("id", *[digest(F.col(f"f{i}")).alias(f"k{i}") for i in at])
    for i in sorted(at, key=lambda i: sizes.get(i, 0)):
        key = f"k{i}"
        right = entries.where(F.col("field") == i).select(F.col("rk").alias(key), "freq", F.col("code").alias(f"c{i}"))
        if sizes.get(i, 0) <= BROADCAST_ENTRIES:
            coded = coded.join(F.broadcast(right.drop("freq")), key, "left").drop(key)
        else:
            total = total if total is not None else rows.count()
            have = lookup_join(coded.where(F.col(key).isNotNull()), right, key, "freq", total).drop(key, "freq")
            coded = stored(have.unionByName(coded.where(F.col(key).isNull()).drop(key).withColumn(f"c{i}", F.lit(None).cast("long"))), "records-coded")
    tuples = stored(coded.select("id", F.array(*[F.coalesce(f"c{i}", F.lit(0)) for i in at]).alias("tuple")), "tuples")
    groups = stored(tuples.groupBy("tuple").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n")).where("first_id < last_id"), "tuple-groups")
    total = total if total is not None else rows.count()
    return lookup_join(tuples, groups.drop("last_id"), "tuple", "n", total).where("id <> first_id").select("first_id", F.col("id").alias("copy_id")).distinct()
