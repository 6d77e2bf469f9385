"""Interval-overlap filtering as a range join on buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str], bucket: int = 64) -> DataFrame:
    """Rows of ``left`` whose inclusive interval overlaps one of ``right``'s intervals of the same key.

    The number line is cut into buckets, wider ones on every next level. An interval lies in at most two buckets of its own
    level (whose buckets are at least as wide as it) and of each level above. Of two that overlap, the shorter one meets the
    longer one in a bucket of the longer one's level, so each side is laid on its own level once and on all levels from its
    own on once, and no interval, however long, enters more than two buckets a level. Null keys or ends overlap nothing; an
    end before its start is read as the start. Columns of the right side never reach the result.
    """
    def ends(df: DataFrame, a: str, b: str) -> DataFrame:
        df = df.withColumn("_a", F.col(a).cast("long")).withColumn("_b", F.greatest(F.col(a).cast("long"), F.col(b).cast("long")))
        wide = F.greatest(F.ceil(F.log2((F.col("_b") - F.col("_a") + 1) / bucket)), F.lit(0)).cast("int")
        return df.where("_a is not null and _b is not null").withColumn("_l", wide)

    def laid(df: DataFrame) -> DataFrame:
        size = F.lit(bucket).cast("long") * F.pow(F.lit(2.0), F.col("_l")).cast("long")
        return df.withColumn("_k", F.explode(F.array_distinct(F.array(F.floor(F.col("_a") / size), F.floor(F.col("_b") / size)))))

    rows = left.withColumn("_id", F.monotonically_increasing_id())
    x = ends(rows, *left_range).select(F.col(key).alias("_key"), "_l", "_a", "_b", F.struct(*[left[c] for c in left.columns]).alias("_row"), "_id")
    y = ends(right.select(F.col(key).alias("_key"), F.col(right_range[0]).alias("_s"), F.col(right_range[1]).alias("_e")), "_s", "_e").select("_key", "_l", "_a", "_b").distinct()
    top = x.select("_l").union(y.select("_l")).agg(F.max("_l")).first()[0]
    up = lambda df: laid(df.withColumn("_l", F.explode(F.sequence(F.col("_l"), F.lit(top or 0)))))
    names = lambda df: df.select("_key", "_l", "_k", F.col("_a").alias("_s"), F.col("_b").alias("_e"))
    own, above = names(laid(y)), names(up(y))
    test = lambda p, q: p.join(q, (p._key == q._key) & (p._l == q._l) & (p._k == q._k) & (p._a <= q._e) & (q._s <= p._b), "left_semi")
    hit = test(up(x), own).unionByName(test(laid(x), above))
    return hit.groupBy("_id").agg(F.first("_row").alias("_row")).select("_row.*")


def with_ends(hunks: DataFrame, start: str = "new_start", count: str = "new_count") -> DataFrame:
    """Adds ``new_end``: the last line of a hunk; a hunk of no lines ends where it starts."""
    return hunks.withColumn("new_end", F.greatest(F.col(start), F.col(start) + F.col(count) - 1))


def hunk_headers(diff: DataFrame, line: str) -> DataFrame:
    """Adds new_start and new_count of ``@@ -a,b +c,d @@`` lines; a missing count is 1, other lines get nulls."""
    rx = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    is_header = F.col(line).rlike(rx)
    count = F.regexp_extract(line, rx, 2)
    return diff.withColumn("new_start", F.when(is_header, F.regexp_extract(line, rx, 1).cast("int"))).withColumn("new_count", F.when(is_header, F.when(count == "", 1).otherwise(F.nullif(count, F.lit("")).cast("int"))))
