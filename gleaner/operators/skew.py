"""Joins and pairings that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import stored

#: A key is heavy when it holds at least one row in HEAVY_PARTS, so there are never more than HEAVY_PARTS heavy keys.
HEAVY_PARTS = 2048
#: Rows of a group that meet each other in one task when a group is paired in blocks.
BLOCK_ROWS = 512


def lookup_join(rows: DataFrame, right: DataFrame, key: str, weight: str, total: int, parts: int = HEAVY_PARTS) -> DataFrame:
    """``rows`` inner-joined with ``right``, whose ``key`` is unique and whose ``weight`` counts the key's rows on the left.

    Keys with ``weight * parts >= total`` are joined by broadcast: at most ``parts`` of them can exist, whatever the
    data. All other keys hold few rows each and take the shuffle join.
    """
    heavy_flag = F.col(weight) * F.lit(parts) >= F.lit(max(total, 1))
    heavy = right.where(heavy_flag)
    keys = F.broadcast(heavy.select(key))
    hot = rows.join(F.broadcast(heavy), key)
    cold = rows.join(keys, key, "left_anti").join(right.where(~heavy_flag), key)
    return hot.unionByName(cold)


def block_pairs(rows: DataFrame, group: str, item: str, size: Column | None = None, carry: tuple[str, ...] = (), keep: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct ``item`` values that share a ``group`` value, not made unique over groups.

    Groups of up to ``block_rows`` items meet in one task each. A larger group of n items is cut into ceil(n / block_rows)
    blocks by a hash of the item, and each pair of blocks meets in a task of its own, so no task holds a whole large
    group. ``item`` must be unique within a group. ``keep`` is tested on every pair as it is made; in it the ``carry``
    columns of both sides are named ``x_...`` and ``y_...``.
    """
    if size is None:
        sized = rows.join(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), group)
    else:
        sized = rows.withColumn("_n", size).where("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(block_rows)).cast("int")
    sized = sized.select(group, item, *carry, blocks.alias("_k"))
    sides = lambda df, p, *keys: df.select(group, *keys, F.col(item).alias(f"_{p}"), *[F.col(c).alias(f"{p}_{c}") for c in carry])
    test = F.lit(True) if keep is None else keep
    pair = [F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")]
    small = sized.where("_k = 1").drop("_k")
    near = sides(small, "x").join(sides(small, "y"), group).where("_x < _y").where(test).select(*pair)
    placed = sized.where("_k > 1").withColumn("_b", F.pmod(F.hash(F.lit(17), item), F.col("_k")))
    spread = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o"))
    left, right = sides(spread.where("_b = _i"), "x", "_i", "_j"), sides(spread.where("_b = _j"), "y", "_i", "_j")
    far = left.join(right, [group, "_i", "_j"]).where("(_i = _j and _x < _y) or (_i < _j and _x <> _y)").where(test).select(*pair)
    return near.unionByName(far)


#: Group keys, at most, that are sent to all executors as a list; more take a shuffle join.
BROADCAST_KEYS = 1_000_000


def repeated_only(rows: DataFrame, group: str, item: str) -> DataFrame:
    """The rows whose ``group`` holds at least two different ``item`` values.

    One map-side combined pass finds the repeated groups; their keys are counted, and sent by broadcast only while there
    are at most BROADCAST_KEYS of them.
    """
    keys = stored(rows.groupBy(group).agg(F.min(item).alias("_lo"), F.max(item).alias("_hi")).where("_lo < _hi").select(group), "repeated-groups")
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, group, "left_semi")


def crossed(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """left joined with right on ``key``, where a key may have many rows on both sides: those of a large key are dealt out
    over a grid of tasks, the left ones by rows and the right ones by columns."""
    side = 512
    n_left = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l")).where(F.col("_l") > side)
    n_right = right.groupBy(key).agg(F.count(F.lit(1)).alias("_r")).where(F.col("_r") > side)
    grid = n_left.join(n_right, key, "full").select(key, F.ceil(F.coalesce("_l", F.lit(1)) / side).cast("int").alias("_kl"), F.ceil(F.coalesce("_r", F.lit(1)) / side).cast("int").alias("_kr"))
    grid = stored(grid, "large-keys")
    large = grid.count()  # at most one in ``side`` rows
    if large == 0:
        return left.join(right, key)
    grid = F.broadcast(grid) if large <= BROADCAST_KEYS else grid
    one = F.coalesce(F.col("_kl"), F.lit(1)), F.coalesce(F.col("_kr"), F.lit(1))
    x = left.join(grid, key, "left").withColumn("_i", F.pmod(F.hash(a), one[0])).withColumn("_j", F.explode(F.sequence(F.lit(0), one[1] - 1))).drop("_kl", "_kr")
    y = right.join(grid, key, "left").withColumn("_j", F.pmod(F.hash(b), one[1])).withColumn("_i", F.explode(F.sequence(F.lit(0), one[0] - 1))).drop("_kl", "_kr")
    return x.join(y, [key, "_i", "_j"]).drop("_i", "_j")
