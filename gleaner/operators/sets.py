"""Set operations on tables and paths, and keyed tables: put, look up, list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(path: Column | str) -> Column:
    """A path without empty and ``.`` segments, and with ``..`` applied; one that climbs above its start loses the climb."""
    c = F.col(path) if isinstance(path, str) else path
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.split(c, "/"), none, lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.when(c.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def once_by_path(parts: list[DataFrame], path: str) -> DataFrame:
    """The rows of several roots, each canonical path once, from the first root that has it."""
    tagged = [p.withColumn("_root", F.lit(i)).withColumn("_path", canonical(path)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in every.columns if c not in ("_root", "_path")]
    return every.where("_path is not null").groupBy("_path").agg(F.min_by(F.struct(*rest), "_root").alias("r")).select(F.col("_path").alias("canonical"), "r.*")


def tagged_union(parts: dict[str, DataFrame], column: str) -> DataFrame:
    """(column, tags): the distinct values of several tables, with the sorted names of the tables that have each."""
    rows = [df.select(F.col(column), F.lit(tag).alias("tag")) for tag, df in parts.items()]
    every = reduce(DataFrame.unionByName, rows).where(F.col(column).isNotNull())
    return every.groupBy(column).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def history_with(previous: Column, last: Column) -> Column:
    """A list of names with one more, each once, sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(previous, none), F.when(last.isNotNull(), F.array(last)).otherwise(none))))


def put(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with changed rows in place of those of their keys; of several changes of a key any one counts."""
    new = changes.dropDuplicates([key])
    return rows.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def by_index(rows: DataFrame, column: str, value) -> DataFrame:
    return rows.where(F.col(column) == value)
