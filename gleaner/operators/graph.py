"""Reference graphs: weighted edges from definitions and references, ranks, lookup and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.runtime import checkpointed, stored

#: A name with more definitions than this connects nothing.
MAX_DEFINERS = 20


def build_edges(defs: DataFrame, refs: DataFrame, n_files: int) -> DataFrame:
    """(src, dst, weight, scaled, via): references joined with definitions of the same name in other files.

    ``defs`` (file, name) keeps every row: a file that defines a name twice counts twice. ``refs`` (file, name) is a bag.
    Names of under three characters, with more than MAX_DEFINERS definitions, or referenced in more than
    max(12, 2 % of files) files connect nothing, which also keeps every join key small. ``weight`` counts references,
    ``scaled`` = sum of sqrt(count) / definitions * max(0.1, ln(n / (1 + files))), ``via`` the first five names.
    """
    limit = int(max(12.0, 0.02 * n_files))
    degree = defs.where(F.length("name") >= 3).groupBy("name").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") <= MAX_DEFINERS)
    counts = stored(refs.groupBy("file", "name").agg(F.count(F.lit(1)).alias("cnt")), "references")
    spread = counts.groupBy("name").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") <= limit)
    scale = F.sqrt(F.col("cnt").cast("double")) / F.col("degree") * F.greatest(F.lit(0.1), F.log(F.lit(float(max(n_files, 1))) / (1 + F.col("files"))))
    usable = degree.join(spread, "name")
    met = counts.withColumnRenamed("file", "src").join(usable, "name").join(defs.select("name", F.col("file").alias("dst")), "name").where("src <> dst")
    return met.groupBy("src", "dst").agg(F.sum("cnt").alias("weight"), F.sum(scale).alias("scaled"), F.slice(F.array_sort(F.collect_set("name")), 1, 5).alias("via"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 40) -> DataFrame:
    """(node, rank): weighted ranks after a fixed number of rounds; ranks of nodes without outgoing weight spread evenly.

    ``nodes`` (node), each once; ``edges`` (src, dst, scaled) between them. Ranks sum to 1. The rank that spreads evenly
    is one number, summed on the executors; every round is checkpointed, so plans stay short and a lost executor costs
    one round. No nodes give no rows.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    out = edges.groupBy("src").agg(F.sum("scaled").alias("total")).where("total > 0")
    links = checkpointed(edges.join(out, "src").select(F.col("src").alias("node"), "dst", (F.col("scaled") / F.col("total")).alias("share")).where("share > 0"))
    state = checkpointed(nodes.join(out.select(F.col("src").alias("node"), F.lit(True).alias("sends")), "node", "left").select("node", F.coalesce("sends", F.lit(False)).alias("sends"), F.lit(1.0 / n).alias("rank")))
    for _ in range(iterations):
        loose = state.where("not sends").agg(F.sum("rank")).first()[0] or 0.0
        given = links.join(state.select("node", "rank"), "node").select(F.col("dst").alias("node"), (F.col("rank") * F.col("share")).alias("got"), F.lit(None).cast("boolean").alias("sends"))
        every = given.unionByName(state.select("node", F.lit(0.0).alias("got"), "sends"))
        state = checkpointed(every.groupBy("node").agg(F.max("sends").alias("sends"), ((1 - damping) / n + damping * (F.sum("got") + loose / n)).alias("rank")))
    return state.select("node", "rank")


def neighbours(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, other, dir, weight, via): both directions of each wanted node, mutual edges merged, heaviest first.

    A pair linked both ways takes the direction of the edge that sorts first by (src, dst); via keeps five names at most.
    """
    w = wanted.select("node").distinct()
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("dir"), "weight", "via").unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("dir"), "weight", "via")
    ).join(w, "node", "left_semi")
    merged = both.groupBy("node", "other").agg(F.count(F.lit(1)).alias("n"), F.max("dir").alias("d"), F.sum("weight").alias("weight"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("via")))), 1, 5).alias("via"))
    side = F.when(F.col("n") == 1, F.col("d")).when(F.col("other") < F.col("node"), "in").otherwise("out")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "other"))
    return merged.select("node", rank.alias("rank"), "other", side.alias("dir"), "weight", "via")


def lookup(defs: DataFrame, ranks: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(name, file, exact, rank): definitions whose name holds the query, whole-name hits first, then by file rank."""
    low = F.lower("name")
    hits = defs.where(F.contains(low, F.lit(query.lower()))).select("name", "file", (low == query.lower()).alias("exact"))
    joined = hits.join(ranks.select(F.col("node").alias("file"), "rank"), "file", "left").select("name", "file", "exact", F.coalesce("rank", F.lit(0.0)).alias("rank"))
    return joined.orderBy(F.desc("exact"), F.desc("rank"), "file", "name").limit(max(1, min(50, k)))
