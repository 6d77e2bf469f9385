"""How distinctive a term is for a record: divergence from randomness, geometric model, Laplace gain, length normalisation.

For a term with frequency F in N records, and frequency tf in a record of length l where the mean length is m:

    tfn = tf * log2(1 + c * m / l)
    information = -log2(1 / (1 + F/N)) - tfn * log2((F/N) / (1 + F/N))
    score = information / (tfn + 1)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.words import terms
from gleaner.operators.skew import lookup_join
from gleaner.runtime import stored


def term_scores(records: DataFrame, id_col: str, text_col: str, c: float = 1.0) -> DataFrame:
    """(id, term, tf, df, cf, score) for every term of every record.

    Repeated ids count once (should their texts differ, the greatest counts); a record with a null text, or without terms,
    counts in N and in the mean length but gives no row. Each text is shuffled once, to bring repeated ids together; its
    terms are counted where it then lies, without another shuffle. Statistics by term take one row per task and term.
    Terms that stand in a large part of all records get their statistics by a broadcast of at most 2048 rows. An
    empty table gives no row.
    """
    once = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).groupBy("id").agg(F.max("t").alias("t"))
    listed = once.select("id", terms(F.coalesce("t", F.lit(""))).alias("ts"))
    # rows are partitioned by the id already, and the id is part of this key
    counted = listed.select("id", F.size("ts").alias("len"), F.explode_outer("ts").alias("term")).groupBy("id", "len", "term").agg(F.count("term").alias("tf"))
    tf = stored(counted, "term-frequencies")
    sums = tf.agg(F.sum("tf").alias("all"), F.count_distinct("id").alias("n"), F.count("term").alias("rows")).first()
    total, n, rows = int(sums["all"] or 0), int(sums["n"] or 0), int(sums["rows"] or 0)
    mean = total / n if n else 0.0
    tf = tf.where("term is not null")
    stats = stored(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), "term-statistics")
    joined = lookup_join(tf, stats, "term", "df", rows)
    lam = F.col("cf") / F.lit(float(max(n, 1)))
    tfn = F.col("tf") * F.log2(F.lit(1.0) + F.lit(c * mean) / F.col("len"))
    info = F.log2(1.0 + lam) - tfn * F.log2(lam / (1.0 + lam))
    return joined.select("id", "term", "tf", "df", "cf", (info / (tfn + 1.0)).alias("score"))


def top_terms(scores: DataFrame, k: int) -> DataFrame:
    """(id, rank, term, score): the k most distinctive terms of each record, ties by the term."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.desc("score"), "term")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "term", "score")
