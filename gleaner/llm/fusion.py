"""Field values by Bayesian fusion with copy detection.

Every source claims at most one value for an item. In each round the accuracy of sources, the dependence between each
pair of them that shares an item, and the posterior of each value are estimated from one another: sources that share
false values are likely copiers, and the vote of a source counts only as far as it is independent of the more accurate
voters for that value.

Claims, pairs of claims, accuracies and dependences are all tables; nothing but the number of rounds is held on the
driver, so neither sources nor items have a limit. Pairs of claims are made once; those of an item that very many sources
claim are dealt out over a grid of tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.skew import crossed
from gleaner.runtime import stored

FALSE_VALUES = 10
COPY_RATE = 0.8
PRIOR_DEPENDENCE = 0.1
FIRST_ACCURACY = 0.8


def _dependence(counts: DataFrame, accuracy: DataFrame) -> DataFrame:
    """(i, j, dep): probability that two sources are not independent, of what they share (t right, f wrong) and where they differ (d)."""
    a = accuracy.select(F.col("s").alias("i"), F.col("acc").alias("ai"))
    b = accuracy.select(F.col("s").alias("j"), F.col("acc").alias("aj"))
    m = F.least(F.greatest((F.col("ai") + F.col("aj")) / 2, F.lit(0.05)), F.lit(0.95))
    t, f, c = m * m, (1 - m) * (1 - m) / FALSE_VALUES, COPY_RATE
    log = F.col("t") * F.log(t / (m * c + t * (1 - c))) + F.col("f") * F.log(f / ((1 - m) * c + f * (1 - c))) + F.col("d") * math.log(1 / (1 - c))
    odds = (1 - PRIOR_DEPENDENCE) / PRIOR_DEPENDENCE * F.exp(F.least(F.greatest(log, F.lit(-50.0)), F.lit(50.0)))
    return counts.join(a, "i").join(b, "j").select("i", "j", (1 / (1 + odds)).alias("dep"))


def _posteriors(claims: DataFrame, pairs: DataFrame, accuracy: DataFrame, dependence: DataFrame) -> DataFrame:
    """(item, value, p, n): the probability of each claimed value, and its number of sources."""
    a, b = accuracy.select(F.col("s").alias("i"), F.col("acc").alias("ai")), accuracy.select(F.col("s").alias("j"), F.col("acc").alias("aj"))
    met = pairs.where("same").join(dependence, ["i", "j"]).join(a, "i").join(b, "j")
    # of two that agree, the less accurate one (of equals the one named later) counts only as far as it is independent
    later = F.when(F.col("ai") < F.col("aj"), F.col("i")).otherwise(F.col("j"))
    lost = met.groupBy("item", later.alias("s")).agg(F.sum(F.log(1 - COPY_RATE * F.col("dep"))).alias("lost"))
    sure = F.least(F.greatest("acc", F.lit(0.01)), F.lit(0.99))
    votes = claims.join(accuracy, "s").join(lost, ["item", "s"], "left").withColumn("vote", F.exp(F.coalesce("lost", F.lit(0.0))) * F.log(FALSE_VALUES * sure / (1 - sure)))
    scores = votes.groupBy("item", "value").agg(F.sum("vote").alias("score"), F.count(F.lit(1)).alias("n"))
    tops = scores.groupBy("item").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("top"), F.count(F.lit(1)).alias("k"))
    raw = scores.join(tops, "item").withColumn("e", F.exp(F.col("score") - F.col("top")))
    rest = F.greatest(FALSE_VALUES + 1 - F.first("k"), F.lit(0)) * F.exp(-F.first("top"))
    sums = raw.groupBy("item").agg((F.sum("e") + rest).alias("total"))
    return raw.join(sums, "item").select("item", "value", (F.col("e") / F.col("total")).alias("p"), "n")


def _best(post: DataFrame) -> DataFrame:
    """(item, value, p, n): the most probable value of each item, of equals the smaller."""
    return post.groupBy("item").agg(F.min(F.struct((-F.round("p", 9)).alias("r"), "value", "p", "n")).alias("b")).select("item", "b.value", "b.p", "b.n")


def fuse(claims: DataFrame, rounds: int = 4) -> DataFrame:
    """(item, value, posterior, n_sources): the most probable value of every item, ties by the smaller value.

    ``claims`` (item, source, value, at, record): strings but for the time ``at``; of several claims of one source for one
    item the latest counts, then the smallest record. Claims with a null in item, source or value are left out; no claims
    give no rows.
    """
    pre = claims.where("item is not null and source is not null and value is not null")
    # the latest claim of a source for an item, by a map-side combined minimum
    one = pre.groupBy("item", "source").agg(F.min(F.struct(F.coalesce(-F.unix_micros("at"), F.lit(2**62)).alias("t"), "record", "value")).alias("m"))
    one = stored(one.select("item", F.col("source").alias("s"), "m.value"), "claims")
    x, y = one.select("item", F.col("s").alias("i"), F.col("value").alias("v")), one.select("item", F.col("s").alias("j"), F.col("value").alias("w"))
    pairs = stored(crossed(x, y, "item", "i", "j").where("i < j").select("item", "i", "j", "v", (F.col("v") == F.col("w")).alias("same")), "claim-pairs")
    accuracy = stored(one.select("s").distinct().withColumn("acc", F.lit(FIRST_ACCURACY)), "accuracies")
    # what is true is not known yet, and a majority may be copies: sources that never differ are likely dependent
    counts = pairs.groupBy("i", "j").agg(F.count_if("same").alias("t"), F.lit(0).cast("long").alias("f"), F.count_if(~F.col("same")).alias("d"))
    dependence = stored(_dependence(counts, accuracy), "dependences")
    for _ in range(rounds):
        post = stored(_posteriors(one, pairs, accuracy, dependence), "posteriors")
        right = one.join(post.select("item", "value", "p"), ["item", "value"]).groupBy("s").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"))
        accuracy = stored(right.select("s", F.least(F.greatest((F.col("p") + FIRST_ACCURACY) / (F.col("n") + 1), F.lit(0.05)), F.lit(0.95)).alias("acc")), "accuracies")
        judged = pairs.join(_best(post).select("item", F.col("value").alias("best")), "item")
        good = F.col("same") & (F.col("v") == F.col("best"))
        counts = judged.groupBy("i", "j").agg(F.count_if(good).alias("t"), F.count_if(F.col("same") & ~good).alias("f"), F.count_if(~F.col("same")).alias("d"))
        dependence = stored(_dependence(counts, accuracy), "dependences")
    return _best(_posteriors(one, pairs, accuracy, dependence)).select("item", "value", F.col("p").alias("posterior"), F.col("n").cast("int").alias("n_sources"))
