"""Clusters of equal findings with their support, spread and composite evidence score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Worth of support labels.
SUPPORT_VALUE = {"strong": 1.0, "medium": 0.66, "weak": 0.33}
#: Applicabilities that count as wide.
WIDE = ("general", "workflow-general", "tool-use", "routing")

#: Weights of the evidence score, and what each part is measured by.
SCORE_WEIGHTS = {"support": 0.35, "repetition": 0.20, "duration": 0.15, "freshness": 0.10, "sources": 0.10, "width": 0.10, "contradictions": -0.20, "singleness": -0.10}
#: The fields in which the findings of a cluster are equal.
CLUSTER_KEYS = ["kind", "topic", "statement", "recommendation_strength", "applicability"]


def valid_packet(min_length: int = 10) -> Column:
    """Whether a packet has all its parts: labels from the known sets, a statement of ``min_length``, evidence, times, ids.

    Fixed values: the label sets. Null in any part makes it false.
    """
    known = (
        F.col("kind").isin("principle", "anti-pattern", "example", "warning")
        & F.col("topic").isin("prompts", "instructions", "agents", "skills", "routing", "tooling", "workflow", "other")
        & F.col("recommendation_strength").isin("required", "recommended", "optional", "illustrative")
        & F.col("applicability").isin("general", "prompt-design", "instruction-design", "agent-design", "skill-design", "routing", "tool-use", "workflow-general")
        & F.col("authoritative_support").isin("none", "weak", "medium", "strong")
    )
    present = (F.col("schema_version") == 1) & (F.length("statement") >= min_length) & (F.size("evidence_refs") >= 1)
    for c in ("audit_completed_at", "freshness_checked_at", "live_revalidated", "contradiction_count", "client_behavior_version", "submitted_at", "submission_id", "statement_hash"):
        present = present & F.col(c).isNotNull()
    return F.coalesce(known & present, F.lit(False))


def cluster(packets: DataFrame) -> DataFrame:
    """One row per (kind, topic, statement, recommendation_strength, applicability).

    Counts, best support, first and last time, whole days between audits, contradictions, the hash of the first packet, and
    the evidence score: 100 times a weighted sum of support, repetition, duration, freshness, sources and width, less
    contradictions and singleness. Repeated packet ids count once. Aggregates are combined before the shuffle. Submission
    ids and evidence links are not here but in the function ``samples``.
    """
    keys = CLUSTER_KEYS
    days = lambda c: F.floor((F.unix_timestamp(F.max(c)) - F.unix_timestamp(F.min(c))) / 86400)
    worth = F.lit(0.0)
    for label, x in SUPPORT_VALUE.items():
        worth = F.when(F.col("authoritative_support") == label, x).otherwise(worth)
    once = packets.dropDuplicates(["packet_id"])
    agg = once.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("submissions"),
        F.max(worth).alias("support"),
        F.count_if("live_revalidated").alias("live"),
        F.min("submitted_at").alias("first_seen"),
        F.max("submitted_at").alias("last_seen"),
        days("audit_completed_at").alias("durability_days"),
        days("freshness_checked_at").alias("spread_days"),
        F.sum(F.coalesce("contradiction_count", F.lit(0))).alias("contradictions"),
        F.sum(F.greatest(F.size(F.coalesce("evidence_refs", F.array().cast("array<struct<title:string,url:string,source_type:string>>"))), F.lit(0))).alias("refs"),
        F.min_by("statement_hash", "packet_id").alias("statement_hash"),
    )
    n = F.col("submissions")
    width = F.when(F.col("applicability").isin(*WIDE), 1.0).otherwise(0.7)
    bounded = lambda c: F.least(F.lit(1.0), c)
    parts = {
        "support": F.col("support"), "repetition": bounded(n / 5), "duration": bounded(F.coalesce("durability_days", F.lit(0)) / 30), "freshness": F.when(F.coalesce("spread_days", F.lit(0)) <= 30, 1.0).otherwise(0.5),
        "sources": bounded(F.col("refs") / (n * 4)), "width": width, "contradictions": bounded(F.col("contradictions") / (n * 2)), "singleness": F.when(n == 1, 0.5).otherwise(0.0),
    }
    score = 100 * sum((weight * parts[k] for k, weight in SCORE_WEIGHTS.items()), F.lit(0.0))
    label = F.lit("none")
    for name, x in reversed(SUPPORT_VALUE.items()):
        label = F.when(F.col("support") == x, name).otherwise(label)
    return agg.withColumn("best_support", label).withColumn("score", F.round(score, 6)).drop("support", "refs", "spread_days")


def evidence(packets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, url, title): the evidence links of each group, each url once with its smallest title."""
    links = packets.dropDuplicates(["packet_id"]).select(*keys, F.explode("evidence_refs").alias("e")).where("e.url is not null")
    return links.groupBy(*keys, F.col("e.url").alias("url")).agg(F.min("e.title").alias("title"))


def samples(packets: DataFrame, keys: list[str] = CLUSTER_KEYS, most: int = 5) -> DataFrame:
    """(keys, links, sample_ids): of each cluster the number of evidence links distinct by url and the ``most`` smallest
    submission ids, comma-separated. No more ids than ``most`` are collected."""
    once = packets.dropDuplicates(["packet_id"])
    ids = once.where("submission_id is not null").select(*keys, "submission_id").distinct()
    first = ids.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("submission_id"))).where(F.col("_r") <= most)
    first = first.select(*keys, "submission_id", F.lit(0).alias("link"))
    links = evidence(packets, keys).select(*keys, F.lit(None).cast("string").alias("submission_id"), F.lit(1).alias("link"))
    none = once.select(*keys, F.lit(None).cast("string").alias("submission_id"), F.lit(0).alias("link"))
    grouped = first.unionByName(links).unionByName(none.distinct()).groupBy(*keys)
    return grouped.agg(F.sum("link").alias("links"), F.array_join(F.array_sort(F.collect_set("submission_id")), ",").alias("sample_ids"))
