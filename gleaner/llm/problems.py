"""The queries of problems 2 to 5, each over its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.words import bare, is_blank
from gleaner.llm import dictionary_dedup, fusion, history_dedup, survivorship, term_weighting
from gleaner.runtime import fresh_path, remove, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One load for each batch, in the order of their numbers. Packets land in a folder per batch first, as they would arrive."""
    packets = table(spark, sf_dir, "packets").select("packet_id", "batch_no", "statement")
    landed, store_path = fresh_path(spark, "landed"), fresh_path(spark, "history")
    packets.withColumn("batch", F.coalesce("batch_no", F.lit(-1))).write.partitionBy("batch").option("compression", "zstd").parquet(landed)
    landing = spark.read.parquet(landed)
    sizes = {r["batch"]: r["n"] for r in landing.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per batch
    store = history_dedup.HistoryStore.create(spark, store_path, sum(sizes.values()))
    found = [history_dedup.ingest(store, landing.where(F.col("batch") == b), "packet_id", "statement", ["batch_no"]) for b in sorted(sizes)]
    remove(spark, landed)
    return reduce(DataFrame.unionByName, found)


PACKET_FIELDS = ["kind", "topic", "statement", "recommendation_strength", "applicability"]


def all_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and the readable packet files, with the five content fields; null and blank statements are left out."""
    packets = table(spark, sf_dir, "packets").select("packet_id", *PACKET_FIELDS)
    files = table(spark, sf_dir, "packet_files").select("packet_id", F.try_parse_json("payload").alias("j"))
    keys = {"recommendation_strength": "recommendationStrength"}
    read = files.where("j is not null").select("packet_id", *[F.try_variant_get("j", f"$.{keys.get(n, n)}", "string").alias(n) for n in PACKET_FIELDS])
    return packets.unionByName(read).where(~is_blank("statement"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary_dedup.copies(all_packets(spark, sf_dir), "packet_id", PACKET_FIELDS, bare)


#: (field, kind, order) of the fields that a principle takes from its records.
PRINCIPLE_FIELDS = [
    ("authoritative_support", "text", "trust"),
    ("live_revalidated", "flag", "trust"),
    ("contradiction_count", "count", "trust"),
    ("freshness_checked_at", "time", "latest"),
    ("public_summary", "text", "trust"),
]


def principle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principles and packets with a principle code, in one layout."""
    code = F.upper(F.trim("principle_code")).alias("principle_code")
    same = ["authoritative_support", "live_revalidated", "public_summary"]
    a = table(spark, sf_dir, "principles").select(
        code, F.col("record_id"), F.lit("principles").alias("origin"), F.col("snapshot_id").alias("source"), *same,
        F.lit(None).cast("int").alias("contradiction_count"), F.lit(None).cast("timestamp").alias("freshness_checked_at"), F.col("generated_at").alias("at"),
    )
    b = table(spark, sf_dir, "packets").select(
        code, F.col("packet_id").alias("record_id"), F.lit("packets").alias("origin"), F.col("community_repo").alias("source"), *same,
        "contradiction_count", "freshness_checked_at", F.col("freshness_checked_at").alias("at"),
    )
    return a.unionByName(b).where("principle_code is not null")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survivorship.best_values(principle_records(spark, sf_dir), "principle_code", "record_id", PRINCIPLE_FIELDS, "authoritative_support", "at")
    return rows.select("principle_code", "field_name", "record_id")


def p3_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable value of every field of every principle, by fusion of its sources: repositories and snapshots."""
    rows = principle_records(spark, sf_dir)
    plain = lambda n, kind: F.lower(F.trim(F.col(n))) if kind == "text" else F.col(n).cast("string")
    claims = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.when(survivorship.usable(F.col(n), kind), plain(n, kind)).alias("value")) for n, kind, _ in PRINCIPLE_FIELDS])).alias("c")
    listed = rows.select(F.col("principle_code").alias("code"), F.concat("origin", F.lit("/"), F.lower("source")).alias("source"), "at", F.col("record_id").alias("record"), claims)
    fused = fusion.fuse(listed.select(F.concat("code", F.lit("|"), "c.field").alias("item"), "source", "c.value", "at", "record"))
    return fused.select(F.split("item", r"\|")[0].alias("principle_code"), F.split("item", r"\|")[1].alias("field_name"), "value", F.round("posterior", 4).alias("posterior"), "n_sources")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = term_weighting.term_scores(table(spark, sf_dir, "notes"), "note_id", "text")
    return s.select(F.col("id").alias("note_id"), "term", "tf", "df", "cf", F.round("score", 6).alias("score"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms used at least four times in a note and found in two to six notes."""
    s = term_weighting.term_scores(table(spark, sf_dir, "notes"), "note_id", "text")
    return s.where("tf >= 4 and df between 2 and 6").select(F.col("id").alias("note_id"), "term")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_fused": p3_fused, "p4_found": p4_found, "p5_found": p5_found, "p5_scores": p5_scores}
