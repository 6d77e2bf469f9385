"""Small rollups: packets as they are handed in, quotas, facets, change summaries, paired events, facts of a session log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import statement_hash
from gleaner.runtime import stored


def sanitised(raw: DataFrame, id_col: str, payload: str) -> DataFrame:
    """(id, kind, topic, statement, public_summary, caution_notes, statement_hash) of readable packets with a statement.

    Only known fields pass; runs of white space in a statement become one blank, missing texts an empty one. Repeated ids
    count once.
    """
    j = raw.select(F.col(id_col).alias("id"), F.try_parse_json(payload).alias("j")).where("j is not null").dropDuplicates(["id"])
    get = lambda n: F.try_variant_get("j", f"$.{n}", "string")
    s = j.select("id", get("kind").alias("kind"), get("topic").alias("topic"), F.trim(F.regexp_replace(get("statement"), r"(?U)\s+", " ")).alias("statement"), F.coalesce(get("publicSummary"), F.lit("")).alias("public_summary"), F.coalesce(get("cautionNotes"), F.lit("")).alias("caution_notes"))
    return s.where("statement is not null").withColumn("statement_hash", statement_hash("statement"))


def monthly_quota(events: DataFrame, key: str, at: str, event_id: str, limit: int) -> DataFrame:
    """(key, month, n, remaining): what each key used of a monthly limit; never below nothing left. Repeated ids count once."""
    e = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).dropDuplicates([event_id])
    return e.groupBy(F.col(key).alias("key"), F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n")).withColumn("remaining", F.greatest(F.lit(limit) - F.col("n"), F.lit(0)))


def facet_index(records: DataFrame, id_col: str, topics: str, applicability: str) -> DataFrame:
    """(facet, label, n, first_id): records by topic and by applicability; null labels belong to none, repeated ids count once."""
    r = records.dropDuplicates([id_col])
    f = r.select(F.lit("topic").alias("facet"), F.explode(topics).alias("label"), F.col(id_col).alias("id")).unionByName(r.select(F.lit("applicability").alias("facet"), F.col(applicability).alias("label"), F.col(id_col).alias("id")))
    return f.where("label is not null").distinct().groupBy("facet", "label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def change_summary(changes: DataFrame, group: str, name: str, shown: int = 3) -> DataFrame:
    """(grp, n, summary): the first names of each group, and how many more there are. Only ``shown`` names are gathered."""
    c = changes.where(F.col(name).isNotNull()).select(F.col(group).alias("grp"), F.col(name).alias("name")).distinct()
    first = c.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("name"))).where(F.col("k") <= shown)
    names = first.groupBy("grp").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    met = c.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("grp", "g")
    met = met.join(names, F.col("g").eqNullSafe(F.col("grp")))
    return met.select(F.col("g").alias("grp"), "n", F.concat("names", F.when(F.col("n") > shown, F.concat(F.lit(" +"), F.col("n") - shown, F.lit(" more"))).otherwise("")).alias("summary"))


def paired(events: DataFrame, key: str, at: str, event_id: str, begins: Column, ends: Column, slice_seconds: int = 86_400) -> DataFrame:
    """(key, begin_id, began, ended, seconds): every beginning with the end that follows it before anything else of the kind; open
    ones have null ends. Other events don't matter, repeated ids count once.

    The events of a key are cut into slices of time; within a slice each event sees the next one, and only the first event
    of each slice is brought together by key, so a key that holds a large part of all events is not one task's work.
    """
    e = events.where(F.col(key).isNotNull() & F.col(at).isNotNull() & (begins | ends)).dropDuplicates([event_id]).select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(event_id).alias("id"), begins.alias("begin"))
    e = stored(e.withColumn("slice", F.floor(F.unix_timestamp("at") / slice_seconds)), "paired-events")
    w = Window.partitionBy("key", "slice").orderBy("at", "id")
    inside = e.withColumn("next", F.lead(F.struct("begin", "at")).over(w))
    first = e.groupBy("key", "slice").agg(F.min(F.struct("at", "id", "begin")).alias("f"))
    after = first.select("key", "slice", F.lead(F.struct("f.begin", "f.at")).over(Window.partitionBy("key").orderBy("slice")).alias("after"))
    x = inside.where("begin").join(after, ["key", "slice"]).withColumn("next", F.coalesce("next", "after"))
    ended = F.when(~F.col("next.begin"), F.col("next.at"))
    return x.select("key", F.col("id").alias("begin_id"), F.col("at").alias("began"), ended.alias("ended"), F.floor((F.unix_micros(ended) - F.unix_micros("at")) / 1_000_000).alias("seconds"))


def session_facts(lines: DataFrame) -> DataFrame:
    """(session, first_request, title, created, lines) of log lines (session, line, kind, value, ts): the first request, the last title."""
    pick = lambda f, kind: f(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, F.col("line")))
    return lines.where("session is not null").groupBy("session").agg(pick(F.min_by, "request").alias("first_request"), pick(F.max_by, "title").alias("title"), F.min("ts").alias("created"), F.count(F.lit(1)).alias("lines"))


def ranked_sections(items: DataFrame, section: str, sections: list[str], order: list[Column], most: dict[str, int]) -> DataFrame:
    """Items in the order of their sections, each section in its own order and with at most so many items as ``most`` says."""
    place = F.array_position(F.array(*map(F.lit, sections)), F.col(section))
    w = Window.partitionBy(section).orderBy(*order)
    kept = items.withColumn("_s", place).where("_s > 0").withColumn("_n", F.row_number().over(w))
    limit = F.lit(None).cast("int")
    for name, n in most.items():
        limit = F.when(F.col(section) == name, n).otherwise(limit)
    kept = kept.where(limit.isNull() | (F.col("_n") <= limit))
    return kept.orderBy("_s", "_n").drop("_s", "_n")


def model_catalogue(models: DataFrame, name: str, capabilities: str, default: str) -> DataFrame:
    """Models that can chat, the default first, then by lower-case name."""
    return models.where(F.array_contains(capabilities, "chat")).orderBy(F.desc(F.coalesce(F.col(default), F.lit(False))), F.lower(name), name)


def coalesced_settings(*sources: Column) -> Column:
    """The first setting that is there and not empty."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in sources])


def adapted_corpus(rows: DataFrame) -> DataFrame:
    """Entries of the older layout (id, title, scope, path, tags, tokens, summary) in the present one; unknown scopes are ``knowledge``.

    Missing titles and ids get their defaults; tags and tokens become the keywords.
    """
    labels = {"copilot": "Copilot guide", "knowledge": "Knowledge note", "archive": "Archive entry"}
    scope = F.lower(F.coalesce("scope", F.lit("knowledge")))
    scope = F.when(scope.isin(*labels), scope).otherwise("knowledge")
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), scope)
    none = F.array().cast("array<string>")
    words = F.filter(F.concat(F.coalesce("tags", none), F.coalesce("tokens", none)), lambda x: F.coalesce(x, F.lit("")) != "")
    title, snippet = F.trim(F.coalesce("title", F.lit("Untitled note"))), F.trim(F.coalesce("summary", F.lit("")))
    return rows.select(
        F.col("id").alias("id"), title.alias("title"), F.coalesce("path", title).alias("path"), scope.alias("scope_key"), label.alias("scope_label"), snippet.alias("snippet"),
        F.trim(F.concat(title, F.lit(" "), snippet, F.lit(" "), F.array_join(words, " "))).alias("search_text"), words.alias("keywords"), F.concat(F.array(label), F.slice(words, 1, 3)).alias("pills"),
    )
