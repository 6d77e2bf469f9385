"""Notes and indexes as stored things: create, append, replace a section, write and read an index."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import text_index


def safe_path(root: str, path: str) -> str:
    """The path below the root; one that leaves it is refused."""
    full = posixpath.normpath(posixpath.join(root, path))
    if not full.startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"{path} lies outside of the notes")
    return full


def upsert(notes: DataFrame, changes: DataFrame, key: str = "filename", overwrite: bool = False) -> DataFrame:
    """Notes with changed ones in place. Without ``overwrite`` a change to a note that exists fails when the result is read."""
    if not overwrite:
        changes = changes.join(notes.select(key).distinct().withColumn("_old", F.lit(True)), key, "left")
        changes = changes.withColumn(key, F.when(F.col("_old").isNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("note exists: "), F.col(key))))).drop("_old")
    return notes.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def append(text: str | None, content: str) -> str:
    return content if not text else text.rstrip("\n") + "\n\n" + content


def replace_section(text: str, heading: str, content: str) -> str:
    """The text with the body under a heading replaced, up to the next heading of its level or above; a missing heading is added."""
    m = re.search(rf"(?m)^(#{{1,6}})[ \t]+{re.escape(heading)}[ \t]*$", text)
    if not m:
        return append(text, f"## {heading}\n\n{content}\n")
    after = re.compile(rf"(?m)^#{{1,{len(m.group(1))}}}[ \t]+\S").search(text, m.end())
    rest = text[after.start() :] if after else ""
    return text[: m.end()] + f"\n\n{content.strip()}\n" + ("\n" + rest if rest else "")


def read_note(notes: DataFrame, name: str, max_chars: int | None = None, key: str = "filename") -> DataFrame:
    cut = F.col("text") if max_chars is None else F.substring("text", 1, max(500, min(100_000, max_chars)))
    return notes.where(F.col(key) == name).withColumn("text", cut)


def write_index(index: text_index.Index, path: str) -> None:
    """An index as three tables: files, idf, postings (sorted by term, so that a lookup reads few row groups)."""
    text_index.index_files(index).write.parquet(f"{path}/files")
    index.idf.write.parquet(f"{path}/idf")
    text_index.postings(index).repartitionByRange("term").sortWithinPartitions("term", "doc").write.parquet(f"{path}/postings")


def read_index_files(spark: SparkSession, path: str) -> DataFrame:
    return lenient(spark.read.parquet(f"{path}/files"))


def lenient(files: DataFrame) -> DataFrame:
    """Index rows with null lists as empty ones and null weights dropped."""
    none = F.array().cast("array<string>")
    weights = F.map_filter(F.coalesce("norm_vec", F.map_from_entries(F.array().cast("array<struct<k:string,v:double>>"))), lambda k, v: v.isNotNull())
    return files.withColumn("norm_vec", weights).withColumn("top_terms", F.filter(F.coalesce("top_terms", none), lambda x: x.isNotNull()))


def index_json(files: DataFrame) -> DataFrame:
    """One JSON text per file entry."""
    return files.select(F.to_json(F.struct(*files.columns)).alias("value"))


def edited(notes: DataFrame, name: str, heading: str | None, content: str, key: str = "filename") -> DataFrame:
    """The notes with one of them changed: the section under ``heading`` replaced, or the content appended; a missing note fails.

    Only the changed note goes through Python, as one row.
    """
    mine = notes.where(F.col(key) == name)
    row = mine.first()
    if row is None:
        raise ValueError(f"no such note: {name}")
    text = append(row["text"], content) if heading is None else replace_section(row["text"] or "", heading, content)
    return notes.where(F.col(key) != name).unionByName(mine.withColumn("text", F.lit(text)))


def rebuilt(notes: DataFrame, key: str = "filename") -> text_index.Index:
    """The index of notes as they are after a change."""
    from gleaner.functions.text import markdown_title

    return text_index.build_index(notes.withColumn("title", markdown_title("text", key)), key, "text", "title")
