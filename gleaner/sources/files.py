"""Files as tables: source trees, Markdown corpora, packets, line logs; and what is told from paths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never walked (a tool's own folder comes in as a parameter), and the size beyond which a file is passed over.
PRUNED = ".git node_modules target dist build out vendor .venv __pycache__ .next .cache".split()
MAX_BYTES = 2 * 1024 * 1024
#: Languages by file ending.
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "sh": "shell", "md": "markdown", "c": "c", "cpp": "cpp", "rb": "ruby"}


def is_binary(content: Column) -> Column:
    """Whether one of the first 8192 bytes is NUL."""
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\x00"))


def ignore_patterns(text: str, folder: str = "") -> list[tuple[str, bool]]:
    """(regular expression on a relative path, whether it brings back) of each line of an ignore file in ``folder``, in order."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[1:] if back else line
        only_folders, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        rx = ""
        for piece in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|\\\\.|.", line.lstrip("/")):
            rx += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece) or (piece.replace("[!", "[^") if piece[0] == "[" and len(piece) > 1 else re.escape(piece[-1]))
        start = re.escape(folder.rstrip("/") + "/") if folder else ""
        out.append((f"^{start}{'' if anchored else '(?:.*/)?'}{rx}" + ("/" if only_folders else "(?:/|$)"), back))
    return out


def is_ignored(rel: Column, patterns: list[tuple[str, bool]]) -> Column:
    """Whether ignore patterns leave a path out; the last one that matches decides."""
    hit = F.lit(False)
    for rx, back in patterns:
        hit = F.when(rel.rlike(rx), not back).otherwise(hit)
    return hit


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, length) of all files below a root, hidden ones too. Names are listed on the driver, without contents."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found, entries = fs.makeQualified(top).toString().rstrip("/"), [], fs.listFiles(top, True)
    while entries.hasNext():
        entry = entries.next()
        path = entry.getPath().toString()
        found.append((path, path[len(base) + 1 :], entry.getLen()))
    return spark.createDataFrame(found, "path string, rel string, length long")


def contents(listed: DataFrame) -> DataFrame:
    """``listed`` with the ``content`` of every file. Spark's own file source never lists hidden names, so each task opens its files."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                uri = row.path if "://" in row.path else "file://" + row.path.removeprefix("file:")
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as stream:
                    yield pd.DataFrame([(*row, stream.read())], columns=[*pdf.columns, "content"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema.fields)
    return listed.mapInPandas(scan, schema + ", content binary")


def walk(spark: SparkSession, root: str, glob: str = "*", text_only: bool = True, pruned: tuple[str, ...] = (), ignore: str | None = ".gitignore") -> DataFrame:
    """(rel, ext, length, text): files below a root; pruned folders, files over 2 MiB, binary and ignored ones are left out.

    Names that begin with a dot or an underscore count as well. ``ignore`` names the ignore files that are obeyed, that of
    a folder for what lies below it. Order is by the path where a caller asks for it.
    """
    kept = listed_files(spark, root).where((F.col("length") <= MAX_BYTES) & ~F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, (*PRUNED, *pruned)))))
    name = F.element_at(F.split("rel", "/"), -1)
    if ignore:
        patterns = []
        for r in contents(kept.where(name == ignore)).select("rel", F.decode("content", "UTF-8").alias("text")).orderBy("rel").collect():  # the ignore files only
            patterns += ignore_patterns(r["text"], r["rel"].rpartition("/")[0])
        kept = kept.where(~is_ignored(F.col("rel"), patterns))
    files = contents(kept.where(name.rlike("^" + re.escape(glob).replace(r"\*", ".*") + "$")))
    if text_only:
        files = files.where(~is_binary(F.col("content")))
    ext = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))
    return files.select("rel", ext.alias("ext"), "length", F.decode("content", "UTF-8").alias("text"))


def markdown_files(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """(rel, text) of Markdown files; without recursion only the top level, without names that begin with ``_``."""
    found = walk(spark, root, "*.md").where("ext = 'md'").select("rel", "text")
    return found if recursive else found.where(~F.contains("rel", F.lit("/")) & ~F.col("rel").startswith("_"))


def corpus(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Several corpora as one, each row tagged with its ``scope``; missing columns are null."""
    out = None
    for scope, df in parts:
        tagged = df.withColumn("scope", F.lit(scope))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def first_hit(parts: list[DataFrame], key: str) -> DataFrame:
    """One row per key, from the first table that has it; within a table any row of the key."""
    tagged = corpus([(str(i).zfill(6), p) for i, p in enumerate(parts)])
    rest = [c for c in parts[0].columns if c != key]
    return tagged.groupBy(key).agg(F.min_by(F.struct(*rest), "scope").alias("r")).select(key, "r.*")


#: Keys and phrases that must not occur in a packet.
FORBIDDEN_KEYS = "repository repo workspace projectName filePath localPath directoryStructure repoTypeSignals".split()
PRIVATE_TEXT = r"/Users/|/home/|[A-Za-z]:\\\\|this repository|my workspace|our repo"


def packet_checks(raw: DataFrame, id_col: str, payload: str) -> DataFrame:
    """(id, readable, forbidden, private): what stands against a raw packet; unreadable JSON has no forbidden keys."""
    v = F.try_parse_json(payload)
    keys = F.json_object_keys(payload)
    return raw.select(
        F.col(id_col).alias("id"), F.coalesce(v.isNotNull(), F.lit(False)).alias("readable"),
        F.coalesce(v.isNotNull() & F.arrays_overlap(keys, F.array(*map(F.lit, FORBIDDEN_KEYS))), F.lit(False)).alias("forbidden"),
        F.coalesce(F.col(payload).rlike(PRIVATE_TEXT), F.lit(False)).alias("private"),
    ).dropDuplicates(["id"])


def json_lines(lines: DataFrame, path: str, line: str) -> DataFrame:
    """(path, record): the JSON records of line files; a file with a line that is no JSON is left out whole."""
    parsed = lines.where(F.trim(line) != "").select(F.col(path).alias("path"), F.try_parse_json(line).alias("record"))
    bad = parsed.where("record is null").select("path").distinct()
    return parsed.join(bad, "path", "left_anti")


def top_folders(paths: DataFrame, path: str) -> DataFrame:
    """Distinct first segments of paths that lie in a folder."""
    return paths.where(F.contains(path, F.lit("/"))).select(F.split_part(path, F.lit("/"), F.lit(1)).alias("folder")).distinct()


def language_counts(paths: DataFrame, path: str) -> DataFrame:
    """(language, n) of paths with a known ending."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return paths.select(F.try_element_at(names, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))).alias("language")).where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def newest_release(releases: DataFrame, name: str, draft: str) -> DataFrame:
    """The release with the greatest version, compared component by component; drafts don't count."""
    from gleaner.functions.text import version_key

    return releases.where(~F.coalesce(F.col(draft), F.lit(False)) & F.col(name).isNotNull()).groupBy().agg(F.max_by(name, version_key(name)).alias("newest"))


def overlaid(first: Column, second: Column) -> Column:
    """Two maps as one, where the second map's keys win."""
    both = F.concat(F.map_entries(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k))), F.map_entries(second))
    return F.map_from_entries(both)


def packet_reader(spark: SparkSession, root: str) -> DataFrame:
    """(rel, record): the JSON files below a root, one record each, by path; those that are no JSON are left out."""
    found = walk(spark, root, "*.json", ignore=None)
    return found.select("rel", F.try_parse_json("text").alias("record")).where("record is not null").orderBy("rel")


def pack_entries(packs: DataFrame, path: str, payload: str, arrays: dict[str, tuple[str, str]]) -> DataFrame:
    """(path, kind, pos, entry): the entries of pack files; ``arrays`` says which key of a pack holds them and their kind.

    A pack without any of the keys, or that is no JSON, has no entry. Order within a pack is kept in ``pos``.
    """
    j = packs.select(F.col(path).alias("path"), F.try_parse_json(payload).alias("j")).where("j is not null")
    out = None
    for key, (kind, title) in arrays.items():
        rows = j.select("path", F.posexplode(F.try_variant_get("j", f"$.{key}", "array<variant>")).alias("pos", "entry"))
        rows = rows.select("path", F.lit(kind).alias("kind"), "pos", F.try_variant_get("entry", f"$.{title}", "string").alias("title"), F.to_json("entry").alias("entry"))
        out = rows if out is None else out.unionByName(rows)
    return out


def snapshot_files(spark: SparkSession, root: str, manifest: str = "manifest.json") -> DataFrame:
    """(name, path, payload): the files that a snapshot's manifest names, read in two steps; missing files are left out.

    The manifest names the snapshot's own manifest (``snapshotManifest``), whose ``files`` maps names to paths.
    """
    read = lambda rel: spark.read.option("wholetext", True).text(f"{root.rstrip('/')}/{rel}").first()[0]
    inner = spark.createDataFrame([(read(manifest),)], "t string").select(F.get_json_object("t", "$.snapshotManifest")).first()[0]
    named = spark.createDataFrame([(read(inner),)], "t string").select(F.explode(F.from_json(F.get_json_object("t", "$.files"), "map<string,string>")).alias("name", "rel"))
    texts = walk(spark, root, ignore=None).select("rel", F.col("text").alias("payload"))
    return named.join(texts, "rel").select("name", F.col("rel").alias("path"), "payload")


def written_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, for a site or another tool."""
    rows.write.mode("overwrite").json(path)


def cached_fetch(path: str, fetch, cache: dict, now: float, ttl: float = 600.0) -> str:
    """A remote file by way of a cache of (text, tag, time): within ``ttl`` seconds as it is, later asked for by its tag, and
    stale where asking fails. ``fetch(path, tag)`` gives (text or None if unchanged, tag) or raises."""
    held = cache.get(path)
    if held and now - held[2] < ttl:
        return held[0]
    try:
        text, tag = fetch(path, held[1] if held else None)
    except OSError:
        if held:
            return held[0]
        raise
    text = held[0] if text is None and held else text
    cache[path] = (text, tag, now)
    return text
