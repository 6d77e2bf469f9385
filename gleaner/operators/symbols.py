"""Symbols of source files (definitions and references), the project's graph built on them, and its rendering as text.

There is no parser at hand, so definitions are told by declaration patterns and references by the identifiers that are
called; that is a stated deviation. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import basename, round_to
from gleaner.operators import graph
from gleaner.operators.secrets import text_lines
from gleaner.runtime import stored

#: Languages whose symbols are read, by file ending.
CODE = {"rs": "rust", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "py": "python", "pyi": "python", "go": "go"}
#: Labels of other files, by ending; any other ending is its own label.
LABELS = {"sh": "shell", "bash": "shell", "zsh": "shell", "md": "markdown", "markdown": "markdown", "yml": "yaml", "yaml": "yaml", "h": "c-header", "rb": "ruby", "": "text"}
_NAME = "([A-Za-z_$][A-Za-z0-9_$]*)"
_SCRIPT = [
    ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}"),
    ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}"),
    ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|[A-Za-z_$][A-Za-z0-9_$]*\s*=>)"),
    ("interface", rf"^\s*(?:export\s+)?interface\s+{_NAME}"),
]
#: Declarations by language: (kind, pattern with the name as its group).
DECLARATIONS = {
    "rust": [
        ("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+{_NAME}"),
        ("class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union|type)\s+{_NAME}"),
        ("interface", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+{_NAME}"),
        ("module", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+{_NAME}"),
        ("macro", rf"^\s*macro_rules!\s+{_NAME}"),
    ],
    "javascript": _SCRIPT, "typescript": _SCRIPT, "tsx": _SCRIPT,
    "python": [("function", rf"^\s*(?:async\s+)?def\s+{_NAME}"), ("class", rf"^\s*class\s+{_NAME}")],
    "go": [("method", rf"^func\s+\([^)]*\)\s*{_NAME}"), ("function", rf"^func\s+{_NAME}"), ("type", rf"^\s*type\s+{_NAME}")],
    "shell": [("function", r"^\s*(?:function\s+)?([A-Za-z_][A-Za-z0-9_-]*)\s*\(\)\s*\{")],
}
#: Words before an opening parenthesis that call nothing.
KEYWORDS = "if for while match switch return catch fn func function def class elif except with in and or not await async let mut new typeof super self".split()
#: Possessive: a name that no parenthesis follows is given up at once, since what is left of it is followed by its own letters.
_CALL = r"\b([A-Za-z_$][A-Za-z0-9_$]*+)!?+\s*+\("
MAP_FILES, MAP_NODES, MAP_EDGES, NODE_DOCS, NODE_NEIGHBOURS = 30, 24, 60, 80, 14


def _mapped(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def label(path: Column | str) -> Column:
    """The language of a file by its ending, else the ending."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(_mapped(CODE | LABELS, ext), ext)


def is_test_path(path: Column) -> Column:
    """The index's own notion of a test file. Fixed values."""
    p = F.lower(path)
    b = basename(p)
    hit = p.rlike("/(test|tests|__tests__|spec)/") | b.rlike(r"^test[-_.]|\.test\.|\.spec\.|_test\.")
    return hit | b.endswith("test.java") | b.endswith("tests.java")


def _rules(path: Column | str) -> Column:
    """What a file's ending says of its symbols, or null: one pattern with a group for each kind, the kinds, and whether calls are read.

    Rules are values of a map and not branches: code for every pattern of every language would be too long to be compiled.
    """
    names = CODE | LABELS | {k: k for k in DECLARATIONS}
    one = lambda lang: F.struct(F.lit("^(?:" + "|".join(rx.removeprefix("^") for _, rx in DECLARATIONS[lang]) + ")").alias("rx"), F.array(*[F.lit(kind) for kind, _ in DECLARATIONS[lang]]).alias("kinds"), F.lit(lang in CODE.values()).alias("calls"))
    known = F.create_map(*[x for ext, lang in names.items() if lang in DECLARATIONS for x in (F.lit(ext), one(lang))])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def code_lines(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, rules, line_no, line) of the files whose symbols are read; rules are looked up once per file."""
    known = files.select(F.col(path).cast("string").alias("path"), _rules(F.col(path)).alias("rules"), F.col(text).alias("text"))
    return text_lines(known.select("path", "rules", F.when(F.col("rules").isNotNull(), F.col("text")).alias("text")), "path", "text", "rules")


def _ruled(lines: DataFrame) -> DataFrame:
    return lines if "rules" in lines.columns else lines.withColumn("rules", _rules(F.col("path")))


def _found(group: Column) -> Column:
    return F.call_function("regexp_extract", F.col("line"), F.col("rules.rx"), group)


def _declares() -> Column:
    return _found(F.lit(0)) != ""


def _declared() -> Column:
    """The declaration of a line that has one, as an array: of the pattern's alternatives, one matched."""
    each = F.transform("rules.kinds", lambda kind, i: F.struct(_found(i + 1).alias("name"), kind.alias("kind")))
    return F.filter(each, lambda x: x["name"] != "")


def definitions(lines: DataFrame) -> DataFrame:
    """(file, name, kind, line) of lines (path, line_no, line): one row per declaration; a name twice on one line counts once.

    Lines of ``code_lines`` have their rules already.
    """
    some = _ruled(lines).where(_declares()).select("path", "line_no", F.explode(_declared()).alias("d"))
    return some.select(F.col("path").alias("file"), "d.name", "d.kind", F.col("line_no").cast("int").alias("line"))


def references(lines: DataFrame) -> DataFrame:
    """(file, name): one row for each call, those on a line that declares the name aside. Only code files have references.

    What a line declares is told from the line itself, so calls meet no table of definitions.
    """
    some = _ruled(lines).where(F.col("rules.calls") & F.contains("line", F.lit("(")))
    some = some.select("path", "line", F.when(_declares(), F.col("rules")).alias("rules"))  # few lines carry them on
    calls = some.select("path", "line", _declared()[0]["name"].alias("own")).select("path", "own", F.explode(F.regexp_extract_all("line", F.lit(_CALL), F.lit(1))).alias("name"))
    return calls.where(~F.col("name").isin(*KEYWORDS) & ~F.col("name").eqNullSafe(F.col("own"))).select(F.col("path").alias("file"), "name")


def headings(lines: DataFrame, most: int = 40) -> DataFrame:
    """(file, line, heading): the first ``most`` lines of a Markdown file that begin with ``#`` at any depth, in fences too."""
    text = F.trim(F.regexp_replace("line", r"^\s*#+", ""))
    found = lines.where(label("path").isin("markdown", "mdx") & F.col("line").rlike(r"^\s*#")).select(F.col("path").alias("file"), F.col("line_no").alias("line"), text.alias("heading")).where("heading <> ''")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line"))).where(F.col("n") <= most).drop("n")


class ProjectIndex:
    """files (file, lang, loc, rank), defs, headings, edges (src, dst, weight, scaled, via) of one project."""

    def __init__(self, files: DataFrame, defs: DataFrame, heads: DataFrame, edges: DataFrame):
        self.files, self.defs, self.headings, self.edges = files, defs, heads, edges


def index_project(sources: DataFrame, path: str, text: str, iterations: int = 40) -> ProjectIndex:
    """The index of a project's files. Ranks of test files are taken times 0.3; ranks have six decimals.

    Repeated paths count once, and a null text has no line, symbol or reference, but its file is a node.
    """
    once = sources.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text")).where("path is not null").dropDuplicates(["path"])
    once = stored(once, "project-files")
    lines, code = text_lines(once, "path", "text"), code_lines(once, "path", "text")
    defs = stored(definitions(code), "project-defs")
    n = once.count()
    edges = stored(graph.build_edges(defs.select("file", "name"), references(code), n), "project-edges")
    ranks = graph.pagerank(once.select(F.col("path").alias("node")), edges.select("src", "dst", "scaled"), iterations=iterations)
    factor = F.when(is_test_path(F.col("file")), 0.3).otherwise(1.0)
    loc = lines.groupBy(F.col("path").alias("file")).agg(F.max("line_no").alias("loc"))
    files = once.select(F.col("path").alias("file"), label("path").alias("lang")).join(loc, "file", "left").join(ranks.withColumnRenamed("node", "file"), "file")
    files = stored(files.select("file", "lang", F.coalesce("loc", F.lit(0)).alias("loc"), round_to(F.col("rank") * factor, 6).alias("rank")), "project-ranks")
    return ProjectIndex(files, defs, stored(headings(lines), "project-headings"), edges)


def ranked(index: ProjectIndex, k: int) -> DataFrame:
    """The k files of the highest rank, numbered from 0, ties by the path."""
    top = index.files.orderBy(F.desc("rank"), "file").limit(k)
    return top.withColumn("n", F.row_number().over(Window.orderBy(F.desc("rank"), "file")) - 1)


def lookup(index: ProjectIndex, query: str, k: int = 10) -> DataFrame:
    """(name, kind, file, line, exact, rank): symbols whose name holds the query, whole-name hits first, then by file rank."""
    low = F.lower("name")
    hits = index.defs.where(F.contains(low, F.lit(query.lower()))).withColumn("exact", low == query.lower()).join(index.files.select("file", "rank"), "file")
    return hits.orderBy(F.desc("exact"), F.desc("rank"), "file", "line", "name").limit(max(1, min(50, k))).select("name", "kind", "file", "line", "exact", "rank")


def mermaid(index: ProjectIndex) -> DataFrame:
    """(value): the graph of the top files as Mermaid text, with the first edges among them; a bounded report."""
    top = stored(ranked(index, MAP_NODES), "map-nodes")
    nodes = top.select(F.lit(0).alias("part"), F.col("n").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit("  n"), "n", F.lit('["'), basename("file"), F.lit('"]')).alias("s"))
    x, y = top.select(F.col("file").alias("src"), F.col("n").alias("i")), top.select(F.col("file").alias("dst"), F.col("n").alias("j"))
    among = index.edges.select("src", "dst").join(F.broadcast(x), "src").join(F.broadcast(y), "dst").orderBy("src", "dst").limit(MAP_EDGES)
    among = among.withColumn("k", F.row_number().over(Window.orderBy("src", "dst")))
    links = among.select(F.lit(1).alias("part"), F.col("k").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit("  n"), "i", F.lit(" --> n"), "j").alias("s"))
    body = nodes.unionByName(links).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "a", "b", "s"))), lambda x: x["s"]), "\n").alias("body"))
    return body.select(F.concat(F.lit("```mermaid\ngraph LR\n"), "body", F.lit("\n```\n")).alias("value"))


def shown_names(index: ProjectIndex, k: int) -> DataFrame:
    """(file, names): the first k different symbol names of each file, module words aside."""
    real = index.defs.where(~F.col("name").isin("exports", "module", "require", "default")).groupBy("file", "name").agg(F.min("line").alias("line"))
    first = real.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("line", "name"))).where(F.col("r") <= k)
    return first.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("names"))


def project_map(index: ProjectIndex) -> DataFrame:
    """(n, line): the list of the most important files, one line each."""
    top = ranked(index, MAP_FILES).join(shown_names(index, 4), "file", "left")
    names = F.coalesce(F.concat(F.lit(" — `"), F.array_join("names", "`, `"), F.lit("`")), F.lit(""))
    return top.select("n", F.concat(F.col("n") + 1, F.lit(". [["), "file", F.lit("]] · "), "lang", F.lit(" · "), "loc", F.lit(" LOC"), names).alias("line"))


def node_docs(index: ProjectIndex) -> DataFrame:
    """(file, doc): a text for each of the top files with its symbols, headings and neighbours; a bounded report."""
    top = stored(ranked(index, NODE_DOCS), "node-docs")
    listed = lambda df, by, s: df.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, s.alias("_s")))), lambda x: x["_s"]), "\n").alias("body"))
    few = lambda df, by, k: df.join(F.broadcast(top.select("file")), "file", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy(*by))).where(F.col("_r") <= k)
    defs = listed(few(index.defs, ["line", "name"], 60), ["_r"], F.concat(F.lit("- `"), "name", F.lit("` ("), "kind", F.lit(") — L"), "line"))
    heads = listed(few(index.headings, ["line"], 30), ["_r"], F.concat(F.lit("- "), "heading"))
    near = graph.neighbours(index.edges, top.select(F.col("file").alias("node"))).withColumnRenamed("node", "file")
    via = F.when(F.size("via") > 0, F.concat(F.lit(" via `"), F.array_join("via", "`, `"), F.lit("`"))).otherwise("")
    link = F.concat(F.lit("- [["), "other", F.lit("]]"), via)
    out, into = listed(near.where("dir = 'out'"), ["rank"], link), listed(near.where("dir = 'in'"), ["rank"], link)
    arrow = F.when(F.col("dir") == "out", F.concat(F.lit("  c --> x"), F.col("rank") - 1)).otherwise(F.concat(F.lit("  x"), F.col("rank") - 1, F.lit(" --> c")))
    drawn = listed(near.where(F.col("rank") <= NODE_NEIGHBOURS), ["rank"], F.concat(F.lit("  x"), F.col("rank") - 1, F.lit('["'), basename("other"), F.lit('"]\n'), arrow))
    doc = top
    parts = [F.concat(F.lit("# "), "file", F.lit("  ·  "), "lang", F.lit("  ·  "), "loc", F.lit(" LOC"))]
    for name, df, title in (("d", defs, "## Symbols"), ("h", heads, "## Headings"), ("g", drawn, None), ("o", out, "### References"), ("i", into, "### Referenced by")):
        doc = doc.join(df.withColumnRenamed("body", name), "file", "left")
        text = F.concat(F.lit(title + "\n\n"), name) if title else F.concat(F.lit('## Graph\n\n```mermaid\ngraph LR\n  c["'), basename("file"), F.lit('"]\n'), name, F.lit("\n```"))
        parts.append(text)
    return doc.select("file", F.concat(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n\n"), F.lit("\n")).alias("doc"))


def write_index(index: ProjectIndex, path: str) -> None:
    """The graph as four tables, and the map, its graph and the node texts beside them."""
    for name in ("files", "defs", "headings", "edges"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    project_map(index).orderBy("n").select("line").coalesce(1).write.mode("overwrite").text(f"{path}/map")
    mermaid(index).coalesce(1).write.mode("overwrite").text(f"{path}/graph")
    node_docs(index).write.mode("overwrite").parquet(f"{path}/nodes")


def read_index(spark, path: str) -> ProjectIndex:
    return ProjectIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("files", "defs", "headings", "edges")])


def bundle(index: ProjectIndex) -> DataFrame:
    """(file, entry): an index as rows of JSON, one per file, to be carried elsewhere; ``unbundled`` reads them back."""
    d = index.defs.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "name", "kind"))).alias("defs"))
    h = index.headings.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "heading"))).alias("headings"))
    e = index.edges.groupBy(F.col("src").alias("file")).agg(F.array_sort(F.collect_list(F.struct("dst", "weight", "scaled", "via"))).alias("edges"))
    rows = index.files.join(d, "file", "left").join(h, "file", "left").join(e, "file", "left")
    return rows.select("file", F.to_json(F.struct("lang", "loc", "rank", "defs", "headings", "edges")).alias("entry"))


def unbundled(rows: DataFrame) -> ProjectIndex:
    schema = "lang string, loc int, rank double, defs array<struct<line:int,name:string,kind:string>>, headings array<struct<line:int,heading:string>>, edges array<struct<dst:string,weight:long,scaled:double,via:array<string>>>"
    r = rows.select("file", F.from_json("entry", schema).alias("x"))
    flat = lambda name: r.select("file", F.explode(f"x.{name}").alias("y")).select("file", "y.*")
    return ProjectIndex(r.select("file", "x.lang", "x.loc", "x.rank"), flat("defs").select("file", "name", "kind", "line"), flat("headings"), flat("edges").withColumnRenamed("file", "src"))
