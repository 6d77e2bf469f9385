"""Symbols of source files at size: no join, few expressions, all cores."""

from pyspark.sql import functions as F

from gleaner.operators import symbols
from gleaner.plans import code_queries

FILES = [
    ("a.rs", "pub fn go(x: u8) { go(1); stop!(2) }\nfn other () {\n  go (3); go(4)\n}\nstruct Go(u8);\n"),
    ("b.js", "export const run = async (a) => run(a)\nlet f = function g() { run(1) }\ncall\n(1)\n"),
    ("c.rust", "trait T {}\r\nmacro_rules! m { () => { n() } }\r\n"),
    ("d.sh", "function up() {\n  down (1)\n}\n"),
    ("e.java", "int get(int a) { return get(a); }"),
    ("f.py", ""),
    ("g.py", None),
    ("plain", "fn x() { y() }"),
]
DEFINED = {("a.rs", "go", "function", 1), ("a.rs", "other", "function", 2), ("a.rs", "Go", "class", 5), ("b.js", "run", "function", 1), ("b.js", "f", "function", 2), ("c.rust", "T", "interface", 1), ("c.rust", "m", "macro", 2), ("d.sh", "up", "function", 1)}
CALLED = [("a.rs", "go"), ("a.rs", "go"), ("a.rs", "stop"), ("b.js", "g"), ("b.js", "run"), ("c.rust", "n")]


def _parts(spark, path, n=200):
    part = spark.range(n).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), F.lit("a name").alias("p_name"))
    part.coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_references_meet_no_table_of_definitions(spark, tmp_path):
    files = spark.createDataFrame(FILES, "path string, text string")
    for lines in (symbols.text_lines(files, "path", "text"), symbols.code_lines(files, "path", "text")):
        assert {tuple(r) for r in symbols.definitions(lines).collect()} == DEFINED
        assert sorted(tuple(r) for r in symbols.references(lines).collect()) == CALLED
    q = code_queries.g_references(spark, _parts(spark, tmp_path))
    assert "Join" not in q._jdf.queryExecution().toString() and q.count() > 0


def test_the_parts_of_references_are_dealt_out(spark, tmp_path):
    lines = code_queries._code(spark, _parts(spark, tmp_path))
    assert symbols.references(lines).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_the_parts_of_definitions_are_dealt_out(spark, tmp_path):
    q = code_queries.g_definitions(spark, _parts(spark, tmp_path))
    assert q.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert q.where("kind = 'function' and name like 'build%'").count() == 40
