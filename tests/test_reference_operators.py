"""Text functions, index, search, graph, intervals, secrets, lint, diagnostics, clusters and sessions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import clusters, diagnostics, graph, intervals, lint, matching, rollups, secrets, setup, site, symbols, text_index
from gleaner.streaming import chats, sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_and_titles(spark):
    text = "# Title here\nThe quick `inline code` brown fox\n```\ncode block\n```\nsee https://x.example/a jumps 42"
    assert one(spark, T.doc_tokens(F.lit(text))) == ["title", "quick", "brown", "fox", "see", "jumps"]
    assert one(spark, T.query_terms(F.lit("Go to the DNS resolver"))) == ["dns", "resolver", "go"]
    assert one(spark, T.keyword_tokens(F.lit("a snake_case v1.2 x x-y"))) == ["snake_case", "v1.2", "x-y"]
    assert one(spark, T.markdown_title(F.lit(text), F.lit("f"))) == "Title here"
    assert one(spark, T.markdown_title(F.lit("no"), F.lit("f"))) == "f"
    assert len(T.STOPWORDS) == 120 and len(T.SITE_STOPWORDS) == 110


def test_scalars(spark):
    assert one(spark, T.count_of(F.lit("needle body needle"), F.lit("needle"))) == 2
    assert one(spark, T.round_to(F.lit(1.005), 2)) == 1.0
    assert [T.to_fixed(0.15, 1), T.to_fixed(12.25, 1), T.to_fixed(9.96, 1), T.to_fixed(99.99, 1), T.to_fixed(2.5, 0)] == ["0.1", "12.3", "10.0", "100.0", "3"]
    assert one(spark, T.parsed_int(F.lit(" 42x"), 1, 20, 5)) == 20 and one(spark, T.parsed_int(F.lit("x"), 1, 20, 5)) == 5
    assert one(spark, T.version_key(F.lit("v1.10.2-rc"))) == [1, 10, 2]
    assert one(spark, T.percent_encoded(F.lit("a b*~"))) == "a%20b%2A~"
    assert one(spark, T.slug(F.lit(" Hello, World "))) == "hello-world" and one(spark, T.basename(F.lit("a/b.md"))) == "b.md"
    assert one(spark, T.summarised(F.lit("x" * 70 + ". " + "y" * 60), 100)) == "x" * 70 + "..."
    assert one(spark, T.summarised(F.lit("x" * 130), 100)) == "x" * 100 + "..."
    assert one(spark, T.snippet(F.lit("a" * 100 + " needle " + "b" * 300), F.array(F.lit("needle")))).startswith("...")
    assert one(spark, T.snippet(F.lit("  "), F.array(F.lit("x")))) == "No extractable text."
    assert one(spark, T.shortened(F.lit("one two three"), 9)) == "one two..."


@pytest.mark.parametrize("glob,path,hit", [("*.env", "a/b.env", True), ("secrets/", "x/secrets/y", True), ("secrets/", "x/secretsy", False), ("a.b", "axb", False), (".env*", "c/.env.local", True)])
def test_globs(spark, glob, path, hit):
    assert one(spark, F.lit(path).rlike(T.glob_regex(glob))) is hit


NOTES = [("networking-dns", "# DNS basics\nA resolver asks a nameserver for names and caches answers."), ("algorithms-graph", "# Graph traversal\nBreadth first search walks a graph by layers of vertices."), ("empty", None), ("empty", None)]


def build(spark):
    docs = spark.createDataFrame(NOTES, "name string, text string").withColumn("title", T.markdown_title("text", "name"))
    return docs, text_index.build_index(docs, "name", "text", "title")


def test_index_and_search(spark):
    docs, index = build(spark)
    assert index.size == 3
    norms = {r["doc"]: r["n"] for r in index.vectors.groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()}
    assert norms == {"networking-dns": pytest.approx(1), "algorithms-graph": pytest.approx(1)}
    q = spark.createDataFrame([(1, "dns resolver nameserver"), (2, "graph traversal"), (3, ""), (4, None)], "q int, words string")
    got = {r["query"]: r["doc"] for r in text_index.search([("local", index)], q, "q", "words").where("rank = 1").collect()}
    assert got == {1: "networking-dns", 2: "algorithms-graph"}
    both = text_index.search([("local", index), ("community", index)], q, "q", "words").collect()
    assert {r["source"] for r in both} == {"local"}
    kw = text_index.keyword_search(docs, "name", "name", "title", "text", q, "q", "words").where("rank = 1").collect()
    assert {r["query"]: r["doc"] for r in kw} == got
    one_doc = spark.createDataFrame([("p", "p", "needle title", "needle body needle")], "id string, path string, title string, text string")
    assert text_index.keyword_search(one_doc, "id", "path", "title", "text", spark.createDataFrame([(1, "needle")], "q int, w string"), "q", "w").first()["score"] == 14
    assert text_index.related(index, F.lit(True)).count() == 0
    assert {r["doc"]: r["title"] for r in text_index.index_files(index).collect()}["networking-dns"] == "DNS basics"


def test_related_is_symmetric(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(r.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"], k=12)), "") for i in range(8)], "id long, text string, title string")
    index = text_index.build_index(docs, "id", "text", "title")
    sims = {(x["doc"], x["other"]): x["similarity"] for x in text_index.related(index, F.lit(True), k=50).collect()}
    assert sims and all(sims[(b, a)] == s for (a, b), s in sims.items())


def test_graph(spark):
    defs = spark.createDataFrame([("core", "alpha"), ("core", "beta"), ("a", "run"), ("b", "go")], "file string, name string")
    refs = spark.createDataFrame([("a", "alpha"), ("a", "alpha"), ("b", "beta"), ("b", "alpha"), ("core", "alpha"), ("a", "go")], "file string, name string")
    edges = graph.build_edges(defs, refs, 5).cache()
    assert {(r["src"], r["dst"]): r["weight"] for r in edges.collect()} == {("a", "core"): 2, ("b", "core"): 2}
    nodes = spark.createDataFrame([("core",), ("a",), ("b",), ("x",), ("y",)], "node string")
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(nodes, edges.select("src", "dst", "scaled"), iterations=6).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and max(ranks, key=ranks.get) == "core"
    near = graph.neighbours(edges, nodes.where("node = 'core'")).collect()
    assert [(r["other"], r["dir"]) for r in near] == [("a", "in"), ("b", "in")]
    hits = graph.lookup(defs, spark.createDataFrame(list(ranks.items()), "node string, rank double"), "ALPHA").collect()
    assert [(h["name"], h["exact"]) for h in hits] == [("alpha", True)]
    assert graph.pagerank(nodes.limit(0), edges.select("src", "dst", "scaled")).count() == 0


def test_intervals(spark):
    r = random.Random(4)
    hunks = [("f" if r.random() < 0.8 else None, r.choice([None, *range(300)]), r.randrange(0, 150), k) for k in range(80)]
    ranges = [("f", a, a + r.randrange(40)) for a in r.sample(range(400), 6)] + [("g", 1, 5), (None, 1, 500)]
    h = intervals.with_ends(spark.createDataFrame(hunks, "file string, new_start int, new_count int, k int"))
    got = {x["k"] for x in intervals.overlapping(h, spark.createDataFrame(ranges, "file string, a int, b int"), "file", ("new_start", "new_end"), ("a", "b")).collect()}
    want = {k for f, s, c, k in hunks if f and s is not None and any(g == f and s <= b and a <= max(s, s + c - 1) for g, a, b in ranges)}
    assert got == want
    diff = spark.createDataFrame([("@@ -1 +1 @@",), ("@@ -3,2 +3,0 @@",), ("+x",)], "line string")
    assert [(r["new_start"], r["new_count"]) for r in intervals.hunk_headers(diff, "line").collect()] == [(1, 1), (3, 0), (None, None)]


def test_secrets(spark):
    good = ["AKIA" + "A" * 16, "API_KEY = 1", "my password: x", "postgres://u:p@h", "Authorization: Bearer abc", "-----BEGIN RSA PRIVATE KEY-----"]
    bad = ["nothing here", "keyboard", None, ""]
    df = spark.createDataFrame([(g, True) for g in good] + [(b, False) for b in bad], "line string, want boolean")
    assert all(r[0] == r[1] for r in df.select(secrets.has_secret(F.col("line")), "want").collect())
    paths = {"a/.env": True, ".env.foo": True, "x/id_rsa": True, "k.pem": True, "readme.md": False, "env": False}
    df = spark.createDataFrame(list(paths.items()), "p string, want boolean")
    assert all(r[0] == r[1] for r in df.select(secrets.is_sensitive_path(F.col("p")), "want").collect())
    files = spark.createDataFrame([("f", "ok\r\n api_key = 2 \nok\n"), ("g", None), ("h", "")], "path string, text string")
    assert [tuple(r) for r in secrets.scan(files, "path", "text").collect()] == [("f", 2, "api_key = 2")]


def brute_span(lines, at, python):
    """The span of the function on line ``at``, character by character."""
    if python:
        def depth(x):
            return len(x) - len(x.lstrip(" \t"))

        last = at
        for k in range(at + 1, len(lines)):
            if lines[k].strip() and depth(lines[k]) <= depth(lines[at]):
                break
            last = k if lines[k].strip() else last
        return last - at + 1
    for stop in range(at, len(lines)):
        body = "".join(lines[at : stop + 1])
        if "{" in body and body.count("{") <= body.count("}"):
            return stop - at + 1
    return 1


def random_source(r, python):
    lines = []
    for k in range(r.randrange(5, 40)):
        pad = r.choice(["", "  ", "    ", "\t"])
        if r.random() < 0.3:
            lines.append(f"{pad}def f{k}(a):" if python else r.choice(["fn f{}(a) {{", "pub fn f{}()", "fn f{}(x) {{ if a && b {{ c() }} }}", "pub fn f{}() {{}}"]).format(k))
        else:
            lines.append(pad + r.choice(["", "x", "if x:", "while y: pass || z"] if python else ["", "}", "{", "x }", "} {", "if a {", "}}", "case b && c", "for {"]))
    return "\n".join(lines)


def test_function_spans_match_brute_force(spark):
    r = random.Random(5)
    files = [(f"f{k}.{'py' if k % 2 else 'rs'}", random_source(r, k % 2)) for k in range(60)] + [("g.rs", None), ("h.rs", ""), ("i.d.ts", "function a() {}"), ("j.txt", "fn a() {}")]
    df = spark.createDataFrame(files, "path string, text string").withColumn("line", F.lit("clash"))
    got = {(x["path"], x["line_no"]): (x["name"], x["span"], x["decisions"]) for x in lint.functions(lint.source_lines(df, "path", "text")).collect()}
    want = {}
    for path, text in files[:60]:
        lines = text.split("\n")
        while lines and lines[-1] == "":
            lines.pop()
        python = path.endswith("py")
        for k, line in enumerate(lines):
            m = re.match(r"\s*def (\w+)\(" if python else r"\s*(?:pub )?fn (\w+)\(", line)
            if m:
                n = brute_span(lines, k, python)
                said = sum(sum(x.lstrip().startswith(d) for d in lint.DECISIONS) + x.count("&&") + x.count("||") for x in lines[k : k + n])
                want[(path, k + 1)] = (m.group(1), n, said)
    assert got == want


def test_lint_rules(spark):
    long = "export function big() {\n" + "  a && b;\n" * 210 + "}\n"
    files = [
        ("a.js", "try { x() } catch (e) { }\n_ = err\nexcept A:\npass"), ("b.go", "_ = err\ncatch (e) {}"), ("c.py", "try:\n  f()\nexcept OSError:\n    pass\ncatch (e) {}"),
        ("d.js", long), ("e.tsx", long), ("f.js", "// quality:allow-long-function quality:allow-large-block\n" + long), ("g.py", "x = 1\n" * 701), ("h/test/i.py", "x = 1\n" * 701),
        ("k.rs", "// said\npub fn a() {}\n/* x */\npub fn b() {}\n# no\npub fn c() {}\nfn d() {}"), ("l.py", "# said\ndef a(): pass\n\ndef b(): pass\n\ndef _c(): pass"),
    ]
    df = spark.createDataFrame(files + [("m.js", None), files[0]], "path string, text string")
    rows = lint.issues(df, "path", "text")
    got = {(r["file"], r["category"], r["line"]) for r in rows.collect()}
    assert {x for x in got if x[1] == "cs-principle"} == {("a.js", "cs-principle", 1), ("b.go", "cs-principle", 1), ("c.py", "cs-principle", 3), ("d.js", "cs-principle", 1)}
    assert {x[0] for x in got if x[1] == "maintainability"} == {"g.py"}
    assert {x[0] for x in got if x[1] == "large-block-without-comment"} == {"d.js", "e.tsx", "g.py", "h/test/i.py"}
    said = {r["file"]: r["message"] for r in rows.where("category = 'documentation-gap'").collect()}
    assert said["k.rs"].endswith(": c") and said["l.py"].endswith(": b") and said["d.js"].startswith("1 public")
    page = lint.report(rows, 3).collect()
    assert [r["severity"] for r in page] == ["high", "high", "medium"] and lint.severity_counts(rows).first()["high"] == 2
    assert lint.issues(df.limit(0), "path", "text").count() == 0


def test_signals(spark):
    rows = [("p", "src/A.java", "package a.b;\npublic class AModel {\n  public int f(int a) { return 1; }\n}\n// TODO\n// return x;"), ("p", "src/test/ATest.java", "import org.junit.Test; assertEquals(1, 2);"), ("p", "README.md", "It is O(n) fast."), ("p", "x/Makefile", "all:"), ("q", "a.txt", None)]
    got = {r["project"]: r for r in lint.signals(spark.createDataFrame(rows + [rows[0]], "project string, path string, text string"), "project", "path", "text").collect()}
    p = got["p"]
    assert (p["src_files"], p["test_files"], p["public_decls"], p["assertion_count"], p["big_o_mentions"], p["has_model"], p["mvc_score"], p["junit_usage"], p["build_files"], p["todo_markers"], p["commented_code"]) == (1, 1, 2, 1, 1, True, 1, True, ["x/Makefile"], 1, 1)
    assert (got["q"]["src_files"], got["q"]["class_count"], got["q"]["test_ratio"]) == (0, 1, 0.0)


MINI = [
    ("src/core.rs", "pub fn engine() {}\npub struct Motor;\n"), ("src/main.rs", "fn main() { engine(); inner_sh(); }\n"), ("src/other.rs", "fn other() {\n  engine();\n}\n"),
    ("run.sh", "start_it() {\n  echo\n}\n"), ("README.md", "# Mini\n\n## Use\n"),
]


def test_symbols_of_a_mini_project(spark, tmp_path):
    df = spark.createDataFrame([*MINI, ("empty.rs", None)], "path string, text string")
    index = symbols.index_project(df, "path", "text")
    assert {(r["file"], r["name"], r["kind"]) for r in index.defs.collect()} == {("src/core.rs", "engine", "function"), ("src/core.rs", "Motor", "class"), ("src/main.rs", "main", "function"), ("src/other.rs", "other", "function"), ("run.sh", "start_it", "function")}
    assert {(r["src"], r["dst"]) for r in index.edges.collect()} == {("src/main.rs", "src/core.rs"), ("src/other.rs", "src/core.rs")}
    assert symbols.ranked(index, 1).first()["file"] == "src/core.rs"
    assert [r["heading"] for r in index.headings.orderBy("line").collect()] == ["Mini", "Use"]
    assert [r["file"] for r in symbols.lookup(index, "ENGINE").collect()] == ["src/core.rs"]
    assert "n0[" in symbols.mermaid(index).first()["value"] and symbols.project_map(index).count() == 6
    doc = {r["file"]: r["doc"] for r in symbols.node_docs(index).collect()}["src/core.rs"]
    assert "- `engine` (function) — L1" in doc and "### Referenced by\n\n- [[src/main.rs]] via `engine`" in doc
    symbols.write_index(index, str(tmp_path / "index"))
    back = symbols.read_index(spark, str(tmp_path / "index"))
    again = symbols.unbundled(symbols.bundle(index))
    for name in ("files", "defs", "headings", "edges"):
        rows = Counter(map(str, sorted(map(tuple, getattr(index, name).select(sorted(getattr(index, name).columns)).collect()), key=str)))
        for other in (back, again):
            assert Counter(map(str, sorted(map(tuple, getattr(other, name).select(sorted(getattr(index, name).columns)).collect()), key=str))) == rows
    js = spark.createDataFrame([("a.js", "export function alpha() {}\nclass Beta {}\nalpha();\nif (x) {}\n")], "path string, text string")
    lines = symbols.text_lines(js, "path", "text")
    assert {r["name"] for r in symbols.definitions(lines).collect()} == {"alpha", "Beta"} and [r["name"] for r in symbols.references(lines).collect()] == ["alpha"]


def test_mutual_edges_are_one_neighbour(spark):
    e = spark.createDataFrame([("a", "b", 2, ["x"]), ("b", "a", 3, ["y", "x"]), ("c", "a", 1, ["z"])], "src string, dst string, weight long, via array<string>")
    got = [tuple(r) for r in graph.neighbours(e, spark.createDataFrame([("a",)], "node string")).orderBy("rank").collect()]
    assert got == [("a", 1, "b", "out", 5, ["x", "y"]), ("a", 2, "c", "in", 1, ["z"])]


def test_word_hits_match_brute_force(spark):
    r = random.Random(2)
    texts = [(k, "".join(r.choices("ab ", k=30)), r.choice([None, "aab", ""])) for k in range(40)]
    words = ["a", "aa", "ab", "aba", "b a", "zz", "", None]
    w = spark.createDataFrame([(x,) for x in words], "w string")
    df = spark.createDataFrame(texts, "k long, t string, u string")
    for block in (100, 2):
        got = {(x["k"], x["word"]): tuple(x["n"]) for x in matching.word_hits(df, ["k"], ["t", "u"], w, "w", block).collect()}
        assert got == {(k, x): (t.count(x), (u or "").count(x)) for k, t, u in texts for x in words if x and (x in t or x in (u or ""))}
    assert matching.word_hits(df, ["k"], ["t"], w.limit(0), "w").count() == 0


def test_long_intervals_enter_few_buckets(spark):
    a = spark.createDataFrame([("f", 0, 2**40, 1), ("f", 5, 5, 2), ("f", 2**41, 2**41 + 3, 3)], "file string, a long, b long, k int")
    b = spark.createDataFrame([("f", 7, 9), ("f", 2**39, 2**39), ("f", 2**41 - 5, 2**41)], "file string, a long, b long")
    assert {r["k"] for r in intervals.overlapping(a, b, "file", ("a", "b"), ("a", "b")).collect()} == {1, 3}


def test_sessions_across_slices(spark):
    rows = [(k, 1_000_000 + k * 50, 1, 1.0) for k in range(200)] + [(500, 1_100_000, 1, 1.0), (501, 1_100_121, 1, 1.0), (502, None, 1, 1.0)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "value")
    assert sorted(r["events"] for r in sessions.sessions(df, "user_id", "ts", "value", "event_id").collect()) == [1, 1, 200]


def test_text_labels(spark):
    assert one(spark, T.title_case(F.lit("genai"))) == "GenAI" and one(spark, T.title_case(F.lit("big_data-x"))) == "Big Data X" and one(spark, T.title_case(F.lit(None).cast("string"))) == ""
    assert one(spark, T.category(F.lit("k/sre-notes.md"))) == "SRE" and one(spark, T.pill_label(F.lit("RBAC"))) == "RBAC" and one(spark, T.pill_label(F.lit("two-part tag"))) == "Two-Part Tag"
    assert one(spark, T.valid_tags(F.array(*map(F.lit, ("a", "", "a/b", "2024-01-02x", "y" * 41))))) == ["a"]
    assert one(spark, T.highlighted(F.lit("A <b> dog & cats"), F.array(F.lit("dog"), F.lit("cat")))) == "A &lt;b&gt; <mark>dog</mark> &amp; cats"
    assert one(spark, T.result_path(F.lit("a/b.md · old"), F.lit("t"), F.lit("Scope"))) == "Scope · b.md"
    assert one(spark, T.first_prose_line(F.lit("# T\n![x](y)\n<p>\nshort\n> A line of prose here"))) == "A line of prose here"
    f = one(spark, T.frontmatter(F.lit("---\nname: 'x y'\ndescription: d\nuser-invocable: false\n---\nbody"), F.lit("a.agent.md")))
    assert (f["name"], f["description"], f["user_invocable"]) == ("x y", "d", False) and one(spark, T.frontmatter(F.lit("none"), F.lit("a"))) is None
    assert one(spark, F.to_json(T.recovered_json(F.lit('<think>{</think>```json\n{"a": 1}\n```')))) == '{"a":1}' and one(spark, F.to_json(T.recovered_json(F.lit('so {"a": 2} it is')))) == '{"a":2}'
    assert one(spark, T.recovered_json(F.lit("no"))) is None and one(spark, T.guessed_language(F.lit("a.B.PY"))) == "python" and one(spark, T.extension_of(F.lit("c#"))) == ".cs"
    assert [one(spark, T.elapsed_label(F.lit(x))) for x in (7, 120, 187)] == ["7s", "2 min", "3 min 7s"] and [one(spark, T.ago_label(F.lit(x))) for x in (7, 120, 7300)] == ["just now", "2 min ago", "2 hr ago"]
    assert one(spark, T.to_fixed_text(F.lit(0.15), F.lit(1))) == "0.1" and one(spark, T.file_stem(F.lit("a/b.c.md"))) == "b.c"
    long = "Intro word. " * 30
    assert one(spark, T.browser_snippet(F.lit("# My Title — " + long + "needle here. And more."), F.lit("My Title"), F.lit(""), F.array(F.lit("needle")))).startswith("…")
    assert one(spark, T.browser_snippet(F.lit("word " * 50), F.lit("x"), F.lit("A preview."), F.array(F.lit("zz")))) == "A preview."
    assert one(spark, T.browser_snippet(F.lit("Sort is O(n log n). Heap is O(n). Done."), F.lit("x"), F.lit(None).cast("string"), F.array(F.lit("zz")))) == "Sort is O(n log n)."


def test_setup_report(spark):
    rows = [("a", "Cargo.toml", ""), ("a", "Makefile", ""), ("a", "src/main.rs", ""), ("a", "README.md", "# T\n\nIt does a thing well."), ("b", "Makefile", ""), ("c", "package.json", '{"description": " Said ", "scripts": {"test": "x"}}'), ("c", "package.json", None), ("d", "x.txt", None)]
    got = {r["project"]: r for r in setup.report(spark.createDataFrame(rows, "project string, path string, text string")).collect()}
    assert got["a"]["stacks"] == ["Rust | Cargo.toml | cargo build --release | cargo test | cargo clippy && cargo fmt --check"] and got["a"]["purpose"] == "It does a thing well." and got["a"]["entry_points"] == ["src/main.rs"]
    assert got["b"]["stacks"] == ["Make | Makefile | make | make test"] and got["c"]["purpose"] == "Said" and got["c"]["stacks"] == ["Node.js | package.json | npm run test"]
    assert len(got["d"]["gaps"]) == 7 and len(got["b"]["gaps"]) == 8 and len(got["a"]["questions"]) == 3 and len(got["d"]["questions"]) == 5


def test_rollups(spark):
    m = spark.createDataFrame([("Zed", ["chat"], False), ("alpha", ["chat", "x"], None), ("main", ["chat"], True), ("embed", ["x"], True), (None, None, None)], "n string, c array<string>, d boolean")
    assert [r["n"] for r in rollups.model_catalogue(m, "n", "c", "d").collect()] == ["main", "alpha", "Zed"]
    old = spark.createDataFrame([("1", None, "ODD", None, ["a"], ["b", ""], " s ")], "id string, title string, scope string, path string, tags array<string>, tokens array<string>, summary string")
    r = rollups.adapted_corpus(old).first()
    assert (r["title"], r["scope_key"], r["keywords"], r["search_text"]) == ("Untitled note", "knowledge", ["a", "b"], "Untitled note s a b")
    items = spark.createDataFrame([("old", 1), ("live", 2), ("old", 3), ("old", 4), ("none", 9)], "s string, t int")
    assert [r["t"] for r in rollups.ranked_sections(items, "s", ["live", "old"], [F.desc("t")], {"old": 2}).collect()] == [2, 4, 3]
    assert one(spark, rollups.coalesced_settings(F.lit(None).cast("string"), F.lit(" "), F.lit("x"), F.lit("y"))) == "x"


def edits_of(seed):
    r, rows = random.Random(seed), []
    for k in range(60):
        i = r.randrange(5)
        rows.append(r.choice([
            (2, ["requests"], f'[{{"message":{{"text":"Ask {k}"}}}}]', i), (1, ["requests", str(i), "modelState"], f'{{"value":{r.randrange(3)}}}', None), (1, ["customTitle"], f'"T{k}"', None), (0, [], "{broken", None),
            (1, ["requests", str(i), "response"], f'{{"invocationMessage":"Run {k}"}}', None), (2, ["requests", str(i), "response"], f'[{{"kind":"progressMessage","content":"Step {k}"}}]', None),
        ]))
    return rows


def test_chat_states_agree_with_the_fold(spark):
    rows, want = [], {}
    for s in range(12):
        state = {}
        for k, (kind, path, v, offset) in enumerate(edits_of(s)[: 5 * s]):
            rows.append((f"s{s}", k, kind, path, v, offset))
            state = chats.folded(state, kind, path, v, offset)
        if state:
            want[f"s{s}"] = (state.get("last", -1), state.get("last", -1) >= 0 and state.get("done", -1) < state["last"], state.get("title") or state.get("prompt") or chats.NO_TITLE, state.get("call") or state.get("progress"), state["edits"])
    df = spark.createDataFrame(rows + rows[:3], "session string, line long, kind int, k array<string>, v string, offset int").withColumn("at", F.timestamp_seconds(F.col("line") + 1_900_000_000))
    got = {r["session"]: tuple(r[c] for c in ("last_request", "active", "title", "preview", "edits")) for r in chats.chat_states(df, F.timestamp_seconds(F.lit(1_900_000_100))).collect()}
    assert got == want
    assert not any(r["active"] for r in chats.chat_states(df, F.timestamp_seconds(F.lit(1_900_001_000))).collect())


def test_chat_stream(spark, tmp_path):
    rows = [("a", k, kind, path, v, offset) for k, (kind, path, v, offset) in enumerate(edits_of(3))]
    df = spark.createDataFrame(rows, "session string, line long, kind int, k array<string>, v string, offset int").withColumn("at", F.timestamp_seconds(F.col("line") + 1_900_000_000)).coalesce(1)
    want = chats.chat_states(df, F.timestamp_seconds(F.lit(1_900_000_060))).first()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        df.write.parquet(f"{tmp_path}/in/a")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = chats.stream_chat_states(stream).writeStream.format("memory").queryName("got_chats").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        for k in range(2):  # a later session moves the watermark past the quiet time
            df.limit(1).select(F.lit("z").alias("session"), "line", "kind", "k", "v", "offset", F.timestamp_seconds(F.lit(1_900_010_000)).alias("at")).write.parquet(f"{tmp_path}/in/b{k}")
            q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [r for r in spark.table("got_chats").where("session = 'a'").collect()]
    for c in ("last_request", "title", "preview", "edits"):
        assert got[0][c] == want[c]
    assert got[0]["active"] == want["active"] and len(got) == 2 and not got[1]["active"]


def test_diagnostics(spark):
    t = lambda *rows: spark.createDataFrame([(r,) for r in rows], "t string")
    got = [tuple(r) for r in diagnostics.tsc(t("src/a.ts(3,7): error TS22: no such thing", "noise"), "t").collect()]
    assert got == [("src/a.ts", 3, 7, "error", "TS22", "no such thing", "tsc")]
    assert [tuple(r) for r in diagnostics.mypy(t("a.py:3: note: see", "a.py:4:1: error: bad  [attr-x]"), "t").collect()] == [("a.py", 3, 0, "hint", "", "see", "mypy"), ("a.py", 4, 1, "error", "attr-x", "bad", "mypy")]
    assert diagnostics.clippy(t("not json", '{"reason":"x"}', '{"reason":"compiler-message","message":{"level":"warning","message":"m","spans":[]}}'), "t").count() == 0
    assert diagnostics.eslint(t("not json", "[]", '[{"filePath":"a","messages":[{"severity":2,"message":"m"}]}]'), "t").first()["severity"] == "error"


def test_cluster_samples(spark):
    ref = "array<struct<title:string,url:string,source_type:string>>"
    rows = [(i, "k", "t", "s", "r", None, f"id{i}", [("x", "u1", None), ("y", f"v{i % 2}", None), ("z", None, None)]) for i in range(7, 0, -1)]
    rows += [rows[0], (8, "k", "t", "other", "r", "a", None, None)]
    df = spark.createDataFrame(rows, f"packet_id long, kind string, topic string, statement string, recommendation_strength string, applicability string, submission_id string, evidence_refs {ref}")
    got = {r["statement"]: (r["links"], r["sample_ids"]) for r in clusters.samples(df).collect()}
    assert got == {"s": (3, "id1,id2,id3,id4,id5"), "other": (0, "")}


def test_clusters(spark):
    row = lambda i, s, sup, d, live: f"({i}L, 'principle', 'agents', '{s}', 'required', 'general', '{sup}', {live}, 0, timestamp '2030-01-{d:02d}', timestamp '2030-01-{d:02d}', timestamp '2030-01-{d:02d}', 'h{i}', array(named_struct('title', 't', 'url', 'u{i}', 'source_type', 's')))"
    rows = ", ".join([row(1, "same", "weak", 1, "true"), row(2, "same", "strong", 20, "false"), row(2, "same", "strong", 20, "false"), row(3, "alone", "none", 3, "null")])
    df = spark.sql(f"select * from values {rows} as v(packet_id, kind, topic, statement, recommendation_strength, applicability, authoritative_support, live_revalidated, contradiction_count, audit_completed_at, freshness_checked_at, submitted_at, statement_hash, evidence_refs)")
    got = {r["statement"]: r for r in clusters.cluster(df).collect()}
    assert (got["same"]["submissions"], got["same"]["best_support"], got["same"]["live"], got["same"]["durability_days"], got["same"]["statement_hash"]) == (2, "strong", 1, 19, "h1")
    assert got["same"]["score"] == pytest.approx(100 * (0.35 + 0.2 * 0.4 + 0.15 * 19 / 30 + 0.1 + 0.1 * 0.25 + 0.1))
    assert got["alone"]["score"] == pytest.approx(100 * (0.2 * 0.2 + 0.1 + 0.1 * 0.25 + 0.1 - 0.05))


def test_site_related_without_overlap(spark):
    rows = [(1, "k", "AI", "note", None, []), (2, "z", "AI", "note", ["x"], []), (3, "q", None, "other", ["y"], ["t"]), (3, "q", None, "other", ["y"], ["t"])]
    df = spark.createDataFrame(rows, "entry_id long, scope_key string, category string, document_type string, keywords array<string>, topics array<string>")
    got = {(r["entry"], r["other"]): r["score"] for r in site.related(df, "entry_id", F.lit(True)).collect()}
    assert got == {(1, 2): pytest.approx(1.75), (2, 1): pytest.approx(1.75)}


def test_sessions_batch_and_stream(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, 1_900_000_000 + int(r.random() * 20_000), r.choice([1, 2, None]), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "value")
    want = Counter((x["key"], x["started"], x["ended"], x["events"]) for x in sessions.sessions(df, "user_id", "ts", "value", "event_id").collect())
    # the last event moves the watermark past everything
    late = spark.createDataFrame([(999, 1_900_100_000, 9, 0.0)], "event_id long, s long, user_id long, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = sessions.stream_sessions(stream, "user_id", "ts", "value").writeStream.format("memory").queryName("got_sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    for k in range(2):
        late.write.parquet(f"{tmp_path}/in/b{k}")
        q.processAllAvailable()
    q.stop()
    got = Counter((x["key"], x["started"], x["ended"], x["events"]) for x in spark.table("got_sessions").where("key <> 9").collect())
    assert got == want


def test_folded_edits(spark):
    rows = [("s", 1, 1, "a", "1"), ("s", 2, 0, None, None), ("s", 3, 1, "a", "2"), ("s", 4, 1, "a", "3"), ("t", 1, 1, "b", "x")]
    df = spark.createDataFrame(rows, "session string, line int, kind int, path string, value string")
    assert {tuple(r) for r in sessions.folded(df, "session", "line", "kind", "path", "value").collect()} == {("s", "a", "3"), ("t", "b", "x")}
