import pytest
from pyspark.sql import functions as F

from gleaner.operators import text_index
from gleaner.plans.registry import Registry
from gleaner.sources import files, notes, web


def test_walk(spark, tmp_path):
    root = tmp_path / "proj"
    bodies = {
        "a.md": b"# A", "_b.md": b"x", "sub/c.md": b"y", "sub/d.bin": b"q\x00q", "node_modules/e.md": b"z", "big.txt": b"x" * (files.MAX_BYTES + 1), ".github/f.yml": b"f", "mine/g.md": b"g",
        ".gitignore": b"*.log\n!keep.log\n/top.txt\ngen/\n", "x.log": b"1", "sub/keep.log": b"2", "top.txt": b"3", "sub/top.txt": b"4", "gen/h.md": b"5", "sub/.gitignore": b"only.md\n", "sub/only.md": b"6", "only.md": b"7",
    }
    for name, body in bodies.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    got = {r["rel"] for r in files.walk(spark, str(root), pruned=("mine",)).collect()}
    assert got == {"a.md", "_b.md", "sub/c.md", ".github/f.yml", ".gitignore", "sub/keep.log", "sub/top.txt", "sub/.gitignore", "only.md"}
    assert {r["rel"] for r in files.markdown_files(spark, str(root)).collect()} == {"a.md", "only.md"}
    assert {r["rel"] for r in files.markdown_files(spark, str(root), recursive=True).collect()} == {"a.md", "_b.md", "sub/c.md", "only.md", "mine/g.md"}
    (tmp_path / "none").mkdir()
    assert files.walk(spark, str(tmp_path / "none")).count() == 0


def test_snapshots_and_packs(spark, tmp_path):
    for name, body in {"manifest.json": '{"snapshotManifest": "s/m.json"}', "s/m.json": '{"files": {"principles": "s/p.json", "gone": "s/q.json"}}', "s/p.json": '{"principles": [{"id": "P1", "statement": "x"}, {"id": "P2"}]}', "s/bad.json": "{"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    packs = files.snapshot_files(spark, str(tmp_path))
    assert [r["name"] for r in packs.collect()] == ["principles"]
    got = [tuple(r)[:4] for r in files.pack_entries(packs, "path", "payload", {"principles": ("Principle", "id"), "practices": ("Practice", "id")}).orderBy("pos").collect()]
    assert got == [("s/p.json", "Principle", 0, "P1"), ("s/p.json", "Principle", 1, "P2")]
    assert [r["rel"] for r in files.packet_reader(spark, str(tmp_path)).collect()] == ["manifest.json", "s/m.json", "s/p.json"]


def test_cached_fetch():
    def fetch(path, tag):
        calls.append(tag)
        if broken:
            raise OSError
        return (None, "t1") if tag == "t1" else ("body", "t1")

    calls, cache, broken = [], {}, False
    assert files.cached_fetch("p", fetch, cache, 0) == files.cached_fetch("p", fetch, cache, 599) == files.cached_fetch("p", fetch, cache, 700) == "body" and calls == [None, "t1"]
    broken = True
    assert files.cached_fetch("p", fetch, cache, 5000) == "body"
    with pytest.raises(OSError):
        files.cached_fetch("q", fetch, cache, 0)


def test_note_edits_and_index(spark):
    df = spark.createDataFrame([("a.md", "# A\n\n## X\n\nold\n\n## Y\n\nkept graph"), ("b.md", "other words")], "filename string, text string")
    got = {r["filename"]: r["text"] for r in notes.edited(df, "a.md", "X", "new resolver").collect()}
    assert "new resolver" in got["a.md"] and "old" not in got["a.md"] and "kept" in got["a.md"]
    after = notes.edited(df, "b.md", None, "appended nameserver")
    assert notes.rebuilt(after).vectors.where("term = 'nameserver'").count() == 1
    with pytest.raises(ValueError):
        notes.edited(df, "zz.md", None, "x")


def test_first_hit_and_overlay(spark):
    a, b = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert {tuple(r) for r in files.first_hit([a, b], "k").collect()} == {("x", 1), ("y", 3)}
    m = spark.sql("select map('a', 1, 'b', 2) p, map('b', 3) q")
    assert m.select(files.overlaid(F.col("p"), F.col("q")).alias("m")).first()["m"] == {"a": 1, "b": 3}


def test_packets_lines_releases(spark):
    raw = spark.createDataFrame([(1, '{"kind":"x"}'), (2, '{"repo":"x"}'), (3, '{"kind":'), (4, '{"a":"in /home/me"}'), (5, None)], "id long, payload string")
    got = {r["id"]: (r["readable"], r["forbidden"], r["private"]) for r in files.packet_checks(raw, "id", "payload").collect()}
    assert got == {1: (True, False, False), 2: (True, True, False), 3: (False, False, False), 4: (True, False, True), 5: (False, False, False)}
    lines = spark.createDataFrame([("a", '{"x":1}'), ("a", ""), ("b", '{"x":2}'), ("b", "bad")], "path string, line string")
    assert [r["path"] for r in files.json_lines(lines, "path", "line").collect()] == ["a"]
    rel = spark.createDataFrame([("v0.9.10", False), ("v0.10.1", None), ("v9.0.0", True), (None, False)], "name string, draft boolean")
    assert files.newest_release(rel, "name", "draft").first()["newest"] == "v0.10.1"


def test_web(spark):
    assert web.search_url("a b", site="x.org", exclude="c", time_range="week") == "https://www.google.com/search?q=a%20b%20-c%20site%3Ax.org&tbs=qdr:w"
    html = '<a href="/url?q=https%3A%2F%2Fa.org%2Fp&sa=1"><h3>One <b>x</b></h3></a><a href="https://www.google.com/x"><h3>g</h3></a><a href="https://b.org"><h3>Two</h3></a><a href="https://b.org"><h3>Again</h3></a><a href="https://c.org">no</a>'
    df = spark.createDataFrame([(1, html), (2, None)], "page int, html string")
    assert {(r["url"], r["title"]) for r in web.result_links(df, "page", "html").collect()} == {("https://a.org/p", "One x"), ("https://b.org", "Two")}
    img = spark.createDataFrame([(1, '<img src="https://gstatic.x/1" alt="cat"><img src="https://gstatic.x/1" alt="dog"><img src="https://o.x" alt="cat">')], "page int, html string")
    assert [tuple(r) for r in web.image_links(img, "page", "html").collect()] == [(1, "https://gstatic.x/1", "cat")]
    assert df.select(web.page_text(F.lit("<style>x</style><p>a</p><!-- c -->b")).alias("t")).first()["t"] == "a b"


def test_transcript(spark):
    body = ["WEBVTT", "00:00:01.000 --> 00:00:02.000", "<c>One.</c> Two.", "One. Two.", "", "Three.", "Four.", "Five &amp; six."]
    df = spark.createDataFrame([("f", i, b) for i, b in enumerate(body)], "path string, n int, line string")
    assert web.clean_transcript(df, "path", "n", "line").first()["text"] == "One. Two. Three. Four.\n\nFive & six."


def test_notes(spark, tmp_path):
    text = "# T\n\n## A\n\nold\n\n### A1\n\nx\n\n## B\n\ny\n"
    assert notes.replace_section(text, "A", "new") == "# T\n\n## A\n\nnew\n\n## B\n\ny\n"
    assert notes.replace_section("# T", "C", "z") == "# T\n\n## C\n\nz\n"
    assert notes.append("a\n", "b") == "a\n\nb"
    with pytest.raises(ValueError):
        notes.safe_path("/k", "../x")
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "filename string, text string")
    change = spark.createDataFrame([("a", "3")], "filename string, text string")
    assert {tuple(r) for r in notes.upsert(df, change, overwrite=True).collect()} == {("a", "3"), ("b", "2")}
    with pytest.raises(Exception, match="note exists"):
        notes.upsert(df, change).collect()
    index = text_index.build_index(df.withColumn("text", F.lit("graph traversal graph")).withColumn("title", F.lit("t")), "filename", "text", "title")
    notes.write_index(index, f"{tmp_path}/index")
    assert notes.read_index_files(spark, f"{tmp_path}/index").count() == 2


def test_registry(spark):
    r = Registry(builtin={"one": lambda s, d: s.range(1)})
    assert r.register("two", "select 2 as x") == "registered" and r.register("two", "select 3 as x", force=True) == "updated"
    for bad in ("One", "9x", "one"):
        with pytest.raises(ValueError):
            r.register(bad, "select 1")
    assert r.run(spark, "two", "").first()["x"] == 3 and r.run(spark, "one", "").count() == 1
    r.disabled.add("one")
    with pytest.raises(ValueError):
        r.run(spark, "one", "")
    assert r.unregister("two") and not r.unregister("two") and [x[0] for x in r.list()] == ["one"]


def test_registry_is_saved(spark, tmp_path):
    a, b = Registry(builtin={"own": None}), Registry(builtin={"taken": None})
    a.register("mine", "select 1 as x")
    a.register("taken", "select 2 as x")
    a.disabled.add("mine")
    a.save(spark, f"{tmp_path}/r1.json")
    b.load(spark, f"{tmp_path}/r1.json")
    assert set(b.added) == {"mine"} and b.run(spark, "mine", "", force=True).first()["x"] == 1
    with pytest.raises(ValueError):
        b.run(spark, "mine", "")
    with pytest.raises(ValueError):
        a.save(spark, f"{tmp_path}/r1.json")


def test_sets(spark):
    from gleaner.operators import sets

    df = spark.createDataFrame([("/a/./b/../c",), ("a//b/",), ("../x",), (None,)], "p string")
    assert [r[0] for r in df.select(sets.canonical("p")).collect()] == ["/a/c", "a/b", "x", None]
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in sets.put(t, spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string"), "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert sets.by_index(t, "v", "b").first()["k"] == 2
