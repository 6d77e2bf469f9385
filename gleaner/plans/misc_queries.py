"""Queries of paths, versions, pages, logs and set operations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as t
from gleaner.operators import intervals, secrets, sets
from gleaner.runtime import table
from gleaner.sources import files, web


def f_encoded(spark, sf_dir):
    e = table(spark, sf_dir, "notes_search").dropDuplicates(["entry_id"])
    return e.select("entry_id", t.percent_encoded("title").alias("encoded"))


def f_globs(spark, sf_dir):
    """Which of four globs every note's path matches."""
    p = table(spark, sf_dir, "notes").select("path").where("path is not null").distinct()
    return p.select("path", *[F.col("path").rlike(t.glob_regex(g)).alias(n) for n, g in (("md", "*.md"), ("folder", "notes/"), ("start", "a*"), ("exact", "readme.md"))])


def s_newest_release(spark, sf_dir):
    """The newest order, read as a version, drafts aside."""
    o = table(spark, sf_dir, "orders")
    v = F.concat(F.lit("v"), F.col("o_orderkey") % 23, F.lit("."), F.col("o_custkey") % 19, F.lit("."), F.col("o_orderkey") % 17)
    return files.newest_release(o.select(v.alias("name"), (F.col("o_orderstatus") == "P").alias("draft")), "name", "draft")


def s_top_folders(spark, sf_dir):
    paths = table(spark, sf_dir, "notes").select("path").union(table(spark, sf_dir, "packet_files").select("file_path"))
    return files.top_folders(paths, "path")


def s_first_hit(spark, sf_dir):
    """Principles by code, from the snapshot table if it has the code, else from packets: the smallest record of each."""
    code = F.upper(F.trim("principle_code")).alias("code")
    best = lambda df, i: df.groupBy(code).agg(F.min(i).alias("record")).where("code is not null")
    return files.first_hit([best(table(spark, sf_dir, "principles"), "record_id"), best(table(spark, sf_dir, "packets"), "packet_id")], "code")


def s_overlaid(spark, sf_dir):
    """The settings of every customer: those of the nation, overruled by the customer's own."""
    c = table(spark, sf_dir, "customer")
    first = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.lit("any"))
    second = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    m = files.overlaid(first, second)
    return c.select("c_custkey", m["nation"].alias("nation"), m["segment"].alias("segment"), m["name"].alias("name"), F.size(m).alias("n"))


def s_json_lines(spark, sf_dir):
    """Packet files as lines of one log per folder: a log with a broken line is left out whole."""
    p = table(spark, sf_dir, "packet_files").dropDuplicates(["packet_id"])
    log = F.concat(F.lit("log"), F.col("packet_id") % 97)
    lines = p.select(log.alias("path"), F.col("payload").alias("line"))
    return files.json_lines(lines, "path", "line").groupBy("path").agg(F.count(F.lit(1)).alias("records"))


def s_web_results(spark, sf_dir):
    """The results on a page made of every part: a redirect, a direct link twice, a link of the search engine."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    html = F.concat(F.lit('<a class=x href="/url?q=https%3A%2F%2Fa.org%2F'), k, F.lit('&amp;sa=1"><h3>One <b>'), "p_name", F.lit('</b></h3></a><a href="https://b.org/'), k, F.lit('"><h3>Two</h3></a><a href="https://b.org/'), k, F.lit('"><h3>Again</h3></a><a href="https://www.google.com/z"><h3>no</h3></a><img src="https://x.gstatic.com/i'), k, F.lit('" alt="A picture"><img src="https://x.gstatic.com/j" alt="no">'))
    return web.result_links(p.select("p_partkey", html.alias("html")), "p_partkey", "html").select(F.col("page").alias("page"), "pos", "url", "title")


def s_images(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    html = F.concat(F.lit('<img src="https://x.gstatic.com/i'), k, F.lit('" alt="A '), "p_name", F.lit('"><IMG alt="no" src="https://x.gstatic.com/j"><img src="https://other.org/k" alt="other one">'))
    return web.image_links(p.select("p_partkey", html.alias("html")), "p_partkey", "html")


def d14_headers(spark, sf_dir):
    """Hunk headers made of every order line, and what they say."""
    line = F.concat(F.lit("@@ -1,2 +"), F.col("l_partkey"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit(","), F.col("l_linenumber") - 1)), F.lit(" @@ x"))
    h = intervals.hunk_headers(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line")), "line")
    return intervals.with_ends(h).drop("line")


def d12_tagged(spark, sf_dir):
    """Sensitive paths among the notes and the packet files, with the tables that have them."""
    made = lambda df, c: df.select(F.regexp_replace(c, r"[^/]+$", ".env").alias("path"))
    union = sets.tagged_union({"notes": made(table(spark, sf_dir, "notes"), "path"), "files": made(table(spark, sf_dir, "packet_files"), "file_path")}, "path")
    return union.where(secrets.is_sensitive_path(F.col("path"))).select("path", F.array_join("tags", "+").alias("tags"))


def s_canonical(spark, sf_dir):
    """Notes of two roots under crooked paths, each once, the first root first."""
    n = table(spark, sf_dir, "notes").where("path is not null").groupBy("path").agg(F.min("note_id").alias("note_id"))
    a = n.where("note_id % 2 = 0").select(F.concat(F.lit("./x/../"), "path").alias("path"), F.lit("first").alias("root"))
    b = n.select(F.concat(F.lit("y//./../"), "path").alias("path"), F.lit("second").alias("root"))
    return sets.once_by_path([a, b], "path").select("canonical", "root")


def s_snapshot_history(spark, sf_dir):
    """The snapshots of every principle code, as a sorted history with one more."""
    p = table(spark, sf_dir, "principles").where("principle_code is not null")
    g = p.groupBy(F.upper(F.trim("principle_code")).alias("code")).agg(F.collect_set("snapshot_id").alias("held"), F.max("snapshot_id").alias("last"))
    return g.select("code", F.array_join(sets.history_with(F.col("held"), F.concat("last", F.lit("-next"))), " ").alias("history"))


SQL = {
    "f_encoded": "select distinct on (entry_id) entry_id, url_encode(title) as encoded from notes_search",
    "f_globs": "with p as (select distinct path from notes where path is not null) select path, regexp_matches(path, '(^|/).*\\.md$') as md, regexp_matches(path, '(^|/)notes(/|$)') as folder, regexp_matches(path, '(^|/)a.*$') as start, regexp_matches(path, '(^|/)readme\\.md$') as exact from p",
    "s_newest_release": "select 'v' || o_orderkey % 23 || '.' || o_custkey % 19 || '.' || o_orderkey % 17 as newest from orders where o_orderstatus <> 'P' order by o_orderkey % 23 desc, o_custkey % 19 desc, o_orderkey % 17 desc limit 1",
    "s_top_folders": "with p as (select path from notes union all select file_path from packet_files) select distinct string_split(path, '/')[1] as folder from p where contains(path, '/')",
    "s_first_hit": """with a as (select upper(trim(principle_code)) code, min(record_id) r from principles where principle_code is not null group by 1), b as (select upper(trim(principle_code)) code, min(packet_id) r from packets where principle_code is not null group by 1)
      select coalesce(a.code, b.code) as code, coalesce(a.r, b.r) as record from a full join b on a.code = b.code""",
    "s_overlaid": "select c_custkey, c_nationkey::varchar as nation, c_mktsegment as segment, c_name as name, 3 as n from customer",
    "s_json_lines": """with p as (select distinct on (packet_id) 'log' || packet_id % 97 path, payload from packet_files) select path, count(*) as records from p where trim(payload) <> '' group by 1 having bool_and(coalesce(json_valid(payload), false))""",
    "s_web_results": "select p_partkey as page, 0 as pos, 'https://a.org/' || p_partkey as url, 'One ' || p_name as title from part union all select p_partkey, 1, 'https://b.org/' || p_partkey, 'Two' from part",
    "s_images": "select p_partkey as page, 'https://x.gstatic.com/i' || p_partkey as src, 'A ' || p_name as alt from part",
    "d14_headers": "with h as (select l_orderkey, l_linenumber, l_partkey::int a, case when l_linenumber % 3 = 0 then 1 else l_linenumber - 1 end::int c from lineitem) select l_orderkey, l_linenumber, a as new_start, c as new_count, greatest(a, a + c - 1) as new_end from h",
    "d12_tagged": """with p as (select regexp_replace(path, '[^/]+$', '.env') path, 'notes' tag from notes where path is not null union select regexp_replace(file_path, '[^/]+$', '.env'), 'files' from packet_files)
      select path, string_agg(tag, '+' order by tag) as tags from p group by 1""",
    "s_canonical": "with n as (select path, min(note_id) i from notes where path is not null group by 1) select path as canonical, case when i % 2 = 0 then 'first' else 'second' end as root from n",
    "s_snapshot_history": """with p as (select upper(trim(principle_code)) code, snapshot_id s from principles where principle_code is not null and snapshot_id is not null), q as (select code, s from p union select code, max(s) || '-next' from p group by 1)
      select code, string_agg(s, ' ' order by s) as history from q group by 1""",
}
QUERIES = {f.__name__: f for f in (f_encoded, f_globs, s_newest_release, s_top_folders, s_first_hit, s_overlaid, s_json_lines, s_web_results, s_images, d14_headers, d12_tagged, s_canonical, s_snapshot_history)}
