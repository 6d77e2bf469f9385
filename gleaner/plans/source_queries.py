"""Queries over raw files and markup, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.text import slug
from gleaner.operators import secrets
from gleaner.runtime import table
from gleaner.sources import files, notes, web


def s_packet_checks(spark, sf_dir):
    return files.packet_checks(table(spark, sf_dir, "packet_files"), "packet_id", "payload")


def s_page_text(spark, sf_dir):
    """The text of every note read as a page's source."""
    n = table(spark, sf_dir, "notes").dropDuplicates(["note_id"]).where("text is not null")
    return n.select("note_id", F.length(web.page_text("text")).alias("chars"), F.md5(web.page_text("text")).alias("md5"), slug("title").alias("slug"))


def s_index_weights(spark, sf_dir):
    """The weights of the old index, read leniently."""
    f = notes.lenient(table(spark, sf_dir, "index_files").select("filename", "top_terms", "norm_vec"))
    return f.select("filename", F.explode("norm_vec").alias("term", "weight"))


def s_transcripts(spark, sf_dir):
    """All documents cleaned as transcripts: what is left of each, white space aside."""
    lines = secrets.text_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), "id", "text")
    bare = F.regexp_replace("text", "[ \\n]", "")
    return web.clean_transcript(lines, "path", "line_no", "line").select("path", F.length(bare).alias("letters"), F.md5(bare).alias("md5"))


def s_languages(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select("path").union(table(spark, sf_dir, "packet_files").select("file_path"))
    return files.language_counts(paths.unionByName(paths.select(F.regexp_replace("path", "md$", "py").alias("path"))), "path")


def s_monthly_counts(spark, sf_dir):
    """Events of each user and month."""
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


_KEYS = ", ".join(f"'{k}'" for k in files.FORBIDDEN_KEYS)
SQL = {
    "s_packet_checks": f"""select packet_id as id, bool_or(coalesce(json_valid(payload), false)) as readable,
      bool_or(coalesce(json_valid(payload) and list_has_any(json_keys(case when json_valid(payload) then payload end), [{_KEYS}]), false)) as forbidden,
      bool_or(coalesce(regexp_matches(payload, '{files.PRIVATE_TEXT}'), false)) as private from packet_files group by 1""",
    "s_page_text": r"""with n as (select note_id, any_value(text) t, any_value(title) ti from notes where text is not null group by 1),
      p as (select note_id, ti, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) x from n)
      select note_id, length(x)::int as chars, md5(x) as md5, regexp_replace(regexp_replace(lower(ti), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from p""",
    "s_transcripts": r"""with a as (select doc_id::varchar path, string_split_regex(regexp_replace(text, '\r?\n\z', ''), '\r?\n') ls from documents where text is not null and text <> ''),
      l as (select path, unnest(ls) line, generate_subscripts(ls, 1) n from a),
      k as (select path, n, trim(replace(replace(replace(replace(regexp_replace(line, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')) t from l
            where not regexp_matches(line, '^(WEBVTT|Kind:|Language:|NOTE)|^\d{2}:\d{2}:\d{2}\.\d+ -->')),
      f as (select *, lag(t) over (partition by path order by n) b from k where t <> ''),
      j as (select path, regexp_replace(string_agg(t, ' ' order by n), '\s+', ' ', 'g') x from f where b is null or b <> t group by 1),
      s as (select path, x, regexp_extract_all(x, '[^.!?]*[.!?](?:[^.!?\s''"][^.!?]*[.!?])*[''"]?(?:\s|$)') p from j)
      select path, length(replace(replace(x, ' ', ''), chr(10), ''))::int as letters, md5(replace(replace(x, ' ', ''), chr(10), '')) as md5 from s""",
    "s_index_weights": "with u as (select filename, unnest(map_keys(norm_vec)) as term, unnest(map_values(norm_vec)) as weight from index_files where norm_vec is not null) select * from u where weight is not null",
    "s_languages": f"""with p as (select path from documents union all select file_path from packet_files), q as (select path from p union all select regexp_replace(path, 'md$', 'py') from p),
      m as (select lower(regexp_extract(path, '\\.([^./]+)$', 1)) e from q)
      select case e {" ".join(f"when '{k}' then '{v}'" for k, v in files.LANGUAGES.items())} end as language, count(*) as n from m group by 1 having language is not null""",
    "s_monthly_counts": "select user_id, strftime(ts, '%Y-%m') as month, count(*) as n from events where user_id is not null and ts is not null group by 1, 2",
}
QUERIES = {f.__name__: f for f in (s_packet_checks, s_page_text, s_index_weights, s_transcripts, s_languages, s_monthly_counts)}
