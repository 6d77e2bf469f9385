"""Queries of the corpus index over notes and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import STOPWORDS, markdown_title, snippet
from gleaner.operators import text_index
from gleaner.runtime import table


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "notes").select("filename", "path", "origin", "text").dropDuplicates(["filename"])
    return notes.withColumn("title", markdown_title("text", "filename"))


def _index(spark: SparkSession, sf_dir: str) -> text_index.Index:
    return text_index.build_index(_notes(spark, sf_dir), "filename", "text", "title")


def d1_term_frequencies(spark, sf_dir):
    return _index(spark, sf_dir).tf.select("doc", "term", "n", F.round("tf", 6).alias("tf"))


def d1_idf(spark, sf_dir):
    return _index(spark, sf_dir).idf.select("term", "df", F.round("idf", 6).alias("idf"))


def d1_vectors(spark, sf_dir):
    return _index(spark, sf_dir).vectors.select("doc", "term", "rank", F.round("weight", 6).alias("weight"))


def d1_index_files(spark, sf_dir):
    """The index as one row per note; maps come out as the count and sum of their weights, arrays joined."""
    f = text_index.index_files(_index(spark, sf_dir))
    total = F.aggregate(F.map_values("norm_vec"), F.lit(0.0), lambda a, x: a + x * x)
    return f.select("doc", "title", F.array_join("top_terms", " ").alias("top_terms"), F.size("norm_vec").alias("terms"), F.round(total, 6).alias("norm"))


def d1_posting_sizes(spark, sf_dir):
    return text_index.postings(_index(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("files"), F.min("doc").alias("first_file"))


def d2_related(spark, sf_dir):
    """The five nearest documents of every document whose id is divisible by 100, against all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("").alias("title"))
    index = text_index.build_index(docs, "doc_id", "text", "title")
    return text_index.related(index, F.col("doc") % 100 == 0)


def _queries(spark, sf_dir):
    """Every evaluation passage, whole."""
    return table(spark, sf_dir, "eval_items").select("item_id", F.col("passage").alias("words"))


def d3_search(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    build = lambda df: text_index.build_index(df, "filename", "text", "title")
    local, community = build(notes.where("origin = 'repo'")), build(notes)
    return text_index.search([("local", local), ("community", community)], _queries(spark, sf_dir), "item_id", "words")


def d4_keyword(spark, sf_dir):
    return text_index.keyword_search(_notes(spark, sf_dir), "filename", "path", "title", "text", _queries(spark, sf_dir), "item_id", "words")


def d4_snippets(spark, sf_dir):
    """A snippet of every note around the first of three words."""
    return _notes(spark, sf_dir).select("filename", snippet("text", F.array(F.lit("retries"), F.lit("pipeline"), F.lit("bounds"))).alias("snippet"))


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _cleaned(col: str) -> str:
    """Raw text with code, URLs, marks and numbers cut out."""
    c = f"regexp_replace({col}, '(?s)```.*?```', ' ', 'g')"
    for p in (r"`[^`\n]+`", r"https?://\S+", r"[#*_\[\]()>|~^=+]", r"\b\d+\b"):
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    return c


def _tokens(col: str) -> str:
    return f"list_filter(regexp_extract_all(lower({_cleaned(col)}), '[a-z]+'), lambda t: length(t) >= 3 and t not in ({_STOP}))"


_NOTES = r"""
notes1 as (select filename doc, any_value(path) path, any_value(origin) origin, any_value(text) txt from notes group by 1),
titled as (select *, coalesce(nullif(trim(regexp_extract(txt, '(?m)^# +(\S[^\r\n]*)', 1)), ''), doc) title from notes1)
"""


def _vectors(source: str, p: str = "") -> str:
    return f"""
{p}tok as (select doc, unnest({_tokens("coalesce(txt, '')")}) term from {source}),
{p}cnt as (select doc, term, count(*) n from {p}tok group by 1, 2),
{p}tf as (select doc, term, n, n / sum(n) over (partition by doc) tf from {p}cnt),
{p}idf as (select term, count(*) df, ln(((select count(*) from {source}) + 1) / (count(*) + 1)) + 1 idf from {p}tf group by 1),
{p}w as (select doc, term, tf * idf w, row_number() over (partition by doc order by tf * idf desc, term) rank from {p}tf join {p}idf using (term)),
{p}vec as (select doc, term, rank, w / sqrt(sum(w * w) over (partition by doc)) weight from {p}w where rank <= 120)
"""


_IDX = "with " + _NOTES + "," + _vectors("titled")
_DOCS = "with docs1 as (select doc_id doc, text txt from documents)," + _vectors("docs1")
_ASK = "ask0 as (select item_id, any_value(passage) words from eval_items group by 1)"

SQL = {
    "d1_term_frequencies": _IDX + "select doc, term, n, round(tf, 6) tf from tf",
    "d1_idf": _IDX + "select term, df, round(idf, 6) idf from idf",
    "d1_vectors": _IDX + "select doc, term, rank, round(weight, 6) weight from vec",
    "d1_index_files": _IDX + """select doc, title, t as top_terms, coalesce(n, -1)::int as terms, round(s, 6) as norm from titled
      left join (select doc, string_agg(term, ' ' order by rank) filter (where rank <= 15) t, count(*) n, sum(weight * weight) s from vec group by 1) using (doc)""",
    "d1_posting_sizes": _IDX + "select term, count(*) files, min(doc) first_file from vec group by 1",
    "d2_related": _DOCS + """, s as (select a.doc, b.doc other, round(sum(a.weight * b.weight), 6) similarity from vec a join vec b on a.term = b.term and a.doc <> b.doc where a.doc % 100 = 0 group by 1, 2)
      select doc, rank, other, similarity from (select *, row_number() over (partition by doc order by similarity desc, other) rank from s where similarity > 0.03) where rank <= 5""",
    "d3_search": "with " + _NOTES + ", loc as (select * from titled where origin = 'repo')," + _vectors("loc", "l_") + "," + _vectors("titled", "c_") + "," + _ASK + f""",
      ask as (select distinct item_id, unnest(list_concat({_tokens("words")}, list_filter(regexp_extract_all(lower(words), '[a-z]+'), lambda t: length(t) >= 2 and t not in ({_STOP})))) q from ask0),
      vecs as (select doc, term, weight, 0 pr, 'local' source from l_vec union all select doc, term, weight, 1, 'community' from c_vec),
      reach as (select item_id, term, bool_or(term = q or (length(q) >= 3 and starts_with(term, q)) or (length(q) >= 5 and contains(term, q))) narrow
                from ask join (select distinct term from vecs) on contains(term, q) group by 1, 2),
      reach2 as (select item_id, term from (select *, bool_or(narrow) over (partition by item_id) anyn from reach) where narrow or not anyn),
      cand as (select item_id, doc, min(pr) pr from reach2 join vecs using (term) group by 1, 2),
      sc as (select c.item_id, c.doc, c.pr,
                    (coalesce((select sum(weight) from vecs v where v.doc = c.doc and v.pr = c.pr and v.term in (select q from ask a where a.item_id = c.item_id)), 0)
                     + 0.4 * (select count(*) from ask a where a.item_id = c.item_id and contains(lower(t.title), a.q))) * case when c.pr = 0 then 1.15 else 1 end s
             from cand c join titled t on t.doc = c.doc),
      r as (select *, row_number() over (partition by item_id order by round(s, 9) desc, pr, doc) rank, count(*) over (partition by item_id) total from sc where round(s, 9) > 0)
      select item_id as query, rank, doc, case when pr = 0 then 'local' else 'community' end as source, floor(round(s, 9) * 1000 + 0.5) / 1000 as score, total from r where rank <= 5""",
    "d4_snippets": r"""with n as (select filename, trim(regexp_replace(coalesce(any_value(text), ''), '\s+', ' ', 'g')) t from notes group by 1),
      h as (select filename, t, least(nullif(instr(lower(t), 'retries'), 0), nullif(instr(lower(t), 'pipeline'), 0), nullif(instr(lower(t), 'bounds'), 0)) - 1 p from n),
      k as (select *, greatest(p - 80, 0) a, least(p + 180, length(t)) b, t[1:220] head from h),
      c as (select *, length(head) - coalesce(nullif(instr(reverse(head), ' .'), 0), 1000000) - 1 cut from k)
      select filename, case when t = '' then 'No extractable text.' when p is null then case when length(t) <= 220 then t when cut >= 0 and strlen(head[1:cut]) > 132 then trim(head[1:cut]) || '...' else trim(head) || '...' end
        else case when a > 0 then '...' else '' end || trim(t[a + 1:b]) || case when b < length(t) then '...' else '' end end as snippet from c""",
    "d4_keyword": "with " + _NOTES + "," + _ASK + r""",
      ask as (select item_id, unnest(list_filter(string_split_regex(lower(words), '[^a-z0-9_.\-]+'), lambda t: length(t) >= 2)) q from ask0),
      low as (select doc, lower(coalesce(path, '')) p, lower(title) t, lower(coalesce(txt, '')) b from titled),
      s as (select item_id, doc, any_value(p) p, sum(10 * (length(t) - length(replace(t, q, ''))) // length(q) + 6 * (length(p) - length(replace(p, q, ''))) // length(q) + 2 * ((length(b) - length(replace(b, q, ''))) // length(q)))::bigint score from ask, low group by 1, 2)
      select item_id as query, rank, doc, score from (select *, row_number() over (partition by item_id order by score desc, p, doc) rank from s where score > 0) where rank <= 5""",
}

QUERIES = {f.__name__: f for f in (d1_term_frequencies, d1_idf, d1_vectors, d1_index_files, d1_posting_sizes, d2_related, d3_search, d4_keyword, d4_snippets)}
