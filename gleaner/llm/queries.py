"""The training-text queries, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import leakage, markup, mixing, problem_sql, problems, shared_spans, templates
from gleaner.runtime import stored, table


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes and the search entries in one layout: (tbl, row_id, host, text)."""
    notes = table(spark, sf_dir, "notes").select(F.lit("notes").alias("tbl"), F.col("note_id").alias("row_id"), F.col("origin").alias("host"), "text")
    entries = table(spark, sf_dir, "notes_search").select(F.lit("notes_search").alias("tbl"), F.col("entry_id").alias("row_id"), F.col("scope_key").alias("host"), F.col("summary").alias("text"))
    return notes.unionByName(entries)


def without_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id, text, cuts): every record once, with the stretches of it that are templates of its origin.

    The redelivered rows of a record are one; should their texts differ, the greatest counts.
    """
    once = marked_up(spark, sf_dir).groupBy("tbl", "row_id").agg(F.max("host").alias("host"), F.max("text").alias("text"))
    keyed = once.withColumn("id", F.col("row_id") * 2 + F.when(F.col("tbl") == "notes", 0).otherwise(1)).withColumn("host", F.concat("tbl", F.lit("/"), F.coalesce(F.lower(F.trim("host")), F.lit(""))))
    keyed = stored(keyed, "marked-up")
    return keyed.join(templates.template_cuts(keyed, "id", "host", "text"), "id", "left").select("tbl", "row_id", "text", "cuts")


def _cleared(text: str | None, cuts) -> tuple[markup.Parsed, bool, int]:
    """What the scanner finds outside the templates, whether any markup was in them, and their number."""
    spans = [] if cuts is None or text is None else [(c["start"], c["end"]) for c in cuts]
    got = markup.parse(templates.cut(text, spans) if spans else text)
    return got, any(markup.parse(text[a:b]).other for a, b in spans), len(spans)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of every record. Templates are cut first; they hold none of the four kinds, and their own markup counts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for tbl, row_id, text, cuts in zip(pdf["tbl"], pdf["row_id"], pdf["text"], pdf["cuts"]):
                got, marked, _ = _cleared(text, cuts)
                for kind, n in got.counts.items():
                    rows.extend((tbl, row_id, kind, k) for k in range(1, n + 1))
                if got.other or marked:
                    rows.append((tbl, row_id, "other", 1))
            yield pd.DataFrame(rows, columns=["tbl", "row_id", "element", "pos"])

    return without_templates(spark, sf_dir).mapInPandas(scan, "tbl string, row_id long, element string, pos int")


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of every record, after parts that recur across the records of one origin are cut out."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tbl, row_id, text, cuts in zip(pdf["tbl"], pdf["row_id"], pdf["text"], pdf["cuts"]):
                got, _, n = _cleared(text, cuts)
                out.append((tbl, row_id, got.base, got.clean, n))
            yield pd.DataFrame(out, columns=["tbl", "row_id", "base", "clean", "template_parts"])

    return without_templates(spark, sf_dir).mapInPandas(scan, "tbl string, row_id long, base string, clean string, template_parts int")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with leaked spans cut out; those that leak by more than half are dropped (null text)."""
    found = stored(p6_leaks(spark, sf_dir), "leaks")
    out = leakage.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text", found)
    return out.select("doc_id", "removed_chars", "dropped", F.md5("text").alias("text_md5"))


def _mix(spark: SparkSession, sf_dir: str, total_share: float | None = None) -> tuple[DataFrame, DataFrame]:
    plan = table(spark, sf_dir, "mix_plan")
    names = plan.select(mixing.source_key("source_name").alias("k")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", mixing.source_key("source").alias("source"), "text")
    counted = stored(mixing.token_counts(docs.join(F.broadcast(names), docs.source == names.k, "left_semi"), "text"), "token-counts")
    total = None
    if total_share is not None:
        total = int((counted.agg(F.sum("tokens")).first()[0] or 0) * total_share)
    # sources that are used again and again come in late, the others early
    late = plan.select(mixing.source_key("source_name").alias("s"), "max_repeats").where("max_repeats > 1").collect()
    schedules = {r["s"]: mixing.ramp(0.5, 1.5) for r in late}
    early = [r["k"] for r in names.collect() if r["k"] is not None and r["k"] not in schedules]
    schedules |= {s: mixing.ramp(1.5, 0.5) for s in early}
    return mixing.mixture(counted, "doc_id", plan, total, schedules)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture that meets all shares, as an ordered list of documents."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source really got in that mixture."""
    return _mix(spark, sf_dir)[1]


def p7_budget_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture that is to be as long as all planned sources together, where small sources are repeated up to their cap."""
    return _mix(spark, sf_dir, 1.0)[0]


def p7_budget_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source really got when the mixture is to be as long as all planned sources together: small ones hit their cap."""
    return _mix(spark, sf_dir, 1.0)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.sharing_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = shared_spans.shared_parts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return parts.select("doc_id", "n_chars", "shared_chars", "kept_chars", F.to_json("removed").alias("removed"))


P6_FOUND = """
with i as (select item_id, any_value(regexp_extract_all(lower(passage), '[a-z0-9]+')) w from eval_items where passage is not null group by 1),
k as (select item_id, w, least(20, len(w)) n from i where len(w) > 0),
g as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') s from (select item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) p from k)),
d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents where text is not null),
h as (select doc_id, n, array_to_string(w[p:p + n - 1], ' ') s from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) p from d, (select distinct n from k) where len(w) >= n))
select distinct doc_id, item_id from h join g using (n, s)
"""

P6_CLEANED = """
with i as (select item_id, any_value(regexp_extract_all(lower(passage), '[a-z0-9]+')) w from eval_items where passage is not null group by 1),
k as (select item_id, w, least(20, len(w)) n from i where len(w) > 0),
g as (select distinct n, array_to_string(w[p:p + n - 1], ' ') s from (select item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) p from k)),
d as (select doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') w, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') ts from documents where text is not null),
h as (select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') s from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) p from d, (select distinct n from k) where len(w) >= n)),
c as (select distinct doc_id, p, p + n - 1 q from h join g using (n, s)),
t0 as (select doc_id, unnest(ts) t, generate_subscripts(ts, 1) pos from d where doc_id in (select doc_id from c)),
t as (select *, count(*) filter (where regexp_matches(t, '^[A-Za-z0-9]')) over (partition by doc_id order by pos) k, regexp_matches(t, '^[A-Za-z0-9]') word from t0),
o as (select t.doc_id, pos, any_value(t.t) t, bool_or(c.p is not null) gone from t left join c on c.doc_id = t.doc_id and t.k >= c.p and (t.k < c.q or (t.k = c.q and t.word)) group by 1, 2),
m as (select doc_id, coalesce(string_agg(t, '' order by pos) filter (where not gone), '') kept, coalesce(sum(length(t)) filter (where gone), 0)::int removed from o group by 1)
select d.doc_id, case when d.text is null then null else coalesce(m.removed, 0) end::int as removed_chars, coalesce(m.removed > 0.5 * length(d.text), false) as dropped,
  case when coalesce(m.removed > 0.5 * length(d.text), false) then null else md5(coalesce(m.kept, d.text)) end as text_md5
from documents d left join m on m.doc_id = d.doc_id
"""

P8_PARTS = """
with w as (select doc_id, i, md5(substring(text, i, 400)) h from (select doc_id, text, unnest(generate_series(1, length(text) - 399)) i from documents where length(text) >= 400)),
g as (select h, min(doc_id) lo, max(doc_id) hi from w group by h having min(doc_id) < max(doc_id)),
k as (select doc_id, i - 1 a, lo < doc_id late from w join g using (h)),
z as (select doc_id, 'all' kind, a from k union all select doc_id, 'late', a from k where late),
b as (select *, case when a <= lag(a) over (partition by doc_id, kind order by a) + 400 then 0 else 1 end fresh from z),
c as (select *, sum(fresh) over (partition by doc_id, kind order by a) grp from b),
r as (select doc_id, kind, grp, min(a) a, max(a) + 400 b from c group by 1, 2, 3),
s as (select doc_id, sum(b - a) filter (where kind = 'all') shared, sum(b - a) filter (where kind = 'late') gone, string_agg('{"start":' || a || ',"end":' || b || '}', ',' order by a) filter (where kind = 'late') js from r group by 1)
select d.doc_id, coalesce(length(d.text), 0)::int as n_chars, coalesce(shared, 0)::int as shared_chars, (coalesce(length(d.text), 0) - coalesce(gone, 0))::int as kept_chars, '[' || coalesce(js, '') || ']' as removed
from documents d left join s on s.doc_id = d.doc_id
"""

P8_FOUND = """
with w as (select distinct doc_id, md5(substring(text, i, 400)) h from (select doc_id, text, unnest(generate_series(1, length(text) - 399)) i from documents where length(text) >= 400)),
g as (select h from w group by h having count(*) > 1),
k as (select * from w where h in (select h from g))
select distinct a.doc_id as doc_a, b.doc_id as doc_b from k a join k b on a.h = b.h and a.doc_id < b.doc_id
"""

QUERIES = {**problems.QUERIES} | {f.__name__: f for f in (p1_found, p1_clean, p6_found, p6_cleaned, p7_mixture, p7_shares, p7_budget_mixture, p7_budget_shares, p8_found, p8_parts)}
SQL = {**problem_sql.SQL, "p6_found": P6_FOUND, "p6_cleaned": P6_CLEANED, "p8_found": P8_FOUND, "p8_parts": P8_PARTS}
