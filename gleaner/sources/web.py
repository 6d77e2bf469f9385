"""Web pages and transcripts: search addresses, results in a page's source, page text, clean transcripts."""

from __future__ import annotations

import urllib.parse

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search_url(query: str, site: str = "", exact: str = "", exclude: str = "", file_type: str = "", language: str = "", time_range: str = "") -> str:
    """The address of a web search with its filters."""
    parts = [query.strip()]
    if exact:
        parts.append(f'"{exact}"')
    parts += [f"-{w}" for w in exclude.split()]
    if site:
        parts.append(f"site:{site}")
    if file_type:
        parts.append(f"filetype:{file_type}")
    url = "https://www.google.com/search?q=" + urllib.parse.quote(" ".join(parts), safe="-_.~")
    if language:
        url += f"&lr=lang_{language}"
    span = {"day": "d", "week": "w", "month": "m", "year": "y"}.get(time_range)
    return url + (f"&tbs=qdr:{span}" if span else "")


def result_links(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, pos, url, title): anchors that hold a third level heading, redirects unwrapped, each address once.

    Only http addresses of other hosts than the search engine's count. Null pages have no result.
    """
    rx = r'(?is)<a\b[^>]*?href="([^"]+)"[^>]*>(?:(?!</a>).)*?<h3\b[^>]*>(.*?)</h3>'
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(rx), F.lit(1)).alias("u"), F.regexp_extract_all(html, F.lit(rx), F.lit(2)).alias("t"))
    found = pages.where(F.col(html).isNotNull()).select(F.col(page).alias("page"), F.posexplode(both).alias("pos", "x"))
    raw = F.replace(F.col("x.u"), F.lit("&amp;"), F.lit("&"))
    url = F.when(raw.startswith("/url?"), F.try_url_decode(F.regexp_extract(raw, r"[?&]q=([^&]+)", 1))).otherwise(raw)
    kept = found.select("page", "pos", url.alias("url"), F.trim(F.regexp_replace("x.t", "<[^>]+>", "")).alias("title")).where(F.col("url").rlike("^https?://") & ~F.col("url").rlike(r"^https?://([^/]*\.)?google\.com(/|$)"))
    return kept.groupBy("page", "url").agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"))


def image_links(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, src, alt): thumbnails with a description of three or more characters, each source once."""
    tags = pages.where(F.col(html).isNotNull()).select(F.col(page).alias("page"), F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))).alias("tag"))
    attr = lambda n: F.regexp_extract("tag", rf'(?i)\b{n}="([^"]*)"', 1)
    return tags.select("page", attr("src").alias("src"), attr("alt").alias("alt")).where(F.contains("src", F.lit("gstatic")) & (F.length("alt") >= 3)).groupBy("page", "src").agg(F.min("alt").alias("alt"))


def page_text(html: Column | str) -> Column:
    """The text of a page's source: scripts, styles, comments and tags gone, white space collapsed."""
    c = F.col(html) if isinstance(html, str) else html
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def page_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def clean_transcript(lines: DataFrame, path: str, line_no: str, line: str) -> DataFrame:
    """(path, text): caption files as paragraphs of four sentences.

    Headers, times, tags and entities go; a line equal to the kept line before it goes. A transcript is one row of the
    result, so its lines are gathered; files are independent of one another.
    """
    t = F.col(line)
    header = t.rlike(r"^(WEBVTT|Kind:|Language:|NOTE)|^\d{2}:\d{2}:\d{2}\.\d+ -->")
    c = F.regexp_replace(t, "<[^>]+>", "")
    for entity, to in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(entity), F.lit(to))
    kept = lines.where(t.isNotNull() & ~header).select(F.col(path).alias("path"), F.col(line_no).alias("n"), F.trim(c).alias("t")).where("t <> ''")
    w = Window.partitionBy("path").orderBy("n")
    fresh = kept.withColumn("before", F.lag("t").over(w)).where("before is null or before <> t")
    text = fresh.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), " ").alias("text"))
    four = r"((?:[^.!?]*(?:[.!?](?!['\"]?(?:\s|$))[^.!?]*)*[.!?]['\"]?(?:\s|$)){4})"
    return text.select("path", F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\s+", " "), four, "$1\n\n"), r" *\n\n *", "\n\n")).alias("text"))
