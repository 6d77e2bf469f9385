"""Text expressions: tokenizers, titles, snippets, counts and rounding, all as JVM expressions."""

from __future__ import annotations

import decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Stop words of the corpus index.
STOPWORDS = (
    "a about above after again all also am an and any are as at be because been before being between both but by can could did do does doing down "
    "during each few for from further get got had has have having he her here him his how if in into is it its itself just let me more most must my "
    "new no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they "
    "this those through to too under until up use used using very via was we were what when where which while who will with would you your"
).split()
#: Stop words of the site index.
SITE_STOPWORDS = (
    "a about after all also an and any are as at be because been before being between both but by can could did do does doing down during each few for "
    "from further get got had has have having how if in into is it its itself just like may more most must need no nor not now of off on once only or "
    "other our out over own same should so some such than that the their them then there these they this those through to too under until up use used "
    "using very via was we were what when where which while who will with would you your"
).split()
#: What is cut out of a text before it is split into index tokens, in this order.
CLEANERS = (r"(?s)```.*?```", r"`[^`\n]+`", r"https?://\S+", r"[#*_\[\]()>|~^=+]", r"\b\d+\b")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doc_tokens(text: Column | str) -> Column:
    """Tokens of the corpus index: code, URLs, marks and numbers cut out, runs of a-z of three or more, no stop words."""
    c = _col(text)
    for pattern in CLEANERS:
        c = F.regexp_replace(c, pattern, " ")
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(F.lower(c), "[^a-z]+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def light_tokens(text: Column | str) -> Column:
    """The lighter split of queries: runs of a-z of two or more, no stop words."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(F.lower(_col(text)), "[^a-z]+"), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def query_terms(text: Column | str) -> Column:
    """Index tokens of a query followed by its light tokens, each once."""
    return F.array_distinct(F.concat(doc_tokens(text), light_tokens(text)))


def keyword_tokens(text: Column | str) -> Column:
    """Tokens of a keyword query: lower case, split outside a-z 0-9 _ . -, of two or more; repeated ones stay."""
    return F.filter(F.split(F.lower(_col(text)), r"[^a-z0-9_.\-]+"), lambda t: F.length(t) >= 2)


def site_tokens(text: Column | str) -> Column:
    stop = F.array(*map(F.lit, SITE_STOPWORDS))
    return F.filter(F.split(F.lower(_col(text)), "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def browser_tokens(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(_col(text)), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def markdown_title(text: Column | str, fallback: Column | str) -> Column:
    """Text of the first line that begins with ``# `` and says something, else the fallback."""
    found = F.trim(F.regexp_extract(_col(text), r"(?m)^# +(\S[^\r\n]*)", 1))
    return F.coalesce(F.when(found != "", found), _col(fallback))


def count_of(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text``, without overlaps; an empty part counts as none."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("long")


def strip_markdown(text: Column | str) -> Column:
    """Plain text of a Markdown page: thirteen ordered rewrites, white space collapsed. The patterns."""
    c = _col(text)
    for pattern, to in (
        (r"(?s)```.*?```", " "), (r"`([^`]+)`", " $1 "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", " $1 "), (r"(?m)^>\s?", ""),
        (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"\|", " "), (r"<[^>]+>", " "), (r"[~*_]", " "), (r"\r", ""), (r"\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def headings(text: Column | str, most: int = 8) -> Column:
    """Second to fourth level headings in order, at most ``most``, without emphasis marks."""
    found = F.regexp_extract_all(_col(text), F.lit(r"(?m)^#{2,4}[ \t]+([^\r\n]+)"), F.lit(1))
    return F.slice(F.transform(found, lambda h: F.trim(F.regexp_replace(h, r"[*_`]", ""))), 1, most)


def paragraphs(text: Column | str, least: int = 48) -> Column:
    """Plain paragraphs of at least ``least`` characters."""
    blocks = F.split(F.regexp_replace(_col(text), r"(?s)```.*?```", "\n\n"), r"\n\s*\n")
    return F.filter(F.transform(blocks, strip_markdown), lambda b: F.length(b) >= least)


def shortened(text: Column | str, most: int) -> Column:
    """The text, cut at the last blank within ``most`` characters and marked with dots if it is longer."""
    c = _col(text)
    head = F.substring(c, 1, most)
    last = F.length(head) - F.coalesce(F.nullif(F.locate(" ", F.reverse(head)), F.lit(0)), F.lit(0))
    cut = F.when(F.locate(" ", head) > 1, F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.trim(cut), F.lit("...")))


def snippet(text: Column | str, terms: Column | str, before: int = 80, after: int = 180, most: int = 220) -> Column:
    """The stretch around the earliest of the terms; without a hit the beginning of the text; a fixed text for empty ones."""
    compact = F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\s+", " "))
    low = F.lower(compact)
    first = F.array_min(F.filter(F.transform(_col(terms), lambda t: F.instr(low, t)), lambda i: i > 0)) - 1
    start, end = F.greatest(first - before, F.lit(0)), F.least(first + after, F.length(compact))
    middle = F.trim(F.substring(compact, start + 1, end - start))
    around = F.concat(F.when(start > 0, "...").otherwise(""), middle, F.when(end < F.length(compact), "...").otherwise(""))
    return F.when(compact == "", "No extractable text.").when(first.isNull(), summarised(compact, most)).otherwise(around)


def summarised(text: Column | str, most: int) -> Column:
    """The text up to the last paragraph or sentence end beyond 60 % of ``most`` bytes, else cut hard; dots mark the cut."""
    c = _col(text)
    head = F.substring(c, 1, most)
    last = lambda mark: F.when(F.locate(mark, head) > 0, F.length(head) - F.locate(mark[::-1], F.reverse(head)) - len(mark) + 1).otherwise(-1)
    at = F.greatest(last("\n\n"), last(". "))
    # the break counts in bytes, as the limit does not: a text of other than ASCII letters breaks a little later
    bytes_at = F.octet_length(F.substring(head, F.lit(1), F.greatest(at, F.lit(0))))
    cut = F.when((at >= 0) & (bytes_at > int(most * 0.6)), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.trim(cut), F.lit("...")))


def round_to(x: Column | str, places: int) -> Column:
    """floor(x * 10^p + 0.5) / 10^p, which is not the rounding of ``round``."""
    k = float(10**places)
    return F.floor(_col(x) * k + 0.5) / k


def to_fixed(value: float, places: int) -> str:
    """The number's exact binary value, rounded half up, with ``places`` decimals."""
    return str(decimal.Decimal(value).quantize(decimal.Decimal(1).scaleb(-places), decimal.ROUND_HALF_UP))


def parsed_int(text: Column | str, low: int, high: int, default: int) -> Column:
    """The integer a text begins with, kept within bounds; the default where there is none."""
    digits = F.regexp_extract(_col(text), r"^\s*([+-]?\d{1,18})", 1)
    return F.least(F.greatest(F.coalesce(F.when(digits != "", digits).cast("long"), F.lit(default)), F.lit(low)), F.lit(high))


def version_key(text: Column | str) -> Column:
    """A version as integers, so that versions compare component by component."""
    return F.transform(F.split(F.regexp_replace(_col(text), "^v", ""), r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d{1,9})", 1), F.lit("")).cast("int"), F.lit(0)))


def percent_encoded(text: Column | str) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(_col(text)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ``*`` is any run, a trailing ``/`` means a folder; it matches whole path ends."""
    import re

    body = "".join(".*" if ch == "*" else re.escape(ch) for ch in glob.rstrip("/"))
    return f"(^|/){body}" + ("(/|$)" if glob.endswith("/") else "$")


#: Labels of categories that are no plain words, and tags that are written in capitals.
CATEGORY_LABELS = {
    "ai": "AI", "api": "API", "auth": "Auth", "ci": "CI", "cli": "CLI", "css": "CSS", "ddd": "DDD", "genai": "GenAI", "ide": "IDE", "iot": "IoT", "lsp": "LSP", "ml": "ML",
    "os": "OS", "sre": "SRE", "svg": "SVG", "web3": "Web3",
}
ACRONYMS = (
    "cs rdf sha api cli ui ux os ai ml sql http css js ts dfs bfs mst dag cfg scc neo4j vpc dns tls ssh jwt rbac cicd cdn yaml json xml html wasm grpc"
).split()
#: File endings of languages, and languages of endings.
EXTENSIONS = {
    "python": ".py", "javascript": ".js", "js": ".js", "typescript": ".ts", "ts": ".ts", "java": ".java", "c": ".c", "cpp": ".cpp", "c++": ".cpp", "csharp": ".cs", "c#": ".cs",
    "go": ".go", "rust": ".rs", "sql": ".sql", "bash": ".sh", "shell": ".sh", "sh": ".sh",
}
GUESSED = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".c": "c", ".cpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".sql": "sql", ".sh": "bash",
    ".json": "javascript", ".md": "text", ".txt": "text",
}


def _looked_up(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def title_case(slug_text: Column | str) -> Column:
    """Words of a slug with capitals, known labels as they are written; null gives an empty text."""
    low = F.lower(F.coalesce(_col(slug_text), F.lit("")))
    words = F.filter(F.split(low, "[-_]"), lambda w: w != "")
    return F.coalesce(_looked_up(CATEGORY_LABELS, low), F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " "))


def category(path: Column | str) -> Column:
    """The label of what a Markdown file's name begins with, up to the first dash."""
    stem = F.regexp_replace(basename(path), r"\.md$", "")
    first = F.split_part(stem, F.lit("-"), F.lit(1))
    return title_case(F.when(first == "", "notes").otherwise(first))


def pill_label(tag: Column | str) -> Column:
    """A tag as it is shown: known acronyms in capitals, else every run of letters, digits and ``_`` with a capital."""
    low = F.lower(_col(tag))
    # cut before each run, so that every piece begins with one
    pieces = F.split(low, r"(?<![a-z0-9_])(?=[a-z0-9_])")
    shown = F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")
    return F.when(low.isin(*ACRONYMS), F.upper(low)).otherwise(shown)


def valid_tags(tags: Column | str) -> Column:
    """Tags that are not empty, hold no slash, begin with no date and have at most 40 characters."""
    return F.filter(_col(tags), lambda t: t.isNotNull() & (t != "") & ~F.contains(t, F.lit("/")) & ~t.rlike(r"^\d{4}-\d{2}-\d{2}") & (F.length(t) <= 40))


def result_path(path: Column | str, title: Column | str, scope: Column | str) -> Column:
    """Scope and file name of a result; what follows a spaced dash or dot in the name is left out."""
    raw = F.trim(F.coalesce(_col(path), F.lit("")))
    base = F.when(raw == "", F.coalesce(_col(title), F.lit("Note"))).otherwise(F.when(basename(raw) == "", raw).otherwise(basename(raw)))
    return F.concat(F.coalesce(_col(scope), F.lit("Knowledge")), F.lit(" · "), F.trim(F.regexp_replace(base, r"\s+[·—–]\s+.*$", "")))


def escaped_html(text: Column | str) -> Column:
    c = _col(text)
    for mark, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(to))
    return c


def escaped_regex(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def highlighted(text: Column | str, terms: Column | str) -> Column:
    """The text as HTML with every whole-word hit of a term in ``<mark>``, case aside; without terms only escaped."""
    t = F.filter(_col(terms), lambda x: x.isNotNull() & (x != ""))
    rx = F.concat(F.lit(r"(?i)\b("), F.array_join(F.transform(t, escaped_regex), "|"), F.lit(r")\b"))
    return F.when(F.coalesce(F.size(t), F.lit(0)) > 0, F.regexp_replace(escaped_html(text), rx, F.lit("<mark>$1</mark>"))).otherwise(escaped_html(text))


def browser_snippet(text: Column | str, title: Column | str, preview: Column | str, terms: Column | str) -> Column:
    """260 characters from 90 before the first term that occurs, cut at a blank; rules and the repeated title go first.

    Word clouds (ten words and more with fewer than one sentence mark to four words, and no table) and texts with two or
    more O(...) give the preview instead, else the first sentence, else (for the latter) nothing.
    """
    c = F.coalesce(F.nullif(_col(text), F.lit("")), F.lit(""))
    for rx, to in ((r"(?:^|\n)\s*[-=]{3,}\s*(?=\n|$)", " "), (r"(?:^|\n)\s*[|\-: ]+\s*(?=\n|$)", " "), ("-{3,}", " "), (r"\s{2,}", " ")):
        c = F.regexp_replace(c, rx, to)
    c = F.regexp_replace(F.trim(c), r"^#+\s*", "")
    # the title is skipped word by word, so that its punctuation may differ
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(_col(title), F.lit(""))), "&amp;", "&"), r"[^\w]+"), lambda w: w != "")
    lead = F.when(F.size(words) > 0, F.concat(F.lit(r"(?i)^\W*"), F.array_join(words, r"\W+"), F.lit(r"(?!\w)[\s,.:;\-]*"))).otherwise(F.lit("^(?!)"))
    bare = lambda t: F.regexp_replace(t, lead, F.lit(""))
    hay = bare(c)
    low = F.lower(hay)
    hits = F.filter(F.transform(_col(terms), lambda t: F.instr(low, t)), lambda i: i > 0)
    start = F.greatest(F.coalesce(F.try_element_at(hits, F.lit(1)) - 91, F.lit(0)), F.lit(0))
    end = F.least(F.length(hay), start + 260)
    middle = F.regexp_replace(F.trim(F.substring(hay, start + 1, end - start)), r"\s\S*$", "")
    shown = F.concat(F.when(start > 0, "…").otherwise(""), middle, F.when(end < F.length(hay), "…").otherwise(""))
    clean = F.trim(middle)
    n_words, marks = F.size(F.split(clean, r"\s+")), F.regexp_count(clean, F.lit("[.!?]"))
    cloud = (n_words >= 10) & (marks < n_words / 4) & (F.regexp_count(clean, F.lit(r"\|")) <= 2)
    orders = F.regexp_count(clean, F.lit(r"O\([^)]{1,20}\)")) >= 2
    other = bare(F.coalesce(_col(preview), F.lit("")))
    cut = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.substring(other, 1, 260)), "-{3,}", " "), r"\s{2,}", " "))
    instead = F.when((other != "") & (other != hay), F.when(F.length(cut) < F.length(other), F.concat(cut, F.lit("…"))).otherwise(cut))
    sentence = F.nullif(F.trim(F.regexp_extract(hay, r"[A-Z][^.!?]{15,}[.!?]", 0)), F.lit(""))
    return F.coalesce(F.when(cloud, F.coalesce(instead, sentence)), F.when(orders, F.coalesce(instead, sentence, F.lit(""))), shown)


def first_prose_line(text: Column | str) -> Column:
    """The first line of twelve bytes or more that is no heading, image or tag, quote marks left out; else null."""
    lines = F.transform(F.split(_col(text), r"\r?\n"), lambda x: F.trim(x))
    said = F.filter(lines, lambda t: (t != "") & ~F.substring(t, 1, 1).isin("#", "!", "<"))
    return F.try_element_at(F.filter(F.transform(said, lambda t: F.trim(F.regexp_replace(t, "^>+", ""))), lambda t: F.octet_length(t) >= 12), F.lit(1))


def frontmatter(text: Column | str, file_name: Column | str) -> Column:
    """STRUCT<name, description, user_invocable> of a file that begins with a block between ``---`` lines, else null."""
    c = _col(text)
    block = F.regexp_extract(c, r"(?s)\A---(.*?)\n---", 1)
    plain = lambda k: F.regexp_replace(F.trim(F.regexp_extract(block, rf"(?m)^{k}:\s*(.+)$", 1)), "^[\"']|[\"']$", "")
    has = lambda k: block.rlike(rf"(?m)^{k}:\s*(.+)$")
    name = F.when(has("name"), plain("name")).otherwise(F.replace(_col(file_name), F.lit(".agent.md"), F.lit("")))
    invocable = F.regexp_extract(block, r"(?m)^user-invocable:\s*(true|false)\s*", 1) != "false"
    return F.when(c.rlike(r"(?s)\A---.*?\n---"), F.struct(name.alias("name"), plain("description").alias("description"), invocable.alias("user_invocable")))


def recovered_json(text: Column | str) -> Column:
    """The JSON value in a chatty answer: thinking and fences go, else what stands from the first ``{`` to the last ``}``; else null."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(text), r"(?is)<think>.*?</think>", ""), r"\A```(?:json)?\s*", ""), r"```\s*\z", "")
    c = F.trim(c)
    inner = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(inner))


def extension_of(lang: Column | str) -> Column:
    return F.coalesce(_looked_up(EXTENSIONS, _col(lang)), F.lit(".txt"))


def guessed_language(name: Column | str) -> Column:
    """The language that a file's ending stands for; ``text`` for all others."""
    return F.coalesce(_looked_up(GUESSED, F.lower(F.regexp_extract(_col(name), r"(\.[^.]*)$", 1))), F.lit("text"))


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def statement_hash(statement: Column | str) -> Column:
    """SHA-256 of a statement whose runs of white space are one blank."""
    return F.sha2(F.trim(F.regexp_replace(_col(statement), r"(?U)\s+", " ")), 256)


def elapsed_label(seconds: Column | str) -> Column:
    """``7s``, ``3 min`` or ``3 min 7s``."""
    s = F.floor(_col(seconds) + 0.5).cast("long")
    m, rest = F.floor(s / 60), s % 60
    return F.when(s < 60, F.concat(s, F.lit("s"))).when(rest > 0, F.concat(m, F.lit(" min "), rest, F.lit("s"))).otherwise(F.concat(m, F.lit(" min")))


def ago_label(seconds: Column | str) -> Column:
    """``just now``, ``5 min ago`` or ``2 hr ago``."""
    s = F.floor(_col(seconds) + 0.5).cast("long")
    m = F.floor(s / 60)
    return F.when(s < 60, "just now").when(m < 60, F.concat(m, F.lit(" min ago"))).otherwise(F.concat(F.floor(m / 60), F.lit(" hr ago")))


def iso_time(at: Column | str) -> Column:
    return F.date_format(_col(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")


@F.pandas_udf(StringType())
def to_fixed_text(value: pd.Series, places: pd.Series) -> pd.Series:
    """``to_fixed`` over columns; nulls stay null. Exact decimals have no built-in expression."""
    return pd.Series([None if pd.isna(v) else to_fixed(float(v), int(p)) for v, p in zip(value, places)])
