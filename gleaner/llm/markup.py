"""Markup residue: one scanner for HTML, Markdown, wiki and LaTeX that lists a text's elements and writes it clean.

A text is cut in three passes. First everything opaque is lifted out, whichever comes first in the text: code blocks,
formulas, comments, scripts, templates and inline code. What stands inside such a piece counts for nothing else. Then
lines are classified (headings, list items, tables, quotes, rules). Last, the inline marks of what is left are found and
removed. The base markup, told from the opaque-free text, decides between readings: ``#`` lines are list items where
headings are written ``== so ==``, doubled quotes are emphasis in wiki text and quotation marks in LaTeX.
"""

from __future__ import annotations

import html
import re

KINDS = ("heading", "list_item", "code_block", "formula")

#: HTML tags that are markup; any other word in angle brackets is plain text, such as a generic type.
TAGS = (
    "a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup dd del details "
    "dfn div dl dt em embed fieldset figcaption figure font footer form frame head header hr html i iframe img input ins kbd label legend link main "
    "map mark meta nav nobr nowiki object ol option p param picture pre q ref s samp section select small source span strike strong sub summary sup "
    "table tbody td textarea tfoot th thead time title tr tt u ul var video wbr references gallery h1 h2 h3 h4 h5 h6 li math script style syntaxhighlight"
).split()
#: Environments by what they hold; every other environment is other markup.
CODE_ENVIRONMENTS = "verbatim|lstlisting|minted|Verbatim|alltt"
MATH_ENVIRONMENTS = "equation|align|gather|multline|displaymath|math|eqnarray|flalign|alignat"
LIST_ENVIRONMENTS = "itemize|enumerate|description"
SECTIONS = "part|chapter|section|subsection|subsubsection|paragraph"

_NAME = "|".join(TAGS)
_OPAQUE = re.compile(
    rf"""
      (?P<fence>^[ ]{{0,3}}(?:>[ ]?)*[ ]*(?P<f>`{{3,}}|~{{3,}})[^\n]*(?:\n(?:(?!^[ ]{{0,3}}(?:>[ ]?)*[ ]*(?P=f)[`~]*[ ]*$)[^\n]*(?:\n|\Z))*(?:[ >]*(?P=f)[`~]*[ ]*$)?|\Z))
    | (?P<pre><(?P<pt>pre|source|syntaxhighlight)\b[^<>]*>.*?(?:</(?P=pt)\s*>|\Z))
    | (?P<verb>\\begin\{{(?P<ve>{CODE_ENVIRONMENTS})\}}.*?(?:\\end\{{(?P=ve)\}}|\Z))
    | (?P<comment><!--.*?(?:-->|\Z))
    | (?P<script><(?P<st>script|style)\b[^<>]*>.*?(?:</(?P=st)\s*>|\Z))
    | (?P<nowiki><nowiki\b[^<>]*>.*?(?:</nowiki\s*>|\Z))
    | (?P<mathtag>:?<math\b[^<>]*>.*?(?:</math\s*>|\Z))
    | (?P<menv>\\begin\{{(?P<me>{MATH_ENVIRONMENTS})\*?\}}.*?(?:\\end\{{(?P=me)\*?\}}|\Z))
    | (?P<display>\$\$(?=\s*\S)(?:(?!\$\$|\n[ ]*\n).)+?(?:\$\$|\Z))
    | (?P<bracket>\\\[(?:(?!\\\]|\\\[).)+?\\\])
    | (?P<paren>\\\((?:(?!\\\)|\\\(|\n[ ]*\n).)+?\\\))
    | (?P<dollar>(?<![\\$\w])\$(?![\s$])(?:[^$\n\\]|\\.|\n(?![ ]*\n))*?(?<![\s\\])\$(?![\d$A-Za-z]))
    | (?P<path>\b[A-Za-z]:\\[\w.\\-]+)
    | (?P<tick>(?<!`)(?P<t>`{{1,2}})(?!`)(?P<inner>[^`\n]+?)(?<!`)(?P=t)(?!`))
    """,
    re.S | re.M | re.I | re.X,
)
#: Where an opaque piece may begin, or (a fence, a path, a formula tag) shortly after its beginning.
_TRIGGER = re.compile(r"[`\\$]|~~~|<(?=[psnm!])", re.I)
_FENCE_INDENT = re.compile(r"[ ]{0,3}(?:>[ ]?)*[ ]*")
_INDENT = 1000
_EQUALS = re.compile("={1,6}(?!=)")
_ATX = re.compile(r"^ {0,3}#{1,6}[ \t]+\S")
_SETEXT = re.compile(r"^ {0,3}(?:=+|-{2,})[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_QUOTE = re.compile(r"^ {0,3}>[ ]?")
_ITEM = re.compile(r"^[ \t]*(?:[-+]|\*{1,6}|\d{1,9}[.)])[ \t]+(?=\S)(?:\[[ xX]\][ \t]+)?")
_WIKI_ITEM = re.compile(r"^[*#]+[ \t]*(?=\S)")
_TABLE_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TEX_HEADING = re.compile(rf"\\(?:{SECTIONS})\*?(?:\[[^\]\n]*\])?\{{")
_TEX_ITEM = re.compile(r"\\item(?![A-Za-z])(?:\[[^\]\n]*\])?[ \t]*")
_HTML_HEADING = re.compile(r"<h[1-6]\b[^<>]*>", re.I)
_HTML_ITEM = re.compile(r"<li\b[^<>]*>[ \t]*", re.I)
_STRUCTURE_TAG = re.compile(r"</?(?:h[1-6]|li|ul|ol)\b[^<>]*>", re.I)
_STRUCTURE_ENV = re.compile(rf"\\(?:begin|end)\{{(?:{LIST_ENVIRONMENTS})\}}(?:\[[^\]\n]*\])?")
_TAG = re.compile(rf"</?(?:{_NAME})(?:\s[^<>]*|/)?>|<(?:a|img)\s+(?:href|src)=[^<>]*\Z", re.I)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_TEX_COMMAND = re.compile(r"\\[A-Za-z]+\*?")
_TEX_ARGUMENT = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{")
_TEX_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_TEX_QUOTE = re.compile(r"``((?:(?!``).)+?)''|`([^`'\n]+)'")
_WIKI_EMPHASIS = re.compile(r"'{2,5}")
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)(?:\]\]|\Z)")
_WEB_LINK = re.compile(r"\[(?:https?|ftp)://[^\s\]]+[ \t]*([^\]\n]*)(?:\]|\Z)")
_TEMPLATE = re.compile(r"\{\{([^{}]*)(?:\}\}|\Z)", re.S)
_WIKI_TABLE = re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.S | re.M)
_SWITCH = re.compile(r"__[A-Z]{3,}__")
_MD_IMAGE = re.compile(r"!\[([^\]\n]*)\](?:\([^()\n]*(?:\)|\Z)|\[[^\]\n]*\])")
_MD_LINK = re.compile(r"\[((?:[^\[\]\n]|\[[^\[\]\n]*\])+)\](?:\([^()\n]*(?:\)|\Z)|\[[^\]\n]*\])")
_MD_REFERENCE = re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]*\S+[^\n]*$", re.M)
_MD_NOTE = re.compile(r"\[\^[^\]\n]+\]")
_AUTO = re.compile(r"<(?:https?://|mailto:)[^<>\s]+>")
_STRONG = re.compile(r"(?<![\w*])(\*{1,3})(?![\s*])([^*\n]+?)(?<![\s*])\1(?![\w*])")
_BARS = re.compile("_+")
_STRIKE = re.compile(r"~~(?=\S)([^~\n]+?)~~")
_CUT = re.compile(r"(?<!\S)(?:\*\*|~~|__|''+)(?=\w)[^*~_'\n]*(?:\.\.\.|…)\s*\Z")
_HOLD = re.compile("\x00(\\d+)\x00")


class Parsed:
    """Counts of the four kinds of elements, whether there is other markup, and the clean text."""

    __slots__ = ("base", "clean", "counts", "other")

    def __init__(self, base: str, counts: dict[str, int], other: bool, clean: str):
        self.base, self.counts, self.other, self.clean = base, counts, other, clean


def _wiki_heading(line: str) -> tuple[int, str] | None:
    """Level and text of a heading written ``== so ==``."""
    m = _EQUALS.match(line)
    if not m:
        return None
    mark, line = m.group(), line.rstrip(" \t")
    text = line[len(mark) : -len(mark)].strip(" \t")
    return (len(mark), text) if line.endswith(mark) and len(line) > 2 * len(mark) and text and text[0] != "=" else None


def _underscored(line: str) -> tuple[str, int]:
    """The line without ``_emphasis_``, and how many there were: each opening run of one to three takes the next closing one of its length."""
    runs = [m.span() for m in _BARS.finditer(line)]
    after = [0, 0, 0, 0]  # the next closing run of each length, from the right
    found: list[int] = [0] * len(runs)
    for k in range(len(runs) - 1, -1, -1):
        a, b = runs[k]
        if b - a > 3:
            continue
        found[k] = after[b - a]
        if a and not line[a - 1].isspace() and not (b < len(line) and (line[b].isalnum())):
            after[b - a] = k
    out, at, n, k = [], 0, 0, 0
    while k < len(runs):
        a, b = runs[k]
        opens = b - a <= 3 and b < len(line) and not line[b].isspace() and not (a and line[a - 1].isalnum())
        if opens and found[k] > k:
            c, d = runs[found[k]]
            out += [line[at:a], line[b:c]]
            at, n, k = d, n + 1, found[k]
        k += 1
    return "".join([*out, line[at:]]), n


def opaque(text: str) -> list[re.Match]:
    """The opaque pieces from left to right. Each is looked for where it may begin only, and none is scanned twice."""
    found, pos = [], 0
    for t in _TRIGGER.finditer(text):
        i = t.start()
        if i < pos:
            continue
        c, m = text[i], None
        if c in "`~" and text.startswith(c * 3, i):
            low = max(pos, i - _INDENT)
            start = text.rfind("\n", low, i) + 1 or low
            if (not start or text[start - 1] == "\n") and _FENCE_INDENT.fullmatch(text, start, i):
                m = _OPAQUE.match(text, start)
        elif c == "<" and i > pos and text[i - 1] == ":":
            m = _OPAQUE.match(text, i - 1)
        elif c == "\\" and i - 2 >= pos and text[i - 1] == ":":
            m = _OPAQUE.match(text, i - 2)
        m = m or _OPAQUE.match(text, i)
        if m and m.end() > i:
            found.append(m)
            pos = m.end()
    return found


def _replaced(text: str, found: list[re.Match], to) -> str:
    out, at = [], 0
    for m in found:
        out += [text[at : m.start()], to(m)]
        at = m.end()
    return "".join([*out, text[at:]])


def masked(text: str) -> str:
    """The text with code blocks and formulas as runs of NUL of their length."""
    return _replaced(text, opaque(text), lambda m: m.group() if m.group("tick") or m.group("path") or m.group("comment") or m.group("script") or m.group("nowiki") else "\0" * (m.end() - m.start()))


def _base(text: str) -> str:
    if any(_wiki_heading(line) for line in text.split("\n") if line[:1] == "="):
        return "wiki"
    if _TEX_HEADING.search(text) or re.search(r"\\(?:begin|end|documentclass)\{|\\item(?![A-Za-z])", text):
        return "latex"
    if re.search(r"(?m)^ {0,3}#{1,6}[ \t]+\S|^(?=\S).*\n(?:=+|-{2,})[ \t]*$", text):
        return "markdown"
    if re.search(r"\{\{|\[\[|'''?\w|<ref\b|<nowiki|\[https?://", text):
        return "wiki"
    if re.search(r"\\(?:emph|textbf|texttt|underline|href|footnote|cite|label|ref|textit)\{|``[^`\n]+''", text):
        return "latex"
    return "markdown"


def parse(text: str | None) -> Parsed:
    """Elements and clean text of one record; null and blank text has neither. Work grows with the length of the text."""
    counts = dict.fromkeys(KINDS, 0)
    if text is None or not text.strip():
        return Parsed("plain", counts, False, "")
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", " ")
    held: list[str] = []
    other = False

    def hold(s: str) -> str:
        held.append(s)
        return f"\x00{len(held) - 1}\x00"

    # the base is told without code, formulas and comments; ticks are code only where they are not LaTeX quotes
    pieces = opaque(text)
    base = _base(_replaced(text, pieces, lambda m: m.group() if m.group("tick") or m.group("path") else " "))

    def lift(m: re.Match) -> str:
        nonlocal other
        s = m.group()
        if m.group("fence"):
            counts["code_block"] += 1
            body = re.sub(rf"\n?[ >]*{m.group('f')}[`~]*[ ]*\Z", "", s.partition("\n")[2])
            return hold(f"```\n{body}\n```") + ("\n" if s.endswith("\n") else "")
        if m.group("pre"):
            counts["code_block"] += 1
            body = re.sub(r"^<[^<>]*>\s*(?:<code\b[^<>]*>)?|(?:</code\s*>)?\s*</[^<>]*>$", "", s, flags=re.I)
            return hold(f"```\n{html.unescape(body)}\n```")
        if m.group("verb"):
            counts["code_block"] += 1
            body = re.sub(r"^\\begin\{\w+\}(?:\[[^\]\n]*\])?\n?|\n?\\end\{\w+\}$", "", s)
            return hold(f"```\n{body}\n```")
        if m.group("mathtag") or m.group("menv") or m.group("display") or m.group("bracket"):
            counts["formula"] += 1
            block = not (m.group("mathtag") and "display" not in s.partition(">")[0] and s[0] != ":")
            body = re.sub(r"^:?<math[^<>]*>|</math\s*>$|^\\begin\{[^}]*\}|\\end\{[^}]*\}$|^\$\$|\$\$$|^\\\[|\\\]$", "", s, flags=re.I).strip()
            return hold(f"$${body}$$" if block else f"${body}$")
        if m.group("paren") or m.group("dollar"):
            counts["formula"] += 1
            return hold("$" + s.strip("$").removeprefix("\\(").removesuffix("\\)").strip() + "$")
        if m.group("path"):
            return hold(s)
        if m.group("tick"):
            if base == "latex":
                return s
            other = True
            return hold(m.group("inner"))
        other = True  # comment, script, style, nowiki
        if m.group("nowiki"):
            return hold(re.sub(r"</?nowiki[^<>]*>", "", s, flags=re.I))
        return ""

    text = _replaced(text, pieces, lift)
    if base == "latex":
        text, n = _TEX_COMMENT.subn("", text)
        other = other or n > 0

    # lines
    if base == "wiki":
        text, n = _WIKI_TABLE.subn(_wiki_table, text)
        other = other or n > 0
    lines, out = text.split("\n"), []
    table = False
    for k, line in enumerate(lines):
        m = _QUOTE.match(line)
        if m and base != "latex":
            other = True
            while m:
                line = line[m.end() :]
                m = _QUOTE.match(line)
        above = out[-1] if out else ""
        if base == "wiki":
            m = _wiki_heading(line)
            if m:
                counts["heading"] += 1
                line = "#" * m[0] + " " + m[1]
            elif _WIKI_ITEM.match(line) and not line.startswith("#REDIRECT"):
                counts["list_item"] += 1
                m = _WIKI_ITEM.match(line)
                line = "  " * (len(m.group().strip()) - 1) + "- " + line[m.end() :]
            elif re.match(r"-{4,}\s*$", line):
                other, line = True, ""
            elif re.match(r"[:;]+\s*\S", line):
                other, line = True, line.lstrip(":; ")
        elif base == "markdown":
            if _ATX.match(line):
                counts["heading"] += 1
                line = line.strip()
                bare = line.rstrip("#")
                line = bare.rstrip() if bare[-1:] in (" ", "\t") else line
            elif _SETEXT.match(line) and above.strip() and not above.lstrip().startswith(("#", "- ", "|")) and k and lines[k - 1].strip():
                counts["heading"] += 1
                out[-1] = ("# " if "=" in line else "## ") + above.strip()
                continue
            elif _RULE.match(line):
                other, line = True, ""
            elif "|" in line and _TABLE_RULE.match(line):
                other, table = True, True
                continue
            elif _ITEM.match(line):
                counts["list_item"] += 1
                m = _ITEM.match(line)
                line = " " * (len(line) - len(line.lstrip())) + "- " + line[m.end() :]
            elif line.lstrip().startswith("|") and (table or line.rstrip().endswith("|")):
                other = True
                line = " | ".join(c.strip() for c in line.strip().strip("|").split("|"))
            else:
                table = False
        out.append(line)
    text = "\n".join(out)

    # elements that tags or commands make, in any base
    counts["heading"] += len(_HTML_HEADING.findall(text))
    counts["list_item"] += len(_HTML_ITEM.findall(text))
    text = re.sub(r"<h([1-6])\b[^<>]*>((?:(?!<h[1-6]\b).)*?)</h\1\s*>", lambda m: "#" * int(m.group(1)) + " " + " ".join(m.group(2).split()), text, flags=re.I | re.S)
    text = _STRUCTURE_TAG.sub("", _HTML_ITEM.sub("- ", text))
    if base == "latex":
        counts["heading"] += len(_TEX_HEADING.findall(text))
        counts["list_item"] += len(_TEX_ITEM.findall(text))
        text = re.sub(rf"\\({SECTIONS})\*?(?:\[[^\]\n]*\])?\{{([^{{}}\n]*)\}}", lambda m: "#" * min(6, 1 + SECTIONS.split("|").index(m.group(1))) + " " + m.group(2), text)
        text = _STRUCTURE_ENV.sub("", _TEX_ITEM.sub("- ", text))

    # inline marks
    def drop(pattern: re.Pattern, to) -> None:
        nonlocal text, other
        text, n = pattern.subn(to, text)
        other = other or n > 0

    drop(_TAG, lambda m: "\n" if re.match(r"</?(?:p|div|tr|table|blockquote|br)\b", m.group(), re.I) else "")
    drop(_AUTO, lambda m: m.group()[1:-1])
    if base == "wiki":
        drop(_TEMPLATE, lambda m: m.group(1).rsplit("|", 1)[-1] if m.group(1).startswith("note|") else "")
        drop(_WIKI_LINK, lambda m: m.group(1) if not re.match(r"\[\[(?:Category|File|Image):", m.group()) else "")
        drop(_WEB_LINK, r"\1")
        drop(_WIKI_EMPHASIS, "")
        drop(_SWITCH, "")
    elif base == "latex":
        drop(_TEX_QUOTE, lambda m: '"' + (m.group(1) or m.group(2)) + '"')
        drop(re.compile(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}"), r"\1")
        drop(re.compile(r"~?\\(?:label|cite|ref|documentclass|usepackage|begin|end|vspace|hspace)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}(?:\{[^{}\n]*\})?"), "")
        for _ in range(3):
            drop(re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}"), r"\1")
        drop(re.compile(r"\\\\[ \t]*$", re.M), "")
        drop(_TEX_ARGUMENT, "")
        drop(_TEX_COMMAND, "")
    else:
        drop(_MD_REFERENCE, "")
        drop(_MD_IMAGE, r"\1")
        drop(_MD_LINK, r"\1")
        drop(_MD_NOTE, "")
        for _ in range(2):
            drop(_STRONG, r"\2")
            if "_" in text:
                freed = [_underscored(x) if "_" in x else (x, 0) for x in text.split("\n")]
                text, other = "\n".join(x for x, _ in freed), other or any(n for _, n in freed)
        drop(_STRIKE, r"\1")
        drop(_TEX_ARGUMENT, "")
    drop(_CUT, lambda m: m.group().lstrip("*~_'"))
    text, n = _ENTITY.subn(lambda m: html.unescape(m.group()), text)
    other = other or n > 0
    for _ in range(3):
        text = _HOLD.sub(lambda m: held[int(m.group(1))], text)
        if "\x00" not in text:
            break
    text = "\n".join(x.rstrip(" \t") for x in text.split("\n"))
    return Parsed(base, counts, other, re.sub(r"\n{3,}", "\n\n", text).strip())


def _wiki_table(m: re.Match) -> str:
    rows = []
    for line in m.group().split("\n")[1:]:
        if line[:2] in ("|-", "|}", "|+"):
            continue
        rows.append(" | ".join(c.strip() for c in re.split(r"\|\||!!", line.lstrip("|!")) if c.strip()))
    return "\n".join(r for r in rows if r)
