"""Markup, templates, leakage, mixing and shared spans against brute force and on edge cases."""

import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("gleaner.llm")

from gleaner.llm import leakage, markup, mixing, shared_spans, templates

WORD = re.compile("[a-z0-9]+")


def kinds(text):
    p = markup.parse(text)
    return {k: n for k, n in p.counts.items() if n} | ({"other": 1} if p.other else {})


@pytest.mark.parametrize(
    "text,want",
    [
        (None, {}), ("", {}), ("  \n", {}),
        ("It costs $5 per run and $9 per day, type Map<K, V>, x * y * z, snake_case_name, C:\\temp\\x, R&D, a < b and b > c.", {}),
        ("Overview:\n\nPlain text as [3] says in #12.", {}),
        ("# A\n\n## B ##\n\nC\n---\n\nD\n===\n", {"heading": 4}),
        ("# A\r\n\r\n- x\r\n  - [ ] y\r\n1) z\r\n+ w\r\n", {"heading": 1, "list_item": 4}),
        ("# A\n\n```sh\n# not\n- not **x** $a$\n```\n\n~~~\n== no ==\n~~~", {"heading": 1, "code_block": 2}),
        ("# A\n\n```\nnever closed\n# x", {"heading": 1, "code_block": 1}),
        ("# A\n\n$$\nx\n$$ and $y^2$ and \\(z\\) and \\[p < 0.05\\]", {"heading": 1, "formula": 4}),
        ("# A\n\n*a* text", {"heading": 1, "other": 1}), ("# A\n\n`code`", {"heading": 1, "other": 1}), ("# A\n\n---\n", {"heading": 1, "other": 1}),
        ("# A\n\n| a | b |\n| --- | :-: |\n| c | d |", {"heading": 1, "other": 1}), ("# A\n\n> q", {"heading": 1, "other": 1}),
        ("== A ==\n\n# one\n# two\n* three\n** four\n\n===B===\n\n:<math>x</math>", {"heading": 2, "list_item": 4, "formula": 1}),
        ("== A ==\n\n<source lang=x>\n== no ==\n</source>\n[[Page|word]]", {"heading": 1, "code_block": 1, "other": 1}),
        ("<h1 id='a'>\nT\n</h1>\n\n<ul>\n<li>a\n<li>b</li>\n</ul>\n<PRE>x\n<b>y</b></PRE>", {"heading": 1, "list_item": 2, "code_block": 1}),
        ("<p>x", {"other": 1}), ("a&nbsp;b", {"other": 1}), ("x<!-- y -->", {"other": 1}),
        ("\\section*{A}\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\\begin{verbatim}\n\\item no\n\\end{verbatim}\n\\begin{equation}\nx\n\\end{equation}", {"heading": 1, "list_item": 2, "code_block": 1, "formula": 1}),
        ("\\section{A}\n\nSome \\emph{x} word", {"heading": 1, "other": 1}), ("\\paragraph{A}\n\n% note\nword", {"heading": 1, "other": 1}),
        ("a cut **word...", {"other": 1}), ('a cut <a href="https://x...', {"other": 1}),
    ],
)
def test_elements(text, want):
    assert kinds(text) == want


def test_clean_text_keeps_structure():
    p = markup.parse("# T\n\nA **b** [c](http://d) &amp; `e`.\n\n1. x\n2. y\n\n```py\nz = 1\n```\n\n$$q$$\n")
    assert p.clean == "# T\n\nA b c & e.\n\n- x\n- y\n\n```\nz = 1\n```\n\n$$q$$"
    assert markup.parse(p.clean).counts == p.counts


def test_very_long_text_is_scanned_whole():
    text = "# A\n\n" + "word *x* and $y$ more\n- item\n\n" * 5000
    assert markup.parse(text).counts == {"heading": 1, "list_item": 5000, "code_block": 0, "formula": 5000}


@pytest.mark.parametrize("piece", ["\\[ x ", "_a ", "``a ", "[a ", "$a ", "<b ", "**a ", "a ```", "\\begin{equation} ", "[[a|", "''", "<h1>", "\\textbf{", "~~a ", "{{a ", "&a", "\\( x "])
def test_work_grows_with_the_length(piece):
    def took(n):
        start = time.process_time()
        markup.parse(piece * n)
        return time.process_time() - start

    took(100)
    small, large = min(took(4000) for _ in range(3)), min(took(16_000) for _ in range(2))
    # four times the text takes four times as long, give or take; sixteen times would be quadratic
    assert large < 9 * small + 0.05


def test_line_forms():
    assert kinds("== A ==\n\n" + "= b" + " " * 50 + "x") == {"heading": 1}
    assert kinds("# A ##\n\nsnake_case and _emphasised words_ here") == {"heading": 1, "other": 1}
    assert markup.parse("# A\n\n_one_ and __two_x__ and three_four_").clean == "# A\n\none and two_x and three_four_"


def test_structure_is_no_template(spark):
    rows = [(i, "h", f"Own words {i} here\n\n<h2>Inner heading of all pages</h2>\n\n$$a \\leq b + c + d + e + f$$\n\n<nav><a href='#top'>up to the top</a></nav>\n\n```\n<nav>code of every page</nav>\n```") for i in range(8)]
    df = spark.createDataFrame(rows, "id long, host string, text string")
    cuts = {r["id"]: [tuple(c) for c in r["cuts"]] for r in templates.template_cuts(df, "id", "host", "text").collect()}
    left = {templates.cut(rows[i][2], c) for i, c in cuts.items()}
    assert len(cuts) == 8 and all("up to the top" not in t and "Inner heading" in t and "code of every page" in t and "leq" in t and "Own words" in t for t in left)


def test_templates(spark):
    foot = "<div><p>Shared footer of the whole site</p></div>"
    rows = [(i, "h", f"<p>Page {i} has its own words here</p>\n\n{foot}") for i in range(12)] + [(50, "other", foot), (51, None, None), (0, "h", f"<p>Page 0 has its own words here</p>\n\n{foot}")]
    df = spark.createDataFrame(rows, "id long, host string, text string")
    cuts = {r["id"]: r["cuts"] for r in templates.template_cuts(df, "id", "host", "text", min_pages=5).collect()}
    assert set(cuts) == set(range(12))
    assert templates.cut(rows[3][2], [tuple(c) for c in cuts[3]]).strip() == "<p>Page 3 has its own words here</p>"
    assert templates.template_cuts(df.limit(0), "id", "host", "text").count() == 0


def brute_leaks(docs, items, need=20):
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for i, p in items:
            q = WORD.findall((p or "").lower())
            k = min(need, len(q))
            if k:
                grams = {tuple(q[a : a + k]) for a in range(len(q) - k + 1)}
                if any(tuple(w[a : a + k]) in grams for a in range(len(w) - k + 1)):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("vocab,max_words", [(4, 10**6), (40, 10**6), (6, 60)])
def test_leaks_match_brute_force(spark, vocab, max_words):
    r = random.Random(vocab)
    words = [f"w{k}" for k in range(vocab)]
    items = [(i, " ".join(r.choices(words, k=r.choice([3, 6, 9, 14])))) for i in range(25)] + [(90, None), (91, "?!"), (3, None)]
    items.append(items[5])
    docs = []
    for d in range(60):
        parts = [r.choice(items)[1] or "" for _ in range(2)] + [" ".join(r.choices([*words, "zz"], k=20))]
        parts = [" ".join(p.split()[r.randrange(3) :]) for p in parts]
        docs.append((d, ", ".join(r.sample(parts, 3)).upper() if d % 2 else "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, "é" * 30)]
    items = [x for x in items if x[0] != 3 or x[1]]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, passage string"), "item_id", "passage", leak_words=6, max_words=max_words)
    rows = got.select("doc_id", "item_id").collect()
    assert {tuple(x) for x in rows} == brute_leaks(docs, items, 6) and len(rows) == len(set(rows))


def test_leaks_empty_and_cleaned(spark):
    passage = " ".join(f"q{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"Before. {passage.upper()}! " + "after " * 40), (2, "clean"), (3, passage), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, passage string")
    found = leakage.leaks(docs, "doc_id", "text", items, "item_id", "passage").cache()
    got = {r["doc_id"]: (r["text"], r["dropped"]) for r in leakage.cleaned(docs, "doc_id", "text", found).collect()}
    assert got == {1: ("Before. ! " + "after " * 40, False), 2: ("clean", False), 3: (None, True), 4: (None, False)}
    assert leakage.leaks(docs, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0
    assert leakage.leaks(docs.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0


def test_cut_spans_of_letters_that_grow(spark):
    passage = " ".join(f"q{k}" for k in range(20))
    text = "İİ before İ. " + passage + " after İ" + " x" * 60
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = leakage.leaks(docs, "doc_id", "text", spark.createDataFrame([(7, passage)], "item_id long, passage string"), "item_id", "passage")
    assert leakage.cleaned(docs, "doc_id", "text", found).first()["text"] == text.replace(passage, "")


PLAN = "source_name string, target_share double, max_repeats int"


def test_mixture_meets_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_DOCS", 7)
    r = random.Random(1)
    rows = [(i, r.choice(["Big_A", "big-a", "big a "]), r.randrange(5, 30)) for i in range(400)] + [(1000 + i, "small", 20) for i in range(10)] + [(3000, None, 9), (3001, "unplanned", 9), (1000, "small", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    plan = spark.createDataFrame([("big-a", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), (None, 0.1, 1)], PLAN)
    placed, report = mixing.mixture(docs, "doc_id", plan, schedules={"small": mixing.ramp(0, 1)})
    rep = {x["source"]: x for x in report.collect()}
    assert rep["small"]["tokens"] == 600 and rep["small"]["times_used"] == 3 and rep["absent"]["tokens"] == 0
    assert 750 <= rep["big-a"]["tokens"] < 750 + 30 and rep["big-a"]["times_used"] == 1
    assert sum(x["actual_share"] for x in rep.values()) == pytest.approx(1)
    got = placed.collect()
    assert [x["position"] for x in got] == sorted(x["position"] for x in got) and 0 <= got[0]["position"] and got[-1]["position"] <= 1
    assert len({(x["doc_id"], x["copy_no"]) for x in got}) == len(got)
    # the integral of a weight that grows from 0 is t^2: a quarter of the tokens comes in the first half
    early = sum(x["tokens"] for x in got if x["source"] == "small" and x["position"] < 0.5)
    assert early == pytest.approx(150, abs=20)
    capped = {x["source"]: x for x in mixing.mixture(docs, "doc_id", plan, total=10**6)[1].collect()}
    assert capped["small"]["tokens"] == 600 and capped["big-a"]["tokens"] == capped["big-a"]["available_tokens"]


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, tokens long")
    plan = spark.createDataFrame([("a", 1.0, 1)], PLAN)
    placed, report = mixing.mixture(docs, "doc_id", plan)
    assert placed.count() == 0 and [x["tokens"] for x in report.collect()] == [0]
    assert mixing.mixture(docs, "doc_id", plan.limit(0))[1].count() == 0
    with pytest.raises(ValueError):
        mixing.segments([(0, -1), (1, 2)], 5)


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["tokens"] for r in mixing.token_counts(docs, "text").collect()} == {1: 2, 2: 0, 3: 0}


def random_documents(seed):
    r = random.Random(seed)
    alphabet = "abcdefgh é😀\n"
    base = ["".join(r.choices(alphabet, k=r.choice([30, 200, 90]))) for _ in range(12)]
    docs = []
    for d in range(40):
        text = "".join(r.choices(alphabet, k=r.randrange(80)))
        if r.random() < 0.7:
            b = r.choice(base)
            x = r.randrange(20)
            text += b[x : len(b) - r.randrange(20)] + "".join(r.choices(alphabet, k=30))
        docs.append((d, text))
    return docs + [(90, None), (91, ""), (92, docs[3][1]), (93, docs[3][1]), (94, "a" * 300), (95, "b" + "a" * 120), (96, "ab" * 90)]


@pytest.mark.parametrize("seed", [1, 2])
def test_sharing_documents_match_brute_force(spark, seed):
    span, rows = 60, random_documents(seed)
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    grams = {d: {t[k : k + span] for k in range(len(t) - span + 1)} for d, t in rows if t}
    want = {(a, b) for a, b in combinations(sorted(grams), 2) if grams[a] & grams[b]}
    got = [tuple(x) for x in shared_spans.sharing_documents(docs, "doc_id", "text", span=span, window=20).collect()]
    assert set(got) == want and len(got) == len(want)
    parts = {r["doc_id"]: r for r in shared_spans.shared_parts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", span=span, window=20).collect()}
    assert set(parts) == {d for d, _ in rows}
    for d, t in rows:
        t = t or ""
        covered, late = set(), set()
        for k in range(len(t) - span + 1):
            holders = [e for e in grams if e != d and t[k : k + span] in grams[e]]
            covered |= set(range(k, k + span)) if holders else set()
            late |= set(range(k, k + span)) if any(e < d for e in holders) else set()
        if d not in (92, 93, 3):  # whole copies also share what lies outside the stretches
            assert (parts[d]["shared_chars"], parts[d]["kept_chars"]) == (len(covered), len(t) - len(late)), d
    if len(rows[3][1]) >= span:
        assert parts[3]["shared_chars"] == len(rows[3][1]) and parts[93]["kept_chars"] == 0


def test_sharing_documents_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shared_spans.sharing_documents(docs, "doc_id", "text").count() == 0
    assert shared_spans.shared_parts(docs, "doc_id", "text").count() == 0


def test_every_passage_holds_a_whole_line():
    r = np.random.default_rng(3)
    for _ in range(30):
        passage = r.integers(0, 4, 400).astype(np.uint32)
        a = np.concatenate([r.integers(0, 4, r.integers(0, 300)).astype(np.uint32), passage, r.integers(0, 4, 50).astype(np.uint32)])
        b = np.concatenate([r.integers(0, 4, r.integers(0, 300)).astype(np.uint32), passage])
        x = shared_spans.lines(a, np.array([len(a)]))[2]
        y = shared_spans.lines(b, np.array([len(b)]))[2]
        assert len(np.intersect1d(x, y))


def test_clashing_columns_and_long_texts(spark):
    r = random.Random(9)
    shared = "".join(r.choices("abcdefghij ", k=500))
    noise = lambda n: "".join(r.choices("klmnopqrst ", k=n))
    rows = [(1, noise(150_000) + shared + noise(10)), (2, shared), (3, noise(600)), (4, "z" * 150_000), (5, "z" * 450 + noise(20)), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("a", "b", "digest", "tk", "doc", "n", "id", "host", "source", "tokens", "start", "item_id", "spans")])
    assert {tuple(x) for x in shared_spans.sharing_documents(df, "doc_id", "text").collect()} == {(1, 2), (4, 5)}
    items = spark.createDataFrame([(9, " ".join(rows[2][1].split()[:25]), 1)], "item_id long, passage string, doc_id int")
    assert {(x["doc_id"], x["item_id"]) for x in leakage.leaks(df, "doc_id", "text", items, "item_id", "passage").collect()} == {(3, 9)}
    placed, _ = mixing.mixture(df.withColumn("source", F.lit("s")).withColumn("runs", F.lit(1)).withColumn("want", F.lit(2)), "doc_id", spark.createDataFrame([("s", 1.0, 1)], PLAN))
    assert placed.count() == 6
    assert templates.template_cuts(df, "doc_id", "host", "text").count() == 0


def test_sharing_documents_without_broadcasts(spark, monkeypatch):
    r = random.Random(12)
    base = ["".join(r.choices("abcde ", k=700)) for _ in range(4)]
    rows = [(i, r.choice(base)[:600] + str(i) * 5 + r.choice(base)[100:600]) for i in range(14)] + [(20, base[0] * 2), (21, base[0] * 2), (21, base[0] * 2), (30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(tuple(x) for x in shared_spans.sharing_documents(df, "doc_id", "text").collect())
    monkeypatch.setattr(shared_spans, "BROADCAST_IDS", 0)
    monkeypatch.setattr("gleaner.operators.skew.BROADCAST_KEYS", 0)
    got = Counter(tuple(x) for x in shared_spans.sharing_documents(df, "doc_id", "text").collect())
    texts = dict(rows)
    real = {(a, b) for a, b in combinations(sorted(k for k, t in texts.items() if t), 2) if any(texts[a][i : i + 400] in texts[b] for i in range(len(texts[a]) - 399))}
    assert got == want and set(got) == real and max(got.values()) == 1
