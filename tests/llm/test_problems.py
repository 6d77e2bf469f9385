"""Dictionary dedup, survivorship, fusion and term weighting against brute force and on edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.functions.words import bare
from gleaner.llm import dictionary_dedup, fusion, history_dedup, survivorship, term_weighting
from gleaner.runtime import fresh_path

PACKET = "packet_id long, batch_no int, statement string, value string"


def test_copies_under_layout(spark):
    rows = [(1, "Principle", "a. B", None), (2, "principle ", "A b", None), (3, "PRINCIPLE", "ab!", "x"), (4, None, "ab", None), (5, None, "AB", None), (6, "p", "", None), (6, "p", "", None), (7, "p", "", None)]
    df = spark.createDataFrame(rows, "packet_id long, kind string, statement string, extra string")
    got = {tuple(r) for r in dictionary_dedup.copies(df, "packet_id", ["kind", "statement"], bare).collect()}
    assert got == {(1, 2), (1, 3), (4, 5), (6, 7)}
    assert dictionary_dedup.copies(df.limit(0), "packet_id", ["kind", "statement"], bare).count() == 0


def test_copies_without_broadcast_dictionary(spark, monkeypatch):
    monkeypatch.setattr(dictionary_dedup, "BROADCAST_ENTRIES", 0)
    r = random.Random(3)
    rows = [(i, r.choice(["a", "A ", "b", None]), r.choice(["x y", "X-Y", "z"]), None) for i in range(300)]
    df = spark.createDataFrame(rows, "packet_id long, kind string, statement string, extra string")
    groups = defaultdict(list)
    for i, k, s, _ in rows:
        groups[(None if k is None else re.sub("[^a-z0-9]", "", k.lower()), re.sub("[^a-z0-9]", "", s.lower()))].append(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert {tuple(x) for x in dictionary_dedup.copies(df, "packet_id", ["kind", "statement"], bare).collect()} == want


def test_best_values(spark):
    t = "timestamp '2030-01-0{}'"
    rows = spark.sql(
        f"""select * from values
        ('A', 1L, 'Weak', {t.format(1)}, 'first'), ('A', 2L, ' STRONG', {t.format(2)}, 'N/A'), ('A', 3L, 'strong', {t.format(3)}, null),
        ('A', 4L, 'weak', {t.format(5)}, 'second'), ('A', 5L, 'weak', {t.format(5)}, 'third'), ('A', 5L, 'weak', {t.format(5)}, 'third'),
        ('B', 6L, 'strong', {t.format(1)}, 'alone'), ('B', 6L, 'strong', {t.format(1)}, 'alone'), (null, 7L, 'strong', {t.format(1)}, 'x'), (null, 8L, null, null, null)
        as v(code, id, support, at, text)"""
    )
    got = {(r[0], r[1]): r[2] for r in survivorship.best_values(rows, "code", "id", [("support", "text", "trust"), ("text", "text", "trust"), ("at", "time", "latest")], "support", "at").collect()}
    assert got == {("A", "support"): 3, ("A", "text"): 4, ("A", "at"): 4}
    assert survivorship.best_values(rows.limit(0), "code", "id", [("text", "text", "trust")], "support", "at").count() == 0


def test_fusion_discounts_copiers(spark):
    r = random.Random(7)
    rows = []
    for k in range(60):
        truth = f"t{k}"
        for s in ("a", "b", "c"):
            rows.append((f"i{k}", s, truth if r.random() < 0.9 else f"e{s}{k}", None, k))
        wrong = truth if r.random() < 0.3 else f"w{k}"
        rows += [(f"i{k}", s, wrong, None, k) for s in ("x1", "x2", "x3", "x4")]
    rows += [("n", None, "v", None, 1), (None, "a", "v", None, 1), ("m", "a", None, None, 1), rows[0]]
    df = spark.createDataFrame(rows, "item string, source string, value string, at timestamp, record long")
    got = {x["item"]: x["value"] for x in fusion.fuse(df).collect()}
    plain = Counter()
    votes = defaultdict(Counter)
    for i, s, v, _, _ in rows[:-1]:
        if i and s and v:
            votes[i][v] += 1
    plain = sum(votes[f"i{k}"].most_common(1)[0][0] == f"t{k}" for k in range(60))
    assert set(got) == {f"i{k}" for k in range(60)}
    right = sum(got[f"i{k}"] == f"t{k}" for k in range(60))
    assert right > plain + 15 and right >= 55
    assert fusion.fuse(df.limit(0)).count() == 0


def test_term_scores(spark):
    texts = {1: "alpha alpha beta the the", 2: "beta gamma the", 3: None, 4: "", 5: "alpha's ab x9 THE"}
    df = spark.createDataFrame([*texts.items(), (1, texts[1])], "note_id long, text string").withColumn("term", F.lit("clash")).withColumn("df", F.lit(1))
    got = {(r["id"], r["term"]): (r["tf"], r["df"], r["cf"], r["score"]) for r in term_weighting.term_scores(df, "note_id", "text").collect()}
    words = {i: re.findall("[a-z]{3,}", (t or "").lower()) for i, t in texts.items()}
    n, mean = len(texts), sum(map(len, words.values())) / len(texts)
    want = {}
    for i, ws in words.items():
        for w, tf in Counter(ws).items():
            cf, d = sum(x.count(w) for x in words.values()), sum(w in x for x in words.values())
            lam, tfn = cf / n, tf * math.log2(1 + mean / len(ws))
            want[(i, w)] = (tf, d, cf, (math.log2(1 + lam) - tfn * math.log2(lam / (1 + lam))) / (tfn + 1))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
    assert term_weighting.term_scores(df.limit(0), "note_id", "text").count() == 0
    assert [r["term"] for r in term_weighting.top_terms(term_weighting.term_scores(df, "note_id", "text"), 1).where("id = 2").collect()] == ["gamma"]


def test_clashing_columns_and_long_texts(spark):
    long = " ".join(f"word{k}" for k in range(40_000))
    rows = [(1, 0, long, "a"), (2, 0, long.upper() + " extra", "b"), (3, None, "short one", "c"), (4, 1, "short, ONE!", None), (5, 1, long[:200_000], "d")]
    df = spark.createDataFrame(rows, PACKET).select("*", *[F.lit(1).alias(c) for c in ("node", "fp", "sk", "ord", "id", "text", "a", "b", "copies", "n")])
    store = history_dedup.HistoryStore.create(spark, fresh_path(spark, "history"), 10)
    got = {tuple(r) for r in history_dedup.ingest(store, df, "packet_id", "statement", ["batch_no"]).collect()}
    # a null batch comes before all others
    assert got == {(1, 2), (3, 4)}
    same = df.select("*", F.lit("x").alias("tuple"), F.lit("y").alias("k0"), F.lit("z").alias("f0"))
    assert {tuple(r) for r in dictionary_dedup.copies(same, "packet_id", ["statement"], bare).collect()} == {(3, 4)}
    clash = df.select(F.lit("A").alias("grp"), F.lit("C").alias("code"), "packet_id", "statement", F.lit("weak").alias("support"), F.current_timestamp().alias("at"), F.lit(1).alias("lo"), F.lit(2).alias("hi"))
    assert [r["record_id"] for r in survivorship.best_values(clash, "code", "packet_id", [("statement", "text", "trust")], "support", "at").collect()] == [1]
