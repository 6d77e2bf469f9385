"""Batches against a persistent history, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import history_dedup
from gleaner.operators import skew
from gleaner.runtime import file_names, fresh_path

WORD = re.compile("[a-z0-9]+")
PACKET = "packet_id long, batch_no int, statement string, value string"


def expected_links(rows, threshold=0.7):
    accepted, out, seen = [], set(), set()
    for i, b, s, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if i in seen or s is None or not s.strip():
            continue
        seen.add(i)
        w = set(WORD.findall(s.lower()))
        hit = [a for a, v in accepted if w and len(w & v) >= threshold * len(w | v) - 1e-9]
        out.update((a, i) for a in hit)
        if not hit and w:
            accepted.append((i, w))
    return out


def random_statements(n, seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(120)]
    rows, made = [], []
    for i in range(1, n + 1):
        kind = r.random()
        if kind < 0.08:
            s = r.choice([None, "", "   ", "?!", "A", "a b", "a b c", "a b c d e"])
        elif made and kind < 0.6:
            words = r.choice(made).split()
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                words[r.randrange(len(words))] = r.choice(vocab)
            s = " ".join(words).upper() if r.random() < 0.2 else ",  ".join(words)
            s = re.sub(",  ", r.choice([" ", ", "]), s)
        else:
            s = " ".join(r.choices(vocab, k=r.choice([2, 4, 7, 16, 25])))
        if s and WORD.findall(s.lower()):
            made.append(s)
        rows.append((i, i * 4 // n, s, "x"))
    return rows + [rows[3], rows[3], rows[10]]


def ingest_all(spark, rows, parts=("batch_no = 0", "batch_no = 1", "batch_no > 1"), reopen=False, **settings):
    df = spark.createDataFrame(rows, PACKET).coalesce(3)
    store = history_dedup.HistoryStore.create(spark, fresh_path(spark, "history"), 100)
    got = []
    for part in parts:
        for name, value in settings.items():
            setattr(store, name, value)
        got += [tuple(r) for r in history_dedup.ingest(store, df.where(part), "packet_id", "statement", ["batch_no"]).collect()]
        if reopen:
            store = history_dedup.HistoryStore.open(spark, store.path)
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_ingest_matches_brute_force(spark, seed):
    rows = random_statements(160, seed)
    assert ingest_all(spark, rows) == expected_links(rows)


def test_ingest_in_another_session_and_with_full_filters(spark):
    rows = random_statements(160, 5)
    assert ingest_all(spark.newSession(), rows, reopen=True, slice_rows=50) == expected_links(rows)


def test_every_switch_has_been_off(spark, monkeypatch):
    rows = random_statements(120, 6)
    monkeypatch.setattr(history_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(history_dedup, "SETTLE_LINKS", -1)
    monkeypatch.setattr(history_dedup, "BLOCK", 1)
    monkeypatch.setattr(history_dedup, "CHUNK", 7)
    assert ingest_all(spark, rows) == expected_links(rows)


def test_settling_agrees_with_rounds(spark):
    r = random.Random(3)
    links = [(a, b) for a in range(40) for b in range(a + 1, 40) if r.random() < 0.06]
    want, accepted = set(), set()
    for n in range(40):
        (want if any(a in accepted for a, b in links if b == n) else accepted).add(n)
    assert history_dedup.settled(links, set()) == want


def test_a_load_that_was_overtaken_fails(spark):
    df = spark.createDataFrame([(1, 0, "a b c", None)], PACKET)
    store = history_dedup.HistoryStore.create(spark, fresh_path(spark, "history"), 10)
    other = history_dedup.HistoryStore.create(spark, store.path, 10)
    history_dedup.ingest(other, df, "packet_id", "statement", ["batch_no"])
    with pytest.raises(ValueError, match="exists already"):
        history_dedup.ingest(store, df, "packet_id", "statement", ["batch_no"])
    assert len(file_names(spark, f"{store.path}/manifest")) == 1
    assert history_dedup.HistoryStore.open(spark, store.path).loads == other.loads


def test_a_small_batch_reads_its_buckets_only(spark):
    rows = [(i, 0, f"one{i} two{i} three{i} four{i} five{i}", None) for i in range(400)] + [(900, 1, "five7 four7 three7 two7 one7", None), (901, 1, "fully new text", None)]
    assert ingest_all(spark, rows) == {(7, 900)}
    p = history_dedup.fingerprints([900], [rows[400][2]], 0.7, history_dedup.WordOrder(400, {}))
    assert len(p) <= 3  # of 4 parts of 16 buckets each


def broken_runs(seed):
    """Statements of 20 words and more, each with one that has every fifth word replaced and two that are scrambled."""
    r = random.Random(seed)
    rows = []
    for k in range(30):
        base = r.sample([f"w{k % 3}x{v}" for v in range(90)], r.choice([20, 26, 34, 70]))
        changed = [f"n{k}y{v}" if v % 5 == 4 and v < len(base) - 1 else w for v, w in enumerate(base)]
        for c, ws in enumerate((base, changed, r.sample(base, len(base)), [*r.sample(base, len(base) - 3), f"z{k}"])):
            rows.append((len(rows) + 1, c, " ".join(ws), None))
    return rows


@pytest.mark.parametrize("rare, meet, hot", [(10**6, 10**6, 500), (1, 10**6, 500), (4, 3, 500), (10**6, 10**6, 3)])
def test_ingest_finds_pairs_without_long_runs(spark, rare, meet, hot):
    rows = broken_runs(4)
    assert ingest_all(spark, rows, ("batch_no < 0", "batch_no = 0", "batch_no > 0"), rare=rare, meet_rows=meet, hot_rows=hot) == expected_links(rows)


def test_ingest_finds_every_fifth_word_replaced(spark):
    base = [f"w{k}" for k in range(20)]
    changed = [f"new{k}" if k in (4, 9, 14) else w for k, w in enumerate(base)]
    rows = [(1, 0, " ".join(base), None), (2, 0, " ".join(changed), None), (3, 1, " ".join(changed[::-1]), None)]
    assert ingest_all(spark, rows) == expected_links(rows) == {(1, 2), (1, 3)}


def test_scrambled_words_are_found_across_loads(spark):
    r = random.Random(9)
    base = [f"w{k}" for k in range(24)]
    rows = [(1, 0, " ".join(base), None), *[(i, b, " ".join(r.sample(base, 24)), None) for i, b in ((2, 0), (3, 1), (4, 2))]]
    assert ingest_all(spark, rows) == {(1, 2), (1, 3), (1, 4)}


def test_prefix_keys_of_matches_meet():
    r = random.Random(6)
    common = [r.getrandbits(64) for _ in range(90)]
    order = history_dedup.WordOrder(1000, {h: r.choice([1, 20, 300, 900]) for h in common[:80]})
    for t in (0.5, 0.7, 0.9):
        for _ in range(600):
            x = set(r.sample(common, r.choice([3, 6, 9, 11, 15, 25, 40, 64, 70])))
            y = set(list(x)[r.randrange(len(x) // 3) :]) | set(r.sample(common, r.randrange(6)))
            if len(x & y) >= t * len(x | y):
                for rare in (1, 30, 10**6):
                    assert set(history_dedup.prefix_keys(x, t, order, rare)) & set(history_dedup.prefix_keys(y, t, order, rare))


def test_packs_are_whole():
    r = np.random.default_rng(7)
    got = np.empty(500, history_dedup.PRINT)
    got["fp"], got["node"], got["sig"] = r.integers(2**63, 2**63 + 40, 500, dtype=np.uint64), r.integers(-(2**62), 2**62, 500), r.integers(0, 2**63, 500)
    assert history_dedup.unpack(history_dedup.pack(got)).tolist() == np.sort(got).tolist()
    assert len(history_dedup.unpack(history_dedup.pack(got[:0]))) == 0


def test_ingest_hot_group_and_empty(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(i, 0, text if i % 3 else f"other {i} words {i * 7} here {i * 13} and {i * 17} more {i * 19} of {i * 23}", None) for i in range(1, 61)]
    assert ingest_all(spark, rows) == expected_links(rows)
    assert ingest_all(spark, []) == set()


def test_ingest_with_stock_phrases(spark):
    rows = random_statements(150, 3)
    r = random.Random(8)
    rows = [(i, b, s and len(s) > 30 and r.random() < 0.5 and "in the very same order as before " + s or s, v) for i, b, s, v in rows]
    rows = list({x[0]: x for x in rows}.values())
    want = expected_links(rows)
    assert ingest_all(spark, rows, hot_rows=3) == want and ingest_all(spark, rows, meet_rows=2) == want


def test_signature_prunes_no_match():
    r = np.random.default_rng(5)
    for _ in range(200):
        x = set(r.integers(0, 2**62, 20).tolist())
        y = set(list(x)[:17]) | set(r.integers(0, 2**62, 2).tolist())
        sx, sy = (history_dedup.signature(s) & (2**history_dedup.SIGNATURE_BITS - 1) for s in (x, y))
        bound = min(len(x) - (sx & ~sy).bit_count(), len(y) - (sy & ~sx).bit_count())
        assert bound >= len(x & y)


def test_bloom_has_no_false_negative():
    fp = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    b = np.zeros(5000 * history_dedup.BLOOM_BITS // 8, np.uint8)
    history_dedup.bloom_add(b, fp)
    assert history_dedup.bloom_test(b, fp).all()
    assert history_dedup.bloom_test(b, fp ^ np.uint64(0xABCDEF)).mean() < 0.05


def test_packs_are_taken_apart_together():
    r = np.random.default_rng(11)
    packs = []
    for n in (40, 0, 300, 1):
        p = np.empty(n, history_dedup.PRINT)
        p["fp"], p["node"], p["sig"] = r.integers(2**63, 2**63 + 25, n, dtype=np.uint64), r.integers(-(2**62), 2**62, n), r.integers(0, 2**63, n)
        packs.append(history_dedup.pack(p))
    every = np.concatenate([history_dedup.unpack(b) for b in packs])
    assert sorted(history_dedup._load(packs).tolist()) == sorted(every.tolist())
    wanted = np.unique(every["fp"])[::3]
    got = history_dedup._load(packs, wanted)
    assert sorted(got.tolist()) == sorted(every[np.isin(every["fp"], wanted)].tolist()) and (np.diff(got["fp"].astype(float)) >= 0).all()
    assert len(history_dedup._load(packs, wanted[:0])) == len(history_dedup._load([])) == 0


def test_hits_of_a_wide_key_are_tested_together(monkeypatch):
    r, calls, able = np.random.default_rng(12), [], history_dedup._able
    sets = [set(r.integers(0, 90, 20).tolist()) for _ in range(700)]
    p = np.zeros(700, history_dedup.PRINT)
    p["node"], p["sig"] = np.arange(700), [history_dedup.signature(s) for s in sets]
    monkeypatch.setattr(history_dedup, "_able", lambda *a: calls.append(1) or able(*a))
    x = history_dedup._Side(p)
    for same, (a, b) in ((True, ((0, 700), (0, 700))), (False, ((0, 100), (50, 700)))):
        calls.clear()
        got = [tuple(row) for f in history_dedup._blocks(x, x, a, b, 0.3, same) for row in f.tolist()]
        assert len(calls) == 1  # one for each of up to six tiles before
        i, j = (k.ravel() for k in np.meshgrid(np.arange(*a), np.arange(*b), indexing="ij"))
        ok = able(x, x, i, j, np.bitwise_count(x.bits[i] & x.bits[j]).astype(np.int16), 0.3) & ((i < j) | (not same))
        assert sorted(got) == sorted(zip(i[ok].tolist(), j[ok].tolist())) and len(got) == len(set(got)) > 100


def test_few_pairs_of_a_wide_key_are_tested_on_both_bounds(monkeypatch):
    r, tested, able = np.random.default_rng(13), [], history_dedup._able
    sets = [set(r.integers(0, 4000, r.integers(20, 34)).tolist()) for _ in range(600)]
    sets += [set(list(s)[:-2]) for s in sets[:40]] + [set(range(300)), set(range(290)), set()]
    p = np.zeros(len(sets), history_dedup.PRINT)
    p["node"], p["sig"] = np.arange(len(sets)), [history_dedup.signature(s) for s in sets]
    monkeypatch.setattr(history_dedup, "_able", lambda x, y, i, j, both, t: tested.append(len(i)) or able(x, y, i, j, both, t))
    x, n = history_dedup._Side(p[:640]), 640
    got = [tuple(row) for f in history_dedup._blocks(x, x, (0, n), (0, n), 0.7, True) for row in f.tolist()]
    assert {(i, 600 + i) for i in range(40)} <= set(got) and len(got) == len(set(got))
    assert sum(tested) < 0.01 * n * n
    for t in (0.3, 0.7, 0.95):  # whatever the threshold, and with sets too large to be pruned, nothing that may match is lost
        x, n = history_dedup._Side(p), len(p)
        got = {tuple(row) for f in history_dedup._blocks(x, x, (0, n), (0, n), t, True) for row in f.tolist()}
        i, j = (k.ravel() for k in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
        ok = able(x, x, i, j, np.bitwise_count(x.bits[i] & x.bits[j]).astype(np.int16), t) & (i < j)
        assert got == set(zip(i[ok].tolist(), j[ok].tolist()))


def test_a_pair_of_many_parts_is_verified_once(spark):
    sets = spark.createDataFrame([(k, k, None, list(range(20 + k))) for k in range(3)], "node long, ord long, sk binary, ws array<long>")
    pairs = spark.createDataFrame([(0, 1, False)] * 30 + [(0, 2, False)] * 20, "a long, b long, past boolean")
    got = history_dedup.verified(pairs, 50, sets.withColumn("past", F.lit(False)), sets, 0.7)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(0, 1), (0, 2)]
    joined = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[-1]
    assert "Aggregate" in joined  # the pairs are made distinct below the joins, before word sets are moved
