"""Balanced joins and pairings."""

from collections import Counter

from gleaner.operators import skew


def test_block_pairs_and_crossed(spark):
    rows = [("h", i) for i in range(50)] + [("g", 1), ("g", 2), ("o", 9)]
    df = spark.createDataFrame(rows, "grp string, item long")
    got = [tuple(r) for r in skew.block_pairs(df, "grp", "item", block_rows=7).collect()]
    assert len(got) == 50 * 49 // 2 + 1 and {(a, b) for a, b in got} == {(a, b) for a in range(50) for b in range(a + 1, 50)}
    x = spark.createDataFrame([("h", i) for i in range(600)] + [("o", 1)], "k string, a long")
    assert skew.crossed(x, x.withColumnRenamed("a", "b"), "k", "a", "b").count() == 600 * 600 + 1


def test_repeated_only_by_broadcast_and_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), (None, 3), (None, 4)], "k string, v long")
    for most in (skew.BROADCAST_KEYS, 0):
        monkeypatch.setattr(skew, "BROADCAST_KEYS", most)
        assert sorted(r["v"] for r in skew.repeated_only(df, "k", "v").collect()) == [1, 2]
        x = spark.createDataFrame([("h", i) for i in range(600)] + [("o", 1)], "k string, a long")
        assert skew.crossed(x, x.withColumnRenamed("a", "b"), "k", "a", "b").count() == 600 * 600 + 1


def test_lookup_join_splits_heavy_keys(spark):
    rows = spark.createDataFrame([("a", i) for i in range(90)] + [("b", 1), (None, 2)], "k string, v long")
    right = spark.createDataFrame([("a", 90, 1), ("b", 1, 2)], "k string, n long, code int")
    for parts in (1, 2, 10**6):
        assert Counter(r["code"] for r in skew.lookup_join(rows, right, "k", "n", 92, parts).collect()) == {1: 90, 2: 1}
