from __future__ import annotations

from stockbook.llm import common as C


def test_hot_join_equals_a_plain_join(spark):
    rows = [(1, i) for i in range(900)] + [(i, i) for i in range(2, 60)] + [(None, 5)]
    left = spark.createDataFrame(rows, "k bigint, v bigint").repartition(5)
    right = spark.createDataFrame([(1, 900, "hot"), (2, 1, "b"), (3, 1, "c"), (999, 0, "none")],
                                  "k bigint, n bigint, name string")
    for how in ("left", "inner"):
        got = sorted(map(str, C.hot_join(left, right, ["k"], rows="n", how=how).collect()))
        want = sorted(map(str, left.join(right.drop("n"), ["k"], how).collect()))
        assert got == want
    none = right.limit(0)
    assert C.hot_join(left, none, ["k"], rows="n", how="left").count() == len(rows)


def test_split_by_keys_loses_nothing(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    keys = spark.range(0, 1000, 100).withColumnRenamed("id", "k")
    for buckets in (1, 7, 1 << 20):
        maybe, rest = C.split_by_keys(rows, keys, ["k"], buckets)
        assert maybe.count() + rest.count() == 1000
        assert maybe.join(keys, "k", "left_semi").count() == 10


def test_recent_cache_keeps_what_is_used():
    cache = C.RecentCache(3)
    for k in range(20):
        for x in cache.missing([k, "always"]):
            cache.young[x] = x
        assert cache.young["always"] == "always" and cache.young[k] == k
        cache.trim()
    assert len(cache.young) + len(cache.old) <= 8
