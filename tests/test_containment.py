"""The multi-pattern join against ``in`` for every pair."""

from collections import Counter

import numpy as np
import pytest

from metercast.operators.containment import containment_join


def brute(texts, patterns):
    return Counter((k, p) for k, t in texts for p, w in patterns if t is not None and w is not None and w in t)


@pytest.mark.parametrize("size", [{}, {"group_bytes": 12_000}, {"group_patterns": 30}])
def test_pairs_equal_contains(spark, size):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abé😀 "), n))
    texts = [(k, word(int(rng.integers(0, 200)))) for k in range(150)] + [(None, "ab ab"), (7, "ab"), (7, "ab"), (900, None), (901, ""), (902, "a" * 50_000)]
    patterns = [(f"p{k}", word(int(rng.integers(1, 6)))) for k in range(60)] + [("all", ""), ("none", None), (None, "ab"), ("p1", "aa"), ("p1", "aa"),
                                                                                 ("long", "a" * 30_000), ("é", "é😀")]
    t = spark.createDataFrame([(k, x, 1) for k, x in texts], "id long, text string, pid int").repartition(4)
    p = spark.createDataFrame([(k, x, 2) for k, x in patterns], "pid string, text string, id int")
    got = Counter(tuple(r) for r in containment_join(t.select("id", "text"), p.select("pid", "text"), "id", "text", "pid", "text", **size).collect())
    assert got == brute(texts, patterns)


def test_empty_sides(spark):
    t = spark.createDataFrame([(1, "abc")], "id long, text string")
    p = spark.createDataFrame([("x", "b")], "pid string, pattern string")
    assert containment_join(t.limit(0), p, "id", "text", "pid", "pattern").count() == 0
    assert containment_join(t, p.limit(0), "id", "text", "pid", "pattern").count() == 0
    assert containment_join(t, p.where("pid IS NULL"), "id", "text", "pid", "pattern").count() == 0
    assert [tuple(r) for r in containment_join(t, p, "id", "text", "pid", "pattern").collect()] == [(1, "x")]
    with pytest.raises(ValueError):
        containment_join(t, p.withColumnRenamed("pid", "id"), "id", "text", "id", "pattern")
