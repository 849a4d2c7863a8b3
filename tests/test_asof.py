import random

import pytest

from querent.operators.asof import asof_join


def brute(left, right):
    out = []
    for k, t, v in left:
        own = sorted((x[1], x[2]) for x in right if x[0] == k and x[1] is not None and t is not None and x[1] <= t)
        out.append((k, t, v, own[-1][1] if own else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_last_row_of_the_key_at_or_before(spark, partitions):
    rnd = random.Random(partitions)
    key = lambda: rnd.choice(["hot"] * 6 + ["a", "b", None, "only left" if rnd.random() < 0.5 else "z"])
    left = [(key(), rnd.choice([None, *range(60)]), k) for k in range(300)]
    right = [(key(), rnd.choice([None, *range(0, 60, 7)]), k) for k in range(60)] + [("only right", 3, 1)]
    a = spark.createDataFrame(left, "name string, t int, v int")
    b = spark.createDataFrame(right, "name string, t int, w int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = sorted(map(tuple, asof_join(a, b, ["name"], "t", ["w"]).collect()), key=repr)
        assert got == brute(left, right)
        assert sorted(map(tuple, asof_join(a, b.limit(0), ["name"], "t", ["w"]).collect()), key=repr) == brute(left, [])
        assert asof_join(a.limit(0), b, ["name"], "t", ["w"]).collect() == []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_without_a_key_and_clashing_names(spark):
    a = spark.createDataFrame([(k, k) for k in range(50)], "t int, v int")
    b = spark.createDataFrame([(k, -k) for k in range(0, 50, 10)], "t int, w int")
    assert sorted(map(tuple, asof_join(a, b, [], "t", ["w"]).collect())) == [(k, k, -(k // 10 * 10)) for k in range(50)]
    with pytest.raises(ValueError):
        asof_join(a, b, [], "t", ["t"])
