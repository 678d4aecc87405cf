import random

import pytest
from pyspark.sql import functions as F

from millrace.plans.batch import result
from millrace.plans.stream import GraphBuilder
from millrace.plans.window_spec import time_window


def two(spark, a, b):
    g = GraphBuilder()
    make = lambda rows, name: g.source(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, k long, t long"), "t", "i", name=name)
    return make(a, "a"), make(b, "b")


@pytest.mark.parametrize("seed", range(4))
def test_interval_join(spark, seed):
    rng = random.Random(seed)
    a = [(rng.randint(0, 2), rng.randint(0, 60)) for _ in range(40)]
    b = [(rng.randint(0, 2), rng.randint(0, 60)) for _ in range(40)]
    lower = rng.randint(-10, 5)
    upper = lower + rng.randint(0, 10)
    s, r = two(spark, a, b)
    out = result(s.interval_join(r, F.col("k"), F.col("k"), lower, upper, x=F.col("l.i"), y=F.col("r.i")).build())
    expected = [(i, j) for i, (k, t) in enumerate(a) for j, (m, u) in enumerate(b) if k == m and t + lower <= u <= t + upper]
    assert sorted((p.x, p.y) for p in out.collect()) == sorted(expected)


@pytest.mark.parametrize(("size", "advance"), [(10, 10), (12, 5), (3, 8)])
def test_window_join(spark, size, advance):
    rng = random.Random(size)
    a = [(rng.randint(0, 2), rng.randint(0, 60)) for _ in range(30)]
    b = [(rng.randint(0, 2), rng.randint(0, 60)) for _ in range(30)]
    s, r = two(spark, a, b)
    out = result(s.window_join(r, F.col("k"), F.col("k"), time_window(size, advance), x=F.col("l.i"), y=F.col("r.i"), e=F.col("l.window_end")).build())
    ends = range(advance, 100, advance)
    inside = lambda t, e: max(0, e - size) <= t < e
    expected = [(i, j, e) for e in ends for i, (k, t) in enumerate(a) for j, (m, u) in enumerate(b) if k == m and inside(t, e) and inside(u, e)]
    assert sorted((p.x, p.y, p.e) for p in out.collect()) == sorted(expected)


def test_result_time(spark):
    s, r = two(spark, [(1, 5)], [(1, 9)])
    j = s.interval_join(r, F.col("k"), F.col("k"), 0, 10, x=F.col("l.i"))
    assert [p["__ts"] for p in result(j.build()).collect()] == [9]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_broadcast_edges_are_checked(spark, monkeypatch, most):
    from millrace.operators import joins

    monkeypatch.setattr(joins.shared_if_small, "__defaults__", (most,))
    rng = random.Random(9)
    a, b = ([(rng.randint(0, 2), rng.randint(0, 30)) for _ in range(20)] for _ in range(2))
    s, r = two(spark, a, b)
    g = s.interval_join(r.broadcast(), lambda p: p["k"], "k", -3, 3, x=F.col("l.i"), y=F.col("r.i")).build()
    assert [e.partition for e in g.edges] == ["Forward", "Broadcast"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = result(g)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (most > 0)
        found = sorted((p.x, p.y) for p in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == sorted((i, j) for i, (k, t) in enumerate(a) for j, (m, u) in enumerate(b) if k == m and -3 <= u - t <= 3)


def test_join_function(spark):
    s, r = two(spark, [(1, 5), (2, 6)], [(1, 9), (1, 7)])
    pair = lambda a, b: a.assign(x=a["i"] * 10 + b["i"], e=b["window_end"])[["x", "e"]]
    j = s.window_join(r, lambda p: p["k"] + 1, lambda p: p["k"] + 1, time_window(10, 10), pair, "x long, e long")
    assert sorted((p.x, p.e, p["__ts"]) for p in result(j.build()).collect()) == [(0, 10, 9), (1, 10, 7)]


def test_parallelism(spark):
    s = GraphBuilder().source(spark.createDataFrame([(i, i % 3) for i in range(50)], "i long, k long"), "i", "i")
    g = s.filter(F.col("i") >= 0).with_parallelism(5).key_by("k").map(k=F.col("k")).with_parallelism(3).build()
    out = result(g)
    assert out.rdd.getNumPartitions() == 3 and out.select("k", F.spark_partition_id().alias("p")).distinct().count() == 3  # a key is in one partition
    with pytest.raises(ValueError):
        s.with_parallelism(0)
