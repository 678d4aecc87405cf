import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from simulator import count_windows, time_windows, watermarks

from millrace.operators import ordering, watermark
from millrace.operators.aggregates import avg_of, count_of, max_of, min_of, sum_of
from millrace.operators.rows import as_stream
from millrace.plans.batch import result
from millrace.plans.stream import GraphBuilder
from millrace.plans.window_spec import WindowSpec, count_window, time_window


def stream(spark, rows):
    """Rows of (value, ts) in arrival order."""
    df = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(rows)], "i long, value long, t long")
    return GraphBuilder().source(df, "t", "i")


def sums(spark, rows, size, advance):
    out = result(stream(spark, rows).window(time_window(size, advance)).reduce(total=sum_of("value")).sink().build())
    return [(r.window_end, r.total) for r in out.orderBy("window_end").collect()]


@pytest.mark.parametrize(
    ("size", "advance", "rows", "totals"),
    [
        (5, 5, [(1, 0), (2, 3), (3, 7), (4, 9)], [3, 7]),
        (5, 1, [(1, i) for i in range(6)], [1, 2, 3, 4, 5, 5, 4, 3, 2, 1]),
        (10, 10, [(1, 15), (2, 5), (3, 10)], [2, 4]),
        (5, 5, [(1, 0), (2, 4)], [3]),
        (5, 5, [], []),
        (5, 1, [(1, 3)], [1] * 5),
    ],
)
def test_time_window_vectors(spark, size, advance, rows, totals):
    assert [t for _, t in sums(spark, rows, size, advance)] == totals


def test_window_end_and_clamp(spark):
    out = result(stream(spark, [(1, 3)]).window(time_window(5, 1)).reduce(n=count_of()).sink().build()).orderBy("window_end").collect()
    assert [(r.window_start, r.window_end) for r in out] == [(0, 4), (0, 5), (1, 6), (2, 7), (3, 8)]


@pytest.mark.parametrize(
    ("ts", "lateness", "interval", "expected"),
    [
        ([100, 200, 300], 0, 100, [300]),
        ([100, 200, 300], 0, 1, [100, 200, 300]),
        ([100, 200, 300], 50, 1, [50, 150, 250]),
        ([300, 100, 200], 0, 1, [300]),
        ([100, 200, 300, 400, 500], 0, 2, [200, 400, 500]),
        ([], 0, 1, []),
        ([10, 20], 50, 1, []),
    ],
)
def test_watermark_vectors(spark, ts, lateness, interval, expected):
    df = as_stream(spark.createDataFrame(list(enumerate(ts)), "i long, t long"), "t", "i")
    assert [r.watermark for r in watermark.emitted(df, lateness, interval).orderBy("at").collect()] == expected
    assert [x for kind, x in watermarks(ts, lateness, interval) if kind == "wm"] == expected


def test_demo(spark):
    rows = [(i, i) for i in range(1, 16)]
    out = result(stream(spark, rows).map(value=F.col("value") * 2).window(count_window(5, 5)).reduce(total=sum_of("value")).sink().build())
    assert [(r.total, r["__ts"]) for r in out.orderBy("__ts").collect()] == [(30, 5), (80, 10), (130, 15)]


@pytest.mark.parametrize("seed", range(8))
def test_late_time_windows_against_simulator(spark, seed):
    rng = random.Random(seed)
    n, interval, lateness = rng.randint(1, 60), rng.randint(1, 9), rng.randint(0, 12)
    size, advance = rng.randint(1, 20), rng.randint(1, 20)
    ts = [max(0, i + rng.randint(-15, 15)) for i in range(n)]
    skip = rng.choice([0, 0, 7])
    keep = [i for i in range(n) if i >= skip]
    steps = [s for s in watermarks(ts, lateness, interval) if s[0] == "wm" or s[1] in keep]
    expected = [(e, sum(i + 1 for i in rows)) for e, rows in time_windows(steps, ts, size, advance)]
    s = stream(spark, [(i + 1, t) for i, t in enumerate(ts)]).with_watermark(lateness, interval).filter(F.col("i") >= skip)
    out = result(s.window(time_window(size, advance)).reduce(total=sum_of("value")).sink().build())
    assert sorted((r.window_end, r.total) for r in out.collect()) == sorted(expected)


@pytest.mark.parametrize("seed", range(6))
def test_count_windows_against_simulator(spark, seed):
    rng = random.Random(100 + seed)
    n, size, advance = rng.randint(0, 40), rng.randint(1, 12), rng.randint(1, 15)
    expected = [(sum(w), min(w), len(w)) for w in count_windows(n, size, advance)]
    order = list(range(n))
    rng.shuffle(order)
    df = spark.createDataFrame([(i, i) for i in order], "i long, value long")
    s = GraphBuilder().source(df, "value", "i").window(count_window(size, advance))
    out = result(s.reduce(total=sum_of("value"), least=min_of("value"), n=count_of()).sink().build()).orderBy("window_index").collect()
    assert [(r.total, r.least, r.n) for r in out] == expected


def test_slices_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = [(rng.randint(-9, 9), rng.randint(0, 300)) for _ in range(200)]
    w = stream(spark, rows).window(time_window(60, 25))
    a = result(w.reduce(s=sum_of("value"), n=count_of(), lo=min_of("value"), hi=max_of("value"), m=avg_of("value")).build())
    w = stream(spark, rows).window(time_window(60, 25))
    b = result(w.reduce(s=F.sum("value"), n=F.count("value"), lo=F.min("value"), hi=F.max("value"), m=F.avg("value")).build())
    key = lambda df: sorted(map(tuple, df.drop("__wm").collect()))
    assert key(a) == key(b)


@pytest.mark.parametrize("late", [False, True])
def test_taking_rows_out_equals_plain_windows(spark, monkeypatch, late):
    monkeypatch.setattr(ordering, "BLOCK", 5)
    rng = random.Random(9)
    big = 1 << 61
    rows = [(i, rng.choice("abb"), rng.choice([None, None, -3, 5, 7]), rng.randint(0, 40) + i * 3 + (900 if i > 150 else 0)) for i in range(200)]
    rows += [(200 + i, "c", big, 5000 + 100 * i) for i in range(6)]

    def run(**aggs):
        s = GraphBuilder().source(spark.createDataFrame(rows, "i long, k string, value long, t long"), "t", "i")
        s = (s.with_watermark(10, 3) if late else s).key_by("k")
        return sorted(map(repr, result(s.window(time_window(100, 3)).reduce(**aggs).build()).drop("__wm").collect()))

    got = run(s=sum_of("value"), n=count_of("value"), m=avg_of("value"))
    assert got == run(s=F.sum("value"), n=F.count("value"), m=F.try_divide(F.sum("value"), F.count("value")))
    assert any("s=None" in r for r in got)


def test_function_sees_rows_in_order(spark):
    rows = [(1, 4), (2, 2), (3, 4), (4, 0)]
    text = lambda p: pd.DataFrame({"seen": [",".join(map(str, p["value"]))]})
    out = result(stream(spark, rows).window(time_window(5, 5)).reduce(text, "seen string").build())
    assert [r.seen for r in out.collect()] == ["4,2,3,1"]  # equal times: the latest arrival first
    out = result(stream(spark, rows).window(count_window(3, 3)).aggregate(text, "seen string").build())
    assert [r.seen for r in out.orderBy("window_index").collect()] == ["1,2,3", "4"]


def test_keys_sessions_and_rolling(spark):
    df = spark.createDataFrame([(0, "a", 1, 0), (1, "b", 2, 1), (2, "a", 3, 4), (3, "a", 5, 30), (4, "b", 7, 2)], "i long, k string, value long, t long")
    s = GraphBuilder().source(df, "t", "i").key_by("k")
    out = result(s.session(10, total=sum_of("value")).build())
    assert sorted((r.k, r.window_start, r.window_end, r.total) for r in out.collect()) == [("a", 0, 14, 4), ("a", 30, 40, 5), ("b", 1, 12, 9)]
    s = GraphBuilder().source(df, "t", "i").key_by("k")
    assert [r.x for r in result(s.rolling(x=sum_of("value")).build()).orderBy("i").collect()] == [1, 2, 4, 9, 9]
    s = GraphBuilder().source(df, "t", "i").key_by("k").window(count_window(2, 2)).reduce(total=sum_of("value"))
    assert sorted((r.k, r.window_index, r.total) for r in result(s.build()).collect()) == [("a", 0, 4), ("a", 1, 5), ("b", 0, 9)]


def test_map_of_time_keeps_the_source_watermark(spark):
    s = stream(spark, [(1, 10), (2, 20), (3, 5)]).with_watermark(0, 1).map(value=F.col("value"), ts=F.col("__ts") + 100)
    out = result(s.window(time_window(50, 50)).reduce(total=sum_of("value")).build())
    assert [(r.window_end, r.total) for r in out.orderBy("window_end").collect()] == [(150, 6)]


@pytest.mark.parametrize("bad", [(0, 1, "time"), (1, 0, "count"), (1, 1, "other")])
def test_bad_specs(bad):
    with pytest.raises(ValueError):
        WindowSpec(*bad)


def test_chained_windows(spark):
    s = stream(spark, [(i, i) for i in range(20)]).window(time_window(5, 5)).reduce(total=sum_of("value"))
    out = result(s.window(count_window(3, 3)).reduce(all=sum_of("total")).build())
    assert [r.all for r in out.orderBy("window_index").collect()] == [sum(range(15)), sum(range(15, 20))]


def test_hot_keys_run_in_blocks(spark, monkeypatch):
    """One key holds most rows and spans many blocks; null and NaN are keys of their own, both zeros are one."""
    monkeypatch.setattr(ordering, "BLOCK", 7)
    rng = random.Random(3)
    keys = [rng.choice([1.0] * 6 + [2.0, float("nan"), None, 0.0, -0.0]) for _ in range(300)]
    rows = [(i, k, rng.choice([None, *range(-5, 6)]), i // 3 * rng.choice([1, 1, 1, 2])) for i, k in enumerate(keys)]
    shown = lambda k: repr(None if k is None else k + 0.0)
    by_key = {}
    for r in rows:
        by_key.setdefault(shown(r[1]), []).append(r)
    source = lambda: GraphBuilder().source(spark.createDataFrame(rows, "i long, k double, value long, t long"), "t", "i").key_by("k")
    total = lambda values: sum(v for v in values if v is not None) if any(v is not None for v in values) else None

    out = result(source().rolling(s=sum_of("value"), n=count_of("value"), hi=max_of("value")).build())
    got = {r.i: (r.s, r.n, r.hi) for r in out.collect()}
    for part in by_key.values():
        for at, r in enumerate(part, 1):
            known = [x[2] for x in part[:at] if x[2] is not None]
            assert got[r[0]] == (total(known), len(known), max(known, default=None))
    assert len(got) == len(rows)

    out = result(source().window(count_window(4, 4)).reduce(s=sum_of("value"), n=count_of()).build()).collect()
    assert sorted((shown(r.k), r.window_index, r.n, repr(r.s)) for r in out) == sorted((k, i, len(p[4 * i : 4 * i + 4]), repr(total([x[2] for x in p[4 * i : 4 * i + 4]]))) for k, p in by_key.items() for i in range((len(p) + 3) // 4))

    expected = []
    for k, part in by_key.items():
        part, open_ = sorted(part, key=lambda r: (r[3], r[0])), []
        for r in [*part, None]:
            if open_ and (r is None or r[3] - open_[-1] >= 3):
                expected.append((k, open_[0], open_[-1] + 3, len(open_)))
                open_ = []
            if r:
                open_.append(r[3])
    out = result(source().session(3, n=count_of()).build()).collect()
    assert sorted((shown(r.k), r.window_start, r.window_end, r.n) for r in out) == sorted(expected)


def test_rolling_and_sessions_without_keys(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 2)
    s = stream(spark, [(1, 0), (2, 1), (4, 9), (8, 10), (16, 30)])
    assert [r.x for r in result(s.rolling(x=sum_of("value")).build()).orderBy("i").collect()] == [1, 3, 7, 15, 31]
    s = stream(spark, [(1, 0), (2, 1), (4, 9), (8, 10), (16, 30)])
    assert sorted((r.window_start, r.x) for r in result(s.session(5, x=sum_of("value")).build()).collect()) == [(0, 3), (9, 12), (30, 16)]


def test_updates_leave_late_rows_out(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 2)
    rows = [(1, 0), (2, 4), (4, 12), (8, 3), (16, 13), (32, 15)]
    s = stream(spark, rows).with_watermark(0, 1).window(time_window(10, 10))
    out = result(s.updates(retract=True, total=sum_of("value")).build())
    got = sorted((r.window_end, r.firing, r.change, r.total) for r in out.collect())
    assert got == [(10, 0, 1, 1), (10, 1, -1, 1), (10, 1, 1, 3), (20, 0, 1, 4), (20, 1, -1, 4), (20, 1, 1, 20), (20, 2, -1, 20), (20, 2, 1, 52)]


@pytest.mark.parametrize(("allowed", "every", "purge"), [(0, 1, False), (6, 1, False), (6, 2, False), (25, 2, True), (100, 1, True)])
def test_late_updates(spark, monkeypatch, allowed, every, purge):
    monkeypatch.setattr(ordering, "BLOCK", 5)
    rng = random.Random(allowed + every)
    rows = [(i, max(0, i // 2 - rng.choice([0, 0, 1, 5, 12, 20]))) for i in range(120)]
    s = stream(spark, rows).with_watermark(1, 3).window(time_window(10, 5))
    out = result(s.updates(every, purge=purge, allowed=allowed, total=sum_of("value"), n=count_of()).build()).collect()
    parts, top, wm = {}, None, None
    for i, (value, t) in enumerate(rows):
        if i and i % 3 == 0 and top >= 1:
            wm = top - 1
        for e in range(5, 200, 5):
            if max(0, e - 10) <= t < e and (wm is None or e + allowed > wm):
                parts.setdefault(e, ([], []))[wm is not None and e <= wm].append(value)
        top = t if top is None else max(top, t)
    expected = []
    for e, (timely, late) in parts.items():
        held = list(timely)
        if timely:
            expected.append((e, 0, sum(held), len(held)))
        for k in range(0, len(late), every):
            held = late[k : k + every] if purge else held + late[k : k + every]
            expected.append((e, k // every + 1, sum(held), len(held)))
    assert sorted((r.window_end, r.firing, r.total, r.n) for r in out) == sorted(expected)
    assert any(f for _, f, _, _ in expected) == (allowed > 0)
