import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.plans.slots import Slot, SlotManager
from millrace.plans.stream import GraphBuilder


def graph(spark, func):
    df = spark.createDataFrame([(i,) for i in range(5)], "i long")
    return GraphBuilder().source(df, "i", "i").sink(func).build()


def test_manager_runs_the_assigned_slots(spark):
    seen, manager = [], SlotManager(3)
    assert manager.slot_count == 3
    for i in (0, 2):
        manager.get_slot(i).assign(graph(spark, lambda df, i=i: seen.append((i, df.count()))))
    manager.start_all()
    for i in range(3):
        manager.get_slot(i).wait()
    assert sorted(seen) == [(0, 5), (2, 5)]
    assert [manager.get_slot(i).finished for i in range(3)] == [True, False, True]
    with pytest.raises(IndexError):
        manager.get_slot(3)
    with pytest.raises(ValueError):
        SlotManager(0)


def test_one_slot_is_stopped_while_another_goes_on(spark):
    begun, go = threading.Event(), threading.Event()

    def slow(df):
        begun.set()
        df.repartition(4).foreachPartition(lambda rows: time.sleep(120))

    def quick(df):
        go.wait(60)
        assert df.count() == 5

    a, b = Slot(), Slot()
    a.assign(graph(spark, slow))
    b.assign(graph(spark, quick))
    with pytest.raises(RuntimeError):
        Slot().start()
    a.start()
    b.start()
    assert begun.wait(60) and a.is_running
    with pytest.raises(RuntimeError):
        a.assign(graph(spark, quick))
    at = time.perf_counter()
    a.stop()
    assert time.perf_counter() - at < 60 and not a.is_running and not a.finished and a.error is None
    go.set()
    b.wait()
    assert b.finished and b.error is None
    a.assign(graph(spark, quick))
    a.start()
    a.wait()
    assert a.finished
    a.stop()


def test_stop_before_start_and_failure(spark):
    s = Slot()
    s.stop()
    s.assign(graph(spark, lambda df: 1 / 0))
    s.start()
    s.wait()
    assert isinstance(s.error, ZeroDivisionError) and not s.finished


def test_function_shapes(spark):
    df = spark.createDataFrame([(1, 1)], "i long, value long")
    s = GraphBuilder().source(df, "i", "i")

    def nothing(rows) -> None: ...
    def number(rows) -> int: ...
    def two(a, b): ...

    for make in (lambda: s.map(two, "x long"), lambda: s.map(nothing, "x long"), lambda: s.filter(two), lambda: s.filter(nothing), lambda: s.sink(number), lambda: s.sink(two), lambda: s.sink(3)):
        with pytest.raises(TypeError):
            make()
    with pytest.raises(TypeError):
        GraphBuilder().source(number, "i", "i")
    k = F.col("value")
    for args in ((two, k), (k, nothing)):
        with pytest.raises(TypeError):
            s.interval_join(s, *args, 0, 1, x=k)
    with pytest.raises(TypeError):
        s.interval_join(s, k, k, 0, 1, number, "x long")
    assert s.map(lambda rows, more=1: rows, "x long") and s.sink(print) and s.interval_join(s, k, k, 0, 1, two, "x long")
