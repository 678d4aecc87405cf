import json

import pytest
from pyspark.sql import functions as F

from millrace.operators.aggregates import count_of
from millrace.plans.batch import BatchEngine, compile_graph, result, results
from millrace.plans.graph import DataflowGraph, Edge, Node, validate
from millrace.plans.stream import GraphBuilder
from millrace.plans.window_spec import count_tumbling_window, time_tumbling_window


def source(spark, builder=None, name="source"):
    df = spark.createDataFrame([(i, i) for i in range(1, 6)], "i long, value long")
    return (builder or GraphBuilder()).source(df, "i", "i", name=name)


def test_linear_chain(spark):
    g = source(spark).map(value=F.col("value") * 10).filter(F.col("value") > 20).sink().build()
    assert (len(g.nodes), len(g.edges)) == (4, 3)
    assert (g.roots(), g.leaves(), g.topological_order()) == ([1], [4], [1, 2, 3, 4])
    assert sorted(r.value for r in result(g).collect()) == [30, 40, 50]
    assert g.op("map").id == 2 and g.op(3).kind == "Filter" and g.edge(0).target == 2
    with pytest.raises(KeyError):
        g.op("absent")
    with pytest.raises(KeyError):
        g.edge(9)


def test_join_shapes(spark):
    b = GraphBuilder()
    left, right = source(spark, b, "a"), source(spark, b, "b")
    k = F.col("value")
    g = left.window_join(right, k, k, time_tumbling_window(10), x=F.col("l.value")).sink().build()
    assert (len(g.nodes), len(g.edges)) == (4, 3)
    assert g.sources_of(3) == [1, 2] and g.in_degree_of(3) == 2 and g.out_degree_of(1) == 1
    b = GraphBuilder()
    s = source(spark, b)
    up, down = s.map(value=k + 1), s.filter(k > 1)
    g = up.interval_join(down, k, k, -5, 10, x=F.col("l.value")).sink().build()
    assert (len(g.nodes), len(g.edges)) == (5, 5)
    with pytest.raises(ValueError):
        up.interval_join(down, k, k, 3, 2, x=k)
    with pytest.raises(ValueError):
        up.window_join(down, k, k, count_tumbling_window(2), x=k)


def test_validation():
    assert validate([], []).errors == ("graph has no operators",)
    a, b = Node(1, "a", "Map"), Node(2, "b", "Map")
    assert validate([a], [])
    assert "cycle" in validate([a, b], [Edge(0, 1, 2), Edge(1, 2, 1)]).errors[0]
    assert "isn't in the graph" in validate([a], [Edge(0, 1, 7)]).errors[0]
    with pytest.raises(ValueError):
        DataflowGraph([], [])
    with pytest.raises(ValueError):
        GraphBuilder().build()


def test_watermark_only_on_sources(spark):
    s = source(spark)
    with pytest.raises(ValueError):
        s.map(value=F.col("value")).with_watermark(1)
    with pytest.raises(ValueError):
        source(spark).with_watermark(-1)


def test_printing(spark):
    g = source(spark).window(count_tumbling_window(2)).reduce(n=count_of()).window(count_tumbling_window(2)).reduce(n=count_of()).sink().build()
    assert [o["type"] for o in json.loads(g.to_json())["operators"]] == ["Source", "Window", "Window", "Sink"]
    assert g.to_graphviz().startswith("digraph") and "op1 -> op2" in g.to_graphviz()
    assert g.stages() == [[1, 2], [3], [4]] and g.channels() == [(2, 3), (3, 4)]
    assert len(json.loads(g.stages_to_json())["channels"]) == 2
    assert g.stages_to_graphviz().count("style=dashed") == 2


def test_fan_out_runs_every_branch(spark):
    s = source(spark)
    s.filter(F.col("value") > 3).sink(name="high")
    s.filter(F.col("value") <= 3).sink(name="low")
    g = s.build()
    assert {g.op(i).name: df.count() for i, df in results(g).items()} == {"high": 2, "low": 3}
    assert len(compile_graph(g)) == 5
    with pytest.raises(ValueError):
        result(g)


def test_limit_pulls_the_first_rows(spark):
    df = spark.createDataFrame([(i, i) for i in range(9, 0, -1)], "i long, value long")
    g = GraphBuilder().source(df, "i", "i", limit=4).map(value=F.col("value") * 10).filter(F.col("value") > 20).build()
    assert sorted(r.value for r in result(g).collect()) == [30, 40]


def test_engine_queues_more_graphs_than_slots(spark):
    seen = []
    engine = BatchEngine(slots=1)
    for _ in range(3):
        engine.submit(source(spark).sink(lambda df: seen.append(df.count())).build())
    assert engine.execute() == 3 and seen == [5, 5, 5]
    engine.submit(source(spark).sink(lambda df: seen.append(0)).build())
    engine.cancel()
    assert engine.execute() == 0 and len(seen) == 3
    failing = BatchEngine()
    failing.submit(source(spark).sink(lambda df: 1 / 0).build())
    with pytest.raises(ZeroDivisionError):
        failing.execute()
