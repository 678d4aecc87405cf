import pandas as pd
from pyspark.sql import functions as F

from millrace.operators.aggregates import sum_of
from millrace.plans.batch import result
from millrace.plans.stream import GraphBuilder
from millrace.plans.window_spec import count_window, time_window
from millrace.sources.tables import generator_source
from millrace.streaming.runner import FAR_FUTURE, StreamEngine, compile_stream, count_windows, stream_source

SCHEMA = "i long, k long, value long, t long"


def files(spark, path, chunks):
    """One file per chunk, in order."""
    for n, rows in enumerate(chunks):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{n:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def run(spark, tmp_path, name, df):
    got = []
    engine = StreamEngine(spark, str(tmp_path / "state"))
    engine.submit(name, df, lambda batch, _: got.extend(batch.collect()))
    engine.execute()
    return got


def chunks():
    rows = [(i, i % 3, i + 1, 1000 + 10 * i + (7 * i) % 13) for i in range(60)]
    return [rows[:20], rows[20:45], rows[45:], [(999, 0, 0, FAR_FUTURE)]], rows


def test_time_windows_as_in_batch(spark, tmp_path):
    parts, rows = chunks()
    for size, advance in ((50, 50), (50, 20), (20, 50)):
        g = lambda df: GraphBuilder().source(df, "t", "i").filter(F.col("k") < 2).window(time_window(size, advance)).reduce(total=sum_of("value")).sink().build()  # noqa: B023, E731
        at = tmp_path / f"{size}-{advance}"
        stream = stream_source(files(spark, str(at / "in"), parts), "t", "i", lateness=20)
        graph = g(spark.createDataFrame(rows, SCHEMA))
        made = compile_stream(graph, {"source": stream})[graph.leaves()[0]]
        got = {(r.window_start, r.window_end, r.total) for r in run(spark, at, "w", made)}
        expected = {(r.window_start, r.window_end, r.total) for r in result(graph).collect()}
        assert got == expected


def test_interval_join_as_in_batch(spark, tmp_path):
    parts, rows = chunks()
    b = GraphBuilder()
    df = spark.createDataFrame(rows, SCHEMA)
    left, right = b.source(df, "t", "i", name="a"), b.source(df, "t", "i", name="b")
    graph = left.interval_join(right, F.col("k"), F.col("k"), -30, 40, x=F.col("l.i"), y=F.col("r.i")).sink().build()
    src = lambda n: stream_source(files(spark, str(tmp_path / n), parts[:3]), "t", "i", 20)
    made = compile_stream(graph, {"a": src("a"), "b": src("b")})[graph.leaves()[0]]
    got = sorted((r.x, r.y) for r in run(spark, tmp_path, "j", made))
    assert got == sorted((r.x, r.y) for r in result(graph).collect())


def test_count_windows_keep_open_rows(spark, tmp_path):
    parts, rows = chunks()
    stream = stream_source(files(spark, str(tmp_path / "in"), parts[:3]), "t", "i")
    total = lambda p: pd.DataFrame({"total": [int(p["value"].sum())]})
    made = count_windows(stream.select("value", "__seq", "__event_time"), count_window(10, 4), total, "total long")
    got = sorted((r.window_index, r.total) for r in run(spark, tmp_path, "c", made))
    values = [r[2] for r in rows]
    assert got == [(k, sum(values[4 * k : 4 * k + 10])) for k in range((60 - 10) // 4 + 1)]


def test_opaque_and_count_windows_of_a_graph(spark, tmp_path):
    parts, rows = chunks()
    df = spark.createDataFrame(rows, SCHEMA)
    text = lambda p: pd.DataFrame({"seen": [",".join(map(str, p["value"]))]})
    b = lambda: GraphBuilder().source(df, "t", "i")
    graph = b().window(time_window(100, 100)).reduce(text, "seen string").sink().build()
    src = stream_source(files(spark, str(tmp_path / "a"), parts), "t", "i", 20)
    got = {(r.window_end, r.seen) for r in run(spark, tmp_path, "o", compile_stream(graph, {"source": src})[3])}
    assert got == {(r.window_end, r.seen) for r in result(graph).collect()}
    graph = b().window(count_window(10, 10)).reduce(total=sum_of("value")).sink().build()
    src = stream_source(files(spark, str(tmp_path / "b"), parts[:3]), "t", "i")
    got = sorted((r.window_index, r.total, r["__ts"]) for r in run(spark, tmp_path, "n", compile_stream(graph, {"source": src})[3]))
    assert got == sorted((r.window_index, r.total, r["__ts"]) for r in result(graph).collect())


def test_sinks(spark, tmp_path):
    from millrace.sources import sinks

    df, seen = spark.range(5), []
    sinks.collecting(seen)(df)
    sinks.parquet_sink(str(tmp_path / "p"))(df)
    sinks.per_batch(sinks.parquet_sink(str(tmp_path / "p")))(df, 1)
    assert len(seen) == 5 and spark.read.parquet(str(tmp_path / "p")).count() == 10
    mark = str(tmp_path / "rows")
    sinks.each(lambda r: open(mark, "a").write(f"{r.id}\n"))(df)
    assert sorted(open(mark).read().split()) == list("01234")


def test_cancel(spark, tmp_path):
    engine = StreamEngine(spark, str(tmp_path))
    engine.cancel()
    assert not spark.streams.active


def test_generator_source(spark):
    spark.dataSource.register(generator_source("squares", "i long, square long", lambda lo, hi: ((i, i * i) for i in range(lo, hi)), 10))
    assert sorted(map(tuple, spark.read.format("squares").load().collect())) == [(i, i * i) for i in range(10)]
