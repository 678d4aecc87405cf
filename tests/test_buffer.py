from pyspark.sql import functions as F

from millrace.operators import buffer
from millrace.operators.ordering import ranked, running_max
from millrace.operators.rows import as_stream
from millrace.operators.watermark import least_watermark


def test_ranges(spark):
    df = as_stream(spark.createDataFrame([(i, 100 * i) for i in (3, 1, 5, 2, 4)], "i long, t long"), "t", "i")
    inside, rest = buffer.extract(df, 200, 400)
    assert sorted(r.t for r in inside.collect()) == [200, 300] and rest.count() == 3
    assert buffer.from_time(df.filter("t < 500"), 250).count() == 2
    same = as_stream(spark.createDataFrame([(1, 7), (2, 7), (3, 4)], "i long, t long"), "t", "i")
    assert [r.i for r in buffer.in_time_order(same).collect()] == [3, 2, 1]


def test_ranks_and_running_maxima(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"), ((F.col("id") * 31) % 97).alias("v"))
    rows = ranked(df, "x", total="n")
    assert [(r.x, r.rank, r.n) for r in rows.orderBy("x").collect()] == [(i, i, 1000) for i in range(1000)]
    values = {r.x: r.v for r in df.collect()}
    got = {r.x: r.m for r in running_max(df, "x", "v", "m", block=64).collect()}
    assert got == {i: max((values[j] for j in range(i)), default=None) for i in range(1000)}
    assert ranked(df.limit(0), "x").count() == 0


def test_least_watermark(spark):
    df = spark.createDataFrame([(3, 5), (None, 5), (4, None)], "a long, b long")
    assert [r.w for r in df.select(least_watermark(F.col("a"), F.col("b")).alias("w")).collect()] == [3, None, None]
    assert [r.w for r in df.select(least_watermark(F.col("a")).alias("w")).collect()] == [3, None, 4]
