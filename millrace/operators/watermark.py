"""Watermarks of a bounded stream in closed form, and the lateness that follows from them.

A source emits max(ts) - lateness after every ``interval`` rows, if that is at least 0 and above its
last watermark, and once more at the end if rows came since. A row therefore meets the watermark of the
last multiple of ``interval`` before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import ranked, running_max, settled
from millrace.operators.rows import SEQ, TS, WM


def _blocks(df: DataFrame, interval: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their block of ``interval`` arrivals, and per block the largest event time up to its start."""
    rows = ranked(df, SEQ, name="__i", total="__all").withColumn("__b", F.floor(F.col("__i") / interval))
    top = rows.groupBy("__b", F.ceil(F.col("__all") / interval).alias("__blocks")).agg(F.max(TS).alias("__top"), F.count("*").alias("__n"))
    return rows.drop("__all"), running_max(top, "__b", "__top", "__before", total="__blocks").join(top, "__b")


def stamp(df: DataFrame, lateness: int = 0, interval: int = 100) -> DataFrame:
    """``df`` with ``__wm``: the watermark in force when each row arrives."""
    if lateness < 0 or interval < 1:
        raise ValueError("lateness must not be negative, interval must be positive")
    rows, blocks = _blocks(df, interval)
    wm = F.when(F.col("__before") >= lateness, F.col("__before") - lateness)
    return rows.join(blocks.select("__b", wm.alias("__new")), "__b").withColumn(WM, F.col("__new")).drop("__b", "__i", "__new")


def emitted(df: DataFrame, lateness: int = 0, interval: int = 100) -> DataFrame:
    """The watermarks that the source emits, in order: (at, watermark), ``at`` the number of rows before."""
    rows, blocks = _blocks(df, interval)
    upto = F.greatest("__before", "__top")
    b = blocks.withColumn("at", F.col("__b") * interval + F.col("__n")).withColumn("watermark", F.when(upto >= lateness, upto - lateness)).filter("watermark IS NOT NULL")
    b = settled(ranked(b.select("at", "watermark"), "at", name="__i", total="__all"))
    last = running_max(b, "__i", "watermark", "__last", total="__all")
    return b.join(last, "__i").filter("__last IS NULL OR watermark > __last").select("at", "watermark")


def in_force(df: DataFrame) -> Column:
    """The watermark that a window meets at a row: those before the first row that reaches the window don't count."""
    head = df.agg(F.min(F.struct(SEQ, WM)).getField(WM)).scalar()  # a scalar subquery: nothing runs while the plan is made
    return F.when(head.isNull() | (F.col(WM) > head), F.col(WM))


def least_watermark(*watermarks: Column) -> Column:
    """The watermark of several inputs: the least, and none while one of them has none."""
    known = [w.isNotNull() for w in watermarks]
    every = known[0]
    for k in known[1:]:
        every = every & k
    return F.when(every, F.least(*watermarks) if len(watermarks) > 1 else watermarks[0])
