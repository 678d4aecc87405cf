"""Window and interval joins: inner, one result per matching pair.

Expressions over a pair name its sides ``l.`` and ``r.``; event time of the result is ``ts``, by default
the later of the two. A pair carries the least of both watermarks, so windows over a join know late pairs
once both inputs have a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType, StructType

from millrace.operators.ordering import settled
from millrace.operators.rows import SEQ, TS, WM
from millrace.operators.watermark import least_watermark
from millrace.operators.windows import END, assign_time
from millrace.plans.window_spec import WindowSpec


Key = Column | str | Callable[[pd.DataFrame], pd.Series]
#: A join's result: columns by expression, or a function of the pairs' left and right rows with the schema of what it makes.
Made = dict[str, Column] | tuple[Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], str]
#: Bytes of the most that a broadcast edge shares; a larger input is joined by shuffling.
SHARED_BYTES = 64 << 20


def key_column(key: Key, names: list[str]) -> Column:
    """A join key: a column, its name, or a key selector, which gives a whole number for each row of an Arrow batch."""
    if isinstance(key, (str, Column)):
        return F.col(key) if isinstance(key, str) else key

    @F.pandas_udf("long")
    def select(rows: pd.DataFrame) -> pd.Series:
        return key(rows)

    return select(F.struct(*names))


def made_columns(pairs: DataFrame, made: Made, left: list[str], right: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """``pairs`` and the columns of the result; ``left`` and ``right`` name what a join function gets."""
    if isinstance(made, dict):
        return pairs, made
    func, schema = made

    @F.pandas_udf(StructType.fromDDL(schema))
    def make(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return func(a, b)

    side = lambda s, names: F.struct(*[F.col(f"{s}.{n}").alias(n) for n in names])
    pairs = pairs.withColumn("__made", make(side("l", left), side("r", right)))
    return pairs, {f.name: F.col(f"__made.{f.name}") for f in StructType.fromDDL(schema)}


def shared_if_small(df: DataFrame, most: int = SHARED_BYTES) -> DataFrame:
    """``df`` for every task, if its rows, written and counted first, take no more than ``most`` bytes."""
    rows = settled(df)
    wide = lambda f: not isinstance(f.dataType, AtomicType) or isinstance(f.dataType, (StringType, BinaryType))
    size = F.lit(0)
    for f in rows.schema:
        size = size + (F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) if wide(f) else F.lit(0)) + 16
    return F.broadcast(rows) if (rows.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else rows


def _result(pairs: DataFrame, made: Made, ts: Column | None, left: list[str], right: list[str]) -> DataFrame:
    pairs, columns = made_columns(pairs, made, left, right)
    at = ts.cast("long") if ts is not None else F.greatest(F.col(f"l.{TS}"), F.col(f"r.{TS}"))
    seq = F.greatest(F.col(f"l.{SEQ}"), F.col(f"r.{SEQ}"))
    return pairs.select(*[c.alias(n) for n, c in columns.items()], at.alias(TS), seq.alias(SEQ), least_watermark(F.col(f"l.{WM}"), F.col(f"r.{WM}")).alias(WM))


def window_join(left: DataFrame, right: DataFrame, left_key: Key, right_key: Key, spec: WindowSpec, made: Made, ts: Column | None = None, late: bool = False) -> DataFrame:
    """Pairs of equal keys in a common time window, once per window; hot keys are spread by window. ``l.window_end`` may be read."""
    if spec.kind != "time":
        raise ValueError("a window join needs a time window")
    a = assign_time(left.withColumn("__key", key_column(left_key, left.columns)), spec, late).alias("l")
    b = assign_time(right.withColumn("__key", key_column(right_key, right.columns)), spec, late).alias("r")
    return _result(a.join(b, (F.col("l.__key") == F.col("r.__key")) & (F.col(f"l.{END}") == F.col(f"r.{END}"))), made, ts, [*left.columns, END], [*right.columns, END])


def interval_join(left: DataFrame, right: DataFrame, left_key: Key, right_key: Key, lower: int, upper: int, made: Made, ts: Column | None = None) -> DataFrame:
    """Pairs of equal keys with r.ts in [l.ts + lower, l.ts + upper], both ends included.

    Both sides are dealt by key and time bucket of the interval's width, so a hot key is split over
    time and the range test meets two buckets per left row.
    """
    if lower > upper:
        raise ValueError("lower must not exceed upper")
    width = max(1, upper - lower)
    first, last = F.floor((F.col(TS) + lower) / width), F.floor((F.col(TS) + upper) / width)
    a = left.withColumn("__key", key_column(left_key, left.columns)).withColumn("__bucket", F.explode(F.sequence(first, last))).alias("l")
    b = right.withColumn("__key", key_column(right_key, right.columns)).withColumn("__bucket", F.floor(F.col(TS) / width)).alias("r")
    near = F.col(f"r.{TS}").between(F.col(f"l.{TS}") + lower, F.col(f"l.{TS}") + upper)
    return _result(a.join(b, (F.col("l.__key") == F.col("r.__key")) & (F.col("l.__bucket") == F.col("r.__bucket")) & near), made, ts, left.columns, right.columns)
