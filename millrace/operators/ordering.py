"""Arrival order on partitioned data: ranks and running maxima without a single-task sort.

Spark rows have no order of their own. A stream's arrival order is a column here; whatever depends on
it (count windows, watermarks) is computed from ranks over range-partitioned rows.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Least rows of a block in two-level runs. Past its square, blocks grow with the square root of the rows, and so does their number.
BLOCK = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session that names none gets a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="millrace-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut; it survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ranked(df: DataFrame, *keys: str | Column, name: str = "rank", total: str | None = None) -> DataFrame:
    """``df`` with ``name``: its 0-based place in the order of ``keys``; ``total`` names a column for the number of rows.

    Rows are range-partitioned and sorted, then written once (which fixes partitions and their order
    also when a task is repeated); each partition's first rank comes from the counts of those before
    it, one number per partition.
    """
    rows = df.withColumns({f"__k{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(keys)})
    order = [f"__k{i}" for i in range(len(keys))]
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).drop(*order)
    rows = settled(rows.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    first, before = [0] * (counts[-1][0] + 1 if counts else 1), 0
    for p, n in counts:
        first[p] = before
        before += n
    low = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    start = F.split(F.lit(",".join(map(str, first))), ",").cast("array<bigint>")  # one literal, also for very many partitions
    rows = rows.withColumn(name, low + start[part.cast("int")]).drop("__at")
    return rows.withColumn(total, F.lit(before).cast("long")) if total else rows


def _block(place: Column, total: Column, least: int) -> Column:
    return F.floor(place / F.greatest(F.lit(least), F.ceil(F.sqrt(total)))).cast("long")


def blocked(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """``df`` in the order of ``keys`` and ``order``, cut into blocks of rows.

    Adds ``__key`` (the keys as a struct, so that null keys join), ``__place`` (from 0 on, over all keys) and ``__block``. A
    hot key spans many blocks: what runs along a key runs inside (``__key``, ``__block``) and over one row per block.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    rows = ranked(df.withColumn("__key", key), "__key", *order, name="__place", total="__rows")
    return rows.withColumn("__block", _block(F.col("__place"), F.col("__rows"), BLOCK)).drop("__rows")


def running_max(df: DataFrame, order: str, value: str, name: str, block: int = BLOCK, total: str | None = None) -> DataFrame:
    """(order, name): the maximum of ``value`` over all rows before, by the dense integer ``order``; null for the first.

    Two levels: maxima of blocks of rows, whose running maximum is taken over one row per block, and the
    running maximum inside each block. ``total`` names a column with the number of rows, with which blocks grow.
    """
    rows = df.select(order, value, _block(F.col(order), F.col(total) if total else F.lit(0), block).alias("__block"))
    whole = rows.groupBy("__block").agg(F.max(value).alias("__max"))
    before = whole.select("__block", F.max("__max").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = F.max(value).over(Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__inside", inside).join(before, "__block").select(order, F.greatest("__inside", "__before").alias(name))
