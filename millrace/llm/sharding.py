"""Sharding by Hilbert-curve order: rows near in several metadata dimensions share a shard.

1. Each dimension is quantised to ``BITS`` bits, in its own order: numbers by their place between
   approximate quantiles (so a skewed size fills the range evenly), names by their rank.
2. The Hilbert index of the quantised point orders the rows; equal points are ordered by the text's
   hash, then the id's, so a hot point (a source with a third of all rows) still spreads over partitions.
3. The global order is cut into runs. Under the law ``rows`` the runs' counts differ by one at most.

Each shard's files then hold short ranges in every dimension, so readers can prune on any of them.

Edge cases: a null text has no bytes; null dimensions take the lowest cell; repeated rows each get a
slot of their own; fewer rows than shards leave shards empty; an empty table gives no rows; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import globally_ranked, settled, table

BITS, SHARDS, MOST_NAMES = 8, 24, 100_000


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows) with ``bits`` bits a dimension.

    The known bit-plane method: undo excess rotations and reflections from the highest plane
    down, Gray-encode across the dimensions, then interleave the planes.
    """
    x = points.T.astype(np.uint64).copy()
    n = len(x)
    for plane in range(bits - 1, 0, -1):
        q = np.uint64(1 << plane)
        low = q - np.uint64(1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        q = np.uint64(1 << plane)
        flip ^= np.where((x[n - 1] & q) != 0, q - np.uint64(1), np.uint64(0))
    x ^= flip
    index = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << np.uint64(1)) | ((x[i] >> np.uint64(plane)) & np.uint64(1))
    return index.astype(np.int64)


def by_quantile(df: DataFrame, name: str, bits: int = BITS) -> Column:
    """The cell of a number among 2**bits cells of about equal counts; one pass of mergeable summaries over all rows."""
    cells = 1 << bits
    cuts = df.stat.approxQuantile(name, [i / cells for i in range(1, cells)], 0.25 / cells)

    @F.pandas_udf("long")
    def cell(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.unique(cuts), values.fillna(-np.inf).to_numpy(), "right").astype(np.int64))

    return cell(F.col(name).cast("double"))


def by_order(df: DataFrame, name: str, cell: str, bits: int = BITS) -> DataFrame:
    """``df`` with ``cell``: the place of a name among its sorted distinct values, spread over 2**bits cells; 0 for null.

    Cells keep the order of the names, so that a shard's least and largest name bound a short range. The distinct
    names are ranked as a table and joined back, by broadcast up to ``MOST_NAMES`` of them.
    """
    names = globally_ranked(df.select(F.col(name).alias("_name")).filter("_name IS NOT NULL").distinct(), "_name", name="_place", total="_names")
    names = names.select("_name", F.expr(f"_place * {1 << bits}L div _names").alias(cell))
    few = names.count() <= MOST_NAMES
    return df.join(F.broadcast(names) if few else names, F.col(name) == F.col("_name"), "left").drop("_name").withColumn(cell, F.coalesce(cell, F.lit(0).cast("long")))


def hilbert_order(df: DataFrame, dimensions: list[Column], *ties: Column, bits: int = BITS) -> DataFrame:
    """``df`` with ``rank`` along the curve through the dimensions' cells (integers below 2**bits)."""

    @F.pandas_udf("long")
    def index(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(np.clip(cells.to_numpy(), 0, (1 << bits) - 1), bits))

    cells = F.struct(*[F.coalesce(d, F.lit(0)).cast("long").alias(f"d{i}") for i, d in enumerate(dimensions)])
    rows = df.withColumn("_curve", index(cells))
    return globally_ranked(rows, "_curve", *ties).drop("_curve")


def cut_runs(ranked: DataFrame, total: int, shards: int) -> DataFrame:
    """``shard`` and ``slot``: runs of the order whose counts differ by one at most."""
    shard = F.expr(f"cast((rank * {shards}L) div {max(total, 1)}L as int)")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, lang, source with shard and slot, ordered by size, source and language; equal texts of one cell lie together."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "lang", "source", F.xxhash64(text).alias("_text"))
    rows = settled(rows)  # read again for the cells and the order; the texts are read once
    size = by_quantile(rows, "size", bits)
    rows = by_order(by_order(rows, "source", "_source", bits), "lang", "_lang", bits)
    ranked = hilbert_order(rows, [size, F.col("_source"), F.col("_lang")], F.col("_text"), F.xxhash64("doc_id"), bits=bits).drop("_source", "_lang", "_text")
    return cut_runs(ranked, ranked.count(), shards)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shard_documents(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_sharding": op9_sharding}
