"""Packing by shortest-pack-first over the length histogram.

1. Every document's ids are cut into pieces of at most ``most`` (the last piece keeps the rest).
2. The histogram of piece lengths has at most ``most`` rows, whatever the corpus size. On it the
   driver places lengths longest first, each into the pack with the most room left, and only
   updates counts of packing patterns.
3. Pieces are ranked within their length by a range-partitioned sort (a hot length is split by a
   hash), and (length, rank) looks up its pattern, sequence and offset in the pattern table. That
   table is bounded: at most two patterns arise per length, and a pattern has under 65 distinct
   lengths.

Edge cases: null or empty text is one piece, the closing id; repeated rows are packed each on its
own; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import globally_ranked, settled, table
from millrace.llm.tokens import pieces

CONTEXT = 2048


def shortest_pack_first(histogram: dict[int, int], most: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``([(length, repeats), ...], count)``: how many sequences hold which lengths, longest first."""
    room: dict[int, list[list]] = {}  # open packs by the room that they have
    done: list[tuple[list[tuple[int, int]], int]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= most:
            raise ValueError(f"length {length} doesn't fit {most}")
        while left and room and (most_room := max(room)) >= length:
            packs = room[most_room]
            pattern, count = packs.pop()
            if not packs:
                del room[most_room]
            moved = min(left, count)
            if count > moved:
                room.setdefault(most_room, []).append([pattern, count - moved])
            grown = [*pattern[:-1], (length, pattern[-1][1] + 1)] if pattern[-1][0] == length else [*pattern, (length, 1)]
            left -= moved
            if most_room == length:
                done.append((grown, moved))
            else:
                room.setdefault(most_room - length, []).append([grown, moved])
        if left:
            if length == most:
                done.append(([(length, 1)], left))
            else:
                room.setdefault(most - length, []).append([[(length, 1)], left])
    return done + [(p, c) for r in sorted(room) for p, c in room[r]]


def pattern_table(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Sorted ranges: pieces of ``length`` with rank from ``rank`` on sit ``repeats`` to a sequence, from ``sequence`` and ``offset`` on."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length, repeats in pattern:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, repeats, sequence, offset))
            next_rank[length] = rank + count * repeats
            offset += length * repeats
        sequence += count
    rows.sort()
    return dict(zip(("length", "rank", "repeats", "sequence", "offset"), np.array(rows or np.empty((0, 5)), dtype=np.int64).T, strict=True))


def place(cut: DataFrame, most: int = CONTEXT) -> DataFrame:
    """``cut`` (rows with ``length``) with ``sequence_id`` and ``offset``. ``cut`` is written to the shared folder first, since it is read again."""
    cut = settled(cut)
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `most` rows
    ranges = pattern_table(shortest_pack_first(histogram, most))
    before = dict(zip(sorted(histogram), np.concatenate([[0], np.cumsum([histogram[k] for k in sorted(histogram)])[:-1]]).tolist(), strict=True)) if histogram else {}
    first = np.array([before.get(k, 0) for k in range(most + 1)], dtype=np.int64)
    names = cut.columns
    ranked = globally_ranked(cut, "length", F.xxhash64(*[c for c in names if c != "ids"]))
    start = np.searchsorted(ranges["length"], np.arange(most + 2))  # the ranges of each length
    shared = cut.sparkSession.sparkContext.broadcast((ranges, first, start))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema) + ", sequence_id long, offset long"

    def run(batches):
        r, first, start = shared.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False) - first[length]
            at = np.empty(len(length), dtype=np.int64)
            for k in np.unique(length):
                own = length == k
                at[own] = start[k] + np.searchsorted(r["rank"][start[k] : start[k + 1]], rank[own], "right") - 1
            into = rank - r["rank"][at]
            columns = [b.column(n) for n in names]
            columns += [pa.array(r["sequence"][at] + into // r["repeats"][at]), pa.array(r["offset"][at] + into % r["repeats"][at] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, most: int = CONTEXT, path: str | None = None, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text", special_as_text: bool = True) -> DataFrame:
    """Pieces of every document with their ``sequence_id`` and ``offset``; with ``with_ids`` also the ids themselves."""
    return place(pieces(docs, doc_id, text, most, path, with_ids, special_as_text), most)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op1_packing": op1_packing}
