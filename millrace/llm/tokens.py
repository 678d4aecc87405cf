"""Encoded lengths and pieces of documents under a public byte-level tokenizer.

The vocabulary file is a parameter (a ``tokenizers`` JSON file, by default the public 50k
byte-level BPE). Its vocabulary is read from that file and run by a faster engine that gives
the same ids; a text which that engine refuses (its pattern matcher has a stack limit) is
encoded by ``tokenizers`` itself. Special tokens' strings in a text are ordinary text, as in the notes of the
vocabulary files, unless ``special_as_text`` is set to False: then each is its one id, as ``tokenizers`` does by default.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The id that ends each document.
END_ID = 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The file writes each byte as one printable character: itself if printable, else the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.cache
def encoder(path: str | None = None, special_as_text: bool = True):
    """``encode(text) -> uint32 array`` for the vocabulary file; one per Python worker."""
    import tiktoken
    from tokenizers import Tokenizer

    path = path or default_path()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    chars = _byte_of_char()
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = special_as_text

    def encode(text: str) -> np.ndarray:
        if not special_as_text and any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        try:
            return np.array(fast.encode_ordinary(text), dtype=np.uint32)
        except BaseException as e:  # the engine's own panics aren't Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def _texts(column: pa.Array) -> Iterator[str]:
    """One text at a time, so that no batch of long texts is held twice."""
    for x in column:
        yield x.as_py() or ""


def encoded_lengths(docs: DataFrame, text: str = "text", path: str | None = None, special_as_text: bool = True) -> DataFrame:
    """One row ``n_tokens`` (int, with the closing id) per document."""

    def run(batches):
        encode = encoder(path, special_as_text)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) + 1 for t in _texts(b.column(0))], pa.int32())], ["n_tokens"])

    return docs.select(text).mapInArrow(run, "n_tokens int")


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 2048, path: str | None = None, with_ids: bool = False, special_as_text: bool = True) -> DataFrame:
    """Each document's ids and the closing id, cut into pieces of at most ``most``.

    Rows: doc_id, start, length, ids_crc32, doc_tokens, and ``ids`` if asked for.
    """
    fields = [pa.field("doc_id", pa.int64()), *(pa.field(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")), *[pa.field("ids", pa.list_(pa.int32()))] * with_ids]
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches):
        encode = encoder(path, special_as_text)
        for b in batches:
            rows: list[list] = [[] for _ in fields]
            for key, t in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                ids = np.append(encode(t), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), most):
                    part = ids[at : at + most]
                    for column, value in zip(rows, (key, at, len(part), zlib.crc32(part.tobytes()), len(ids), part.astype(np.int32)), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, fields, strict=True)], schema=pa.schema(fields))

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, ddl)


def length_table(lengths: DataFrame) -> DataFrame:
    """The exact histogram of ``n_tokens`` with its suffix sums: one row per length that occurs.

    For a context limit equal to the row's length: ``n_docs`` of exactly that length, ``n_docs_from``
    at least as long, ``n_tokens_from`` their tokens, ``whole_tokens`` of documents that fit,
    ``truncated_total`` tokens left when every document is cut at the limit, ``cut_docs`` that lose
    tokens, and ``share_within`` (the quantile that the limit is). A limit between two rows is
    answered from the next longer row ``r``: the same ``n_docs_from``, and ``truncated_total(r)`` less
    ``n_docs_from`` times the difference (``truncated_total`` does that).

    Counting is one shuffle of partial counts by length; the sums run over the histogram alone,
    whose size is the number of distinct lengths, however many documents there are. An empty
    table gives no rows; null texts count as empty (length 1, the closing id).
    """
    h = lengths.groupBy(F.col("n_tokens").cast("long").alias("context_limit")).agg(F.count("*").alias("n_docs"))
    from pyspark.sql import Window

    down = Window.orderBy(F.desc("context_limit")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, t = F.col("n_docs"), F.col("n_docs") * F.col("context_limit")
    h = h.withColumns({"n_docs_from": F.sum(n).over(down), "n_tokens_from": F.sum(t).over(down)})
    h = h.withColumns({"_docs": F.max("n_docs_from").over(whole), "total_tokens": F.max("n_tokens_from").over(whole)})
    limit = F.col("context_limit")
    return h.select(
        limit, n, "n_docs_from", "n_tokens_from", "total_tokens",
        (F.col("total_tokens") - F.col("n_tokens_from") + t).alias("whole_tokens"),
        (F.col("total_tokens") - F.col("n_tokens_from") + F.col("n_docs_from") * limit).alias("truncated_total"),
        (F.col("n_docs_from") - n).alias("cut_docs"),
        ((F.col("_docs") - F.col("n_docs_from") + n) / F.col("_docs")).alias("share_within"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> Column | int:
    """Tokens left when each document is cut at ``limit``, from the rows of ``length_table``."""
    row = histogram.filter(F.col("context_limit") >= limit).orderBy("context_limit").limit(1).collect()
    if row:
        return row[0].truncated_total - row[0].n_docs_from * (row[0].context_limit - limit)
    top = histogram.agg(F.max("total_tokens")).first()[0]
    return top or 0


def quantile(histogram: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of the documents don't exceed."""
    return histogram.filter(F.col("share_within") >= share).agg(F.min("context_limit")).first()[0]


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(encoded_lengths(table(spark, sf_dir, "documents")))


QUERIES = {"op7_token_counts": op7_token_counts}
