"""Suffix-array deduplication of exact repeats, bucket by bucket, with difference-cover ranks.

Every byte is removed that lies in a string of ``LENGTH`` bytes which also starts anywhere else in
the corpus, the same document included. Only the order of suffixes up to ``LENGTH`` bytes matters, so
the suffixes are sorted bucket by bucket and no array over the whole corpus is ever held:

1. Anchors. Each window of ``LENGTH`` bytes has an anchor, the place of its least ``GRAM``-byte hash.
   Equal windows have equal anchors, and neighbouring windows mostly share one, so a document is a
   short list of runs of windows, each with a 128-bit digest of its bytes. A run whose anchor occurs
   once cannot repeat and is done; runs of equal bytes repeat and are done too.
2. Buckets. Where an anchor has several different runs, one run of each kind travels with its bytes
   (about two bytes per suffix) to the bucket of the anchor. So a passage that very many rows share
   comes once, however many they are.
3. Sorting. A task takes its buckets one after the other, about ``CHUNK`` bytes at a time. Suffixes
   are first grouped by their first and last bytes. Long ties are resolved by cover ranks: positions of
   a difference cover are ranked beforehand by their next bytes. Any two tied suffixes reach cover
   positions at one common shift below the cover's period, so each comparison costs two lookups, and
   partitioning around pivots, all ties at once, sorts them. Groups are formed by fingerprints and
   verified on all their bytes.
4. Large buckets. An anchor with more than ``BUCKET`` different runs is refined by deeper bytes: its
   windows are cut into pieces of ``PIECE`` windows by their place relative to the anchor, and pieces
   meet by a digest of the bytes that all windows of the piece share (a prefix of 385 bytes instead
   of 32). What is left of a window then is less than ``PIECE`` bytes on either side, compared as bytes.

No call holds more than CHUNK + BUCKET * 768 bytes of text. Texts of any length are read in blocks.

Edge cases: null and short texts lose nothing; rows with equal texts are occurrences of each
other, whatever their ids; a text without break (one letter, one period) is handled as any other; an
empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bytehash import U, byte_slices, mix, powers, prefix_hashes, substring_hash
from millrace.llm.common import settled, table

#: COVER: the cover of period 73 with ten residues.
LENGTH, GRAM, COVER, CHUNK, BUCKET, PIECE = 400, 32, 1, 1 << 19, 1024, 16
_TEXT = ["h1", "h2"]
_PLACE_BITS = 28


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """A period 24 r**2 + 36 r + 13 and 6 r + 4 residues whose differences cover all residues (Colbourn and Ling)."""
    gaps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate([[0], np.cumsum(gaps)])


@functools.cache
def _shifts(r: int) -> tuple[np.ndarray, np.ndarray]:
    """Membership by residue, and for two residues the least shift that brings both into the cover."""
    period, cover = difference_cover(r)
    member = np.zeros(period, dtype=bool)
    member[cover] = True
    shift = np.full((period, period), -1, dtype=np.int64)
    at = np.arange(period)
    for d in range(period - 1, -1, -1):
        both = member[(at + d) % period][:, None] & member[(at + d) % period][None, :]
        shift[both] = d
    if (shift < 0).any():
        raise ValueError(f"no difference cover for {period}")
    return member, shift


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, row, place of the anchor, hash of its gram. Under 2**28 bytes."""
    empty = np.empty(0, dtype=np.int64)
    width = length - GRAM + 1
    if len(data) < length:
        return empty, empty, empty, empty, np.empty(0, dtype=np.uint64)
    n = len(data) - length + 1
    prefix = prefix_hashes(data)
    grams = (prefix[GRAM:] - prefix[:-GRAM]) * powers(len(prefix))[1][: len(data) - GRAM + 1]
    del prefix
    keys = (grams ^ (grams >> U(32))) * U(0x9E3779B97F4A7C15)
    keys &= ~U((1 << _PLACE_BITS) - 1)
    keys |= np.arange(len(keys), dtype=np.uint64)
    padded = np.full(-(-len(keys) // width) * width, ~U(0), dtype=np.uint64)
    padded[: len(keys)] = keys
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(length, length + n) <= offsets[row + 1]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(start)
    total = np.concatenate([[0], np.cumsum(inside)])
    count = np.diff(np.append(total[first], total[-1]))
    return first, count, row[first], anchor[first], mix(grams[anchor[first]])


def _digests(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of ``data[lo:hi]``, as two integers."""
    view = memoryview(np.ascontiguousarray(data))
    out = b"".join(hashlib.blake2b(view[a:z], digest_size=16).digest() for a, z in zip(lo.tolist(), hi.tolist(), strict=True))
    pairs = np.frombuffer(out, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _blocks(data: np.ndarray, offsets: np.ndarray, length: int):
    """The bytes in blocks of bounded size with their offsets and place: as they are, or overlapping pieces of one long text, a window in one of them."""
    step = 2 * CHUNK
    if len(data) <= step + length or len(offsets) > 2:
        yield data, offsets, 0
        return
    for at in range(0, len(data) - length + 1, step):
        part = data[at : at + step + length - 1]
        yield part, np.array([0, len(part)]), at


def _anchored(rows: DataFrame, length: int) -> DataFrame:
    """(h1, h2, runs): per row its text's kinds of runs, each an anchor a, a digest c1, c2 of its bytes, its number of windows and its first windows."""
    kinds = (("a", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int32()))

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in byte_slices(b, 2, CHUNK):
                parts = []
                for part, edges, at in _blocks(data, offsets, length):
                    first, count, row, _, anchor = _runs(part, edges, length)
                    c1, c2 = _digests(part, first, first + count - 1 + length)
                    parts.append((row, anchor.astype(np.int64), c1, c2, count, at + first - edges[row]))
                parts = [np.concatenate(x) for x in zip(*parts, strict=True)]
                order = np.lexsort((parts[5], parts[3], parts[2], parts[0]))
                row, *columns, start = (x[order] for x in parts)
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])
                starts = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(row)).astype(np.int32)), pa.array(start, pa.int32()))
                runs = pa.StructArray.from_arrays([*(pa.array(x[new], k) for x, (_, k) in zip(columns, kinds, strict=True)), starts], [*(k for k, _ in kinds), "starts"])
                ends = np.searchsorted(row[new], np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), runs)], ["h1", "h2", "runs"])

    return rows.select(*_TEXT, "text").mapInArrow(run, "h1 long, h2 long, runs array<struct<a:long,c1:long,c2:long,n:int,starts:array<int>>>")


def _marked_texts(batches, keep):
    """(h1, h2, bytes, marks that ``keep``) of each text that has marks, once per task as far as memory of the last texts goes."""
    done: set[tuple[int, int]] = set()
    for b in batches:
        h1, h2 = b.column("h1").to_pylist(), b.column("h2").to_pylist()
        for lo, hi, data, offsets in byte_slices(b, b.schema.get_field_index("text"), CHUNK):
            for i in range(lo, hi):
                if (h1[i], h2[i]) not in done:
                    if len(done) >= 10_000:
                        done.clear()
                    done.add((h1[i], h2[i]))
                    yield h1[i], h2[i], data[offsets[i - lo] : offsets[i - lo + 1]], [m for m in b.column("marks")[i].as_py() if m["large"] == keep]


def _in_batches(rows, schema: pa.Schema, bytes_of, most: int = 4 << 20):
    """Record batches of tuples, of about ``most`` bytes each."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + bytes_of(r)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _carry(marked: DataFrame, length: int) -> DataFrame:
    """The marked runs of buckets of bounded size, with their bytes."""
    schema = pa.schema([("bucket", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("multi", pa.bool_()), ("bytes", pa.binary())])

    def rows(batches):
        for h1, h2, data, marks in _marked_texts(batches, False):
            for m in marks:
                yield m["a"], h1, h2, m["start"], m["n"], m["multi"], data[m["start"] : m["start"] + m["n"] - 1 + length].tobytes()

    def run(batches):
        yield from _in_batches(rows(batches), schema, lambda r: len(r[-1]))

    return marked.mapInArrow(run, "bucket long, h1 long, h2 long, start int, n int, multi boolean, bytes binary")


def _pieces(marked: DataFrame, length: int) -> DataFrame:
    """The marked runs of large buckets as pieces of up to ``PIECE`` windows.

    The windows of a piece lie ``PIECE`` * j + i bytes before the anchor, for one j and i from ``i0`` to ``i1``. All of them
    hold the ``core`` (its digest, with the anchor and j: k1, k2); the i-th holds the last i bytes of ``left`` before it
    and the first PIECE - 1 - i bytes of ``right`` behind it. ``start`` is the window of i1.
    """
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("i0", pa.int32()), ("i1", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("multi", pa.bool_())])

    def rows(batches):
        for h1, h2, data, marks in _marked_texts(batches, True):
            for m in marks:
                text = np.ascontiguousarray(data[m["start"] : m["start"] + m["n"] - 1 + length])
                at = int(_runs(text, np.array([0, len(text)]), length)[3][0])
                raw = text.tobytes()
                for j in range((at - m["n"] + 1) // PIECE, at // PIECE + 1):
                    i0, i1 = max(0, at - m["n"] + 1 - PIECE * j), min(PIECE - 1, at - PIECE * j)
                    lo, hi = at - PIECE * j, at - PIECE * j - PIECE + 1 + length
                    key = hashlib.blake2b(raw[lo:hi] + b"%d %d" % (m["a"], j), digest_size=16).digest()
                    k1, k2 = np.frombuffer(key, dtype=np.int64).tolist()
                    yield k1, k2, i0, i1, raw[lo - i1 : lo], raw[hi : hi + PIECE - 1 - i0], h1, h2, m["start"] + lo - i1, m["multi"]

    def run(batches):
        yield from _in_batches(rows(batches), schema, lambda r: 32)

    return marked.mapInArrow(run, "k1 long, k2 long, i0 int, i1 int, left binary, right binary, h1 long, h2 long, start int, multi boolean")


def _refined(pieces: DataFrame) -> DataFrame:
    """(h1, h2, lo, hi) of repeated starts in large buckets: pieces of equal bytes, then the windows of pieces with one core."""
    kind = ["k1", "k2", "i0", "i1", "left", "right"]
    pieces = settled(pieces)
    same = pieces.groupBy(*kind).agg(F.count("*").alias("k"), F.max("multi").alias("multi"), F.min(F.struct("h1", "h2", "start")).alias("row"))
    same = settled(same)
    whole = pieces.join(same.filter("k > 1").select(*kind), kind).select("h1", "h2", F.col("start").alias("lo"), F.expr("start + i1 - i0").alias("hi"))
    several = same.groupBy("k1", "k2").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("k1", "k2")
    windows = same.join(several, ["k1", "k2"]).select("*", F.explode(F.sequence("i0", "i1")).alias("i"))
    before = F.expr("CASE WHEN i > 0 THEN substring(left, -i, i) ELSE X'' END")
    windows = windows.select("k1", "k2", "i", before.alias("before"), F.expr(f"substring(right, 1, {PIECE - 1} - i)").alias("behind"), F.expr("multi OR k > 1").alias("known"), "row.h1", "row.h2", F.expr("row.start + i1 - i").alias("lo"))
    window = ["k1", "k2", "i", "before", "behind"]
    twice = windows.groupBy(*window).agg(F.count("*").alias("c"), F.max("known").alias("any")).filter("c > 1 OR any").select(*window)
    return whole.union(windows.filter("NOT known").join(twice, window, "left_semi").select("h1", "h2", "lo", F.col("lo").alias("hi")))


def _classes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One member of each class of equal keys, each key's class, and the classes' sizes."""
    order = np.argsort(key)
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    group = np.empty(len(key), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group, np.diff(np.append(np.flatnonzero(new), len(key)))


def _verified(data: np.ndarray, at: np.ndarray, classes: tuple[np.ndarray, np.ndarray, np.ndarray], *spans: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``classes`` of places by fingerprint, with each member's bytes in the spans behind its place compared with those of the class's first.

    Members that differ (fingerprints met) are classed by their bytes.
    """
    first, group, size = classes
    tied = np.flatnonzero(size[group] > 1)
    one, other = at[tied], at[first[group[tied]]]
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray((len(data) + 1,), dtype=np.uint64, buffer=padded, strides=(1,))
    differs = np.zeros(len(tied), dtype=bool)
    for lo, hi in spans:
        for k in [*range(lo, hi - 8, 8), hi - 8]:
            differs |= words[one + k] != words[other + k]
    if not differs.any():
        return classes
    new: dict[tuple, int] = {}
    for i in tied[differs].tolist():
        text = (int(group[i]), *(data[at[i] + lo : at[i] + hi].tobytes() for lo, hi in spans))
        group[i] = new.setdefault(text, len(size) + len(new))
    return _classes(group)


def _cover_ranks(data: np.ndarray, prefix: np.ndarray, reach: int, member: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Per cover position that a tied suffix can reach its rank by the next ``reach`` bytes, in their order; -1 elsewhere.

    Equal strings are found by fingerprint, verified and ranked once. The distinct ones are sorted by words of
    eight bytes, each round only within the ties that are left.
    """
    period = len(member)
    near = np.zeros(len(data) + period, dtype=np.int32)
    near[tied] = 1
    near[tied + period] -= 1  # a start covers the places up to a period on
    near = np.cumsum(near)[: max(0, len(data) - reach + 1)] > 0
    cover = np.flatnonzero(near & np.tile(member, len(data) // period + 1)[: len(near)])
    out = np.full(len(data), -1, dtype=np.int64)
    first, back, _ = _verified(data, cover, _classes(substring_hash(prefix, cover, cover + reach)), (0, reach))
    at = cover[first]
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    rank = np.zeros(len(at), dtype=np.int64)
    left = np.arange(len(at))  # members of ties, which keep the rank of their tie's first place
    for k in range(0, reach, 8):
        word = padded[(at[left] + k)[:, None] + np.arange(min(8, reach - k))]
        word = np.pad(word, ((0, 0), (0, 8 - word.shape[1]))).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((word, rank[left]))
        left, word = left[order], word[order]
        old = rank[left]
        new_tie = np.concatenate([[True], old[1:] != old[:-1]])
        new_word = new_tie | np.concatenate([[True], word[1:] != word[:-1]])
        place = np.arange(len(left))
        base = place[new_tie][np.cumsum(new_tie) - 1]
        rank[left] = old + place[new_word][np.cumsum(new_word) - 1] - base
        alone = new_word & np.concatenate([new_word[1:], [True]])
        left = left[~alone]
        if not len(left):
            break
    out[cover] = rank[back]
    return out


def same_windows(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, r: int = COVER) -> np.ndarray:
    """A class per start: equal for equal strings of ``length`` bytes. All windows lie inside ``data``.

    Tied suffixes agree in their first ``period`` and their last ``period`` bytes; at a common shift below the
    period both are cover positions, whose ranks compare the bytes between.
    """
    member, shift = _shifts(r)
    period = len(member)
    reach = length - period
    prefix = prefix_hashes(data)
    key = substring_hash(prefix, starts, starts + period) + U(3) * substring_hash(prefix, starts + reach, starts + length)
    first, group, size = _verified(data, starts, _classes(key), (0, period), (reach, length))
    label = np.where(size[group] == 1, group, -1)
    next_label = len(size)
    tied = np.flatnonzero(label < 0)
    if not len(tied):
        return label
    ranks = _cover_ranks(data, prefix, reach, member, starts[tied])
    del prefix, key
    pivot = first[group[tied]]
    group = group[tied]
    while True:
        d = shift[starts[tied] % period, starts[pivot] % period]
        order = np.sign(ranks[starts[tied] + d] - ranks[starts[pivot] + d])
        equal = order == 0
        label[tied[equal]] = next_label + group[equal]
        next_label += int(group.max()) + 1
        if equal.all():
            return label
        group, tied = 2 * group[~equal] + (order[~equal] > 0), tied[~equal]
        first, group, _ = _classes(group)
        pivot = tied[first[group]]


def _repeats(t: pa.Table, length: int) -> pa.RecordBatch | None:
    """From whole buckets: (h1, h2, lo, hi) for maximal runs of starts whose window occurs elsewhere, in runs that aren't known to repeat."""
    start, n = t["start"].to_numpy().astype(np.int64), t["n"].to_numpy().astype(np.int64)
    multi = t["multi"].to_numpy()
    texts = t["bytes"].combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    base = np.cumsum(n) - n
    within = np.arange(n.sum()) - np.repeat(base, n)
    label = same_windows(data, np.repeat(offsets[:-1] - offsets[0], n) + within, length)
    hit = np.bincount(label, np.repeat(1 + multi, n))[label] > 1
    edge = np.zeros(len(hit) + 1, dtype=bool)
    edge[base] = edge[-1] = True
    opens = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
    closes = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]])))
    owner = np.searchsorted(base, opens, "right") - 1
    mine = ~multi[owner]
    owner, opens, closes = owner[mine], opens[mine], closes[mine]
    if not len(owner):
        return None
    columns = [t["h1"].to_numpy()[owner], t["h2"].to_numpy()[owner], (start[owner] + within[opens]).astype(np.int32), (start[owner] + within[closes]).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "lo", "hi"])


def _sort_buckets(runs: DataFrame, length: int) -> DataFrame:
    def work(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column("bucket").to_numpy()
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            if held and held[-1].column("bucket")[held[-1].num_rows - 1].as_py() != bucket[0]:
                cuts = np.concatenate([[0], cuts])
            lengths = pa.compute.binary_length(b.column("bytes")).to_numpy().astype(np.int64)
            total = np.concatenate([[0], np.cumsum(lengths)])
            lo = 0
            for cut in cuts:
                if size + total[cut] - total[lo] >= CHUNK:
                    held.append(b.slice(lo, cut - lo))
                    if (out := _repeats(pa.Table.from_batches(held), length)) is not None:
                        yield out
                    held, size, lo = [], 0, cut
            if lo < b.num_rows:
                held.append(b.slice(lo))
                size += total[-1] - total[lo]
        if held and (out := _repeats(pa.Table.from_batches(held), length)) is not None:
            yield out

    return runs.mapInArrow(work, "h1 long, h2 long, lo int, hi int")


def _spans(repeats: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges, end exclusive."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + length) for r in repeats or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` as (doc_id, text, repeats): runs lo..hi that cover every start of a repeated window in the bytes of its text."""
    least = 2 * difference_cover(COVER)[0]
    if length < least:
        raise ValueError(f"length must be {least} or more")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    anchored = settled(_anchored(rows, length))
    seen = anchored.select(*_TEXT, F.explode("runs").alias("r")).select(*_TEXT, "r.*")
    twice = seen.groupBy("a").agg(F.sum(F.size("starts")).alias("c")).filter("c > 1").select("a")
    shared = settled(seen.join(twice, "a"))
    kind = ["a", "c1", "c2"]
    kinds = settled(shared.groupBy(*kind).agg(F.sum(F.size("starts")).alias("k"), F.max("n").alias("n"), F.min(F.struct(*_TEXT, F.col("starts")[0].alias("start"))).alias("row")))
    whole = shared.join(kinds.filter("k > 1").select(*kind), kind).select(*_TEXT, "n", F.explode("starts").alias("lo")).select(*_TEXT, "lo", F.expr("lo + n - 1").alias("hi"))
    several = kinds.groupBy("a").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    runs = kinds.join(several, "a").select("row.*", "a", "n", F.expr("k > 1").alias("multi"), F.expr(f"kinds > {bucket}").alias("large"))
    some_large = not several.filter(F.col("kinds") > bucket).isEmpty()
    marks = runs.groupBy(*_TEXT).agg(F.collect_list(F.struct("start", "n", "a", "multi", "large")).alias("marks"))  # a text's own runs
    marked = rows.join(marks, _TEXT, "left").select("doc_id", "text", *_TEXT, "marks")
    carried = _carry(marked.filter(F.exists("marks", lambda m: ~m.large)), length)
    found = whole.union(_sort_buckets(carried.repartition("bucket").sortWithinPartitions("bucket"), length))
    if some_large:
        found = found.union(_refined(_pieces(marked.filter(F.exists("marks", lambda m: m.large)), length)))
    found = found.groupBy(*_TEXT).agg(F.collect_set(F.struct("lo", "hi")).alias("repeats"))
    return marked.join(found, _TEXT, "left").select("doc_id", "text", "repeats")


def remove_repeats(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """doc_id, kept (binary: the remaining bytes; cuts may fall inside a character) and spans of what was removed."""

    def run(batches):
        for b in batches:
            kept, spans = [], []
            for x, r in zip(b.column("text"), b.column("repeats"), strict=True):
                data, cut = x.as_py().encode(), _spans(r.as_py(), length)
                edges = [0, *(e for s in cut for e in s), len(data)]
                kept.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "end": z} for a, z in cut])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "kept", "spans"])

    return repeated_spans(docs, length, bucket).mapInArrow(run, "doc_id long, kept binary, spans array<struct<start:long,end:long>>")


def digest(removed: DataFrame) -> DataFrame:
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return removed.select("doc_id", (F.octet_length("kept") + n).cast("long").alias("n_bytes"), n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(table(spark, sf_dir, "documents")))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
