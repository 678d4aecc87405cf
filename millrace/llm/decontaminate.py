"""Benchmark decontamination: size-partitioned minwise containment search, then exact containment.

Test items are short and documents long, so their Jaccard similarity says little; what counts is the
share of an item's five-word shingles that a document holds.

1. Items are partitioned by size (powers of two of their number of shingles). Each item keeps its
   ``MINIMA`` least shingle hashes, and each partition the largest of these as its scale: small
   items need a fine scale, large ones a coarse one.
2. A document's sketch for a partition is all its shingle hashes up to that scale (it grows with the
   document, so long documents need no longer windows or larger samples). A document that holds an
   item whole holds all its minima; one that holds a share of 0.8 lacks all six minima with a
   chance of 0.2 ** 6, 6 in 100,000. Any minimum of the partition in its sketch makes a candidate.
3. Each sketch is looked up in its own partition's bits of a bit map of all minima, within the document's row,
   so only documents with a hit give rows and keep their text; hits are then joined to the minima.
4. A candidate is verified on the shingles themselves, as strings.

Everything is built-in functions. The bit map has 512 bits a minimum, 2 MB at most; above ``MAP_MINIMA``
minima (they are counted) the sketches are joined to the minima as rows. Broadcasts are checked too: items
by their bytes, found documents by their number.

Edge cases: an item of one to four words has one shingle, of all its words, and is searched at that
width; an item without words (or null) never matches; a document without words matches nothing;
repeated items and documents each give their rows; null ids take part; empty tables give no matches;
further columns, whatever their names, are carried through by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import let, settled, table, text_of

WIDTH, LEAST, MINIMA = 5, 0.8, 6
MAP_MINIMA, BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 1_000_000, 64 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \x09-\x0D]+"), lambda w: w != "")


def shingles(w: Column, width: Column | int) -> Column:
    """Runs of ``width`` words, as strings."""
    width = width if isinstance(width, Column) else F.lit(width)
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.array_join(F.slice(w, i + 1, width), " "))).otherwise(F.array().cast("array<string>"))


def _hashes(w: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words, equal to those of ``shingles``' strings, as unsigned order shifted to signed."""
    run = lambda i: F.xxhash64(F.concat_ws(" ", *[w[i + k] for k in range(width)]))
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), run)).otherwise(F.array().cast("array<bigint>"))


def item_sets(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """item_id, item_width, item_shingles (distinct) of the items with words; ``row`` tells repeated ids apart."""
    d = items.select(F.col(item_id).alias("item_id"), words(text_of(text)).alias("w")).filter(F.size("w") > 0)
    d = d.withColumn("item_width", F.least(F.size("w"), F.lit(width)))
    d = d.withColumn("item_shingles", F.array_distinct(shingles(F.col("w"), F.col("item_width"))))
    return d.select("item_id", "item_width", "item_shingles").withColumn("row", F.monotonically_increasing_id())


def item_minima(sets: DataFrame, minima: int = MINIMA) -> DataFrame:
    """row, item_width, size_class, h, scale: each item's least hashes and its partition's scale (the partition is the width and the power of two of the size)."""
    h = F.slice(F.array_sort(F.transform("item_shingles", lambda s: F.xxhash64(s))), 1, minima)
    d = sets.select("row", "item_width", F.length(F.bin(F.size("item_shingles"))).alias("size_class"), h.alias("hs"))
    scale = d.groupBy("item_width", "size_class").agg(F.max(F.array_max("hs")).alias("scale"))
    return d.join(F.broadcast(scale), ["item_width", "size_class"]).select("row", "item_width", "size_class", F.explode("hs").alias("h"), "scale")  # a scale per partition: under 70 a width


def _places(h: Column, part: Column | int, size: int) -> list[Column]:
    """The two places of a hash in the bit map, other ones in each partition."""
    own = F.xxhash64(part if isinstance(part, Column) else F.lit(part))
    return [(F.shiftright(h, k).bitwiseXOR(own)).bitwiseAND(F.lit(size - 1)) for k in (0, 24)]


def _part(width: Column, size_class: Column) -> Column:
    return (width * 64 + size_class).cast("int")


def _bit_map(minima: DataFrame, n: int) -> tuple[Column, int]:
    """The map as an array of 64-bit words in one literal, and its number of bits."""
    size = 1 << min(24, max(12, (512 * n - 1).bit_length()))
    at = F.explode(F.array(*_places(F.col("h"), _part(F.col("item_width"), F.col("size_class")), size))).alias("at")
    words = minima.select(at).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    found = {r.word: r.bits for r in words.collect()}  # two a minimum at most
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(size // 64))), ",").cast("array<bigint>"), size


def _sketches(text: Column, scales: dict[tuple[int, int], int], bits: tuple[Column, int] | None) -> Column:
    """Per partition the hashes up to its scale, as structs (part, h); with a bit map only those that it holds."""

    def of_class(hashes: Column, width: int, size_class: int) -> Column:
        part = width * 64 + size_class
        near = lambda h: h <= F.lit(scales[width, size_class])
        held = lambda at: F.getbit(bits[0][F.shiftright(at, 6).cast("int")], at.bitwiseAND(F.lit(63)).cast("int")) == 1
        both = near if bits is None else lambda h: near(h) & held(_places(h, part, bits[1])[0]) & held(_places(h, part, bits[1])[1])
        return F.transform(F.filter(hashes, both), lambda h: F.struct(F.lit(part).alias("part"), h.alias("h")))

    def of_width(w: Column, width: int) -> Column:
        classes = sorted(c for k, c in scales if k == width)
        return let(_hashes(w, width), lambda hashes: F.concat(*[of_class(hashes, width, c) for c in classes]))

    if not scales:
        return F.array().cast("array<struct<part:int,h:bigint>>")
    return let(words(text), lambda w: F.concat(*[of_width(w, k) for k in sorted({k for k, _ in scales})]))


def matches(docs: DataFrame, items: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of the pairs at ``least`` or more, and ``text_hash``, which with doc_id names the document's row."""
    sets = settled(item_sets(items))
    minima = settled(item_minima(sets))
    scales = {(r.item_width, r.size_class): r.s for r in minima.groupBy("item_width", "size_class").agg(F.max("scale").alias("s")).collect()}  # under 70 a width
    side = minima.select("row", _part(F.col("item_width"), F.col("size_class")).alias("part"), "h")
    n = minima.count()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t")).withColumn("text_hash", F.xxhash64("t"))
    key = ["doc_id", "text_hash"]
    if n <= MAP_MINIMA:
        sketch = _sketches(F.col("t"), scales, _bit_map(minima, n))
        candidates = settled(rows.withColumn("hits", sketch).filter(F.size("hits") > 0))
        found = candidates.select(*key, F.explode("hits").alias("x")).select(*key, "x.*").join(F.broadcast(side), ["part", "h"])  # up to MAP_MINIMA
        found = settled(found.select(*key, "row").distinct())
    else:
        found = rows.select(*key, F.explode(_sketches(F.col("t"), scales, None)).alias("x")).select(*key, "x.*").join(side, ["part", "h"])
        found = settled(found.select(*key, "row").distinct())
        candidates = _with_any(rows, found.select(*key).distinct(), key)
    size = sets.agg(F.sum(F.aggregate("item_shingles", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16))).first()[0] or 0
    held = found.join(F.broadcast(sets) if size <= BROADCAST_BYTES else sets, "row")
    wanted = held.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("row", "item_id", "item_width", "item_shingles")).alias("items"))  # a document's own items
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    pairs = candidates.select(*key, "t").join(wanted, same).select(*key, words(F.col("t")).alias("w"), "items")
    shared = [let(F.array_distinct(shingles(F.col("w"), k)), _shared(k)) for k in range(1, WIDTH + 1) if any(w == k for w, _ in scales)]
    scored = pairs.select(*key, F.explode(F.concat(*shared) if shared else F.array().cast("array<struct<item_id:bigint,n_shared:bigint,n_item:bigint>>")).alias("m"))
    scored = scored.select(*key, "m.item_id", "m.n_shared", "m.n_item", (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))
    return scored.filter(F.col("n_shared") >= F.lit(least) * F.col("n_item") - 1e-9)


def _with_any(rows: DataFrame, keys: DataFrame, key: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose key is (or isn't) among ``keys``: by broadcast up to ``BROADCAST_ROWS`` of them, else by a shuffle."""
    keys = settled(keys.select(*[F.col(k).alias(f"__match_{k}") for k in key]))
    same = rows[key[0]].eqNullSafe(F.col(f"__match_{key[0]}")) & (rows[key[1]] == F.col(f"__match_{key[1]}"))
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, same, how)


def _shared(width: int):
    """Of the items of that width: how many of their shingles are among the document's."""
    return lambda own: F.transform(
        F.filter("items", lambda x: x.item_width == width),
        lambda x: F.struct(x.item_id.alias("item_id"), F.size(F.array_intersect(own, x.item_shingles)).cast("long").alias("n_shared"), F.size(x.item_shingles).cast("long").alias("n_item")),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    bad = matches(docs, items, least).select("doc_id", "text_hash").distinct()
    name = "_hash" + "_" * max(map(len, docs.columns))
    rows = docs.withColumn(name, F.xxhash64(text_of("text")))
    return _with_any(rows, bad.withColumnRenamed("text_hash", name), ["doc_id", name], "left_anti").drop(name)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", F.round("containment", 6).alias("containment"))


SQL = {
    "op4_decontamination": rf"""
    WITH i AS (SELECT row_number() OVER () AS r, item_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
    iw AS (SELECT r, item_id, w, least(len(w), {WIDTH}) AS k FROM i WHERE len(w) > 0),
    ip AS (SELECT r, item_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM iw),
    s AS (SELECT DISTINCT r, item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM ip),
    z AS (SELECT r, count(*) AS n FROM s GROUP BY r),
    d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    dk AS (SELECT rid, doc_id, w, k FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k),
    dp AS (SELECT rid, doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM dk),
    ds AS (SELECT DISTINCT rid, doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM dp),
    m AS (SELECT rid, doc_id, s.r, item_id, count(*) AS c FROM ds JOIN s USING (k, g) GROUP BY ALL)
    SELECT doc_id, item_id, c::BIGINT AS n_shared, n::BIGINT AS n_item, round(c / n, 6) AS containment
    FROM m JOIN z USING (r) WHERE c >= {LEAST} * n - 1e-9
    """
}
QUERIES = {"op4_decontamination": op4_decontamination}
