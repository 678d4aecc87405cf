"""N-gram Jaccard self-join of documents by chosen paths.

A document is the set of its five-word shingles. Documents with equal sets are copies and are
joined as one set under a key of its own; ids only name the classes. Over the distinct sets:

1. Tree. In each of ``RUNS`` runs a set x enters one bucket per token that it samples: those whose
   hash lies below SPREAD / (LEAST |x|). Two sets that sample the same shared token meet. A bucket of
   more than ``SMALL`` sets is split again on sampled tokens of its members, down to three levels, unless
   that would spare no work: near copies sample the same tokens and meet in most children again. A bucket
   in which two of ``PROBES`` members share ``FUTILE`` children or more on average is compared whole.
   Each document finds its own buckets from its tokens alone; Spark counts them level by level, only
   buckets with two sets or more go on, and only members of a split bucket are dealt to its children.
2. Candidates. In each leaf bucket, minwise sketches (``BINS`` bins of a byte) rule out pairs far below
   the threshold. A pair counts in its least common bucket only. A leaf of more than ``BLOCK`` sets is
   brute-forced in blocks, every pair of blocks its own group.
3. Links. Members with a candidate bring their tokens; exact intersections (bit sets) decide.
   Output is linear: per set the number of links, and a spanning star of its local component.
4. Classes. Large-star/small-star rounds merge the stars into connected components.

Recall. The share s of the larger set that two sets of similarity s have in common is least where one
holds the other; a level then keeps them together with probability p = 1 - exp(-s SPREAD q / LEAST), q the
next level's p (1 at the last). At s = 0.8 a run finds such a pair in an unsplit bucket with probability
0.78, in a twice split one with 0.64. ``runs_for`` gives the runs for ``RECALL`` at any depth, here 8.
The sketch rules out a pair at 0.8 when its estimate is ``SLACK`` too low, 4.5 standard deviations.

Edge cases: texts of one to four words have one shingle, of all their words; texts without words (null,
empty, blanks) are copies of one another without links; rows that repeat an id and text are copies,
rows that repeat an id with other texts are documents of their own; a null id takes part but names no class; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bytehash import U, byte_slices, mix, shingles
from millrace.llm.common import settled, table

WIDTH, LEAST = 5, 0.8
SPREAD, SMALL, BLOCK, BINS, SLACK = 1.5, 256, 4096, 128, 0.16
PROBES, FUTILE, MOST_PROBES = 32, 0.75, 500_000
RECALL = 0.9995


def run_recall(similarity: float = LEAST, spread: float = SPREAD, levels: int = 3) -> float:
    """The least chance that one run brings a pair of that similarity to a common bucket of the given level."""
    mean, p = similarity * spread / LEAST, 1.0
    for _ in range(levels):
        p = 1 - math.exp(-mean * p)
    return p


def runs_for(recall: float, **at) -> int:
    """Runs that bring a pair at ``LEAST`` together with that chance, in the deepest bucket and whatever the two sizes."""
    return math.ceil(math.log(1 - recall) / math.log(1 - run_recall(**at)))


RUNS = runs_for(RECALL)


def _sampled(nodes: np.ndarray, tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the node, child) for every token that a node samples; long sets go in blocks."""
    at, child = [], []
    for lo in range(0, len(tokens), 65536):
        part = tokens[lo : lo + 65536]
        h = mix(nodes[:, None] ^ part[None, :])
        i, j = np.nonzero(h < U(limit))
        at.append(i)
        child.append(mix(nodes[i] * U(3) + part[j]))
    return np.concatenate(at), np.concatenate(child)


def _sketch(tokens: np.ndarray) -> bytes:
    """One-permutation minwise sketch: per bin of the hash range a byte of its least token, 0 for none."""
    out = np.zeros(BINS, dtype=np.uint8)
    h = np.sort(mix(tokens))
    bins, first = np.unique(h >> U(64 - BINS.bit_length() + 1), return_index=True)
    out[bins.astype(np.int64)] = (mix(h[first]) % U(255)).astype(np.uint8) + 1
    return out.tobytes()


def _trees(docs: DataFrame, width: int) -> DataFrame:
    """Per document: its text's hash ``h``, two signatures of its set, the set's size, its sketch and its buckets by level, those of a level in a list for each of the level above."""
    nested = pa.list_(pa.list_(pa.int64()))
    fields = [pa.field("doc_id", pa.int64()), pa.field("h", pa.int64()), pa.field("s1", pa.int64()), pa.field("s2", pa.int64()), pa.field("n", pa.int32()), pa.field("sketch", pa.binary()), pa.field("l1", pa.list_(pa.int64())), pa.field("l2", nested), pa.field("l3", nested)]
    runs = np.array([7919 * (i + 1) for i in range(RUNS)], dtype=np.uint64)
    seeds = mix(runs)

    def one(tokens: np.ndarray) -> tuple:
        if not len(tokens):
            return 0, 0, 0, bytes(BINS), [], [], []
        signatures = [int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (mix(tokens + U(1)), mix(tokens ^ U(0xABCDEF)))]
        limit = min(2**64 - 1, int(SPREAD / (LEAST * len(tokens)) * 2**64))
        _, l1 = _sampled(seeds, tokens, limit)
        i2, l2 = _sampled(l1, tokens, limit)
        i3, l3 = _sampled(l2, tokens, limit)
        as_list = lambda x: x.astype(np.int64).tolist()
        below = lambda n, i, child: [as_list(x) for x in np.split(child[np.argsort(i, kind="stable")], np.searchsorted(np.sort(i), np.arange(1, n)))] if n else []
        by_l2 = np.argsort(i2, kind="stable")  # the third level stands by the order of the second
        i3 = np.argsort(by_l2)[i3]
        return *signatures, len(tokens), _sketch(tokens), as_list(l1), below(len(l1), i2, l2), below(len(l2), i3, l3)

    def run(batches):
        for b in batches:
            ids, hs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi, data, offsets in byte_slices(b, 2):
                rows = [(i, h, *one(s)) for i, h, s in zip(ids[lo:hi], hs[lo:hi], shingles(data, offsets, width), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, s1 long, s2 long, n int, sketch binary, l1 array<long>, l2 array<array<long>>, l3 array<array<long>>")


def _below(members: DataFrame, trees: DataFrame, level: int, at: str, chosen: str) -> DataFrame:
    """``members`` with ``at``: one row per child of those buckets of the level for which ``chosen`` holds, given the bucket as ``p``."""
    above, children = ("l1", "l2") if level == 1 else ("flatten(l2)", "l3")
    own = trees.select("id", F.expr(above).alias("above"), F.col(children).alias("children")).join(members, "id")
    return own.withColumn(at, F.explode(F.expr(f"flatten(filter(children, (x, i) -> exists(array(above[i]), p -> {chosen})))"))).drop("above", "children")


def _futile(large: DataFrame, trees: DataFrame, level: int) -> DataFrame:
    """The nodes of (id, node, c) whose split would spare few comparisons, judged by about ``PROBES`` members of each.

    Splitting compares a pair once per child that it shares. This only chooses where pairs are compared; no pair is lost.
    """
    probes = settled(large.filter(F.pmod(F.xxhash64("id", "node"), "c") < PROBES).select("id", "node"))
    sent = F.broadcast(probes) if probes.count() <= MOST_PROBES else probes.hint("merge")
    shared = _below(sent, trees, level, "child", "p = node").groupBy("node", "child").agg(F.count("*").alias("k"))
    shared = shared.groupBy("node").agg(F.sum(F.expr("k * (k - 1)")).alias("shared"))
    pairs = probes.groupBy("node").agg(F.count("*").alias("k")).select("node", F.expr("k * (k - 1)").alias("pairs"))
    return settled(shared.join(pairs, "node").filter(F.col("shared") >= FUTILE * F.col("pairs")).filter("pairs > 0").select("node"))


def _leaves(sets: DataFrame, trees: DataFrame) -> DataFrame:
    """(id, node, c): the buckets with at least two sets where brute force takes over, and their sizes.

    Only members of a bucket of more than ``SMALL`` sets that is worth a split go down a level, and only into that bucket's children.
    """
    out, rows = [], sets.select("id", F.explode("l1").alias("node"))
    for level in (1, 2, 3):
        rows = rows.distinct()
        sizes = rows.groupBy("node").agg(F.count("*").alias("c")).filter("c > 1")
        here = settled(rows.join(sizes, "node").select("id", "node", "c"))
        large = here.filter(F.col("c") > SMALL)
        out.append(here if level == 3 else here.filter(F.col("c") <= SMALL))
        if level == 3 or large.isEmpty():
            return reduce(DataFrame.union, out)
        futile = _futile(large, trees, level)
        out.append(large.join(futile, "node", "left_semi").select("id", "node", "c"))
        large = large.join(futile, "node", "left_anti")
        split = settled(large.groupBy("id").agg(F.collect_set("node").alias("split")))  # a set's own samples only
        rows = _below(split.hint("merge"), trees, level, "node", "array_contains(split, p)").select("id", "node")


def _blocked(rows: DataFrame) -> DataFrame:
    """``rows`` of a bucket of c sets with the block pairs (a, b) in which a row takes part, and ``own``, the row's block."""
    width = F.expr(f"cast(ceil(c / {BLOCK}) as int)")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), width).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("a"), F.greatest(k, F.col("own")).alias("b")))
    return rows.withColumn("blocks", pairs)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches, each whole, as tables."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, dtype=bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= held[-1].column(k)[held[-1].num_rows - 1].as_py() != v[0]
        cuts = [*np.flatnonzero(change).tolist(), b.num_rows]
        if cuts[0]:
            held.append(b.slice(0, cuts[0]))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held:
                yield pa.Table.from_batches(held)
            held = [b.slice(lo, hi - lo)]
    if held:
        yield pa.Table.from_batches(held)


def _bits(lists: list[np.ndarray]) -> np.ndarray:
    """Bit sets of the values that occur in two lists or more, a row per list."""
    values, back, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(values), -1, dtype=np.int64)
    place[shared] = np.arange(len(shared))
    at = place[back]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[at >= 0]
    at = at[at >= 0]
    out = np.zeros((len(lists), max(1, (len(shared) + 63) // 64)), dtype=np.uint64)
    np.bitwise_or.at(out, (row, at >> 6), U(1) << (at & 63).astype(np.uint64))
    return out


class _Bucket:
    """A group of sets: which pairs are this group's own (same bucket nowhere lower, right blocks)."""

    def __init__(self, t: pa.Table):
        self.node = t["node"][0].as_py()
        self.id = t["id"].to_numpy()
        self.n = t["n"].to_numpy().astype(np.int64)
        self.cross = t["a"][0].as_py() != t["b"][0].as_py()
        self.own_block = t["own"].to_numpy()
        leaves = [np.array(x, dtype=np.int64) for x in t["leaves"].to_pylist()]
        self.lower = _bits([x[x < self.node] for x in leaves]) if len(leaves) > 1 else None

    def own(self, i: int) -> np.ndarray:
        mask = ~(self.lower & self.lower[i]).any(axis=1)
        if self.cross:
            mask &= self.own_block != self.own_block[i]
        mask[i] = False
        return mask


def _candidates(t: pa.Table, least: float) -> np.ndarray:
    """Which members have a partner in this group that its sketch doesn't rule out."""
    g = _Bucket(t)
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, BINS)
    keep = np.zeros(len(g.id), dtype=bool)
    for i in range(len(g.id)):
        same = ((sketch == sketch[i]) & (sketch > 0)).sum(axis=1)
        either = ((sketch > 0) | (sketch[i] > 0)).sum(axis=1)
        hit = (same >= (least - SLACK) * either) & (np.minimum(g.n, g.n[i]) >= least * np.maximum(g.n, g.n[i]))
        if hit.sum() > 1:
            hit &= g.own(i)
            if hit.any():
                keep[i] = True
    return keep


def _links(t: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, their number of links that are this group's own, and the least id of their component."""
    g = _Bucket(t)
    tokens = _bits([np.frombuffer(x, dtype=np.uint64) for x in t["tokens"].to_pylist()])
    n, links, label = len(g.id), np.zeros(len(g.id), dtype=np.int64), np.full(len(g.id), -1, dtype=np.int64)
    for root in np.argsort(g.id, kind="stable"):
        queue = [root] if label[root] < 0 else []
        if queue:
            label[root] = g.id[root]
        while queue:
            i = queue.pop()
            shared = np.bitwise_count(tokens & tokens[i]).sum(axis=1).astype(np.int64)
            near = shared >= least * (g.n + g.n[i] - shared) - 1e-9
            near[i] = False
            if near.any():
                links[i] = (near & g.own(i)).sum()
                new = np.flatnonzero(near & (label < 0))
                label[new] = g.id[root]
                queue += new.tolist()
    assert n == len(label)
    return g.id, links, label


def components(edges: DataFrame) -> DataFrame:
    """(id, class_id): connected components of edges (u, v), named by their least id, in logarithmically many rounds.

    Large-star and small-star steps in turn; each is a minimum by key (pre-aggregated) joined back, so no
    neighbourhood is ever gathered in one place.
    """
    edges = settled(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(64):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = settled(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("class_id"))
        before = now
    raise RuntimeError("components didn't settle")


def near_duplicates(docs: DataFrame, least: float = LEAST, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``class_id`` (least id of its group), ``n_links`` (other distinct texts at ``least`` or more) and ``n_copies`` (rows with an equal set, itself included)."""
    return _classes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), least, width).select("doc_id", "class_id", "n_links", "n_copies")


def _classes(docs: DataFrame, least: float, width: int) -> DataFrame:
    """``near_duplicates`` of (doc_id, text) with each row's text hash ``h`` and its class's own key ``class``."""
    if least < LEAST:
        raise ValueError(f"the sampling rates hold from a similarity of {LEAST} on")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    trees = settled(_trees(docs, width).withColumn("id", F.monotonically_increasing_id()))
    # one row stands for the set and names it: that of the least id, any without one
    stand = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "id"))
    copies = trees.groupBy("s1", "s2").agg(stand.alias("row"), F.count("*").cast("long").alias("n_copies"), F.max("n").alias("n"))
    copies = settled(copies.select("s1", "s2", F.col("row.id").alias("id"), F.col("row.doc_id").alias("named"), F.col("row.h").alias("h"), "n_copies", "n"))
    sets = trees.select("id", "l1").join(copies.filter("n > 0").select("id"), "id", "left_semi")
    leaves = _leaves(sets, trees)
    lists = leaves.groupBy("id").agg(F.collect_set("node").alias("leaves"))
    members = leaves.join(lists, "id").join(trees.select("id", "n", "sketch"), "id")
    members = _blocked(members).withColumn("x", F.explode("blocks")).select("node", F.col("x.a").alias("a"), F.col("x.b").alias("b"), "own", "id", "n", "leaves", "sketch")

    def keep(batches):
        for t in _groups(batches, ["node", "a", "b"]):
            if t.num_rows > 1 and (own := _candidates(t, least)).any():
                yield from t.drop_columns(["sketch"]).filter(pa.array(own)).to_batches()

    key = ["node", "a", "b"]
    kept = members.repartition(*key).sortWithinPartitions(*key).mapInArrow(keep, "node long, a int, b int, own int, id long, n int, leaves array<long>")
    seats = kept.groupBy("id").agg(F.max("n").alias("n"), F.first("leaves").alias("leaves"), F.collect_list(F.struct("node", "a", "b", "own")).alias("seats"))
    seats = settled(seats.join(copies.select("id", "named", F.col("h").alias("of")), "id"))

    def bring(batches):
        """Each document's tokens, once per seat, if its set is the one that the seat was given for."""
        for b in batches:
            done: set[int] = set()
            ids, ns = b.column("id").to_pylist(), b.column("n").to_pylist()
            for lo, hi, data, offsets in byte_slices(b, b.schema.get_field_index("text")):
                rows = []
                for i, tokens in zip(range(lo, hi), shingles(data, offsets, width), strict=True):
                    if len(tokens) == ns[i] and ids[i] not in done:
                        done.add(ids[i])
                        at = b.column("leaves")[i].as_py()
                        rows += [(s["node"], s["a"], s["b"], s["own"], ids[i], ns[i], at, tokens.tobytes()) for s in b.column("seats")[i].as_py()]
                if rows:
                    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], ["node", "a", "b", "own", "id", "n", "leaves", "tokens"])

    found_at = F.col("doc_id").eqNullSafe(F.col("named")) & (F.col("h") == F.col("of"))
    carried = docs.join(seats, found_at).select("id", "n", "leaves", "seats", "text").mapInArrow(bring, "node long, a int, b int, own int, id long, n int, leaves array<long>, tokens binary")

    def link(batches):
        for t in _groups(batches, ["node", "a", "b"]):
            first = np.unique(t["id"].to_numpy(), return_index=True)[1]
            if len(first) < t.num_rows:  # a repeated row brought the set twice
                t = t.take(pa.array(np.sort(first)))
            if t.num_rows > 1:
                ids, links, label = _links(t, least)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(label)], ["id", "links", "label"])

    found = settled(carried.repartition(*key).sortWithinPartitions(*key).mapInArrow(link, "id long, links long, label long"))
    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    classes = components(found.select(F.col("id").alias("u"), F.col("label").alias("v")))
    known = links.join(classes, "id", "left")
    known = copies.join(known, "id", "left").select("s1", "s2", F.coalesce("class_id", "id").alias("class"), "named", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    names = known.groupBy("class").agg(F.min("named").alias("class_id"))
    return trees.select("doc_id", "h", "s1", "s2").join(known.join(names, "class").drop("named"), ["s1", "s2"])


def one_of_each(docs: DataFrame, least: float = LEAST, width: int = WIDTH) -> DataFrame:
    """One row of ``docs`` per class, of the least ``doc_id``; rows that share an id but no class stay each. Rows without an id stay."""
    found = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least, width).filter("doc_id IS NOT NULL")
    # the least (doc_id, h) of a class and how many rows have it
    rows = found.groupBy("class", "doc_id", "h").agg(F.count("*").alias("n"))
    chosen = settled(rows.groupBy("class").agg(F.min(F.struct("doc_id", "h", "n")).alias("x")).select("x.*"))
    repeated = not chosen.filter("n > 1").isEmpty()
    h = F.xxhash64("text")
    kept = docs.filter("doc_id IS NOT NULL").join(chosen, (docs["doc_id"] == chosen["doc_id"]) & (h == chosen["h"]), "left_semi")
    if repeated:
        name = "_h" + "_" * max(map(len, docs.columns))
        kept = kept.withColumn(name, h).dropDuplicates(["doc_id", name]).drop(name)
    return kept.union(docs.filter("doc_id IS NULL"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = {
    "op2_ngram_jaccard_join": rf"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= {WIDTH}
                THEN list_sort(list_distinct(list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i:i + {WIDTH} - 1], ' '))))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
    r AS (SELECT g, min(doc_id) AS id, count(*) AS n_copies FROM s GROUP BY g),
    t AS (SELECT id, len(g) AS n, unnest(g) AS x FROM r),
    p AS (SELECT a.id AS u, b.id AS v, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id),
    l AS (SELECT u, v FROM p WHERE c >= {LEAST} * (m + n - c) - 1e-9),
    e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
    reach AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
    k AS (SELECT u AS id, min(v) AS least FROM reach GROUP BY u),
    n AS (SELECT u AS id, count(*) AS n_links FROM e GROUP BY u)
    SELECT doc_id, least(r.id, coalesce(k.least, r.id))::BIGINT AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, n_copies::BIGINT AS n_copies
    FROM s JOIN r USING (g) LEFT JOIN k ON k.id = r.id LEFT JOIN n ON n.id = r.id
    """
}
QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
