import hashlib
import itertools
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard, licenses, sharding, suffixes


def shingle_set(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    """doc_id -> (class, links, copies)."""
    sets = defaultdict(list)
    for i, t in rows:
        sets[shingle_set(t)].append(i)
    keys = list(sets)
    links, parent = Counter(), list(range(len(keys)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(keys)), 2):
        u, v = keys[a], keys[b]
        if u and v and len(u & v) >= 0.8 * len(u | v):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = {}
    for a, u in enumerate(keys):
        ids = [i for i in sets[u] if i is not None]
        if ids:
            least[find(a)] = min([*ids, least.get(find(a), min(ids))])
    return Counter((i, least.get(find(a)), links[a], len(sets[u])) for a, u in enumerate(keys) for i in sets[u])


def found_classes(df):
    return Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard.near_duplicates(df).collect())


def test_near_duplicates(odd, empty, corpus, corpus_df):
    assert found_classes(corpus_df) == brute_classes(corpus)
    assert found_classes(odd) == brute_classes([(r.doc_id, r.text) for r in odd.collect()])
    assert jaccard.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        jaccard.near_duplicates(empty, least=0.5)


def test_near_duplicates_split_and_blocked(monkeypatch, corpus, corpus_df):
    """Small limits: buckets are split twice and large leaves compared in blocks."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "RUNS", 12)
    assert found_classes(corpus_df) == brute_classes(corpus)


def test_one_of_each(odd, empty, corpus, corpus_df):
    want = {c for _, c, _, _ in brute_classes(corpus)}
    assert sorted(r.doc_id for r in jaccard.one_of_each(corpus_df).collect()) == sorted(want)
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == Counter({c for _, c, _, _ in brute_classes([(r.doc_id, r.text) for r in odd.collect()])})
    assert jaccard.one_of_each(empty).count() == 0


def test_rows_without_an_id_stay(spark):
    df = spark.createDataFrame([(None, "x y"), (None, "z"), (1, "x y"), (1, "x y"), (2, "x y"), (3, "q")], "doc_id long, text string")
    assert Counter(r.doc_id for r in jaccard.one_of_each(df).collect()) == {None: 2, 1: 1, 3: 1}


def test_sets_are_keyed_by_themselves(spark, words):
    """Near copies among rows without an id, with a repeated id and other texts, and repeated in other batches."""
    rng = random.Random(8)
    a, b, c = ([rng.choice(words) for _ in range(200)] for _ in range(3))
    near = lambda t, k: " ".join([*t[:k], "changed", *t[k + 1 :]])
    rows = [(None, " ".join(a)), (None, near(a, 20)), (1, near(a, 60)), (7, " ".join(b)), (7, " ".join(c)), (8, near(b, 30)), (9, near(c, 30)), (8, near(b, 30)), (None, " ".join(a))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found_classes(df) == brute_classes(rows)
    kept = Counter(map(tuple, jaccard.one_of_each(df).collect()))
    assert kept == Counter([rows[0], rows[1], rows[2], rows[3], rows[4], rows[8]])


def test_recall_formula():
    assert jaccard.run_recall(levels=1) == pytest.approx(0.777, abs=1e-3)
    assert 1 - (1 - jaccard.run_recall()) ** jaccard.RUNS > jaccard.RECALL and jaccard.runs_for(0.9995) == jaccard.RUNS


def test_measured_recall(spark):
    """20,000 planted pairs, each a text of 84 words and its first 68: a similarity of 64 / 80, one set in the other."""
    ids = spark.range(40_000).selectExpr("id AS doc_id", "id % 20000 AS k")
    own = "transform(sequence(1, 68), j -> hex(xxhash64(k * 100 + j)))"
    tail = "transform(sequence(1, 16), j -> concat('t', hex(xxhash64(k * 1000 + j))))"
    df = ids.selectExpr("doc_id", f"array_join(CASE WHEN doc_id < 20000 THEN {own} ELSE concat({own}, {tail}) END, ' ') AS text")
    found = jaccard.near_duplicates(df).filter("n_links = 1").count()
    assert found >= 40_000 * jaccard.RECALL


def test_near_copies_are_not_dealt_out_again(spark, words):
    """A large group of near copies stays in its buckets, whose splits would spare nothing; unrelated texts that share a line are split."""
    rng = random.Random(21)
    base, line = [rng.choice(words) + str(k) for k in range(300)], [rng.choice(words) for _ in range(12)]
    rows = [(i, " ".join([*base[: i % 300], f"w{i}", *base[i % 300 + 1 :]])) for i in range(300)]
    rows += [(1000 + i, " ".join([*line, *(f"{rng.choice(words)}{rng.randrange(10**6)}" for _ in range(20 + i % 90))])) for i in range(800)]
    trees = jaccard._trees(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS h", "text"), jaccard.WIDTH).withColumn("id", F.col("doc_id")).persist()
    first = {(r.id, n) for r in trees.select("id", "l1").collect() for n in r.l1}
    leaves = [(r.id, r.node) for r in jaccard._leaves(trees, trees).collect()]
    assert len(leaves) == len(set(leaves))
    near, other = ([x for x in leaves if (x[0] < 1000) == k] for k in (True, False))
    assert set(near) <= first and len(near) > 300 * 3
    assert not set(other) <= first
    trees.unpersist()
    assert found_classes(spark.createDataFrame(rows[:300], "doc_id long, text string")) == Counter((i, 0, 299, 1) for i in range(300))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(150)] + [(1000, k) for k in range(1001, 1100)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.class_id for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in parent if find(i) != i}
    assert jaccard.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_decontamination(spark, odd, empty, words, corpus, corpus_df):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 40)))) for i in range(20)] + [(20, None), (21, " "), (22, "word"), (23, "b c d"), (3, "a repeated id with seven words here")]
    docs = []
    for i, t in corpus:
        if i % 4 == 0:
            item = items[i // 4 % 20][1].split()
            cut = rng.choice([0, 0, 1, len(item) // 2])
            t = t + " " + " ".join(item[cut:]) + " end"
        docs.append((i, t))
    both = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for r in both.collect():
        for i, t in items:
            n = min(5, len((t or "").split()))
            if n:
                q = shingle_set(t, n)
                own = shingle_set(r.text, n)
                shared = len(q & {g for g in own if len(g) == n})
                if shared >= 0.8 * len(q) - 1e-9:
                    want[(r.doc_id, i, shared, len(q))] += 1
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.matches(both, bench).collect())
    assert got == want
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and {r.text for r in odd.collect()} - {r.text for r in kept.collect()} == {"word", "a b c d"}
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(both, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == odd.count()


def test_decontamination_without_broadcast(monkeypatch, spark, corpus_df, corpus):
    bench = spark.createDataFrame([(i, " ".join(t.split()[:30])) for i, t in corpus[:15] if len(t.split()) > 30], "item_id long, text string")
    key = lambda: Counter(map(tuple, decontaminate.matches(corpus_df, bench).select("doc_id", "item_id", "n_shared").collect()))
    first = key()
    for limit in ("MAP_MINIMA", "BROADCAST_ROWS", "BROADCAST_BYTES"):
        monkeypatch.setattr(decontaminate, limit, 0)
    assert key() == first and first


def brute_repeats(rows, length=400):
    count = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        count.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = Counter()
    for i, b in texts:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        gone = gone[:-1]
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~gone])).hexdigest())] += 1
    return out


@pytest.mark.parametrize("bucket", [suffixes.BUCKET, 1])
def test_suffix_repeats(spark, odd, empty, corpus, corpus_df, bucket):
    digests = lambda df: Counter(map(tuple, suffixes.digest(suffixes.remove_repeats(df, bucket=bucket)).collect()))
    assert digests(corpus_df) == brute_repeats(corpus)
    assert digests(odd) == brute_repeats([(r.doc_id, r.text) for r in odd.collect()])
    edge = [(1, "a" * 900), (2, "xyz" * 300 + "q" * 450), (3, "ab" * 199 + "c"), (4, "z" + "xyz" * 140), (5, "é" * 200 + "n"), (6, "n" + "é" * 200), (7, "p" * 399), (8, "p" * 400), (9, "p" * 400 + "r")]
    assert digests(spark.createDataFrame(edge, "doc_id long, text string")) == brute_repeats(edge)
    assert suffixes.remove_repeats(empty).count() == 0


def test_cover_reaches_every_pair():
    for r in (0, 1, 2, 3):
        member, shift = suffixes._shifts(r)
        assert (shift >= 0).all() and member.sum() == 6 * r + 4


def test_window_classes():
    rng = np.random.default_rng(2)
    base = rng.integers(97, 99, 1500).astype(np.uint8)
    data = np.concatenate([base, base[100:900], rng.integers(97, 123, 300).astype(np.uint8), base[300:1300], np.full(700, 97, np.uint8)])
    starts = np.arange(len(data) - 399)
    label, text, seen = suffixes.same_windows(data, starts), data.tobytes(), {}
    expected = [seen.setdefault(text[i : i + 400], len(seen)) for i in starts]
    assert len(set(zip(label.tolist(), expected, strict=True))) == len(set(label.tolist())) == len(seen)


def test_hilbert_curve():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        index = sharding.hilbert_index(points, bits)
        assert sorted(index.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards(odd, empty, corpus_df):
    full = corpus_df.selectExpr("doc_id", "text", "'en' AS lang", "concat('s', doc_id % 3) AS source")
    for df, shards in ((odd, 24), (full, 24), (full, 7)):
        rows, texts = sharding.shard_documents(df, shards).collect(), [(r.doc_id, r.text) for r in df.collect()]
        crc = lambda t: ((len((t or "").encode()) + 8), zlib.crc32((t or "").encode()))
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, *crc(t)) for i, t in texts)
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        counts = [len(slots.get(k, [])) for k in range(shards)]
        assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x.py", "nothing here"), (3, "a/b/LICENSE", apache), (4, "a/b/c/d/y.py", None), (5, "z/q.py", "text\n" + apache + "\nmore. And more. Still more. Yet more."),
        (6, "a/k.py", "print. one. two. three. four. " + apache), (7, None, ""), (8, "q", "All rights reserved by nobody at all in this long sentence about birds."), (9, "ab/n.py", "x"), (1, "a/LICENSE", mit),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").selectExpr("*", "1 AS license", "2 AS unit", "3 AS dir")
    rows = {r.doc_id: (r.own_license, r.dir_license, r.license_dir, r.license) for r in licenses.scan(df, licenses.default_templates(spark)).collect()}
    assert rows[1] == ("MIT", "MIT", "a", "MIT")
    assert rows[2] == (None, "Apache-2.0", "a/b", "Apache-2.0") and rows[4] == rows[2]
    assert rows[5] == ("Apache-2.0", None, None, "Apache-2.0")
    assert rows[6] == ("Apache-2.0", "MIT", "a", "Apache-2.0")
    assert rows[7] == rows[8] == rows[9] == (None, None, None, None)
    assert licenses.scan(df, licenses.default_templates(spark)).count() == len(files)
    assert licenses.scan(df.limit(0), licenses.default_templates(spark)).count() == 0


def test_full_license_texts(spark):
    """Full texts, wrapped otherwise and with a holder, are licence files; a long text with one notice isn't."""
    names = ["MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "GPL-3.0", "GPL-2.0"]
    full = licenses.full_texts()
    wrapped = {n: "Copyright (c) 2019-2024 Jo Doe and others. All rights reserved.\n\n" + textwrap.fill(full[n], 61) for n in names}
    files = [(i, f"{n}/LICENSE", wrapped[n]) for i, n in enumerate(names)] + [(100 + i, f"{n}/src/x.py", "pass") for i, n in enumerate(names)]
    prose = "\n".join(f"word{i % 700} the of and to in this is a line of text" for i in range(2000))
    files += [(200, "p/readme", prose + "\nLicensed under the Apache License, Version 2.0."), (201, "p/x.py", "pass"), (0, "MIT/LICENSE", wrapped["MIT"]), (300, "MIT/NOTICE", "Licensed under the Apache License, Version 2.0.")]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string"), licenses.default_templates(spark)).collect()}
    assert {n: (rows[i].own_license, rows[100 + i].license, rows[100 + i].license_dir) for i, n in enumerate(names)} == {n: (n, n, n) for n in names}
    assert all(0.75 <= rows[i].cosine <= 1 for i in range(len(names)))
    assert rows[200].own_license == "Apache-2.0" and rows[201].license is None


def test_one_passage_in_many_places(spark):
    """A bucket of more different runs than ``BUCKET``: it is refined, and results equal those by windows."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(450))
    rows = [(i, "".join(rng.choice("ab") for _ in range(420)) + passage + "".join(rng.choice("cd") for _ in range(420))) for i in range(1500)]
    got = {r.doc_id: r.spans for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    near = Counter(t[j : j + 400] for _, t in rows for j in range(390, 500))
    for i, t in rows:
        hit = [j for j in range(390, 500) if near[t[j : j + 400]] > 1]
        assert [(s.start, s.end) for s in got[i]] == [(hit[0], hit[-1] + 400)] and 395 < hit[0] <= 420


def test_windows_are_verified(monkeypatch):
    """Fingerprints that meet don't make windows equal."""
    plain = suffixes.substring_hash
    monkeypatch.setattr(suffixes, "substring_hash", lambda *a: plain(*a) % suffixes.U(7))
    test_window_classes()


def test_long_text_in_blocks(monkeypatch, spark, corpus):
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    text = " ".join(t for _, t in corpus[:30])
    rows = [(1, text[:9000]), (2, text[3000:5000] + "x" + text[100:2500])]
    got = Counter(map(tuple, suffixes.digest(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()))
    assert got == brute_repeats(rows)


def test_license_in_a_long_line(spark, odd):
    """A cued line of 1 MB costs seconds; the odd table is taken."""
    line = "Licensed under the Apache License, Version 2.0 " + " ".join(f"w{i}" for i in range(150_000))
    df = spark.createDataFrame([(1, "a/x", line), (2, "a/y", line + "z")], "doc_id long, path string, text string")
    began = time.perf_counter()
    assert [r.license for r in licenses.scan(df, licenses.default_templates(spark)).collect()] == [None, None]
    assert time.perf_counter() - began < 60
    rows = licenses.scan(odd.withColumn("path", F.concat_ws("/", "source", "lang", "kept")), licenses.default_templates(spark)).collect()
    assert len(rows) == odd.count() and not any(r.license for r in rows)


def test_shards_prune(spark):
    """Shards span short ranges of every dimension, also of names, and equal texts of one source lie together."""
    rng = random.Random(21)
    rows = [(i, "t" * rng.randint(1, 4000), f"l{rng.randrange(8)}", f"s{rng.randrange(60):02d}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    ranges = sharding.shard_documents(df, 64).groupBy("shard").agg(F.min("source").alias("a"), F.max("source").alias("b"), F.min("size").alias("c"), F.max("size").alias("d"), F.min("lang").alias("e"), F.max("lang").alias("f")).collect()
    for value, lo, hi in (("s17", "a", "b"), (1500, "c", "d"), ("l3", "e", "f")):
        assert sum(r[lo] <= value <= r[hi] for r in ranges) <= 40
    copies = spark.createDataFrame([(i, f"text {i % 10:03d}", "en", "one") for i in range(400)], "doc_id long, text string, lang string, source string")
    order = [r.text_crc32 for r in sharding.shard_documents(copies, 4).orderBy("shard", "slot").collect()]
    assert sum(a != b for a, b in itertools.pairwise(order)) == 9
