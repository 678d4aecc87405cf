import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import packing, tokens


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", ["", "Hello  world\n\n it's", "<|endoftext|> x", "日本 é́ ½ 🙂", " " * 3000, "ab" * 4000, "\x00\x01\t\r\n", "don't 'S we'LL 12,345"])
def test_ids_equal_the_library(reference_ids, text):
    assert [*tokens.encoder()(text).tolist(), 1] == reference_ids(text)


def check(rows, texts, reference_ids, most):
    """Every id in one piece; offsets gapless; sequences within the limit."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    want = Counter()
    for key, text in texts:
        ids = np.array(reference_ids(text), dtype="<u4")
        want.update((key, a, len(ids[a : a + most]), zlib.crc32(ids[a : a + most].tobytes()), len(ids)) for a in range(0, len(ids), most))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= most


def test_pack(spark, odd, empty, corpus, corpus_df, reference_ids):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    check(packing.pack(odd).collect(), texts, reference_ids, 2048)
    check(packing.pack(corpus_df, most=64).collect(), corpus, reference_ids, 64)
    assert packing.pack(empty).count() == 0


def test_pack_with_ids(odd, reference_ids):
    row = packing.pack(odd.filter("doc_id = 3"), with_ids=True).first()
    assert row.ids == reference_ids("word")


@pytest.mark.parametrize("seed", range(5))
def test_shortest_pack_first(seed):
    rng = random.Random(seed)
    h = {k: rng.randint(1, 500) for k in rng.sample(range(1, 129), rng.randint(1, 60))}
    patterns = packing.shortest_pack_first(h, 128)
    placed = Counter()
    for pattern, count in patterns:
        assert count > 0 and sum(a * n for a, n in pattern) <= 128
        assert [a for a, _ in pattern] == sorted({a for a, _ in pattern}, reverse=True)
        for a, n in pattern:
            placed[a] += n * count
    assert placed == h
    assert len(patterns) <= 2 * len(h) + 2
    table = packing.pattern_table(patterns)
    assert len(table["rank"]) == sum(len(p) for p, _ in patterns)
    with pytest.raises(ValueError):
        packing.shortest_pack_first({200: 1}, 128)


def test_length_table(spark, odd, empty, corpus, corpus_df, reference_ids):
    for df, texts in ((odd, [r.text for r in odd.collect()]), (corpus_df, [t for _, t in corpus])):
        n = np.array([len(reference_ids(t)) for t in texts])
        h = tokens.length_table(tokens.encoded_lengths(df)).cache()
        rows = h.collect()
        assert sorted(r.context_limit for r in rows) == sorted(set(n.tolist()))
        for r in rows:
            k = r.context_limit
            assert (r.n_docs, r.n_docs_from, r.n_tokens_from, r.total_tokens) == ((n == k).sum(), (n >= k).sum(), n[n >= k].sum(), n.sum())
            assert (r.whole_tokens, r.truncated_total, r.cut_docs) == (n[n <= k].sum(), np.minimum(n, k).sum(), (n > k).sum())
            assert r.share_within == pytest.approx((n <= k).mean())
        for limit in (0, 1, 2, 17, 10**9):
            assert tokens.truncated_total(h, limit) == np.minimum(n, limit).sum()
        assert tokens.quantile(h, 0.5) == sorted(n)[(len(n) + 1) // 2 - 1]
    assert tokens.length_table(tokens.encoded_lengths(empty)).count() == 0
    assert tokens.encoded_lengths(odd).agg(F.min("n_tokens")).first()[0] == 1


def test_special_tokens_either_way(spark):
    from tokenizers import Tokenizer

    texts = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|> x<|endoftext|><|endoftext|>", "x <|endoftext|>", "<|endoftext", "plain", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for as_text in (True, False):
        library = Tokenizer.from_file(tokens.default_path())
        if as_text:
            library.encode_special_tokens = True
        expected = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
        assert {r.doc_id: r.ids for r in tokens.pieces(df, with_ids=True, special_as_text=as_text).collect()} == expected
        lengths = tokens.encoded_lengths(df, special_as_text=as_text)
        assert sorted(r.n_tokens for r in lengths.collect()) == sorted(map(len, expected.values()))
        assert {r.doc_id: r.doc_tokens for r in packing.pack(df, special_as_text=as_text).collect()} == {i: len(x) for i, x in expected.items()}
