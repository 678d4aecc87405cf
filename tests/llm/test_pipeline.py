from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_structure import brute_classes, shingle_set
from test_text_rules import base_measures

from millrace.llm import pii, quality, tokens
from millrace.llm.common import table


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    """Each stage on its predecessor's rows."""
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    steps = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == names
        out.write.parquet(f"{tmp_path}/{i}")
        steps[name] = (docs, spark.read.parquet(f"{tmp_path}/{i}"))
        docs = steps[name][1]
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    before, after = steps["quality_rules"]
    words = set(quality.STOP_WORDS)

    def good(t):
        n, chars, symbols, dup, inside, failed = base_measures(t)
        lines = max(1, sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")))
        stops = sum(w.lower() in words for w in (t or "").split())
        return not failed and 2 <= chars / n <= 20 and symbols / n <= 0.1 and stops / n >= 0.02 and dup / lines <= 0.5 and inside / n <= 0.5

    assert ids(after) == Counter(r.doc_id for r in before.collect() if good(r.text))
    before, after = steps["near_duplicates"]
    assert ids(after) == Counter({c for _, c, _, _ in brute_classes([(r.doc_id, r.text) for r in before.collect()])})
    before, after = steps["decontamination"]
    items = [shingle_set(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert ids(after) == Counter(r.doc_id for r in before.collect() if not any(len(q & shingle_set(r.text)) >= 0.8 * len(q) - 1e-9 for q in items))
    before, after = steps["personal_data"]
    assert ids(after) == ids(before)
    assert pii.find(after).filter(F.size("pii") > 0).count() == 0 < pii.find(before).filter(F.size("pii") > 0).count()
    before, after = steps["packing"]
    encode = tokens.encoder()
    assert {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {r.doc_id: len(encode(r.text)) + 1 for r in before.collect()}
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]  # all but where equal lengths lie
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).select(*columns).collect())) == Counter(map(tuple, after.select(*columns).collect()))


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
