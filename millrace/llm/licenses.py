"""License scans: sparse TF-IDF cosine of headers to templates, then inheritance along directories.

1. Units. Sentences and lines with a licensing cue are a file's headers; the templates are split the
   same way. Equal units are counted once with their number, so a line that a third of the files
   share is scored once.
2. TF-IDF. Document frequencies run over all units of the corpus. Each unit is a sparse vector of its
   terms; it is joined to the templates' terms (a bounded table), and dot products are summed by
   unit and template. The best template from ``LEAST_COSINE`` on is the unit's licence.
3. Whole texts. A cued file is also one sparse vector, compared with the full licence texts of
   ``license_texts``. Frequencies count as 1 + ln tf, document frequencies run over the full texts, so
   that a file's verdict doesn't hang on the corpus; a term in none of them weighs most. A file that
   holds too few of a text's terms to reach ``FULL_COSINE`` is passed over within its row.
4. Files. A file's own licence is that of its whole text, else that of its best unit (ties: the first
   name). A file with a whole text's licence, or whose units are ``FILE_SHARE`` of its sentences or
   more, is a licence file and speaks for its directory; several in one directory: whole texts first,
   then the best cosine's.
5. Inheritance. A file without a licence of its own takes that of the nearest ancestor directory that
   has one: the distinct directories, not the files, are joined to their ancestors' licences by path.

Edge cases: null text has no units; a null path is the root; no match and no licensed ancestor give
null; rows that share an id share its best licence; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import accumulate
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import let, settled, table

LEAST_COSINE, FILE_SHARE, MOST_TEMPLATES = 0.6, 0.4, 10_000
FULL_COSINE = 0.75
#: A unit's 128-bit hash stands for its text wherever only equality counts.
UNIT = ["u1", "u2"]

#: Short public notices by which the licences are named in headers.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted under this license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under the CC0 1.0 Universal license."),
    ("Proprietary", "Copyright. All rights reserved."),
)
CUE = "(?i)licen[cs]e|copyright|all rights reserved|spdx|permission is hereby|public domain|redistribution"


def _sentences(text: str) -> str:
    return f"filter(transform(split({text}, '\\\\n|(?<=[.!?;])[ \\\\t]+'), u -> trim(u)), u -> u <> '')"


def _terms(unit: str) -> Column:
    return F.explode(F.expr(f"filter(split(lower({unit}), '[^a-z0-9]+'), x -> x <> '')"))


def _vectors(units: DataFrame, key: str) -> DataFrame:
    return units.select(key, _terms("unit").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def score_units(units: DataFrame, templates: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(u1, u2, license, cosine) of the best template of each distinct unit that reaches ``least``. ``units``: u1, u2 (its hash), unit, n (its number)."""
    pieces = settled(templates.select("license", F.explode(F.expr(_sentences("text"))).alias("unit")).withColumn("piece", F.monotonically_increasing_id()))
    if pieces.count() > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} template sentences; the template side is broadcast and must stay bounded")
    total = units.agg(F.sum("n")).first()[0] or 0
    tf = units.select(*UNIT, "n", _terms("unit").alias("term")).groupBy(*UNIT, "n", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((F.lit(1.0) + total) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    weighted = tf.join(df, "term").select(*UNIT, "term", (F.col("tf") * idf).alias("w"))
    norms = weighted.groupBy(*UNIT).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    own = _vectors(pieces, "piece").join(df, "term", "left").select("piece", "term", (F.col("tf") * idf).alias("tw"))
    own_norms = own.groupBy("piece").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm")).join(pieces.select("piece", "license"), "piece")
    dots = weighted.join(F.broadcast(own), "term").groupBy(*UNIT, "piece").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))  # bounded by MOST_TEMPLATES
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6)
    scored = dots.join(F.broadcast(own_norms), "piece").join(norms, UNIT).select(*UNIT, "license", cosine.alias("cosine")).filter(F.col("cosine") >= least)
    return scored.groupBy(*UNIT).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best")).select(*UNIT, "best.license", (-F.col("best.c")).alias("cosine"))


def full_texts() -> dict[str, str]:
    """The full licence texts by name."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}


def _full_vectors(texts: dict[str, str], least: float) -> tuple[list, list, float, list]:
    """Of the full texts: (license, term, weight in the unit vector), (term, idf), the idf of other terms, and (terms, need).

    A file at ``least`` from a text holds terms with least**2 of its squared weight; ``need`` of them at the fewest.
    """
    counts = {name: Counter(x for x in re.split("[^a-z0-9]+", text.lower()) if x) for name, text in texts.items()}
    df = Counter(term for c in counts.values() for term in c)
    idf = {term: math.log((1 + len(texts)) / (1 + n)) + 1 for term, n in df.items()}
    vectors, wanted = [], []
    for name, c in counts.items():
        w = {term: (1 + math.log(n)) * idf[term] for term, n in c.items()}
        squares = sum(x * x for x in w.values())
        vectors += [(name, term, x / math.sqrt(squares)) for term, x in w.items()]
        sums = accumulate(sorted((x * x for x in w.values()), reverse=True))
        wanted.append((sorted(w), sum(s < (least * least - 1e-5) * squares for s in sums) + 1))
    return vectors, list(idf.items()), math.log(1 + len(texts)) + 1, wanted


def whole_texts(files: DataFrame, texts: dict[str, str], least: float = FULL_COSINE) -> DataFrame:
    """(doc_id, dir, license, cosine) of the cued files that are near a full licence text as a whole. ``files``: doc_id, dir, t."""
    spark = files.sparkSession
    vectors, idf, other, wanted = _full_vectors(texts, least)
    of_text = F.array(*[F.struct(F.split(F.lit(" ".join(terms)), " ").alias("terms"), F.lit(need).alias("need")) for terms, need in wanted])
    terms = F.array_distinct(F.split(F.lower("t"), "[^a-z0-9]+"))
    enough = let(terms, lambda s: (F.size(s) >= min(need for _, need in wanted)) & F.exists(of_text, lambda x: F.size(F.array_intersect(s, x.terms)) >= x.need))
    held = settled(files.filter(F.col("t").rlike(CUE)).filter(enough).withColumn("digest", F.sha2("t", 256)))
    tf = held.dropDuplicates(["digest"]).select("digest", _terms("t").alias("term")).groupBy("digest", "term").agg(F.count("*").alias("tf"))
    weight = (F.lit(1.0) + F.log("tf")) * F.coalesce("idf", F.lit(other))
    weighted = tf.join(F.broadcast(spark.createDataFrame(idf, "term string, idf double")), "term", "left").select("digest", "term", weight.alias("w"))  # bounded by the full texts
    norms = weighted.groupBy("digest").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(spark.createDataFrame(vectors, "license string, term string, tw double")), "term").groupBy("digest", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "digest").select("digest", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).filter(F.col("cosine") >= least)
    best = held.join(scored, "digest").groupBy("doc_id", "dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best"))
    return best.select("doc_id", "dir", "best.license", (-F.col("best.c")).alias("cosine"))


def directory(path: Column) -> Column:
    return F.coalesce(F.regexp_replace(path, "/?[^/]*$", ""), F.lit(""))


def scan(files: DataFrame, templates: DataFrame, doc_id: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """Per file: own_license, cosine, dir_license, license_dir (the ancestor) and license (own, else inherited)."""
    rows = files.select(F.col(doc_id).alias("doc_id"), directory(F.col(path)).alias("dir"), F.col(text).alias("t"))
    cued = rows.filter(F.col("t").rlike(CUE)).select("doc_id", "dir", F.expr(_sentences("t")).alias("s"))
    parts = settled(cued.select("doc_id", "dir", F.size("s").alias("n_sentences"), F.explode("s").alias("unit")).filter(F.col("unit").rlike(CUE)).withColumns({"u1": F.xxhash64("unit"), "u2": F.xxhash64(F.lit(1), "unit")}))
    units = settled(parts.groupBy(*UNIT).agg(F.first("unit").alias("unit"), F.count("*").alias("n")))
    matched = score_units(units, templates)
    hits = parts.drop("unit").join(matched, UNIT).groupBy("doc_id", "dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best"), F.count("*").alias("n_hits"), F.max("n_sentences").alias("n_sentences"))
    by_unit = hits.select("doc_id", "dir", F.struct(F.lit(1).alias("rank"), "best.c", "best.license").alias("b"), (F.col("n_hits") >= FILE_SHARE * F.col("n_sentences")).alias("is_file"))
    whole = whole_texts(rows, full_texts()).select("doc_id", "dir", F.struct(F.lit(0).alias("rank"), (-F.col("cosine")).alias("c"), "license").alias("b"), F.lit(True).alias("is_file"))
    own = settled(by_unit.union(whole).groupBy("doc_id", "dir").agg(F.min("b").alias("b"), F.max("is_file").alias("is_file")))
    licensed = own.filter("is_file").groupBy("dir").agg(F.min("b").alias("b")).select(F.col("dir").alias("license_dir"), F.col("b.license").alias("dir_license"))
    dirs = rows.select("dir").distinct()
    depth = F.size(F.split("dir", "/"))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("k")).select("dir", "k", F.when(F.col("k") == 0, "").otherwise(F.expr("substring_index(dir, '/', k)")).alias("license_dir")).filter("k = 0 OR license_dir <> ''")
    near = above.join(licensed, "license_dir").groupBy("dir").agg(F.max(F.struct("k", "license_dir", "dir_license")).alias("x")).select("dir", "x.license_dir", "x.dir_license")
    of_file = own.groupBy(F.col("doc_id").alias("o_id")).agg(F.min("b").alias("o")).select("o_id", F.col("o.license").alias("own_license"), (-F.col("o.c")).alias("cosine"))
    out = rows.select("doc_id", "dir").join(near, "dir", "left").join(of_file, F.col("doc_id").eqNullSafe(F.col("o_id")), "left")
    return out.select("doc_id", "dir", "own_license", "cosine", "dir_license", "license_dir", F.coalesce("own_license", "dir_license").alias("license"))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, text string")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' paths are source/language/thousand of the id/id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text"), default_templates(spark))


def _sql() -> str:
    templates = ", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)
    cue = CUE
    cut = r"string_split(regexp_replace(regexp_replace({}, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10))"
    units = lambda c: f"list_filter(list_transform({cut.format(c)}, lambda u: trim(u, ' ')), lambda u: u <> '')"
    terms = "unnest(list_filter(regexp_split_to_array(lower(unit), '[^a-z0-9]+'), lambda x: x <> ''))"
    return f"""
    WITH files AS (SELECT doc_id, concat_ws('/', source, lang, cast(floor(doc_id / 1000)::BIGINT AS VARCHAR)) AS dir, text AS t FROM documents),
    cued AS (SELECT doc_id, dir, {units("t")} AS s FROM files WHERE regexp_matches(t, '{cue}')),
    parts AS (SELECT * FROM (SELECT doc_id, dir, len(s) AS n_sentences, unnest(s) AS unit FROM cued) WHERE regexp_matches(unit, '{cue}')),
    u AS (SELECT unit, count(*) AS n FROM parts GROUP BY unit),
    tot AS (SELECT coalesce(sum(n), 0)::DOUBLE AS total FROM u),
    tf AS (SELECT unit, n, term, count(*) AS tf FROM (SELECT unit, n, {terms} AS term FROM u) GROUP BY ALL),
    df AS (SELECT term, sum(n)::DOUBLE AS df FROM tf GROUP BY term),
    w AS (SELECT unit, term, tf * (ln((1.0 + total) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (term), tot),
    wn AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY unit),
    tpl AS (SELECT row_number() OVER () AS piece, license, unit FROM (SELECT license, unnest({units("text")}) AS unit FROM (VALUES {templates}) AS v(license, text))),
    tt AS (SELECT piece, term, count(*) AS tf FROM (SELECT piece, {terms} AS term FROM tpl) GROUP BY ALL),
    tw AS (SELECT piece, term, tf * (ln((1.0 + total) / (1.0 + coalesce(df, 0))) + 1.0) AS tw FROM tt LEFT JOIN df USING (term), tot),
    tn AS (SELECT piece, license, sqrt(sum(tw * tw)) AS tnorm FROM tw JOIN tpl USING (piece) GROUP BY ALL),
    c AS (SELECT unit, license, round(sum(w * tw) / (any_value(norm) * any_value(tnorm)), 6) AS cosine FROM w JOIN tw USING (term) JOIN wn USING (unit) JOIN tn USING (piece) GROUP BY unit, piece, license),
    b AS (SELECT unit, license, cosine FROM c WHERE cosine >= {LEAST_COSINE} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cosine DESC, license) = 1),
    own AS (SELECT doc_id, dir, first(license ORDER BY cosine DESC, license) AS own_license, max(cosine) AS cosine, count(*) >= {FILE_SHARE} * max(n_sentences) AS is_file FROM parts JOIN b USING (unit) GROUP BY doc_id, dir),
    ld AS (SELECT dir AS license_dir, first(own_license ORDER BY cosine DESC, own_license) AS dir_license FROM own WHERE is_file GROUP BY dir),
    near AS (SELECT d.dir, license_dir, dir_license FROM (SELECT DISTINCT dir FROM files) d JOIN ld ON d.dir = license_dir OR starts_with(d.dir, license_dir || '/') OR license_dir = ''
             QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(license_dir) DESC) = 1)
    SELECT f.doc_id, f.dir, own_license, cosine, dir_license, license_dir, coalesce(own_license, dir_license) AS license
    FROM files f LEFT JOIN near USING (dir) LEFT JOIN own ON f.doc_id = own.doc_id
    """


SQL = {"op3_license_scan": _sql()}
QUERIES = {"op3_license_scan": op3_license_scan}
