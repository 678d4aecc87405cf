"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over the words and lines of the text, and the
rules are rows of a table (measure, lowest, highest). ``compile_rules`` folds the table
into a single boolean expression, so a scan, the measures and the verdict are one
stage without any shuffle.

Edge cases: a null text counts as empty (no words, rejected by the base rule); an empty
table gives an empty result; repeated rows are judged each on its own; other columns,
whatever their names, are carried through by ``filter_quality`` and ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import SPACE_CHARS, table

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the corpus languages (English, French, German, Spanish).
STOP_WORDS = (
    "the of and to a in that is was for on are with as be this by at it an or from "
    "le la les de des et en un une que qui du pour par sur est au pas ne elle il "
    "der die das und ein eine den von zu ist im mit des dem auf sich "
    "el los las con para por una del se su lo no y o"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document while ``lowest <= measure <= highest`` (None: open)."""

    measure: str
    lowest: float | None = None
    highest: float | None = None


#: The verdict beyond the base rule. Ratios are per word or per line with a word.
RULES = (
    Rule("n_words", lowest=50),
    Rule("mean_word_length", lowest=2, highest=20),
    Rule("symbol_ratio", highest=0.10),
    Rule("stop_ratio", lowest=0.02),
    Rule("dup_line_ratio", highest=0.50),
    Rule("repeat_ratio", highest=0.50),
)


def _split_words(text: str) -> str:
    return f"filter(split({text}, '[ \\\\x09-\\\\x0D]+'), w -> w != '')"


#: From the words: how many lie in a window of three words that occurs at least twice in the text.
#: Each window is one long, a hash in the high bits and its position in the low ones, so the sort runs on
#: primitives; neighbours of equal hash count as equal after their words are compared. The words that
#: the repeated windows cover are counted from the gaps between their positions.
_SAME = "shiftrightunsigned({a} ^ {b}, bits) = 0 AND slice(words, cast({a} & low as int) + 1, 3) = slice(words, cast({b} & low as int) + 1, 3)"
_REPEATS = f"""
transform(array(sort_array(transform(sequence(0, size(words) - 3),
    i -> (xxhash64(words[i], words[i + 1], words[i + 2]) & ~low) | i))), s ->
  aggregate(array_sort(filter(transform(s, (x, j) ->
      CASE WHEN j > 0 AND {_SAME.format(a="s[j - 1]", b="x")} THEN cast(x & low as int)
           WHEN j < size(s) - 1 AND {_SAME.format(a="s[j + 1]", b="x")} THEN cast(x & low as int) END),
      p -> p IS NOT NULL)), struct(0L AS n, -3 AS at),
    (a, x) -> struct(a.n + least(3, x - a.at) AS n, x AS at), a -> a.n))[0]
"""


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of its text: counts as long, ratios as double."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    spaces = "".join(f"\\u{ord(c):04x}" for c in SPACE_CHARS)
    d = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumns({"words": F.expr(_split_words("_t")), "_lines": F.expr(f"filter(split(_t, '\n'), l -> trim(BOTH '{spaces}' FROM l) != '')")})
    d = d.withColumn("bits", F.expr("length(bin(size(words)))")).withColumn("low", F.expr("shiftleft(1L, bits) - 1"))
    d = d.selectExpr(
        *[f"`{c}`" for c in docs.columns],
        "cast(size(words) as bigint) AS n_words",
        "cast(length(array_join(words, '')) as bigint) AS word_chars",
        f"cast(size(split(_t, '[{SYMBOLS}]')) - 1 as bigint) AS n_symbols",
        "cast(size(_lines) - size(array_distinct(_lines)) as bigint) AS n_dup_lines",
        "cast(size(_lines) as bigint) AS n_lines",
        f"cast(CASE WHEN size(words) < 4 THEN 0 ELSE {_REPEATS} END as bigint) AS n_repeat_words",
        f"cast(size(filter(words, w -> lower(w) IN ({stop}))) as bigint) AS n_stop_words",
        "monotonically_increasing_id() AS _row",
    )
    word, line = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return d.withColumns(
        {
            "mean_word_length": F.col("word_chars") / word,
            "symbol_ratio": F.col("n_symbols") / word,
            "stop_ratio": F.col("n_stop_words") / word,
            "dup_line_ratio": F.col("n_dup_lines") / line,
            "repeat_ratio": F.col("n_repeat_words") / word,
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def compile_rules(rules=RULES) -> Column:
    """One boolean expression: every rule of the table holds."""
    verdict = F.lit(True)
    for r in rules:
        if r.lowest is not None:
            verdict = verdict & (F.col(r.measure) >= F.lit(r.lowest))
        if r.highest is not None:
            verdict = verdict & (F.col(r.measure) <= F.lit(r.highest))
    return verdict


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with measures, ``base_failed`` and ``kept``."""
    return measures(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def filter_quality(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``; its own measures may share names with them."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    # `_row` isn't deterministic, which keeps the optimiser from moving the test, and with it whole measures, below their projection
    kept = judge(plain, rules, f"_c{names.index(text)}").filter("kept AND _row >= 0")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    names = {"mean_word_length": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(n_words, 1)", "stop_ratio": "n_stop / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "repeat_ratio": "n_repeat_words / greatest(n_words, 1)"}
    tests = [f"{names.get(r.measure, r.measure)} {op} {v}" for r in RULES for op, v in ((">=", r.lowest), ("<=", r.highest)) if v is not None]
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
    k AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM g),
    r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM k),
    p AS (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p FROM r WHERE c >= 2),
    n AS (SELECT rid, count(*) AS n FROM p GROUP BY rid),
    m AS (SELECT doc_id, len(words)::BIGINT AS n_words,
                 length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
                 coalesce(n.n, 0)::BIGINT AS n_repeat_words,
                 len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop
          FROM w LEFT JOIN n USING (rid)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {" AND ".join(tests)} AS kept FROM b
    """


SQL = {"op8_quality_rules": _sql()}
QUERIES = {"op8_quality_rules": op8_quality_rules}
