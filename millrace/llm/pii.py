"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

All of it is built-in expressions. A pattern's matches are found with their positions by
wrapping each match in a marker that the text doesn't hold and splitting there: the odd
pieces are the matches, and the lengths of the pieces before give the start.

Kinds: ``email``, ``ip``, ``card`` (Luhn) and ``phone`` are the base kinds and always stay.
``iban`` (mod-97) and ``ssn`` (needs supporting words nearby) are further kinds, kept when
their score reaches ``THRESHOLD``. Every span gets a score: the kind's prior, plus
``CONTEXT_BONUS`` when one of the kind's context words stands within ``CONTEXT_CHARS`` code points
before it.

Edge cases: null text is empty; no matches give zero counts, the hash of the empty string and an
empty span list; repeated rows each give their own row; an empty table gives an empty result;
further columns are carried through by ``redact`` and ignored by the query. Patterns use
possessive loops, so long texts neither backtrack nor deepen the stack; starts come from running
sums, contexts from the pieces before a match and redacted texts from blocks, so that the time for n
finds in one text grows with n log n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

MARK, OTHER = "\x01", "\x02"
CONTEXT_CHARS, CONTEXT_BONUS, THRESHOLD = 40, 0.3, 0.5
#: CONTEXT_PARTS: pieces that hold so many code points for sure, as a match and its gap have three at least.
CONTEXT_PARTS, BLOCK_CHARS = 32, 4096


@dataclass(frozen=True)
class Kind:
    name: str
    guard: str  # a cheap SQL test on the text `t`, false only where the pattern can't match
    pattern: str
    check: str  # SQL over the match `m`
    prior: float
    context: tuple[str, ...]
    base: bool = True


_DIGITS = "regexp_replace(m, '[^0-9]', '')"

#: Luhn over the digits `g` of the match: from the right, every second digit is doubled and reduced by 9 above 9.
_LUHN = """
transform(array(regexp_replace(m, '[^0-9]', '')), g -> length(g) BETWEEN 12 AND 19 AND
  aggregate(sequence(1, length(g)), 0, (a, i) -> a + CASE
    WHEN (length(g) - i) % 2 = 0 THEN cast(substr(g, i, 1) as int)
    WHEN cast(substr(g, i, 1) as int) > 4 THEN 2 * cast(substr(g, i, 1) as int) - 9
    ELSE 2 * cast(substr(g, i, 1) as int) END) % 10 = 0)[0]
"""

#: Mod 97 of the rearranged account number, letters as 10 to 35, one character at a time.
_MOD97 = """
transform(array(replace(m, ' ', '')), g -> length(g) BETWEEN 15 AND 34 AND
  aggregate(split(substr(g, 5) || substr(g, 1, 4), ''), 0, (a, c) -> CASE
    WHEN c = '' THEN a
    WHEN c BETWEEN '0' AND '9' THEN (a * 10 + ascii(c) - 48) % 97
    ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1)[0]
"""

KINDS = (
    Kind("email", "contains(t, '@')", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.9, ("mail", "contact", "write")),
    Kind("ip", "t rlike '[0-9][.][0-9]'", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "forall(split(m, '[.]'), p -> length(ltrim('0', p)) < 3 OR (length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255'))", 0.6, ("ip", "address", "host", "server")),
    Kind("card", "t rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", r"[0-9](?:[ -]?[0-9])++", _LUHN, 0.7, ("card", "visa", "credit", "payment")),
    Kind("phone", "contains(t, '+')", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", 0.6, ("phone", "call", "tel", "mobile")),
    Kind("iban", "t rlike '[A-Z][A-Z][0-9][0-9][ ]?[A-Z0-9]'", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])", _MOD97, 0.8, ("iban", "account", "bank"), base=False),
    Kind("ssn", "t rlike '[0-9]-[0-9]{2}-[0-9]'", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", "NOT m rlike '^(000|666|9)|-00-|-0000$'", 0.3, ("ssn", "social", "security"), base=False),
)


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scan(values: str, both: str) -> str:
    """SQL for the running values of an array under ``both`` of (x, y): doubled distances, so n log n steps and no growing copies."""
    steps = f"sequence(0, cast(ceil(log2(greatest(size({values}), 2))) as int) - 1)"
    return f"aggregate({steps}, {values}, (a, j) -> transform(a, (y, i) -> CASE WHEN i < shiftleft(1, j) THEN y ELSE transform(array(a[i - shiftleft(1, j)]), x -> {both})[0] END))"


def _found(k: Kind, rank: int) -> str:
    """SQL for the array of confirmed spans of one kind in the text ``t``."""
    context = "|".join(k.context)
    near = f"right(array_join(slice(tails, greatest(1, i + 1 - {CONTEXT_PARTS}), least(i, {CONTEXT_PARTS})), ''), {CONTEXT_CHARS})"
    return f"""
    CASE WHEN {k.guard} THEN
      transform(array(split(regexp_replace(t, {_literal(k.pattern)}, '\\u0001$0\\u0001'), '\\u0001')), parts ->
        CASE WHEN size(parts) = 1 THEN array() ELSE
        transform(array(transform(parts, p -> length(p))), lens ->
          transform(array(struct({_scan("lens", "x + y")} AS ends, transform(parts, p -> right(p, {CONTEXT_CHARS})) AS tails)), w ->
            filter(transform(filter(sequence(0, size(parts) - 1), i -> i % 2 = 1), i ->
              struct(w.ends[i - 1] AS s, {rank} AS rank, w.ends[i] AS e, '{k.name}' AS kind, parts[i] AS m,
                {k.prior}D + CASE WHEN {near.replace("tails", "w.tails")} rlike '(?i)(?<![a-z0-9_])({context})' THEN {CONTEXT_BONUS}D ELSE 0D END AS score)),
            y -> transform(array(y.m), m -> {k.check})[0] {"" if k.base else f"AND y.score >= {THRESHOLD}"}))[0])[0] END)[0]
    ELSE array() END
    """


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: its spans as structs (s, rank, e, kind, m, score), in code points, by start, then kind."""
    t = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, OTHER)
    d = docs.withColumn("t", F.when(F.contains(F.col(text), F.lit(MARK)), t).otherwise(F.coalesce(F.col(text), F.lit(""))))
    d = d.withColumns({f"pii_{k.name}": F.expr(_found(k, i)) for i, k in enumerate(KINDS)})
    kind = "array<struct<s:int,rank:int,e:int,kind:string,m:string,score:double>>"
    spans = F.array_sort(F.concat(*[F.col(f"pii_{k.name}").cast(kind) for k in KINDS]))
    return d.withColumn("pii", spans).drop("t", *[f"pii_{k.name}" for k in KINDS])


def _of(name: str):
    return lambda x: x.kind == name


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by ``<KIND>``; of overlapping spans the one that starts first (or the longer) names the run."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    own = f"_c{names.index(text)}"
    # places of a long text are read from its blocks, not from its start
    spans = "array_sort(pii, (a, b) -> CASE WHEN a.s <> b.s THEN a.s - b.s ELSE b.e - a.e END)"
    piece = f"substr(array_join(slice(w.blocks, p.a div {BLOCK_CHARS} + 1, p.b div {BLOCK_CHARS} - p.a div {BLOCK_CHARS} + 1), ''), p.a % {BLOCK_CHARS} + 1, p.b - p.a)"
    text_between = lambda a, b: f"transform(array(struct({a} AS a, {b} AS b)), p -> {piece})[0]"
    runs = "filter(sequence(0, size(w.x) - 1), i -> i = 0 OR w.x[i].s >= w.ends[i - 1])"  # a span that starts behind all before it opens a run
    tagged = f"transform({runs}, i -> {text_between('CASE WHEN i = 0 THEN 0 ELSE w.ends[i - 1] END', 'w.x[i].s')} || '<' || upper(w.x[i].kind) || '>')"
    rest = text_between("w.ends[size(w.x) - 1]", f"length({own})")
    ends = _scan("transform(x, v -> v.e)", "greatest(x, y)")
    cut = f"""transform(array({spans}), x -> transform(array(struct(x AS x, {ends} AS ends, regexp_extract_all({own}, '(?s).{{1,{BLOCK_CHARS}}}', 0) AS blocks)), w ->
        array_join(concat({tagged}, array({rest})), ''))[0])[0]"""
    d = find(plain, own).withColumn(own, F.expr(f"CASE WHEN size(pii) > 0 THEN {cut} ELSE {own} END"))
    if "n_chars" in names:  # the length of the text, where the table keeps it
        n = f"_c{names.index('n_chars')}"
        d = d.withColumn(n, F.when(F.size("pii") > 0, F.length(own).cast(plain.schema[n].dataType)).otherwise(F.col(n)))
    return d.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = [k.name for k in KINDS if k.base]
    d = d.withColumn("spans", joined(F.col("pii")))
    counts = [F.size(F.filter("pii", _of(n))).cast("long").alias(f"n_{n}") for n in base]
    digest = F.sha2(joined(F.filter("pii", lambda x: x.kind.isin(*base))), 256).alias("base_sha256")
    return d.select("doc_id", *counts, digest, "spans")


def _sql() -> str:
    base = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""len({digits}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len({digits}) + 1), lambda i:
        CASE WHEN (len({digits}) - i) % 2 = 0 THEN cast(substr({digits}, i, 1) AS INT)
             ELSE 2 * cast(substr({digits}, i, 1) AS INT) - CASE WHEN cast(substr({digits}, i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
    g = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
    mod97 = f"""len({g}) BETWEEN 15 AND 34 AND cast(array_to_string(list_transform(string_split({g}, ''), lambda c:
        CASE WHEN c = '' THEN '' WHEN c BETWEEN '0' AND '9' THEN c ELSE cast(ascii(c) - 55 AS VARCHAR) END), '') AS HUGEINT) % 97 = 1"""
    near = f"substr(t, greatest(1, s + 1 - {CONTEXT_CHARS}), least(s, {CONTEXT_CHARS}))"
    checks = {
        "email": "true", "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: len(ltrim(p, '0')) < 3 OR (len(ltrim(p, '0')) = 3 AND ltrim(p, '0') <= '255')))",
        "card": luhn, "phone": f"len({digits}) BETWEEN 9 AND 15", "iban": mod97,
        "ssn": f"regexp_matches({near}, '(?i)\\b(ssn|social|security)') AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
    }
    parts = "\nUNION ALL\n".join(
        f"""SELECT rid, s, {i} AS rank, '{k}' AS kind, s + length(m) AS e FROM (
          SELECT rid, t, p[2 * j] AS m, list_sum(list_transform(p[1:2 * j - 1], lambda x: length(x)))::BIGINT AS s FROM (
            SELECT rid, t, p, unnest(range(1, (len(p) - 1) // 2 + 1)) AS j FROM (
              SELECT rid, t, string_split(regexp_replace(t, '({r})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM d)))
          WHERE {checks[k]}"""
        for i, (k, r) in enumerate(base.items())
    )
    count = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))
    item = "kind || ':' || s || ':' || e"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
    f AS ({parts}),
    a AS (SELECT rid, {count}, coalesce(string_agg({item}, ',' ORDER BY s, rank) FILTER (rank < 4), '') AS b,
                 string_agg({item}, ',' ORDER BY s, rank) AS spans FROM f GROUP BY rid)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in ("email", "ip", "card", "phone"))},
           sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
    """


SQL = {"op6_pii": _sql()}
QUERIES = {"op6_pii": op6_pii}
