import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import pii, quality, secrets

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def base_measures(t):
    t = t or ""
    w = SEP.findall(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SEP.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def test_quality_measures(spark, odd, empty, corpus, corpus_df):
    noisy = [(i, t.replace("a", "#", 5) + "\n" + t[:40] + "\n" + t[:40]) for i, t in corpus]
    for df in (odd, corpus_df, spark.createDataFrame(noisy, "doc_id long, text string")):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df.select("doc_id", "text")).collect())
        assert got == Counter((r.doc_id, *base_measures(r.text)) for r in df.select("doc_id", "text").collect())
    assert quality.judge(empty.select("doc_id", "text")).count() == 0


def test_quality_filter_keeps_columns(odd, corpus_df, empty):
    clean = corpus_df.withColumn("text", F.concat(F.col("text"), F.lit(" the of and to in the a is" * 3))).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(-5))
    kept = quality.filter_quality(clean)
    assert kept.columns == clean.columns
    expected = quality.judge(clean.select("doc_id", "text")).filter("kept").count()
    assert kept.count() == expected > 20
    assert kept.select("kept", "n_words").distinct().collect() == [("mine", -5)]
    assert quality.filter_quality(odd).count() == 0 and quality.filter_quality(empty).columns == odd.columns


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_pii(t):
    t, out = t or "", []
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for rank, (kind, pattern, ok) in enumerate(rules):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, t, re.A) if ok(m[0])]
    return sorted(out)


PII_TEXTS = [
    "a@b.c_d@e.f", "x.y+z@mail-1.example.com, me@@you.org", "é ü 1.2.3.4.5.6.7.8 999.1.1.1 010.020.030.040", "4111 1111 1111 1111 and 4111-1111-1111-1112", "🙂 +1 (456) 555-2186 +12", "call +49 30 1234567 or +1234567890123456",
    "iban DE89 3704 0044 0532 0130 00 no DE89370400440532013001", "social security 123-45-6789, code 123-45-6789", "@" * 50 + "a@b." + "c" * 40, "\x01a@b.co\x01", "1 2 3 4 5 6 7 8 9 0 " * 40, "256.256.256.256 00000000255.1.1.1",
]


def test_pii_against_python(spark, odd, empty):
    rng = random.Random(4)
    texts = [*PII_TEXTS, *("".join(rng.choice("a1@.+- 9(\n_é") for _ in range(rng.randint(0, 120))) for _ in range(400)), *("".join(rng.choice("0123456789 -") for _ in range(60)) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(odd.select("doc_id", "text"))
    got = Counter((r.doc_id, r.spans) for r in pii.find(df).select("doc_id", pii.joined(F.filter("pii", lambda x: x.rank < 4)).alias("spans")).collect())
    joined = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
    assert got == Counter((r.doc_id, joined(base_pii(r.text))) for r in df.collect())
    assert pii.find(empty).count() == 0


def test_pii_validators_and_context(spark):
    df = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")
    found = {r.doc_id: [(x.kind, x.m, round(x.score, 2)) for x in r.pii if x.rank > 3] for r in pii.find(df).collect()}
    assert found[6] == [("iban", "DE89 3704 0044 0532 0130 00", 1.1)]
    assert found[7] == [("ssn", "123-45-6789", 0.6)] * 2
    assert [k for k, v in found.items() if v] == [6, 7]


def test_redact(spark, odd, empty):
    df = spark.createDataFrame([(1, "write a@b.co now +1 (456) 555-2186", 99, "p"), (2, None, None, "q"), (3, "clean", 5, "r")], "doc_id long, text string, n_chars int, pii string")
    rows = {r.doc_id: r for r in pii.redact(df).collect()}
    assert rows[1].text == "write <EMAIL> now <PHONE>" and rows[1].n_chars == 25 and rows[1].pii == "p"
    assert rows[2].text is None and rows[3].text == "clean" and rows[3].n_chars == 5
    assert pii.redact(odd).columns == odd.columns and Counter(map(str, pii.redact(odd).collect())) == Counter(map(str, odd.collect()))
    assert pii.redact(empty).count() == 0


def base_secrets(t):
    t, out = t or "", []
    rules = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    for rank, (kind, pattern, ok) in enumerate(rules):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, t, re.A | (re.I if kind == "assign" else 0)) if ok(m)]
    return sorted(out)


def test_secrets_against_python(spark, odd, empty):
    rng = random.Random(9)
    bits = ["password", "Token", "api_key", "=", ":", " ", '"', "abc123", "AKIA", "ABCDEFGHIJKLMNOPQ", "deadbeef0123456789abcdef", "\n", "é", "secret"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(odd.select("doc_id", "text"))
    joined = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
    rows = secrets.scan(df).collect()
    want = {(r.doc_id, r.text): base_secrets(r.text) for r in df.collect()}
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == Counter(
        (r.doc_id, *(sum(s[2] == k for s in want[r.doc_id, r.text]) for k in ("assign", "access", "hex")), hashlib.sha256(joined(want[r.doc_id, r.text]).encode()).hexdigest()) for r in df.collect()
    )
    for r in rows:
        assert [s for s in r.spans.split(",") if s and not s.startswith("literal")] == [s for s in joined(next(v for (i, _), v in want.items() if i == r.doc_id and hashlib.sha256(joined(v).encode()).hexdigest() == r.base_sha256)).split(",") if s]
    assert secrets.scan(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('part = "abcd1234efgh"\nauth_token = part + "ZZ99xx"\n', ["abcd1234efgh", "ZZ99xx"]),
        ('"clientSecret": "9f8A7s6d5F4g"', ["9f8A7s6d5F4g"]),
        ("export DB_PASSWORD=hunter2hunter2x", ["hunter2hunter2x"]),
        ("const privateKey = `abc123DEF456`", ["abc123DEF456"]),
        ('x = os.getenv("password")', []),
        ("password: should be", []),
        ("monkey: banana123banana", []),
        ("password=changeme", []),
        ("secret == a1b2c3d4e5f6", []),
        ('a = "k3y5w0rd9z"\nb = a\nsecret = b', ["k3y5w0rd9z"]),
    ],
)
def test_secret_literals(text, found):
    assert [text[s[0] : s[3]] for s in secrets.scan_text(text)[1]] == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('api_token: str = "Zx81kQ0pLm22vT"', ["Zx81kQ0pLm22vT"]),
        ('const dbPassword: string = "Zx81kQ0pLm22vT";', ["Zx81kQ0pLm22vT"]),
        ('let auth_token: &str = "Zx81kQ0pLm22vT";', ["Zx81kQ0pLm22vT"]),
        ("static API_TOKEN: &'static str = \"Zx81kQ0pLm22vT\";", ["Zx81kQ0pLm22vT"]),
        ('secret: Optional[str] = "Zx81kQ0pLm22vT"', ["Zx81kQ0pLm22vT"]),
        ('token: string | null = "Zx81kQ0pLm22vT"', ["Zx81kQ0pLm22vT"]),
        ('def f(user: str, password: str = "Zx81kQ0pLm22vT"):', ["Zx81kQ0pLm22vT"]),
        ('var token string = "Zx81kQ0pLm22vT"', ["Zx81kQ0pLm22vT"]),
        ('\tapiKey string = "Zx81kQ0pLm22vT"', ["Zx81kQ0pLm22vT"]),
        ('config["password"] = "Zx81kQ0pLm22vT"', ["Zx81kQ0pLm22vT"]),
        ("os.environ['API_KEY'] = 'Zx81kQ0pLm22vT'", ["Zx81kQ0pLm22vT"]),
        ('part: str = "Zx81kQ0pLm22vT"\ncfg["db"]["password"] = part', ["Zx81kQ0pLm22vT"]),
        ('part: str = "Zx81kQ0pLm22vT"; auth_token: str = part', ["Zx81kQ0pLm22vT"]),
        ('error: password = "Zx81kQ0pLm22vT"', ["Zx81kQ0pLm22vT"]),
        ("secret: Zx81kQ0pLm22vT=ab", ["Zx81kQ0pLm22vT=ab"]),
        ('x: int = 1, password = "Zx81kQ0pLm22vT"', ["Zx81kQ0pLm22vT"]),
        ('name: str = "Zx81kQ0pLm22vT"\npassword: str', []),
        ('token: SecretString2abcdef = "hello"', []),
        ('if config["password"] == "Zx81kQ0pLm22vT":', []),
        ('if (ok ? token : other != "Zx81kQ0pLm22vT")', []),
    ],
)
def test_typed_and_subscripted_secrets(text, found):
    assert [text[s[0] : s[3]] for s in secrets.scan_text(text)[1]] == found


def generated_source(rng):
    """A random source text and the spans of its secret literals, from an evaluation of its assignments while they are written."""
    sensitive, harmless = ["password", "auth_token", "clientSecret", "db.passwd", "api_key", "SECRET"], ["part", "label", "x1", "user_name", "a.b", "auth"]
    text, known, best = "", {}, {}
    for _ in range(rng.randint(1, 12)):
        if rng.random() < 0.2:
            text += rng.choice(["# a remark\n", "call(1, 2)\n", "if x == 3:\n", "\n", "é ü\n"])
        name = rng.choice(sensitive + harmless)
        subscript = rng.random() < 0.2
        text += rng.choice(["", "  ", "export ", "const "])
        text += f'cfg["{name}"] = ' if subscript else name + rng.choice([" = ", "=", ": ", " := "])
        value, spans = "", set()
        for k in range(rng.choice([1, 1, 2, 3])):
            text += " + " if k else ""
            if known and rng.random() < 0.4:
                other = rng.choice(sorted(known))
                text += other
                value, spans = value + known[other][0], spans | known[other][1]
                continue
            literal = "".join(rng.choice(rng.choice(["ab", "abcdefgh0123456789", "QRSTUVWXYZ57"])) for _ in range(rng.choice([3, 6, 9, 14, 20])))
            left, right = rng.choice(['""', "''", "``"])
            spans = spans | {(len(text) + 1, len(text) + 1 + len(literal))}
            value, text = value + literal, text + left + literal + right
        text += rng.choice(["\n", ";\n", "\n\n"])
        if not subscript:
            known[name] = value, spans
        if name in sensitive and len(value) >= 6:
            share = [value.count(c) / len(value) for c in set(value)]
            score = 0.5 * min(1, -sum(p * math.log2(p) for p in share) / 3.5) + 0.3 * (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)) + 0.2 * min(1, len(value) / 16)
            for x in spans if 0.6 + 0.4 * score >= secrets.THRESHOLD else ():
                best[x] = max(best.get(x, 0), 0.6 + 0.4 * score)
    return text, best


def test_literals_of_generated_sources(spark):
    rng = random.Random(31)
    made = [generated_source(rng) for _ in range(400)]
    rows = secrets.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")).collect()
    assert sum(len(best) for _, best in made) > 500
    for r in rows:
        text, best = made[r.doc_id]
        got = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("literal")]
        assert got == sorted(best), text
        assert r.scores == pytest.approx([best[x] for x in got]) and r.literals == [text[a:b] for a, b in got]


def test_many_finds_in_one_text(spark):
    """100,000 addresses in one line of 1 MB: found and redacted in seconds, as by Python."""
    text = "mail " + "".join(f"{'é' if i % 7 == 0 else 'x'}u{i}@b.co 1.2.3.{i % 300} " for i in range(50_000))
    df = spark.createDataFrame([(1, text), (2, "+123+4567 12,34,56 mail a@b.co")], "doc_id long, text string")
    began = time.perf_counter()
    rows = {r.doc_id: r for r in pii.find(df).collect()}
    redacted = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert time.perf_counter() - began < 60
    for i, t in df.collect():
        want = base_pii(t)
        assert [(x.s, x.kind, x.e) for x in rows[i].pii if x["rank"] < 4] == [(a, k, b) for a, _, k, b in want]
        at, out = 0, []
        for x in sorted(rows[i].pii, key=lambda x: (x.s, -x.e)):
            if x.s >= at:
                out.append(t[at : x.s] + f"<{x.kind.upper()}>")
            at = max(at, x.e)
        assert redacted[i] == "".join(out) + t[at:]


M = 1_000_000


@pytest.mark.parametrize(
    "text",
    ["x = 1 " + "a" * M, "a=" * (M // 2), "token=" * (M // 6), "x=1 " + "a.b-" * (M // 4), "x=a + " * (M // 6), "a = " + "a " * (M // 2), "x=b\"y=c'" * (M // 8), 'x="' + '\\"' * (M // 2), "a:b<" * (M // 4)],
    ids=["name", "signs", "names", "dots", "plus", "words", "quotes", "escapes", "types"],
)
def test_secrets_in_a_long_line(text):
    began = time.perf_counter()
    secrets.scan_text(text)
    assert time.perf_counter() - began < 30


def test_values_that_grow():
    doubled = 'v0 = "ab12cd34"\n' + "".join(f"v{i + 1} = v{i} + v{i}\n" for i in range(3000)) + "password = v3000\n"
    assert [doubled[x[0] : x[3]] for x in secrets.scan_text(doubled)[1]] == ["ab12cd34"]
    summed = 'password = "a1b2"\n' + 'password = password + "z9"\n' * 20_000
    assert len(secrets.scan_text(summed)[1]) == 20_001
