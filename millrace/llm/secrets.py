"""Secret scans by assignment-aware lexing.

Base kinds are plain patterns (``assign``, ``access``, ``hex``). Beside them, lines with an
assignment sign are lexed as source or configuration syntax into name-literal pairs::

    password = "..."      export API_KEY=...      "clientSecret": "..."      db.pwd: ...
    part = "..."; auth_token = part + "..."       (constants are propagated)
    api_token: str = "..."      var token string = "..."      config["password"] = "..."

A pair is scored by how sensitive its target's name is and how random its literal looks; from
``THRESHOLD`` on each source literal gives a span of kind ``literal``. A constant with a harmless
name is found when a sensitive name is assigned from it.

Edge cases: null text is empty; a text without finds gives zeros, the hash of the empty string and an
empty span list; repeated rows are scanned each on its own; an empty table gives no rows; only
the id and text columns are read.

Lexing takes time in proportion to the text, also on one very long line: a name is tried once, an unquoted
run is read once however many signs it holds, and values aren't joined: a value is a node that
points to a literal of the text and to the nodes of its other parts, which later values share.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

BASE = (
    ("assign", re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 20),
    ("hex", re.compile(r"([0-9a-f]{24,})"), 24),
)
THRESHOLD = 0.85
STRONG = frozenset("password passwd pwd passphrase secret token apikey credential credentials".split())
#: Weak alone, strong beside one of QUALIFIERS.
WEAK = frozenset("key auth pass pin salt signature cert".split())
QUALIFIERS = frozenset("api private access secret encryption signing auth client master service account ssh db database".split())
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|change.?me|example|placeholder|your[_-].*|none|null|true|false|todo|test|dummy|<.*>|\$\{.*\})$")

_NAME = r"[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+"
_LEFT = re.compile(rf"""(?:"({_NAME})"|'({_NAME})'|(?<![\w$])(?<![\w$][.\-])({_NAME}))[ \t]*+(?::=|=>|=(?![=~])|:(?!:|//))[ \t]*""", re.A)
_TYPE = r"""(?:[&*]|\[\]|'\w{1,20}[ \t]+|mut[ \t]+){0,4}[A-Za-z_$][\w$]{0,60}(?:(?:\.|::)[A-Za-z_$][\w$]{0,60}){0,6}(?:[<\[][^="'\n]{0,60}[>\]])?(?:\[\])?(?:[?!](?!=))?"""
#: A name with its type before the sign, or a quoted subscript.
_DECLARED = re.compile(
    rf"""(?<![\w$.\-])(?:({_NAME})[?!]?[ \t]*:(?!:)[ \t]*{_TYPE}(?:[ \t]*\|[ \t]*{_TYPE}){{0,4}}|var[ \t]+({_NAME})[ \t]+{_TYPE}|({_NAME})[ \t]+(?:\*?string|\[\](?:byte|rune)))[ \t]*=(?![=~>])[ \t]*"""
    rf"""|\[[ \t]*(?:"({_NAME})"|'({_NAME})')[ \t]*\][ \t]*(?::=|=>|=(?![=~])|:(?!:|//))[ \t]*""",
    re.A,
)
_SUBSCRIPT, _SHORT = 4, 256
_TYPE_WORDS = frozenset("str string bytes char any".split())
_QUOTED = re.compile(r"""[bruf]{0,2}(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)""")
_RAW = re.compile(r"""[^\s"'`;,(){}\[\]#]+""")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*")
_SIGN = re.compile("[=:]")


def name_parts(name: str) -> list[str]:
    """Lower-case words of a dotted, dashed, underscored or camel-case name."""
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]


def name_score(name: str) -> float:
    parts = name_parts(name)
    words = set(parts) | {a + b for a, b in zip(parts, parts[1:], strict=False)}
    if words & STRONG or (words & WEAK and (words & QUALIFIERS) - WEAK):
        return 1.0
    return 0.5 if words & WEAK else 0.0


def literal_score(value: str) -> float:
    """0 to 1: entropy, mixed characters and length."""
    return _score(Counter(value), value)


def _score(count: dict[str, float], short: str | None) -> float:
    """``literal_score`` from the numbers of characters; ``short`` is the value itself if it is short."""
    n = sum(count.values())
    if n < 6 or short is not None and PLACEHOLDER.match(short):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    mixed = any("0" <= c <= "9" for c in count) and any("a" <= c <= "z" or "A" <= c <= "Z" for c in count)
    return 0.5 * min(1, entropy / 3.5) + 0.3 * mixed + 0.2 * min(1, n / 16)


class _Node:
    """A constant value: a literal of the text or another constant, and the rest after a plus sign. ``end`` is its last place in the line."""

    __slots__ = ("a", "b", "best", "constant", "count", "end", "needed", "order", "rest", "short")

    def __init__(self, order: int, a: int, b: int, constant: _Node | None, rest: _Node | None, end: int):
        self.order, self.a, self.b, self.constant, self.rest, self.end = order, a, b, constant, rest, end
        self.best, self.needed, self.count, self.short = ("", 0.0), False, None, None

    def parts(self) -> list[_Node]:
        return [x for x in (self.constant, self.rest) if x]


class _Lexer:
    """The assignments of one text."""

    def __init__(self, text: str):
        self.text, self.nodes, self.found = text, [], []
        self.known: dict[str, _Node] = {}
        self.lengths: set[int] = set()  # of known names
        self.at_place: dict[int, _Node | None] = {}  # values of this line by their first place
        self.raw = (0, 0)

    def raw_end(self, at: int, end: int) -> int:
        """End of the unquoted run at that place, ``at`` if there is none."""
        if not self.raw[0] <= at < self.raw[1]:
            m = _RAW.match(self.text, at, end)
            self.raw = m.span() if m else (at, at)
        return self.raw[1]

    def constant(self, a: int, b: int) -> _Node | None:
        return self.known.get(self.text[a:b]) if b - a in self.lengths else None

    def value(self, at: int, end: int) -> _Node | None:
        """The constant value at that place: literals and known names joined by plus signs."""
        chain, last = [], None
        while at not in self.at_place:
            if m := _QUOTED.match(self.text, at, end):
                part, stop = (*m.span(m.lastindex), None), m.end()
            else:
                stop = self.raw_end(at, end)
                constant = self.constant(at, stop)
                if stop == at or not constant and self.text[stop : stop + 1] == "(" and stop < end:
                    self.at_place[at] = None
                    break
                part = (at, stop, constant)
            chain.append((at, part, stop))
            more = _PLUS.match(self.text, stop, end)
            if not more:
                break
            at = more.end()
        else:
            last = self.at_place[at]
        if at in self.at_place and not last:  # a call or nothing behind the sign: no constant
            for place, _, _ in chain:
                self.at_place[place] = None
            return None
        for place, (a, b, constant), stop in reversed(chain):
            last = _Node(len(self.nodes), a, b, constant, last, last.end if last else stop)
            self.nodes.append(last)
            self.at_place[place] = last
        return last

    def assign(self, name: str, value: _Node, keep: bool) -> None:
        self.found.append((name, value))
        if keep:
            self.known[name] = value
            self.lengths.add(len(name))

    def line(self, start: int, end: int) -> None:
        text, at, typed = self.text, start, -1
        self.at_place.clear()
        declared = _DECLARED.finditer(text, start, end)
        d = next(declared, None)
        while (m := _LEFT.search(text, at, end)) or d:
            while d and (not m or d.start() <= m.start()):
                subscript = d.lastindex >= _SUBSCRIPT
                # a bare word after a type may be the rest of a plain value (a: b=c), so only literals and constants count
                if d.start() >= at and (subscript or _QUOTED.match(text, d.end(), end) or self.constant(d.end(), self.raw_end(d.end(), end))):
                    if value := self.value(d.end(), end):
                        self.assign(d[d.lastindex], value, not subscript)
                        typed = typed if subscript else d.end()
                d = next(declared, None)
            if not m:
                break
            at = m.end()
            if at < typed:  # the type isn't the value
                continue
            if value := self.value(at, end):
                name = m[m.lastindex]
                self.assign(name, value, at != typed or name not in _TYPE_WORDS)
                at = max(at, value.end) if text[at : at + 1] in "\"'`" else at

    def run(self) -> _Lexer:
        line_end = -1
        for sign in _SIGN.finditer(self.text):
            if sign.start() >= line_end:
                start = self.text.rfind("\n", 0, sign.start()) + 1
                line_end = self.text.find("\n", sign.start())
                line_end = len(self.text) if line_end < 0 else line_end
                self.line(start, line_end)
        return self

    def summarise(self, wanted: list[_Node]) -> None:
        """Gives the wanted nodes and their parts the numbers of their characters."""
        for x in wanted:
            x.needed = True
        for x in reversed(self.nodes):
            if x.needed:
                for y in x.parts():
                    y.needed = True
        own: dict[int, list[_Node]] = {}
        for x in self.nodes:
            if x.needed and not x.constant:
                own.setdefault(x.b, []).append(x)
        for same_end in own.values():  # literals of one end are suffixes of one run
            count, lo = Counter(), same_end[0].b
            for x in sorted(same_end, key=lambda x: -x.a):
                count.update(self.text[x.a : lo])
                lo = x.a
                x.count, x.short = dict(count), self.text[x.a : x.b] if x.b - x.a <= _SHORT else None
        for x in self.nodes:
            if x.needed:
                if x.constant:
                    x.count, x.short = x.constant.count, x.constant.short
                if x.rest:
                    x.count = Counter(x.count)
                    x.count.update(x.rest.count)
                    x.short = x.short + x.rest.short if x.short is not None and x.rest.short is not None and len(x.short) + len(x.rest.short) <= _SHORT else None
                    if sum(x.count.values()) > 1e12:  # only shares matter then
                        x.count = {c: n * 1e-6 for c, n in x.count.items()}


def scan_text(text: str) -> tuple[list[tuple[int, int, str, int]], list[tuple[int, int, str, int, str, float]]]:
    """Base spans and scored literals, each (start, rank of kind, kind, end, ...)."""
    base = [(m.start(), rank, kind, m.end()) for rank, (kind, pattern, least) in enumerate(BASE) for m in pattern.finditer(text) if len(m[1]) >= least]
    lexed = _Lexer(text).run()
    targets = [(name, value, sensitive) for name, value in lexed.found if (sensitive := name_score(name))]
    if not targets:
        return sorted(base), []
    lexed.summarise([value for _, value, _ in targets])
    for name, value, sensitive in targets:
        found = _score(value.count, value.short)
        score = 0.6 * sensitive + 0.4 * found if found else 0.0
        if score >= THRESHOLD and score > value.best[1]:
            value.best = (name, score)
    scored: dict[tuple[int, int], tuple[str, float]] = {}
    for x in reversed(lexed.nodes):  # a part is older than the values that hold it
        if x.best[1]:
            for y in x.parts():
                if x.best[1] > y.best[1]:
                    y.best = x.best
            if not x.constant and x.b > x.a and x.best[1] > scored.get((x.a, x.b), ("", 0.0))[1]:
                scored[x.a, x.b] = x.best
    return sorted(base), sorted((a, len(BASE), "literal", b, name, score) for (a, b), (name, score) in scored.items())


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the counts and digests of the base kinds, all spans, and the name, score and text of each literal."""
    out = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, names array<string>, scores array<double>, literals array<string>"
    kinds = (pa.int64(), *[pa.int64()] * 3, pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.string()))
    names = [c.split()[0] for c in out.split(", ")]

    def joined(spans) -> str:
        return ",".join(f"{s[2]}:{s[0]}:{s[3]}" for s in spans)

    def run(batches):
        for b in batches:
            rows = []
            for key, value in zip(b.column(0), b.column(1), strict=True):
                t = value.as_py() or ""
                base, extra = scan_text(t)
                count = Counter(s[2] for s in base)
                rows.append((key.as_py(), *(count[k] for k, _, _ in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted([*base, *(x[:4] for x in extra)])), [x[4] for x in extra], [x[5] for x in extra], [t[x[0] : x[3]] for x in extra]))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, out)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


QUERIES = {"op10_secrets": op10_secrets}
