"""Secrets in texts: source code, configuration and prose that holds pieces of either.

Method: assignment-aware lexing.  Lines that can hold an assignment are cut into tokens (quoted
literals, words, operators), and tokens are read as pairs of a target name and a literal: ``name =
"literal"``, ``name: literal``, ``"name": "literal"``, ``d["name"] = ...``, ``name: type = ...``,
``--name literal``, ``setName("literal")``, ``f("name", "literal")``, ``<name>literal</name>`` and the
password of an address.  Constants are propagated: a name that was assigned before stands for its
literals, alone, in a concatenation or inside another literal (``${name}``, ``{name}``), so a literal
counts where it ends up.  A literal's score is the product of how sensitive its target's name is and
how much it looks like a secret and not like a word, a placeholder or a reference.

Spans of the base kinds (``assign``, ``access``, ``hex``) are all kept.  ``literal`` spans, which the
lexing adds, need a score of ``MIN_SCORE`` and lie in no base span.

Every step is linear in the text: a quote that isn't closed on its line is tried once a line, values
of constants are trees that share their parts, and a part is told once for each score.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches, table

KINDS = ("assign", "access", "hex", "literal")
BASE = KINDS[:3]
MIN_SCORE = 0.5

#: Fixed values of the base kinds; letters of a name are in either case, of ASCII alone.
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: A run of these characters that is too short has no longer match in it, so the length is part of the pattern.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED = 8

#: Texts without these (in the regular expressions of Arrow) have nothing of the kind.
_HAS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    # Every sensitive name has one of these; the short ones, which many words hold, stand there as words of their own.
    "literal": r"(?i:pass|pwd|secret|token|key|credential|auth|bearer|signature|salt|cookie|session|://[^/\s:@]+:)"
    r"|(?:^|[\W_]|[^\x00-\x7F])(?i:pat|otp|pin)(?:[\W_A-Z]|[^\x00-\x7F]|$)|[a-z0-9](?:P(?i:at|in)|O(?i:tp))(?:[\W_A-Z]|[^\x00-\x7F]|$)",
}

_TOKEN = re.compile(
    r"""(?P<s>"(?:[^"\\\n]|\\[^\n])*+"|(?<!\w)'(?:[^'\\\n]|\\[^\n])*+'|`(?:[^`\\\n]|\\[^\n])*+`)
    |(?P<o>:=|=>|==|=|:(?!//))
    |(?P<x>[+,;(){}\[\]<>|&!?*\#])
    |(?P<w>(?:\\[^\n]|(?<=[^\W\d_])'(?=[^\W\d_])|[^\s"'`=:+,;(){}\[\]<>|&!?*\#\\])+)""",
    re.VERBOSE,
)
#: A literal after its prefix; elsewhere a single quote after a letter is an apostrophe.
_LITERAL = re.compile(r"(?P<s>\"(?:[^\"\\\n]|\\[^\n])*+\"|'(?:[^'\\\n]|\\[^\n])*+')")
_CANDIDATE = re.compile(r"[=:\"'`<]|--")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>&]+")
_BLANKS = re.compile(r"[^\S\n]*")
_IDENTIFIER = re.compile(r"[\w.$-]+")
_REFERENCE = re.compile(r"\$?\{\s*([\w.]+)\s*\}|\$(\w+)|%\((\w+)\)s")
_ADDRESS = re.compile(r"://[^/\s:@\"']+:([^/\s:@\"']+)@")

#: How sensitive a name is, by the words it is made of; the first that fits counts.
_SENSITIVE = (
    (0.0, r" (?:count|counts|len|length|limit|max|min|size|hint|field|label|prompt|url|uri|path|file|name|regex|pattern|policy|type|expires|expiry|ttl|timeout|public|id|ids|index|error|help|placeholder)(?= )"),
    (1.0, r" (?:password|passwd|passphrase|passcode|pwd|secret|secrets|credential|credentials|(?:api|private|secret|access|signing|encryption|master|account|auth|service|deploy|client) ?key|apikey)(?= )"),
    (0.9, r" (?:token|bearer|authorization|authtoken|pass|pat|salt|signature)(?= )"),
    (0.7, r" (?:auth|cookie|session|otp|pin|key)(?= )"),
)
_SENSITIVE_RE = tuple((score, re.compile(p)) for score, p in _SENSITIVE)
_PLACEHOLDER = re.compile(r"(?i)example|change_?me|your[_-]|xxxx|\*\*\*\*|placeholder|dummy|redacted|<[^>]*>|\{\{|todo|^(?:none|null|nil|true|false|undefined|test|string|password|secret|token)$|^\$|^%|^os\.|^env\b|^process\.|getenv")


@functools.lru_cache(maxsize=1 << 14)
def name_score(name: str) -> float:
    """How sensitive a target name is: 0 to 1."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|[\W_]+", " ", name).lower()
    words = f" {' '.join(words.split())} "
    return next((score for score, p in _SENSITIVE_RE if p.search(words)), 0.0)


class _Value:
    """A literal, or two values joined; what scoring needs is summed as values are joined."""

    __slots__ = ("size", "digits", "letters", "upper", "blanks", "bad", "quoted", "span", "parts", "told")

    def __init__(self, text: str, span: tuple[int, int] | None, quoted: bool, parts: tuple[_Value, ...] = ()):
        self.span, self.parts, self.quoted, self.told = span, parts, quoted, 0.0
        if parts:
            add = lambda f: min(1 << 30, sum(getattr(p, f) for p in parts))
            self.size, self.digits, self.letters, self.upper, self.blanks = map(add, ("size", "digits", "letters", "upper", "blanks"))
            self.bad = any(p.bad for p in parts)
        else:
            self.size = len(text)
            self.digits, self.upper = sum(map(str.isdigit, text)), sum(map(str.isupper, text))
            self.letters, self.blanks = sum(map(str.isalpha, text)), sum(map(str.isspace, text))
            self.bad = bool(_PLACEHOLDER.search(text))

    def score(self) -> float:
        """How much the value looks like a secret: 0 to 1."""
        if self.bad or self.size < 6:
            return 0.0
        mixed = self.digits > 0 and self.letters > 0
        cased = 0 < self.upper < self.letters
        if not self.quoted and not mixed:
            return 0.0  # a word of prose or a name
        s = 0.4 + 0.35 * mixed + 0.1 * cased + 0.1 * (self.size >= 16) + 0.05 * (self.size >= 24)
        if self.letters + self.digits + self.blanks < self.size:
            s += 0.1
        return max(0.0, min(1.0, s - (0.4 if self.blanks else 0.0)))

    def tell(self, score: float) -> Iterator[tuple[int, int]]:
        """Spans of the literals that haven't been told with this score yet."""
        todo = [self]
        while todo:
            v = todo.pop()
            if v.told < score:
                v.told = score
                if v.span is not None:
                    yield v.span
                todo += v.parts


class _Lexer:
    def __init__(self, text: str):
        self.text = text
        self.constants: dict[str, _Value] = {}
        self.found: dict[tuple[int, int], float] = {}

    def line(self, a: int, b: int) -> None:
        text, seen, at = self.text, [], a
        while m := _TOKEN.search(text, at, b):
            at, kind = m.end(), m.lastgroup
            token = (kind, m.group(), m.start(), m.end())
            if kind == "o":
                name = self._target(seen)
                value, at, bare = self._expression(at, b)
                seen = [*seen[-3:], token]
                if value is not None:
                    # A comparison tells what a name may hold, but sets nothing.
                    self._pair(name, value, sets=token[1] != "==")
                    if bare:
                        seen.append(bare)
                continue
            self._positional(seen, token)
            seen.append(token)
            if len(seen) > 64:
                seen = seen[-8:]

    def _target(self, seen: list[tuple]) -> str | None:
        """The name that an operator after these tokens assigns to."""
        if not seen:
            return None
        kind, t, *_ = seen[-1]
        if kind == "w":
            # name: type = value
            if len(seen) >= 3 and seen[-2][1] == ":" and seen[-3][0] == "w" and not name_score(t):
                return seen[-3][1]
            return t
        if kind == "s" and _IDENTIFIER.fullmatch(t, 1, len(t) - 1):
            return t[1:-1]
        if t == "]" and len(seen) >= 3 and seen[-2][0] == "s" and seen[-3][1] == "[":
            return seen[-2][1][1:-1]
        return None

    def _expression(self, at: int, b: int) -> tuple[_Value | None, int, tuple | None]:
        """(value, where it ends, its one bare token or None) of the operands joined by ``+`` or side by side."""
        text, parts, bare = self.text, [], None
        while True:
            at = _BLANKS.match(text, at, b).end()
            m = _TOKEN.match(text, at, b)
            if m and m.lastgroup == "w" and len(m.group()) <= 2 and m.end() < b and text[m.end()] in "\"'" and m.group().isalpha():
                at = m.end()  # the prefix of a literal
                m = _LITERAL.match(text, at, b)
            if m and m.lastgroup == "s":
                parts.append(self._literal(m.start() + 1, m.end() - 1))
                at, bare = m.end(), None
            elif (m := _BARE.match(text, at, b)) and (not parts or m.group() != "+"):
                if m.end() < b and text[m.end()] in "([{":
                    return None, m.end(), None  # a call or an index is no literal
                word, at = m.group(), m.end()
                if word.endswith("+") and at < b and text[at] in "\"'`":
                    word, at = word[:-1], at - 1  # name+"literal"
                known = self.constants.get(word) or self._sum(word)
                bare = None if parts else ("w", word, m.start(), at)
                parts.append(known or _Value(word, (m.start(), at), False))
            else:
                break
            joint = _BLANKS.match(text, at, b).end()
            if joint < b and text[joint] == "+":
                at, bare = joint + 1, None
            elif not (joint < b and text[joint] in "\"'`" and bare is None):
                break
        if not parts:
            return None, at, None
        return parts[0] if len(parts) == 1 else _Value("", None, all(p.quoted for p in parts), tuple(parts)), at, bare

    def _sum(self, word: str) -> _Value | None:
        """The value of ``name+name``, if both are constants."""
        names = word.split("+")
        if len(names) < 2 or not all(n in self.constants for n in names):
            return None
        return _Value("", None, False, tuple(self.constants[n] for n in names))

    def _literal(self, a: int, b: int) -> _Value:
        """A quoted literal, with the constants that it refers to."""
        own = self.text[a:b]
        if "{" in own or "$" in own or "%(" in own:
            used = [self.constants[n] for n in dict.fromkeys(x for m in _REFERENCE.finditer(own) for x in m.groups() if x) if n in self.constants]
            if used:
                rest = _REFERENCE.sub("", own)
                return _Value("", None, True, (*used, *([_Value(rest, (a, b), True)] if rest else ())))
        return _Value(own, (a, b), True)

    def _positional(self, seen: list[tuple], token: tuple) -> None:
        """Pairs without an operator that end in this token."""
        kind, t, a, b = token
        if kind not in "sw" or not seen:
            return
        value = lambda: self._literal(a + 1, b - 1) if kind == "s" else self.constants.get(t) or _Value(t, (a, b), False)
        last = seen[-1]
        if last[0] == "w" and last[1].startswith("--") and not t.startswith("-"):
            self._pair(last[1], value(), sets=False)
        elif len(seen) >= 2 and kind == "s" and last[1] == "(" and seen[-2][0] == "w":
            self._pair(seen[-2][1].rsplit(".", 1)[-1], value(), sets=False)
        elif len(seen) >= 2 and kind == "s" and last[1] == "," and seen[-2][0] == "s" and _IDENTIFIER.fullmatch(seen[-2][1], 1, len(seen[-2][1]) - 1):
            self._pair(seen[-2][1][1:-1], value(), sets=False)
        elif len(seen) >= 3 and last[1] == ">" and seen[-2][0] == "w" and seen[-3][1] == "<":
            self._pair(seen[-2][1], value(), sets=False)

    def _pair(self, name: str | None, value: _Value, sets: bool) -> None:
        if name is None:
            return
        sensitive = name_score(name)
        if sensitive:
            self.tell(sensitive, value)
        if sets:
            self.constants[name] = value

    def tell(self, sensitive: float, value: _Value) -> None:
        score = round(sensitive * value.score(), 2)
        if score >= MIN_SCORE:
            for span in value.tell(score):
                self.found[span] = max(score, self.found.get(span, 0.0))


def literals(text: str) -> dict[tuple[int, int], float]:
    """Spans of the literals that end up in sensitive names, with their scores."""
    lexer, a = _Lexer(text), 0
    while a < len(text):
        # On from the line of the next character that an assignment could have.
        m = _CANDIDATE.search(text, a)
        if m is None:
            break
        a = max(a, text.rfind("\n", a, m.start()) + 1)
        b = text.find("\n", m.start())
        b = len(text) if b < 0 else b
        lexer.line(a, b)
        a = b + 1
    for m in _ADDRESS.finditer(text):
        lexer.tell(1.0, _Value(m.group(1), m.span(1), True))
    return lexer.found


def spans(text: str, has: tuple[bool, ...] = (True,) * len(KINDS)) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start and kind; ``has`` tells the kinds that the text may have."""
    out: list[tuple[int, int, str, float]] = []
    if has[0]:
        out += [(*m.span(), "assign", 1.0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGNED]
    for kind, p, may in (("access", ACCESS, has[1]), ("hex", HEX, has[2])):
        if may:
            out += [(*m.span(), kind, 1.0) for m in p.finditer(text)]
    out.sort()
    if has[3]:
        ends, far = [], 0
        for a, b, *_ in out:
            far = max(far, b)
            ends.append((a, far))
        at, reach = 0, 0
        added = []
        for (a, b), score in sorted(literals(text).items()):
            while at < len(ends) and ends[at][0] <= a:
                reach, at = ends[at][1], at + 1
            if b > reach:
                added.append((a, b, "literal", score))
        out += added
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))


def _find_batches(keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last column is the text; the ``keep`` columns before it stay."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = batch.column(keep)
            has = [pc.fill_null(pc.match_substring_regex(texts, _HAS[k]), False) for k in KINDS]
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i in pc.indices_nonzero(functools.reduce(pc.or_, has)).to_pylist():
                may = tuple(h[i].as_py() for h in has)
                out[i] = [dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in spans(texts[i].as_py(), may)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(out, _ARROW)], [*batch.schema.names[:keep], "secrets"])

    return run


def find(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) with ``secrets``: array<struct<start,end,kind,score>>.

    A null or empty text has none.  Repeated rows stay; a column ``secrets`` is replaced.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "secrets"]
    src = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias("__text"))
    schema = T.StructType([*(src.schema[c] for c in keep), T.StructField("secrets", _FOUND)])
    return src.mapInArrow(_find_batches(len(keep)), schema)


def told(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"] != KINDS[-1])
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return docs.select("doc_id", *(count(k) for k in BASE), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))
