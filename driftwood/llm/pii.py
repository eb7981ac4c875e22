"""Personal data in texts.

Method: regular expressions propose spans, checksums and ranges confirm them, and words near a span
adjust its score.  Everything is a SQL expression over one row; there is no shuffle.

Positions come from the two halves of a match: the pieces between the matches (``split``) and the
matches (``regexp_extract_all``), whose lengths add up to the offsets.  Expressions are written so
that each is linear in the text: possessive where nothing after could need what is given back, and
begun only where a run begins (or where the last match ended), which is where a leftmost match
begins.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table

KINDS = ("email", "ip", "card", "phone", "iban", "number", "secret")
BASE = KINDS[:4]
#: Spans that the method adds need this score; base spans stay whatever their score.
MIN_SCORE = 0.6

_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "number": r"(?<![A-Za-z0-9+.-])[0-9]{3}[\x20.-][0-9]{2,4}[\x20.-][0-9]{4}(?![A-Za-z0-9]|[.-][0-9])",
    "secret": r"(?<![A-Za-z0-9])(?i:token|secret|password|passwd|api[_-]?key)[\"']?\x20?[:=]\x20?[\"']?[A-Za-z0-9+/_=-]{16,}+",
}
#: A text without this has no span of the kind.
_NEEDED = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "number": r"[0-9]{3}[\x20.-][0-9]", "secret": r"(?i)token|secret|passw|api[_-]?key"}
#: Score of a confirmed span, and the words nearby that raise it.
_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "number": 0.3, "secret": 0.7}
_CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact)\b",
    "ip": r"(?i)\b(?:ip|address|host|server)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)\b",
    "number": r"(?i)\b(?:phone|tel|call|mobile|fax|ssn|social|passport)\b",
    "secret": r"(?i)\b(?:auth|bearer|credential|login|private)\b",
}
_NEAR, _RAISE = 40, 0.3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """14 to 19 digits whose Luhn sum is a multiple of ten."""
    d = _digits(m)
    n = F.char_length(d)
    total = F.aggregate(
        F.sequence(F.lit(1), F.least(n, F.lit(19))),
        F.lit(0),
        lambda s, i: s + F.when((n - i) % 2 == 0, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), F.substring(d, i, F.lit(1)).cast("int") + 1)),
    )
    return F.when(n.between(14, 19), total % 10 == 0).otherwise(F.lit(False))


def _octets(m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))


def _mod97(m: Column) -> Column:
    """The check of an account number: moved round and spelled out, it leaves 1 modulo 97."""
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.char_length(turned)),
        F.lit(0),
        lambda r, i: F.when(F.substring(turned, i, F.lit(1)).between("0", "9"), (r * 10 + F.ascii(F.substring(turned, i, F.lit(1))) - 48) % 97).otherwise((r * 100 + F.ascii(F.substring(turned, i, F.lit(1))) - 55) % 97),
    )
    return F.char_length(s).between(15, 34) & (rest == 1)


def _valid(kind: str, m: Column) -> Column:
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: _octets(m),
        "card": lambda: _luhn(m),
        "phone": lambda: F.char_length(_digits(m)).between(10, 15),
        "iban": lambda: _mod97(m),
        "number": lambda: F.lit(True),
        # Letters and digits mixed, as words are not.
        "secret": lambda: m.rlike("[0-9]") & m.rlike("[A-Za-z0-9+/_=-]{16,}$"),
    }[kind]()


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, rank, end, kind, score>> of the confirmed spans of one kind."""
    p = F.lit(_PATTERNS[kind])
    between = F.transform(F.split(text, _PATTERNS[kind], -1), lambda x: F.char_length(x))
    found = F.regexp_extract_all(text, p, F.lit(0))
    rows = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("m"))
    # One pass: the end so far, and the spans.
    none = F.lit([]).cast("array<struct<start:int,end:int,m:string>>")
    placed = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), none.alias("l")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.char_length(x["m"])).alias("at"),
            F.when(_valid(kind, x["m"]), F.concat(a["l"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + F.char_length(x["m"])).alias("end"), x["m"].alias("m"))))).otherwise(a["l"]).alias("l"),
        ),
    )["l"]
    near = lambda s: F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - _NEAR), s["end"] - s["start"] + 2 * _NEAR)
    score = lambda s: F.least(F.lit(1.0), F.lit(_SCORE[kind]) + F.when(near(s).rlike(_CONTEXT[kind]), F.lit(_RAISE)).otherwise(F.lit(0.0)))
    scored = F.transform(placed, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), score(s).alias("score")))
    empty = F.lit([]).cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    return F.when(text.rlike(_NEEDED[kind]), scored).otherwise(empty)


def find(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array<struct<start,rank,end,kind,score>>, by start and kind.

    A null or empty text has none.  Base spans (email, ip, card, phone) are all kept; others need
    a score of ``MIN_SCORE``.  Repeated rows and other columns pass; a column ``pii`` is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    all_spans = F.concat(*(_spans(t, k) for k in KINDS))
    return docs.withColumn("pii", F.array_sort(F.filter(all_spans, lambda s: (s["rank"] < len(BASE)) | (s["score"] >= MIN_SCORE))))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return docs.select("doc_id", *(count(k) for k in BASE), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("pii")).alias("spans"))
