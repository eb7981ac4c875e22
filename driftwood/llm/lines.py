"""Near-duplicate lines of a corpus: an exact set-similarity join that keeps the first of each.

A line's set is its distinct 5-word shingles (one to four words: the whole sequence).  A line goes
if an earlier line, by document and place, has a Jaccard index of ``percent`` or more with it.

Method.  Later copies of a line, equal to the character, go at once and take no part in the join.
Tokens are ordered by rarity, from counts over the whole corpus; lines that can match share one of
their ``n - ceil(t * n) + 1`` rarest tokens (prefix filter).  One shuffle brings the prefixes
together by token; each line there meets the token's first line, which settles groups of near copies
by a star.  Lines that no star settles get new prefixes: all their tokens are counted, those of one
line alone dropped and the others ordered by their true counts.  They meet the earlier lines of these
tokens; the length filter is part of the join's key (bands of ``1 / t``) and the shorter line needs its
token among its ``n - ceil(2t / (1 + t) * n) + 1`` rarest.  Pairs pass the length and the positional
filter, and what is left is verified exactly.

A shingle is as rare as its first word.  Words are counted over the whole corpus in a sketch of
fixed size, ``CELLS`` counters, whose level (0 for rare to 7 for frequent) leads the token.  Any
order that all lines share is exact; this one puts frequent beginnings last.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import copied, release, small, table
from .shingle_sql import BLANKS, map_shingles, words

PERCENT = 75
CELLS = 1 << 16
#: A cell's level is the number of these multiples of the mean that its count reaches.
STEPS = (0.25, 1, 4, 16, 64, 256, 1024)
#: Lists of up to so many rows of two numbers are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Place of a line and of a token in one number: 23 bits of line number, 20 of size, 20 of position.
MAX_LINES, MOST = 1 << 23, (1 << 20) - 1


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, BROADCAST_ROWS) else df


def split_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, line_no, line) of the rows that have an id and a text; line numbers from 0."""
    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def rarity(docs: DataFrame, text: str) -> Column:
    """A literal array of CELLS / 16 numbers that hold a level of four bits for each cell of words."""
    # Words are counted as written and split plainly: levels order tokens and need no more.
    word = docs.select(F.explode(F.split(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), " ")).alias("w")).select(F.xxhash64("w").bitwiseAND(CELLS - 1).cast("int").alias("cell"))
    found = {r["cell"]: r["count"] for r in word.groupBy("cell").count().collect()}  # CELLS rows at most
    mean = max(1.0, sum(found.values()) / CELLS)
    # Plans, which the driver keeps, spell out the array, so it is packed.
    packed = [0] * (CELLS // 16)
    for cell, count in found.items():
        packed[cell // 16] |= sum(count >= x * mean for x in STEPS) << 4 * (cell % 16)
    return F.split(F.lit(",".join(map(str, packed))), ",").cast("array<bigint>")


def tokens(line: Column, levels: Column, k: int) -> Column:
    """Distinct tokens, rarest first: the level in the high bits, 60 bits of the shingle's hash below."""
    cell = lambda x: x.bitwiseAND(CELLS - 1).cast("int")
    level = lambda x: F.call_function("shiftright", F.get(levels, F.shiftright(cell(x), 4)), cell(x).bitwiseAND(15) * 4).bitwiseAND(7)
    token = lambda first, x: F.shiftleft(level(first), 60).bitwiseOR(F.shiftrightunsigned(x, 4))
    return F.sort_array(F.array_distinct(map_shingles(words(line), token, k)))


def _copies(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, h1) of the lines with words that an earlier one equals to the character; h1 is the line's hash."""
    hashed = lines.where(F.btrim("line", F.lit(BLANKS)) != "").select("doc_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    twice = copied(hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    found = copied(hashed.join(_side(twice), ["h1", "h2"]))
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("at"))
    return found.join(_side(first), ["h1", "h2"]).where(F.struct("doc_id", "line_no") > F.col("at")).select("doc_id", "line_no", "h1").distinct()


def repeated_lines(docs: DataFrame, percent: int = PERCENT, *, doc_id: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """(doc_id, line_no) of the lines that go.

    Lines without words stay, as do the lines of rows without id; rows that share an id count as
    one document, whose lines with the same number are no earlier than each other.  A document of
    over ``MAX_LINES`` lines is an error.
    """
    lines = split_lines(docs, doc_id, text)
    levels = rarity(docs, text)
    copies = copied(_copies(lines))
    n = F.size("t")
    prefix = F.slice("t", 1, (n - F.ceil(n * percent / 100) + 1).cast("int"))
    # Blank lines go first: a filter on the tokens would make them twice.
    base = lines.where(F.btrim("line", F.lit(BLANKS)) != "").select("doc_id", "line_no", "line", F.xxhash64("line").alias("h1"))
    few = small(copies, BROADCAST_ROWS)
    if few:
        base = base.join(F.broadcast(copies), ["doc_id", "line_no", "h1"], "left_anti")
    base = base.select("doc_id", "line_no", "h1", tokens(F.col("line"), levels, k).alias("t")).select("doc_id", "line_no", "h1", n.alias("n"), prefix.alias("prefix"))
    if not few:
        # Prefixes are shuffled rather than texts.
        base = base.join(copies, ["doc_id", "line_no", "h1"], "left_anti")
    number = F.when(F.col("line_no") < MAX_LINES, F.col("line_no").cast("bigint")).otherwise(F.raise_error(F.lit("a document has too many lines")))
    size = F.shiftleft(number, 40).bitwiseOR(F.shiftleft(F.least("n", F.lit(MOST)).cast("bigint"), 20))
    # Places are made before the array is exploded: what a later projection reads would be made once a row.
    placed = F.transform("prefix", lambda x, i: F.struct(x.alias("token"), size.bitwiseOR(F.least(i, F.lit(MOST)).cast("bigint")).alias("at")))
    line_of = lambda c: F.shiftright(c, 40).cast("int")
    size_of = lambda c: F.shiftright(c, 20).bitwiseAND(MOST).cast("int")
    pos_of = lambda c: F.col(c).bitwiseAND(MOST).cast("int")
    postings = base.select(F.col("doc_id").alias("doc"), F.explode(placed).alias("x")).select("x.token", "doc", "x.at")
    by = Window.partitionBy("token").orderBy("doc", "at")
    rank = F.row_number().over(by).alias("rank")
    met = postings.select("token", "doc", "at", rank, F.lead("at").over(by).isNotNull().alias("more"))
    hot = copied(met.where("rank > 1 or more").select("token", "doc", "at"))
    release(docs.sparkSession)
    hot = copied(hot.select("token", "doc", "at", rank, F.first("doc").over(by).alias("doc0"), F.first("at").over(by).alias("at0")))

    def overlap(n, m):
        """The least intersection of two sets of n and m tokens that match."""
        return F.ceil((F.col(n) + F.col(m)) * percent / (100 + percent))

    def filtered(pairs: DataFrame) -> DataFrame:
        """(da, la, db, lb) of the pairs (doc, at), (doc0, at0) that pass both filters, the earlier first."""
        both = pairs.select("doc", "doc0", line_of("at").alias("line"), line_of("at0").alias("line0"), size_of("at").alias("n"), size_of("at0").alias("m"), pos_of("at").alias("pos"), pos_of("at0").alias("qos"))
        alike = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
        placed = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("qos")) + F.least("pos", "qos") >= overlap("n", "m")
        both = both.where(alike & (placed | (F.greatest("n", "m") >= MOST)))
        return both.select(F.col("doc0").alias("da"), F.col("line0").alias("la"), F.col("doc").alias("db"), F.col("line").alias("lb")).distinct()

    def held(need: DataFrame) -> DataFrame:
        """(d, l, t): the tokens of the lines (d, l)."""
        asked = copied(need.groupBy(F.col("d").alias("__d")).agg(F.collect_set("l").alias("__l")))
        own = docs.select(F.col(doc_id).alias("__id"), F.split(F.col(text), "\n").alias("__t"))
        own = own.join(F.broadcast(asked) if small(asked.select(F.explode("__l")), BROADCAST_ROWS) else asked, F.col("__id") == F.col("__d"))
        found = own.select(F.col("__d").alias("d"), F.explode(F.transform("__l", lambda i: F.struct(i.alias("l"), F.get("__t", i).alias("line")))).alias("x"))
        found = found.select("d", "x.l", tokens(F.col("x.line"), levels, k).alias("t"))
        # Rows that share an id bring several lines of one number: any of them may match.
        return copied(found.distinct() if repeated_ids else found)

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(doc_id, line_no) of the later lines of the pairs that match."""
        one, two = (sets.select(F.col("d").alias(f"d{s}"), F.col("l").alias(f"l{s}"), F.col("t").alias(f"t{s}")) for s in "ab")
        both = pairs.join(one, ["da", "la"]).join(two, ["db", "lb"]).withColumn("s", F.size(F.array_intersect("ta", "tb")))
        both = both.where(100 * F.col("s") >= percent * (F.size("ta") + F.size("tb") - F.col("s")))
        return both.select(F.col("db").alias("doc_id"), F.col("lb").alias("line_no")).distinct()

    ends = lambda pairs: pairs.select(F.col("da").alias("d"), F.col("la").alias("l")).unionByName(pairs.select(F.col("db").alias("d"), F.col("lb").alias("l")))
    repeated_ids = not docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").isEmpty()
    before = (F.col("doc0") < F.col("doc")) | ((F.col("doc0") == F.col("doc")) & (line_of("at0") < line_of("at")))
    tried = copied(filtered(hot.where("rank > 1").where(before)))
    gone = copied(verified(tried, held(ends(tried))))
    release(docs.sparkSession)
    # Lines that nothing has removed meet the earlier ones of their tokens.
    line = line_of("at").alias("line")
    left = copied(hot.where("rank > 2").select("token", "doc", "at", line, "rank").join(_side(gone.withColumnsRenamed({"doc_id": "doc", "line_no": "line"})), ["doc", "line"], "left_anti"))
    asks = left.groupBy("token").agg(F.max("rank").alias("last"))
    right = copied(hot.where("rank > 1").select("token", "doc", "at", line, "rank").join(asks, "token").where("rank <= last").select("doc", "line").distinct())
    # All tokens of these lines are counted among themselves now.  Those that one line has alone are in no
    # partner, so ``most`` is tighter, and prefixes of what is left, by true counts, are short and rare.
    part = right.select("doc", "line", F.lit(False).alias("asks")).unionByName(left.select("doc", "line", F.lit(True).alias("asks")))
    part = copied(part.groupBy(F.col("doc").alias("d"), F.col("line").alias("l")).agg(F.max("asks").alias("asks")))
    sets = held(part.select("d", "l"))
    need = F.ceil(F.col("n") * percent / 100)
    count = F.count("*").over(Window.partitionBy("token")).alias("c")
    seen = sets.select("d", "l", F.explode("t").alias("token")).select("d", "l", count).where("c > 1").groupBy("d", "l").agg(F.count("*").alias("s"))
    alive = copied(sets.select("d", "l", F.size("t").alias("n")).join(seen, ["d", "l"]).where(F.col("s") >= need).select("d", "l").distinct())
    release(docs.sparkSession)
    shared = sets.select("d", "l", F.size("t").alias("n"), "t").join(_side(alive), ["d", "l"]).select("d", "l", "n", F.explode("t").alias("token")).select("d", "l", "n", "token", count).where("c > 1")
    x = shared.groupBy("d", "l", "n").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("x")).where(F.size("x") >= need)
    lead = F.slice(F.transform("x", lambda y: y["token"]), 1, (F.size("x") - need + 1).cast("int"))
    most = (F.floor(F.size("x") * F.lit((100 + percent) / percent) + 1e-9) - F.col("n")).alias("most")
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100)).cast("int") if percent < 100 else F.col("n")
    top = F.size("x") - F.ceil(2.0 * F.col("n") * percent / (100 + percent)) + 1
    rare = x.select("d", "l", "n", most, band.alias("band"), top.alias("top"), lead.alias("lead")).withColumn("open", F.col("n") <= F.col("most"))
    rare = rare.select("d", "l", "n", "most", "open", "band", F.explode(F.transform("lead", lambda y, i: F.struct(y.alias("token"), (i < F.col("top")).alias("low")))).alias("y")).select("d", "l", "n", "most", "open", "band", "y.token", "y.low")
    rare = copied(rare)
    asking = rare.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(_side(part.where("asks").select("d", "l")), ["d", "l"], "left_semi")
    fits = F.expr("r.n <= l.most AND l.n <= r.most AND CASE WHEN l.n < r.n THEN l.low WHEN l.n > r.n THEN r.low ELSE l.low OR r.low END AND (r.d < l.d OR (r.d = l.d AND r.l < l.l))")
    on = F.expr("l.token = r.token AND l.band = r.band") & fits & (F.expr(f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n)"))
    meet = lambda one, two: asking.where(one).alias("l").join(rare.where(two).alias("r"), on).select(F.col("r.d").alias("da"), F.col("r.l").alias("la"), F.col("l.d").alias("db"), F.col("l.l").alias("lb"))
    rest = meet(F.col("open"), F.lit(True)).unionByName(meet(~F.col("open"), F.col("open"))).distinct()
    late = verified(copied(rest.join(tried, ["da", "la", "db", "lb"], "left_anti")), sets)
    return copies.select("doc_id", "line_no").unionByName(gone).unionByName(late).distinct()


def dedup_lines(docs: DataFrame, percent: int = PERCENT, *, doc_id: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``removed_lines`` (array<int>).

    A null text stays null; one whose lines all go is empty.  Rows without id are unchanged;
    repeated rows and other columns stay; a column ``removed_lines`` is replaced.
    """
    places = copied(repeated_lines(docs, percent, doc_id=doc_id, text=text, k=k))
    gone = places.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list("line_no")).alias("removed_lines"))
    out = docs.drop("removed_lines").join(F.broadcast(gone) if small(places, BROADCAST_ROWS) else gone, F.col(doc_id) == F.col("__id"), "left").drop("__id")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains("removed_lines", i)), "\n")
    return out.withColumns({text: F.when(F.col("removed_lines").isNull(), F.col(text)).otherwise(kept), "removed_lines": F.coalesce("removed_lines", F.lit([]).cast("array<int>"))})


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size("removed_lines").cast("bigint").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def oracle_sql() -> str:
    """Every pair of lines that share a shingle, in DuckDB's dialect."""
    from .decontam import shingles_sql

    source = "(SELECT row_number() OVER (ORDER BY doc_id, no) AS lid, doc_id, no, l AS text FROM raw)"
    return f"""
WITH raw AS MATERIALIZED (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
line AS MATERIALIZED {source},
{shingles_sql("d", "line", "lid")},
size AS MATERIALIZED (SELECT id, count(*) AS n FROM d GROUP BY id),
common AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS k FROM d x JOIN d y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
gone AS (SELECT DISTINCT b AS id FROM common JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
told AS (SELECT doc_id, no, text, gone.id IS NOT NULL AS g FROM line LEFT JOIN gone ON gone.id = line.lid)
SELECT documents.doc_id, coalesce(sum(g::int), 0)::bigint AS n_removed,
  coalesce(string_agg(CASE WHEN g THEN no::varchar END, ',' ORDER BY no), '') AS removed_lines,
  CASE WHEN documents.text IS NOT NULL THEN sha256(coalesce(string_agg(CASE WHEN NOT g THEN told.text END, chr(10) ORDER BY no), '')) END AS text_sha256
FROM documents LEFT JOIN told ON told.doc_id = documents.doc_id GROUP BY documents.doc_id, documents.text
"""
