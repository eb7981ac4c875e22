"""URL rules whose block decisions reach aliases of a page.

Method: redirect equivalence.  Links of redirects and of canonical addresses join pages and
addresses; connected components over them are computed on the cluster.  A page that a rule names
has the rule's verdict.  Any other page takes its class's: allow if some member is explicitly
allowed, else block if some member is blocked, else allow.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, table
from .components import connected_components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the query's rules.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(h: Column, p: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null if none.  Of two as long, the allow."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow", r.name)):
        fits = ((h == r.host) | h.endswith("." + r.host)) & p.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _resolve_batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, base, target) as written to (source, target): entities undone, relative addresses joined
    to the base or the source.  Links that stay without ``://`` name no one page and are left out."""
    for batch in found:
        rows = []
        for source, base, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                to = urljoin(urljoin(source, entities.unescape(base or "").strip()), entities.unescape(target).strip())
            except ValueError:
                continue
            if "://" in to:
                rows.append((source, to))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["source", "target"])


def alias_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) addresses: canonical links and refresh redirects found in the HTML, resolved
    against the page's ``<base>`` or url."""
    tag = F.col("t")
    base = F.regexp_extract(html, r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'>]*)", 1)
    tags = pages.select(F.col(url).alias("source"), base.alias("base"), F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("t"))
    attr = lambda name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?([^\"'>]*)", 1)
    canonical = F.when(tag.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b"), attr("href"))
    refresh = F.when(tag.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract(attr("content"), r"(?is)url\s*=\s*'?([^'\s]+)", 1))
    written = tags.select("source", "base", F.trim(F.coalesce(canonical, refresh)).alias("target")).where((F.col("target") != "") & F.col("source").isNotNull())
    return written.mapInArrow(_resolve_batches, "source string, target string")


def judge(pages: DataFrame, rules: tuple[Rule, ...], redirects: DataFrame | None = None, *, url: str = "url", html: str | None = "html") -> DataFrame:
    """``pages`` with host, path, rule, verdict and alias_class (null: the page is no alias).

    ``redirects`` has further links (source, target).  A null url or one without ``://`` has empty
    host and path and fits no rule; pages with the same url share a class.  Repeated rows stay;
    columns with the new names are replaced.
    """
    src = pages.drop("host", "path", "rule", "verdict", "alias_class", "__own")
    h, p = host(F.col(url)), path(F.col(url))
    links = [x for x in (alias_links(pages, url=url, html=html) if html else None, redirects.select("source", "target") if redirects is not None else None) if x is not None]
    judged = src.withColumns({"host": h, "path": p})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": name, "__own": verdict})
    if not links:
        return judged.withColumns({"verdict": F.coalesce("__own", F.lit("allow")), "alias_class": F.lit(None).cast("string")}).drop("__own")
    edges = links[0] if len(links) == 1 else links[0].unionByName(links[1])
    classes = connected_components(edges, "source", "target")
    _, member = rule_of(host(F.col("id")), path(F.col("id")), rules)
    decided = classes.select("id", "component", member.alias("v")).groupBy("component").agg(F.max(F.when(F.col("v") == "allow", 2).when(F.col("v") == "block", 1).otherwise(0)).alias("d"))
    known = classes.join(decided, "component").select(F.col("id").alias("__url"), F.col("component").alias("alias_class"), F.when(F.col("d") == 1, F.lit("block")).otherwise(F.lit("allow")).alias("__class"))
    out = judged.join(known, F.col(url) == F.col("__url"), "left")
    return out.withColumn("verdict", F.coalesce("__own", "__class", F.lit("allow"))).drop("__own", "__class", "__url")


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")
