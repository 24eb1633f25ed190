"""URL filters with redirect equivalence, in DataFrame functions only.

Rules judge a URL by host suffix and path prefix. Redirects and canonical links make URLs aliases; components over
these edges carry decisions to aliases that no rule fits, and an explicit allow goes before a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import components


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # fits this host and its subdomains
    path: str = "/"  # fits paths that start with it

    @property
    def text(self) -> str:
        return self.host + self.path


#: Tasks that the rows of one URL are spread over when they meet the verdict of its aliases.
SALTS = 16
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?is)<link\s[^>]*>"""
REFRESH = r"""(?is)<meta\s[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*>"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first ``://`` and the next ``/ ? #``, A-Z lowered; path: from there to ``? #``. Else empty."""
    part = lambda n: F.coalesce(F.regexp_extract(url, URL, n), F.lit(""))
    return _lower(part(1)), part(2)


def fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, nulls without one; of equally long rules an allow goes first.

    Host and path are bound once, however many rules there are.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow", r.text))

    def judged(x: Column) -> Column:
        h, p = x["h"], x["p"]
        fits = [((h == r.host) | h.endswith("." + r.host)) & p.startswith(r.path) for r in ranked]
        pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values)], F.lit(None).cast("string"))
        return F.struct(pick([r.text for r in ranked]).alias("rule"), pick([r.verdict for r in ranked]).alias("verdict"))

    return F.transform(F.array(F.struct(host.alias("h"), path.alias("p"))), judged)[0]


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in quotes or bare; empty when it has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def _target(tag: Column) -> Column:
    """Where a canonical link or a refresh points; empty or null for other links."""
    kinds = F.split(F.lower(F.trim(_attribute(tag, "rel"))), r"\s+")
    canonical = F.when(F.array_contains(kinds, "canonical"), F.trim(_attribute(tag, "href")))
    return F.when(F.lower(tag).startswith("<link"), canonical).otherwise(F.regexp_extract(tag, r"""(?is)url\s*=\s*["']?([^\s"'>]+)""", 1))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's URL and that of its canonical link or its refresh redirect; relative ones are resolved when
    they start with ``/`` or ``//``, others that are not absolute are left out."""
    p = pages.select(F.col(url).alias("a"), F.col(html).alias("x")).where(F.col("a").isNotNull() & F.lower("x").rlike("canonical|refresh"))
    tags = F.concat(F.regexp_extract_all("x", F.lit(LINK), F.lit(0)), F.regexp_extract_all("x", F.lit(REFRESH), F.lit(0)))
    edges = p.select("a", F.explode(F.transform(tags, _target)).alias("to")).withColumn("to", F.regexp_replace(F.regexp_replace("to", "(?i)&(amp|#38|#x26);", "&"), "#.*$", ""))
    scheme = F.regexp_extract("a", "^([^:/]+:)//", 1)
    site = F.regexp_extract("a", "^([^:/]+://[^/?#]*)", 1)
    b = F.when(F.col("to").startswith("//"), F.concat(scheme, "to")).when(F.col("to").startswith("/"), F.concat(site, "to")).when(F.contains("to", F.lit("://")), F.col("to"))
    return edges.select("a", b.alias("b")).where("b is not null")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, decided_by (rule, alias or default).

    A URL that a rule fits has that rule's verdict. Else, with aliases: allow if any alias is allowed by a rule, block
    if one is blocked; without: allow. ``redirects(a, b)`` adds edges to those found in ``html``. URLs are compared
    without their fragments. Null URLs and URLs without ``://`` have empty host and path and are allowed; null keys stay
    null; repeated rows are all returned; other columns are not read. An empty table gives no rows.
    """
    u = pages.select(F.col(key).alias("k"), F.col(url).alias("u"))
    host, path = host_and_path(F.col("u"))
    fit = fitting(F.col("host"), F.col("path"), rules)
    judged = u.select("k", F.regexp_replace("u", "#.*$", "").alias("node"), host.alias("host"), path.alias("path")).withColumn("fit", fit)
    judged = judged.select("k", "node", "host", "path", "fit.rule", F.col("fit.verdict").alias("own"))
    edges = None
    if html is not None:
        edges = alias_edges(pages, url, html)
    if redirects is not None:
        edges = redirects.select("a", "b") if edges is None else edges.union(redirects.select("a", "b"))
    allow = F.lit("allow")
    if edges is None:
        return judged.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("own", allow).alias("verdict"), F.when(F.col("own").isNotNull(), "rule").otherwise("default").alias("decided_by"))
    groups = components(edges.select(F.regexp_replace("a", "#.*$", "").alias("a"), F.regexp_replace("b", "#.*$", "").alias("b")))
    members = groups.select("node", "component").union(groups.select("component", "component").distinct())
    seen = members.withColumn("u", F.col("node"))
    seen = seen.withColumns({"host": host, "path": path}).withColumn("own", fit["verdict"])
    spread = seen.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    carried = members.join(spread, "component").select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("alias"))
    # Only URLs that no rule fits take an alias's verdict; rows of one URL are spread over SALTS tasks.
    salted = carried.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    open_ = F.col("own").isNull() & F.col("node").isNotNull()
    joined = judged.where(open_).withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")).join(salted, ["node", "salt"], "left").drop("salt")
    out = joined.unionByName(judged.where(~open_).withColumn("alias", F.lit(None).cast("string")))
    by = F.when(F.col("own").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default")
    return out.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("own", "alias", allow).alias("verdict"), by.alias("decided_by"))
