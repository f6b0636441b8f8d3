"""URL filters with redirect equivalence: block decisions reach a page's aliases. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) for a host, its subdomains, and paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no :// gives an empty host."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule], field: str) -> Column:
    """The text or the verdict of the longest rule that fits, else null.

    Rules are a parameter of the query plan (a literal CASE, so there is no join and no shuffle); lists beyond some
    thousands of rules belong in a table keyed by host.
    """
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def address(url: Column) -> Column:
    """The node of a URL in the alias graph: host, path and query, without scheme and fragment; null without a host."""
    rest = F.regexp_extract(_rest(url), r"^([^#]*)", 1)
    host = host_of(url)
    return F.when(F.length(host) > 0, F.concat(host, F.substr(rest, F.length(host) + F.lit(1))))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']?\s*([^"'>\s]+)""", 1)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): a page's address and where its canonical link or its refresh sends readers.

    Targets may be absolute, //host/path, /path or relative to the page's folder; others (mailto: and the like) and
    empty ones give no edge.
    """
    url = F.col("url")
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1))

    def target(tag: Column) -> Column:
        canonical = F.lower(_attribute(tag, "rel")) == "canonical"
        refresh = F.lower(_attribute(tag, "http-equiv")) == "refresh"
        after_url = F.regexp_extract(tag, r"""(?is)\burl\s*=\s*["']?\s*([^"'>\s]+)""", 1)
        return F.when(canonical, _attribute(tag, "href")).when(refresh, after_url)

    def absolute(to: Column) -> Column:
        site = F.concat(F.regexp_extract(url, r"^(.*?)://", 1), F.lit("://"), host_of(url))
        folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
        return (
            F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
            .when(F.startswith(to, F.lit("//")), F.concat(F.lit("http:"), to))
            .when(F.startswith(to, F.lit("/")), F.concat(site, to))
            .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$"), None)
            .otherwise(F.concat(site, F.when(F.length(folder) > 0, folder).otherwise(F.lit("/")), to))
        )

    found = pages.where(url.isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    to = F.explode(F.transform(F.transform(F.transform(tags, target), absolute), address))
    return found.select(address(url).alias("u"), to.alias("v")).where("u is not null and v is not null and u <> v")


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict, alias_of for each row of pages (id, url, html; other columns are ignored).

    A page's own rule decides. Without one, the page takes the decision of its aliases: the component of redirect and
    canonical-link edges that its address lies in. If a rule allows any address there, the page is allowed (explicit
    allow precedes); else, if a rule blocks any, it is blocked; else it is allowed. alias_of is the component's
    smallest address, null for pages without aliases. Null URLs and URLs without :// have an empty host and path and
    are allowed. Repeated rows are judged alike, each once; an empty table gives no rows.
    """
    found = connected_components(alias_edges(pages.select("url", "html")))
    ruled = found.withColumn("_host", F.regexp_extract("node", r"^([^/?]*)", 1)).withColumn("_path", F.regexp_extract("node", r"^[^/?]*([^?]*)", 1))
    ruled = ruled.withColumn("decision", rule_of(F.col("_host"), F.col("_path"), rules, "verdict"))
    groups = ruled.groupBy("component").agg(
        F.max(F.col("decision") == "allow").alias("allowed"), F.max(F.col("decision") == "block").alias("blocked")
    )
    aliases = found.join(groups, "component").select(
        F.col("node").alias("_node"),
        F.col("component").alias("alias_of"),
        F.when(F.coalesce("allowed", F.lit(False)), F.lit("allow")).when(F.coalesce("blocked", F.lit(False)), F.lit("block")).alias("_group"),
    )
    own = pages.select(F.col(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("_node"))
    judged = own.join(aliases, "_node", "left")
    return judged.select(
        id_col,
        "host",
        "path",
        rule_of(F.col("host"), F.col("path"), rules, "text").alias("rule"),
        F.coalesce(rule_of(F.col("host"), F.col("path"), rules, "verdict"), "_group", F.lit("allow")).alias("verdict"),
        "alias_of",
    )
