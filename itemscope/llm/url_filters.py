"""URL filters with redirect equivalence.  DataFrame operations only.

A page's rule is the longest ``host/path`` rule that fits its URL.  URLs that
redirect (``meta refresh``) or point (``link rel=canonical``) to each other are
aliases: distributed connected components over those edges.  A page without a
rule takes its component's decision: allow if an alias has an allow rule
(explicit allow precedes), else block if an alias has a block rule, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemscope.llm.common import stash
from itemscope.llm.graph import connected_components

#: (action, host, path) in the order given; the longest rule that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return _ascii_lower(F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def _node(url: Column) -> Column:
    """The address without scheme and fragment; null without a host."""
    rest = F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^[^/?#]*([^#]*)", 1)
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.when(rest == "", F.lit("/")).otherwise(rest)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(u, v)``: addresses that a page's refresh or canonical link makes equal."""
    html = F.coalesce(F.col("html"), F.lit(""))
    found = (pages.where(F.instr("url", "://") > 0)
             .withColumns({"tag": F.regexp_extract(html, LINK, 0), "meta": F.regexp_extract(html, META, 0)})
             .where("tag <> '' or meta <> ''")
             .select("url", F.explode(F.array(F.regexp_extract("tag", HREF, 1),
                                              F.regexp_extract("meta", REFRESH, 1))).alias("link"))
             .where("link <> ''"))
    parts = found.withColumns({"scheme": F.regexp_extract("url", r"^(.*?)://", 1), "host": host_of(F.col("url")),
                               "path": path_of(F.col("url")), "u": _node(F.col("url"))})
    folder = F.regexp_extract("path", r"^(.*/)", 1)
    link = F.col("link")
    whole = (F.when(link.contains("://"), link)
             .when(link.startswith("//"), F.concat("scheme", F.lit(":"), link))
             .when(link.startswith("/"), F.concat("scheme", F.lit("://"), "host", link))
             .otherwise(F.concat(F.col("scheme"), F.lit("://"), F.col("host"),
                                 F.when(folder == "", F.lit("/")).otherwise(folder), link)))
    # the written table keeps the long expressions of both ends in separate plans
    ends = stash(parts.select("u", whole.alias("to")))
    return ends.select("u", _node(F.col("to")).alias("v")).where("u is not null and v is not null and u <> v")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path)`` -> ``(host, path, rule, action)`` of those that a rule fits.

    A rule ``(action, host, path)`` fits its host and all subdomains if the path
    starts with its path.  Longest rule text wins; of equal rules, allow wins.
    Only suffixes with at most as many labels as the longest rule host are looked up.
    """
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    parts = F.split("host", r"\.")
    last = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - (labels - 1)), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(last)),
                           lambda i: F.array_join(F.slice(last, i, F.size(last)), "."))
    r = rules.select("action", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    return (urls.select("host", "path").where("host <> ''").distinct()
            .withColumn("suffix", F.explode(suffixes))
            .join(r, F.col("suffix") == F.col("rule_host")).where(F.col("path").startswith(F.col("rule_path")))
            .withColumn("rule", F.concat("rule_host", "rule_path"))
            .groupBy("host", "path").agg(F.max(F.struct(
                F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), "rule")).alias("best"))
            .select("host", "path", "best.rule",
                    F.when(F.col("best.allow"), "allow").otherwise("block").alias("action")))


def judge_urls(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with ``(host, path, rule, verdict, component)``.

    A null URL or one without ``://`` has an empty host and path, no rule, no
    aliases and the verdict allow.  Repeated rows get equal results; null html
    has no links; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(list(RULES), "action string, host string, path string")
    seen = stash(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                              _node(F.col("url")).alias("node")))
    parts = connected_components(alias_edges(pages.select("url", "html")))
    linked = parts.select("node", "root", F.regexp_extract("node", r"^([^/?#]*)", 1).alias("host"),
                          F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    decided = stash(match_rules(seen.select("host", "path").union(linked.select("host", "path")), rules))
    said = (linked.join(decided, ["host", "path"]).groupBy("root")
            .agg(F.max(F.col("action") == "allow").alias("allowed")))
    group = parts.join(said, "root", "left").select(F.col("node").alias("n"), F.col("root").alias("component"), "allowed")
    out = (seen.join(decided, ["host", "path"], "left")
           .join(group, F.col("node") == F.col("n"), "left"))
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(~F.col("allowed"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("component", "node").alias("component"))
