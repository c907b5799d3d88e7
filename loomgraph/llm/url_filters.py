"""URL rules whose block decisions reach redirect and canonical-link aliases. DataFrame operations only.

A rule is a host and a path prefix; it fits the host and its subdomains, and the longest rule that fits decides.
Redirects (meta refresh, or a table of them) and canonical links join pages into classes of aliases. A page that no
rule fits is blocked if any alias of its class is blocked by a rule. An explicit allow takes precedence: a page
that an allow rule decides is never blocked through an alias, and it does not clear its aliases either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpoint
from .components import connected_components

#: Up to so many rules are one expression; more of them are a table that is joined by host suffix.
MOST_IN_EXPRESSION = 200


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    name, _, rest = rule.partition("/")
    return name, "/" + rest


def decide(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds rule and action (null where none fits) to df with columns host and path and a unique row_key.

    Of the rules that fit the longest wins; of equally long ones that with the longer host, then allow."""
    if len(rules) <= MOST_IN_EXPRESSION:
        rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
        for kind, text in sorted(rules, key=lambda r: (len(r[1]), len(_split(r[1])[0]), r[0] == "allow")):
            name, prefix = _split(text)
            fits = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit(prefix))
            rule, action = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(action)
        return df.withColumns({"rule": rule, "action": action})
    table = df.sparkSession.createDataFrame([(*_split(r), r, k) for k, r in rules], "rule_host string, rule_path string, rule string, action string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = df.select("row_key", "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host").filter(F.startswith("path", F.col("rule_path")))
    order = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("host"), (F.col("action") == "allow").alias("allows"), "rule", "action")
    best = fit.groupBy("row_key").agg(F.max(order).alias("best"))
    return df.join(best, "row_key", "left").withColumns({"rule": F.col("best.rule"), "action": F.col("best.action")}).drop("best")


def _query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A[^#]*?(\?[^#]*)", 1), F.lit(""))


def _with_node(df: DataFrame, url: str, name: str) -> DataFrame:
    """Adds what two spellings of one address share: host, path and query, without scheme and fragment."""
    u = F.col(url)
    parts = df.withColumns({"_host": host(u), "_path": path(u), "_query": _query(u)})
    return parts.withColumn(name, F.when(F.col("_host") != "", F.concat("_host", "_path", "_query"))).drop("_host", "_path", "_query")


def links(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of the canonical links and meta refreshes in pages(url, html)."""
    tag = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?\s*canonical\b[^>]*>"
    refresh = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>"
    href = F.regexp_extract(F.regexp_extract("html", tag, 0), r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    to = F.regexp_extract(F.regexp_extract("html", refresh, 0), r"(?is)\burl\s*=\s*([^\"'>\s]+)", 1)
    some = pages.select("url", "html").filter(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    found = some.select("url", F.explode(F.array(href, to)).alias("href")).filter("href <> ''")
    # An address in a page is made absolute.
    own = found.select("url", F.trim(F.regexp_replace("href", "&amp;", "&")).alias("at"), host(F.col("url")).alias("own_host"), F.regexp_extract(path(F.col("url")), r"(?s)\A(.*/)", 1).alias("folder"))
    at, here = F.col("at"), F.concat(F.lit("http://"), "own_host")
    absolute = (
        F.when(F.contains(at, F.lit("://")), at)
        .when(F.startswith(at, F.lit("//")), F.concat(F.lit("http:"), at))
        .when(F.startswith(at, F.lit("/")), F.concat(here, at))
        .when(at != "", F.concat(here, F.when(F.col("folder") == "", "/").otherwise(F.col("folder")), at))
    )
    return _with_node(_with_node(own.withColumn("to", absolute), "url", "src"), "to", "dst").select("src", "dst")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """Judge all rows of pages(page_id, url, html). rules: (allow or block, rule); redirects: (from_url, to_url).

    Returns page_id, url, host, path, rule (null if none fits), verdict and by_alias (blocked through an alias).
    The longest rule that fits decides; of equally long ones that with the longer host, then allow.
    A url that is null or has no :// has an empty host and path, fits no rule, has no aliases and is allowed.
    Repeated rows stay, further columns are dropped, an empty table gives no rows.
    """
    own = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row_key"))
    judged = decide(own, rules)
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(_with_node(_with_node(redirects.select("from_url", "to_url"), "from_url", "src"), "to_url", "dst").select("src", "dst"))
    edges = checkpoint(edges.filter("src is not null and dst is not null and src <> dst").distinct())
    if edges.isEmpty():
        blocked = None
    else:
        members = connected_components(edges)
        address = F.concat(F.lit("http://"), F.col("node"))
        ruled = decide(members.select("*", host(address).alias("host"), path(address).alias("path"), F.monotonically_increasing_id().alias("row_key")), rules)
        bad = ruled.filter("action = 'block'").select("component").distinct()
        blocked = members.join(bad, "component", "left_semi").select("node")
    if blocked is None:
        by_alias = judged.withColumn("by_alias", F.lit(False))
    else:
        by_alias = _with_node(judged, "url", "node").join(blocked.withColumn("hit", F.lit(True)), "node", "left").withColumn("by_alias", F.col("action").isNull() & F.col("hit").isNotNull())
    verdict = F.when(F.col("action").isNotNull(), F.col("action")).when(F.col("by_alias"), "block").otherwise("allow")
    return by_alias.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), "by_alias")
