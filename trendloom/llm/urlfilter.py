"""URL rules, with block decisions carried over to redirect and canonical-link aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep
from .components import connected_components

#: Rule sets of up to this many rules are a literal of the plan; larger ones are a table that hosts and paths are joined to.
LITERAL_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? or #. Both empty without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER), F.regexp_extract(url, pattern, 2)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest (verdict, host/path) rule that fits, allow before block at equal length; or null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    order = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
    table = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(rule.partition("/")[0]).alias("at"), F.lit("." + rule.partition("/")[0]).alias("below"), F.lit(rule[len(rule.partition("/")[0]) :]).alias("path")) for verdict, rule in order])
    fitting = F.filter(table, lambda r: ((host == r["at"]) | F.endswith(host, r["below"])) & F.startswith(path, r["path"]))
    return F.get(F.transform(fitting, lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))), F.lit(0))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(v, r) for v, r in rules], "verdict string, rule string")


def joined_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """places(host, path, ...) with r as best_rule gives it, for rules(verdict, rule) of any number.

    Each distinct place meets the rules by equi joins: its host and the domains above it by the rules' hosts; then, for each
    length that the paths of such a host's rules have, that long a start of its path. So what a place brings about is bounded by its own
    labels and the lengths of rules, not by the number of rules. No more labels are tried than the rules' hosts have.
    """
    at = F.regexp_extract("rule", r"(?s)^([^/]*)", 1)
    known = rules.where("rule is not null and verdict is not null").select("rule", "verdict", at.alias("at"), F.substr("rule", F.length(at) + 1).alias("start"))
    # Of an allow and a block by the same rule the allow counts.
    known = keep(known.groupBy("at", "start", "rule").agg(F.min("verdict").alias("verdict")).withColumn("n", F.length("start")), "rules")
    labels = known.agg(F.coalesce(F.max(F.size(F.split("at", "\\."))), F.lit(0))).first()[0]
    ones = keep(places.select("host", "path").distinct(), "places")
    parts = F.split("host", "\\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    tried = ones.select("host", "path", F.explode(above).alias("at")) if labels else ones.select("host", "path", F.lit("").alias("at")).where("false")
    starts = tried.join(known.select("at", "n").distinct(), "at").where(F.col("n") <= F.length("path")).withColumn("start", F.substr("path", F.lit(1), F.col("n")))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("allow"), F.struct("rule", "verdict").alias("r")))
    found = keep(starts.join(known.drop("n"), ["at", "start"]).groupBy("host", "path").agg(best.alias("b")).select("host", "path", F.col("b.r").alias("r")), "ruled")
    return places.join(found, ["host", "path"], "left")


def resource(url: Column) -> Column:
    """A URL as a node: scheme and host lower-cased, no fragment; null without ://."""
    url = F.regexp_replace(url.cast("string"), "(?s)#.*$", "")
    parts = r"(?s)^(.*?://[^/?]*)(.*)$"
    return F.when(url.contains("://"), F.concat(F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER), F.regexp_extract(url, parts, 2)))


def without_dots(path: Column) -> Column:
    """A path from its slash on, with . and .. segments taken out by a stack; .. above the root is dropped."""
    segments = F.split(F.substr(path, F.lit(2)), "/", -1)
    none = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    end = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(segments, none, step), end), "/"))).otherwise(path)


def alias_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst) of resources: canonical links and meta refreshes in the html, outside comments, resolved against the page's URL."""
    rows = pages.select(pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    rows = rows.where("url is not null").where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    shown = F.when(F.col("html").contains("<!--"), F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", "")).otherwise(F.col("html"))
    tags = rows.select("url", F.explode(F.regexp_extract_all(shown, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))).alias("tag"))
    quoted = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    named = lambda name: F.concat(*[F.regexp_extract("tag", rf"(?is)\b{name}{quoted}", g) for g in (1, 2, 3)])
    canonical = F.col("tag").rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b")
    refresh = F.col("tag").rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b")
    found = tags.where(canonical | refresh).select(
        "url", F.when(canonical, named("href")).otherwise(F.regexp_extract(named("content"), r"(?is)\burl\s*=\s*[\"']?([^\"']+)", 1)).alias("href"))
    found = found.select("url", F.trim(F.replace("href", F.lit("&amp;"), F.lit("&"))).alias("href")).where("href <> ''")
    based = keep(found, "alias_links").select(
        "url", "href", F.regexp_extract("url", r"(?s)^(.*?:)//", 1).alias("scheme"), F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1).alias("root"),
        F.regexp_extract("url", r"(?s)^(.*?://[^?#]*)", 1).alias("page"), F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*/)?", 1).alias("folder"))
    whole = (
        F.when(F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat("scheme", "href"))
        .when(F.col("href").startswith("/"), F.concat("root", "href"))
        .when(F.col("href").startswith("?"), F.concat("page", "href"))
        .otherwise(F.concat("root", F.when(F.col("folder") == "", F.lit("/")).otherwise(F.col("folder")), F.col("href")))
    )
    based = keep(based.select("url", whole.alias("whole")), "alias_urls")
    part = lambda g: F.regexp_extract("whole", r"(?s)^(.*?://[^/?#]*)([^?#]*)(.*)$", g)
    resolved = F.when(F.col("whole").contains("://"), F.concat(part(1), without_dots(part(2)), part(3)))
    return based.select(resource(F.col("url")).alias("src"), resource(resolved).alias("dst"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every page row.

    A page's own longest rule decides, so an explicit allow takes precedence over any block that reaches it. A page without
    a rule is blocked if one of its redirect and canonical aliases, near or far, is blocked by a rule; else it is allowed.
    rules are (verdict, host/path) pairs, or a table rules(verdict, rule) of any size. redirects(src, dst) adds redirect edges. Links in comments don't count, repeated ones count once; a base tag isn't looked at. Alias URLs count whether or not they are pages. A null URL or one without
    :// has an empty host and path, fits no rule and has no aliases. Rows stay as often as they come; other columns of
    pages are not read.
    """
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(resource(F.col("src")), resource(F.col("dst"))))
    if isinstance(rules, list) and len(rules) > LITERAL_RULES:
        rules = rule_table(pages.sparkSession, rules)

    def ruled(rows: DataFrame) -> DataFrame:
        return rows.withColumn("r", best_rule(F.col("host"), F.col("path"), rules)) if isinstance(rules, list) else joined_rules(rows, rules)

    nodes = connected_components(edges)
    host, path = host_and_path(F.col("node"))
    marked = keep(ruled(nodes.withColumn("host", host).withColumn("path", path)), "aliases")
    blocked = keep(marked.where("r.verdict = 'block'").select("component").distinct(), "blocked")
    aliased = keep(marked.join(blocked, "component", "left_semi").select("node"), "blocked_aliases")
    host, path = host_and_path(pages[url_col])
    own = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"), resource(pages[url_col]).alias("node"))
    own = ruled(own)
    hit = own.join(aliased.withColumn("hit", F.lit(True)), "node", "left")
    return hit.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("hit"), F.lit("block")), F.lit("allow")).alias("verdict"))
