"""robots.txt files as rules, and their decision on URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlspan.functions.urls import path_and_query, url_host


def _lines(docs: DataFrame) -> DataFrame:
    """(host, line, name, value); files that did not come with status 200 have none."""
    line = F.trim(F.regexp_replace("raw", "#.*", ""))
    each = docs.filter("status_code = 200").select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line", "raw"))
    return each.select("host", "line", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("name"), F.trim(F.regexp_replace(line, "^[^:]*:?", "")).alias("value")).filter("name <> ''")


def robots_rules(docs: DataFrame) -> DataFrame:
    """host, agent, allow, pattern, pattern_len: one row for each rule and agent of its group."""
    by_line = Window.partitionBy("host").orderBy("line")
    own = _lines(docs).filter("name in ('user-agent', 'allow', 'disallow')")
    starts = (F.col("name") == "user-agent") & (F.lag("name").over(by_line).isNull() | (F.lag("name").over(by_line) != "user-agent"))
    grouped = own.withColumn("start", starts.cast("int")).withColumn("group", F.sum("start").over(by_line))
    agents = grouped.filter("name = 'user-agent'").select("host", "group", F.lower("value").alias("agent"))
    rules = grouped.filter("name <> 'user-agent' and value <> ''").select("host", "group", (F.col("name") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return rules.join(agents, ["host", "group"]).select("host", "agent", "allow", "pattern", F.char_length("pattern").alias("pattern_len"))


def robots_extras(docs: DataFrame) -> DataFrame:
    """host, agent, crawl_delay (seconds), sitemaps."""
    by_line = Window.partitionBy("host").orderBy("line")
    lines = _lines(docs)
    agent = F.last(F.when(F.col("name") == "user-agent", F.lower("value")), ignorenulls=True).over(by_line)
    delays = lines.withColumn("agent", agent).filter("name = 'crawl-delay'").groupBy("host", "agent").agg(F.max(F.expr("try_cast(value as double)")).alias("crawl_delay"))
    maps = lines.filter("name = 'sitemap'").groupBy("host").agg(F.sort_array(F.collect_set("value")).alias("sitemaps"))
    return maps.join(delays, "host", "full_outer").select("host", "agent", "crawl_delay", F.coalesce("sitemaps", F.array().cast("array<string>")).alias("sitemaps"))


def _pattern(rule: str) -> F.Column:
    """A rule's pattern as an anchored regular expression."""
    quoted = F.regexp_replace(F.col(rule), r"([\\.\[\]{}()+?^|])", r"\\$1")
    quoted = F.regexp_replace(quoted, r"\*", ".*")
    return F.concat(F.lit("^"), F.when(quoted.endswith("$"), quoted).otherwise(F.regexp_replace(quoted, r"\$", r"\\$")))


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """``urls`` with ``allowed``: the longest matching rule decides, allow wins ties, no rule allows.

    An agent's own group replaces that for all agents.
    """
    own = rules.filter(F.col("agent").isin(agent.lower(), "*")).withColumn("mine", (F.col("agent") == agent.lower()) & F.lit(agent != "*"))
    which = own.groupBy("host").agg(F.max("mine").alias("mine"))
    chosen = own.join(which, ["host", "mine"]).select(F.col("host").alias("rule_host"), F.struct("pattern_len", "allow", _pattern("pattern").alias("regex")).alias("rule"))
    # A host's rules, from one robots file, are one small row, best rule first; a hot host is a skewed left side only.
    by_host = chosen.groupBy("rule_host").agg(F.sort_array(F.collect_list("rule"), asc=False).alias("rules"))
    keyed = urls.withColumn("rule_host", url_host(F.col("url"))).withColumn("path", path_and_query(F.col("url")))
    hit = F.try_element_at(F.filter("rules", lambda x: F.rlike(F.col("path"), x["regex"])), F.lit(1))["allow"]
    return keyed.join(by_host, "rule_host", "left").withColumn("allowed", F.coalesce(hit, F.lit(True))).select(*urls.columns, "allowed")
