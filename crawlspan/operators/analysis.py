"""Batch analysis by a language model as table operations; the model call is the user's function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlspan.functions.text import compute_cost, json_valid, truncate_words

#: Tokens that an estimate counts for a request, the share of a budget at which a run stops, words of page text in a prompt.
TOKENS_IN, TOKENS_OUT, STOP_SHARE, PROMPT_WORDS = 2000, 500, 0.9, 4000
#: Analysis types: most tokens to answer in, temperature, task.
TYPES = {
    "content_score": (500, 0.3, "Rate the page's content for quality, relevance, readability and depth, 0 to 100 each, with suggestions."),
    "meta_desc": (300, 0.5, "Write a meta description of at most 160 characters for the page."),
    "title_tag": (400, 0.5, "Suggest three title tags of at most 60 characters for the page."),
    "structured_data": (800, 0.3, "Propose structured data for the page."),
    "accessibility": (800, 0.3, "List accessibility problems of the page and how to fix them."),
}
RESULTS = {
    "content_score": "struct<qualityScore:double,relevanceScore:double,readabilityScore:double,depthScore:double,suggestions:array<string>>",
    "meta_desc": "struct<description:string,reasoning:string>",
    "title_tag": "struct<suggestions:array<struct<title:string,reasoning:string>>>",
}
SUMMARY = "struct<summary:string,topActions:array<string>,overallHealth:string,criticalIssuesCount:int,keyFindings:array<string>>"


def eligible_pages(pages: DataFrame, issues: DataFrame | None = None, only_with_issues: bool = False, only_missing_meta: bool = False, limit: int | None = None) -> DataFrame:
    """Pages that answered 200 and have text, by id."""
    out = pages.filter("status_code = 200 and body_text is not null")
    if only_missing_meta:
        out = out.filter("coalesce(title, '') = '' or coalesce(meta_desc, '') = ''")
    if only_with_issues:
        out = out.join(issues.select("crawl_id", "page_id").distinct(), ["crawl_id", "page_id"], "left_semi")
    return out if limit is None else out.orderBy("page_id").limit(limit)


def eligible_count(*args, **kw) -> DataFrame:
    return eligible_pages(*args, **kw).agg(F.count(F.lit(1)).alias("n"))


def cost_estimate(counted: DataFrame, types: list[str], rate_in: float, rate_out: float) -> DataFrame:
    """Tokens and price of analysing ``n`` pages."""
    if not types:
        raise ValueError("no analysis type is chosen")
    requests = F.col("n") * len(types)
    return counted.select("n", requests.alias("requests"), (requests * TOKENS_IN).alias("tokens_in"), (requests * TOKENS_OUT).alias("tokens_out"), compute_cost(requests * TOKENS_IN, requests * TOKENS_OUT, F.lit(rate_in), F.lit(rate_out)).alias("cost_usd"))


def with_content_hash(pages: DataFrame) -> DataFrame:
    return pages.withColumn("content_hash", F.sha2("body_text", 256))


def cache_split(todo: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) by crawl, content and type: a page of equal text is a hit too; equal missing texts are asked once."""
    key = ["crawl_id", "content_hash", "analysis_type"]
    known = cache.dropDuplicates(key).select(*key, "result_json")
    return todo.join(known, key), todo.join(known, key, "left_anti").dropDuplicates(key)


def build_requests(pages: DataFrame, types: list[str]) -> DataFrame:
    """One request for each page and known type."""
    kinds = F.array(*[F.struct(F.lit(t).alias("analysis_type"), F.lit(TYPES[t][0]).alias("max_tokens"), F.lit(TYPES[t][1]).alias("temperature"), F.lit(TYPES[t][2]).alias("task")) for t in types if t in TYPES])
    each = pages.withColumn("kind", F.explode(kinds)).select("*", "kind.*").drop("kind")
    user = F.concat(F.lit("URL: "), F.col("url"), F.lit("\nTitle: "), F.coalesce("title", F.lit("(none)")), F.lit("\n\n"), truncate_words(F.col("body_text"), PROMPT_WORDS))
    return each.withColumn("system_prompt", F.concat(F.lit("You audit web pages. "), F.col("task"), F.lit(" Answer in JSON."))).withColumn("user_prompt", user).drop("task")


def complete(requests: DataFrame, fn: Callable[[str, str, int, float], tuple[str, int, int, str, int]]) -> DataFrame:
    """Calls ``fn(system, user, max_tokens, temperature) -> (text, tokens in, tokens out, model, milliseconds)`` in the tasks."""
    keys = ["crawl_id", "page_id", "analysis_type", "content_hash"]

    def run(batches):
        import pandas as pd

        for b in batches:
            got = [fn(*x) for x in zip(b["system_prompt"], b["user_prompt"], b["max_tokens"], b["temperature"], strict=True)]
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(got, columns=["result_json", "input_tokens", "output_tokens", "model", "latency_ms"])], axis=1)

    return requests.select(*keys, "system_prompt", "user_prompt", "max_tokens", "temperature").mapInPandas(
        run, "crawl_id string, page_id long, analysis_type string, content_hash string, result_json string, input_tokens long, output_tokens long, model string, latency_ms long"
    )


def valid_results(results: DataFrame) -> DataFrame:
    return results.filter(json_valid(F.col("result_json")))


def usage_ledger(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("crawl_id", "provider", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("requests"))


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.agg(F.sum("cost_usd").alias("cost_usd"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("requests").alias("requests"))


def budget_cut(pages: DataFrame, tokens: Column, budget: int, order: str = "page_id", blocks: int = 64) -> DataFrame:
    """Pages in order until nine tenths of the budget were used before one; ``used_before`` is the running sum.

    The sum runs inside ranges of the order; ranges are joined by their own sums, one row each, so no task reads all.
    """
    ranged = pages.withColumn("tokens", tokens).repartitionByRange(blocks, order).withColumn("range", F.spark_partition_id())
    sums = ranged.groupBy("crawl_id", "range").agg(F.sum("tokens").alias("own"))
    before = sums.select("crawl_id", "range", (F.sum("own").over(Window.partitionBy("crawl_id").orderBy("range")) - F.col("own")).alias("before"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("crawl_id", "range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumn("inside", inside).join(before, ["crawl_id", "range"]).withColumn("used_before", F.col("before") + F.col("inside"))
    return out.filter(F.col("used_before") < STOP_SHARE * budget).drop("range", "inside", "before")


def batch_result(results: DataFrame, budget: int) -> DataFrame:
    ok = json_valid(F.col("result_json"))
    used = F.sum(F.when(ok, F.col("input_tokens") + F.col("output_tokens")).otherwise(0))
    return results.agg(F.count_distinct(F.when(ok, F.col("page_id"))).alias("pages"), used.alias("tokens"), F.count_if(~ok).alias("errors"), (used >= STOP_SHARE * budget).alias("exhausted"))


def upsert_analyses(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same crawl, page and type; the newest of several stays."""
    both = old.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)))
    last = Window.partitionBy("crawl_id", "page_id", "analysis_type").orderBy(F.col("seq").desc(), F.col("created_at").desc())
    return both.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n", "seq")


def page_analyses(analyses: DataFrame, page_id: int | None = None) -> DataFrame:
    out = analyses if page_id is None else analyses.filter(F.col("page_id") == page_id)
    return out.orderBy("page_id", "analysis_type")


def summary_input(crawls: DataFrame, counts: DataFrame) -> DataFrame:
    """What a crawl's summary is asked from, as JSON with sorted keys."""
    j = crawls.join(counts, "crawl_id", "left").na.fill(0, ["errors", "warnings", "infos"])
    return j.select("crawl_id", F.to_json(F.struct("errors", "infos", "start_url", "status", "urls_crawled", "warnings")).alias("input_json"))


def typed_results(analyses: DataFrame) -> DataFrame:
    """Typed columns beside the JSON, null where it does not parse."""
    return analyses.select("*", *[F.when(F.col("analysis_type") == t, F.from_json("result_json", s)).alias(t) for t, s in RESULTS.items()])


def typed_summary(summaries: DataFrame) -> DataFrame:
    return summaries.withColumn("parsed", F.from_json("summary_json", SUMMARY)).select("crawl_id", "parsed.*")
