"""Analysing a crawl's pages with a language model as one job that can be stopped and resumed.

The job does what a loop over the pages in order would do: it stops before the first page at which nine tenths of the token
budget are used, counts tokens of answers from the cache as used, asks each text once and drops answers that are not JSON (a
text whose answer was dropped is asked again in another round at the earliest, with its next page's prompt). To
ask many pages at once it goes in rounds: a round takes the pages that the loop would surely still reach, because the most
that they can use (a token is a byte at least, and an answer has its own limit) fits into what is left.

Each round writes its answers, then a row of the ledger, below one folder. A job that is started again on the folder reads the
ledger, takes up a round whose answers were written and goes on after its last page; no page whose answer was written is
asked again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlspan.functions.text import compute_cost, json_valid
from crawlspan.operators.analysis import STOP_SHARE, TYPES, build_requests, with_content_hash
from crawlspan.sources.scratch import cut, exists

#: A call of the model: system prompt, user prompt, most tokens to answer in, temperature -> text, tokens in, tokens out,
#: model, milliseconds. It raises where the provider fails.
Model = Callable[[str, str, int, float], tuple[str, int, int, str, int]]
ANSWER = "struct<analysis_type:string,result_json:string,input_tokens:long,output_tokens:long,model:string,latency_ms:long>"
ANALYSES = "crawl_id string, page_id long, analysis_type string, content_hash string, provider string, model string, result_json string, input_tokens long, output_tokens long, cost_usd double, latency_ms long"
LEDGER = "round int, first_page long, last_page long, pages long, input_tokens long, output_tokens long, cost_usd double, errors long, asked long"


@dataclass(frozen=True)
class Batch:
    """What to ask and where to keep it. ``rates``: price of a thousand tokens in and out; ``most``: pages of a round;
    ``token_bytes``: the least bytes of a prompt's token, by which a round is filled. Where a model uses more tokens than
    that, a round may ask pages that the loop would not have reached; their answers are kept, but don't count."""

    types: tuple[str, ...]
    budget: int
    path: str
    provider: str = "local"
    rates: tuple[float, float] = (0.0, 0.0)
    most: int = 10_000
    token_bytes: float = 1.0
    ranges: int = 64


def _ordered(pages: DataFrame, batch: Batch) -> DataFrame:
    """page_id, content_hash and ``upto``, the most tokens that all pages up to this one can use. The running sum is taken
    inside ranges of the order and moved on by the sums of the ranges before, one row each."""
    room = sum(TYPES[t][0] for t in batch.types if t in TYPES)
    prompts = build_requests(pages, list(batch.types)).groupBy("page_id").agg(F.sum(F.octet_length("system_prompt") + F.octet_length("user_prompt")).alias("bytes"))
    sized = with_content_hash(pages).select("page_id", "content_hash").join(prompts, "page_id", "left").select("page_id", "content_hash", (F.ceil(F.coalesce("bytes", F.lit(0)) / batch.token_bytes) + room).alias("use"))
    ranged = cut(sized.repartitionByRange(batch.ranges, "page_id").withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("range").agg(F.sum("use").alias("own"))
    before = sums.select("range", (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("before"))
    inside = F.sum("use").over(Window.partitionBy("range").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0))
    return cut(ranged.withColumn("inside", inside).join(before, "range").select("page_id", "content_hash", (F.col("before") + F.col("inside")).alias("upto")))


def _ask(units: DataFrame, model: Model) -> DataFrame:
    """One row for each text: its answers in the order of the types, and whether a call failed; calls end at a failure."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for page, crawl, sha, requests in zip(b["page_id"], b["crawl_id"], b["content_hash"], b["requests"], strict=True):
                answers, failed = [], False
                for r in sorted(requests, key=lambda r: r["place"]):
                    try:
                        text, n_in, n_out, name, took = model(r["system_prompt"], r["user_prompt"], r["max_tokens"], r["temperature"])
                    except Exception:  # whatever the provider raises is that page's failure, not the job's
                        failed = True
                        break
                    answers.append({"analysis_type": r["analysis_type"], "result_json": text, "input_tokens": n_in, "output_tokens": n_out, "model": name, "latency_ms": took})
                rows.append((crawl, page, sha, answers, failed))
            yield pd.DataFrame(rows, columns=["crawl_id", "page_id", "content_hash", "answers", "failed"])

    return units.mapInPandas(run, f"crawl_id string, page_id long, content_hash string, answers array<{ANSWER}>, failed boolean")


def ledger(spark, path: str) -> DataFrame:
    """A row for each finished round."""
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger/*") if exists(spark, f"{path}/ledger") else spark.createDataFrame([], LEDGER)


def analyses(spark, path: str) -> DataFrame:
    """The valid answers of all rounds, each under the first page of its text."""
    return spark.read.schema(ANALYSES).parquet(f"{path}/answers/*/valid") if exists(spark, f"{path}/answers") else spark.createDataFrame([], ANALYSES)


def _round(pages: DataFrame, chosen: DataFrame, cache: DataFrame, batch: Batch, model: Model, folder: str) -> None:
    """Asks what the cache lacks of the chosen pages, and writes the valid answers and what each page comes to."""
    known = cache.groupBy("content_hash").agg(F.collect_set("analysis_type").alias("have"))
    mine = with_content_hash(pages).join(chosen.select("page_id"), "page_id", "left_semi")
    first = mine.groupBy("content_hash").agg(F.min("page_id").alias("page_id"))
    place = F.array_position(F.array(*map(F.lit, batch.types)), F.col("analysis_type"))
    asked = build_requests(mine.join(first, ["content_hash", "page_id"], "left_semi"), list(batch.types)).join(known, "content_hash", "left").filter("have is null or not array_contains(have, analysis_type)")
    units = asked.groupBy("crawl_id", "page_id", "content_hash").agg(F.collect_list(F.struct(place.alias("place"), "analysis_type", "system_prompt", "user_prompt", "max_tokens", "temperature")).alias("requests"))
    told = cut(_ask(units, model))
    answers = told.select("crawl_id", "page_id", "content_hash", F.inline("answers")).withColumn("provider", F.lit(batch.provider))
    answers = answers.withColumn("cost_usd", compute_cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(batch.rates[0]), F.lit(batch.rates[1])))
    valid = answers.filter(json_valid(F.col("result_json"))).select(*(c.split()[0] for c in ANALYSES.split(", ")))
    valid.write.mode("overwrite").parquet(f"{folder}/valid")
    fresh = pages.sparkSession.read.schema(ANALYSES).parquet(f"{folder}/valid")
    use = cache.unionByName(fresh).groupBy("content_hash").agg(F.sum("input_tokens").alias("n_in"), F.sum("output_tokens").alias("n_out"), F.sum("cost_usd").alias("cost"))
    per_text = told.select("content_hash", "failed")
    # A page with a failed call counts as an error and its tokens as none.
    zero = lambda c, of: F.when(F.coalesce("failed", F.lit(False)), of).otherwise(F.coalesce(c, of)).alias(c)
    each = chosen.join(per_text, "content_hash", "left").join(use, "content_hash", "left").select("page_id", zero("n_in", F.lit(0)), zero("n_out", F.lit(0)), zero("cost", F.lit(0.0)), F.coalesce("failed", F.lit(False)).alias("failed"))
    each.write.mode("overwrite").parquet(f"{folder}/pages")
    told.agg(F.coalesce(F.sum(F.size("answers") + F.col("failed").cast("int")), F.lit(0)).alias("asked")).write.mode("overwrite").parquet(f"{folder}/asked")


def _book(spark, folder: str, out: str, number: int, used: int, limit: float) -> None:
    """The ledger's row of a round whose answers are written. Should it have used more than it could, the pages that the loop
    would not have reached don't count."""
    each = spark.read.parquet(f"{folder}/pages")
    total = each.agg(F.sum(F.col("n_in") + F.col("n_out"))).first()[0] or 0
    if used + total >= limit:
        so_far = F.sum(F.col("n_in") + F.col("n_out")).over(Window.orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1))  # a round has a bounded number of pages
        each = each.withColumn("before", F.coalesce(so_far, F.lit(0)) + used).filter(F.col("before") < limit)
    row = each.agg(F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"), F.count(F.lit(1)).alias("pages"), F.sum("n_in").alias("input_tokens"), F.sum("n_out").alias("output_tokens"), F.sum("cost").alias("cost_usd"), F.count_if("failed").alias("errors"))
    row = row.crossJoin(spark.read.parquet(f"{folder}/asked"))  # one row each
    row.withColumn("round", F.lit(number)).select(*(c.split()[0] for c in LEDGER.split(", "))).coalesce(1).write.mode("overwrite").parquet(out)


def analyse_batch(pages: DataFrame, model: Model, batch: Batch, cache: DataFrame | None = None) -> DataFrame:
    """Runs or resumes a batch over one crawl's eligible pages (crawl_id, page_id, url, title, meta_desc, body_text) and gives
    its sums: pages, input_tokens, output_tokens, cost_usd, errors, asked, rounds, exhausted.

    ``cache`` has answers of earlier jobs, in the columns of :func:`analyses`.
    """
    if not any(t in TYPES for t in batch.types):
        raise ValueError("no known analysis type is chosen")
    spark, limit = pages.sparkSession, STOP_SHARE * batch.budget
    order = _ordered(pages, batch)
    before = cache.select(*(c.split()[0] for c in ANALYSES.split(", "))) if cache is not None else spark.createDataFrame([], ANALYSES)
    n = order.count()
    while True:
        done = ledger(spark, batch.path).agg(F.max("round"), F.max("last_page"), F.sum("pages"), F.sum(F.col("input_tokens") + F.col("output_tokens"))).first()
        number, last, finished, used = 0 if done[0] is None else done[0] + 1, done[1], done[2] or 0, done[3] or 0
        if used >= limit or finished >= n:
            break
        folder, row = f"{batch.path}/answers/round={number}", f"{batch.path}/ledger/round={number}"
        if not exists(spark, f"{folder}/asked/_SUCCESS"):
            rest = order if last is None else order.filter(F.col("page_id") > last)
            first = rest.agg(F.min("page_id")).first()[0]
            base = 0 if last is None else order.filter(F.col("page_id") == last).agg(F.max("upto")).first()[0]
            sure = F.col("upto") - base <= int(limit) - used
            chosen = rest.filter(sure | (F.col("page_id") == first)).orderBy("page_id").limit(batch.most)
            _round(pages, cut(chosen), before.unionByName(analyses(spark, batch.path)), batch, model, folder)
        _book(spark, folder, row, number, used, limit)
    sums = ledger(spark, batch.path).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "input_tokens", "output_tokens", "cost_usd", "errors", "asked")), F.count(F.lit(1)).alias("rounds"))
    return sums.withColumn("exhausted", F.lit(finished < n))


def page_answers(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Every page with the answers on its text, whichever page they were asked for."""
    return with_content_hash(pages).select("crawl_id", "page_id", "content_hash").join(answers.drop("page_id"), ["crawl_id", "content_hash"])
