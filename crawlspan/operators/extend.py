"""What users add: page rules as table functions, issue mapping, and analyses over the stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.model import CATEGORIES, SEVERITIES


def plugin_page_view(parsed: DataFrame) -> DataFrame:
    """The stable part of a page that user code sees."""
    n = lambda c: F.size(c).alias(f"{c}_count")
    return parsed.select(
        "page_id", "url", "title", "meta_description", "meta_robots", "canonical", "viewport", "h1s", "h2s", n("links"), n("images"), n("scripts"), n("stylesheets"), "word_count", "body_text", "parse_ok"
    )


def run_udtf_rule(parsed: DataFrame, fn: Callable[..., list[tuple]], columns: list[str]) -> DataFrame:
    """Runs ``fn(*columns) -> [(rule_id, severity, category, message, detail_json)]`` on each page as a table function."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="rule_id string, severity string, category string, message string, detail_json string")
    class Rule:
        def eval(self, *args):
            yield from fn(*args)

    spark = parsed.sparkSession
    spark.udtf.register("crawlspan_user_rule", Rule)
    plugin_page_view(parsed).createOrReplaceTempView("crawlspan_page_view")
    return spark.sql(f"SELECT p.page_id, i.* FROM crawlspan_page_view p, LATERAL crawlspan_user_rule({', '.join('p.' + c for c in columns)}) i")


class GroupRule:
    """A user's rule over the pages of a group. An instance sees one group: :meth:`pages` for each Arrow batch of it, in
    order, then :meth:`end`; both give issues as (page_id, rule_id, severity, category, message, detail_json)."""

    def pages(self, batch: pa.RecordBatch) -> Iterable[tuple]:
        return ()

    def end(self) -> Iterable[tuple]:
        return ()


def run_group_rule(pages: DataFrame, rule: type[GroupRule], by: list[str], order: list[str]) -> DataFrame:
    """Runs a rule on each group of pages that are equal in the columns ``by``, its pages in ``order``, as a table function.

    A group passes through one task batch by batch, so what a task holds is what the rule keeps. A table that lacks a column
    is refused at once.
    """
    from pyspark.sql.functions import arrow_udtf

    lacks = [c for c in ("page_id", *by, *order) if c not in pages.columns]
    if lacks:
        raise ValueError(f"a rule over groups of pages needs a table with {', '.join(lacks)}")
    names = ("page_id", "rule_id", "severity", "category", "message", "detail_json")
    kinds = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in names[1:])])

    @arrow_udtf(returnType="page_id long, rule_id string, severity string, category string, message string, detail_json string")
    class Groups:
        def __init__(self) -> None:
            self.rule = rule()

        def eval(self, batch: pa.RecordBatch):
            yield self.table(self.rule.pages(batch))

        def terminate(self):
            yield self.table(self.rule.end())

        @staticmethod
        def table(issues: Iterable[tuple]) -> pa.Table:
            columns = list(zip(*issues, strict=True)) or [()] * len(kinds)
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    spark, name = pages.sparkSession, f"crawlspan_pages_{uuid.uuid4().hex}"
    pages.createOrReplaceTempView(name)
    spark.udtf.register("crawlspan_group_rule", Groups)
    quoted = lambda names: ", ".join(f"`{c}`" for c in names)
    out = spark.sql(f"SELECT * FROM crawlspan_group_rule(TABLE({name}) PARTITION BY {quoted(by)} ORDER BY {quoted(order)})")
    spark.catalog.dropTempView(name)
    return out


def map_plugin_issues(issues: DataFrame, plugin: str) -> DataFrame:
    """Rule ids get the plugin's name; what is no severity becomes warning, no category structured, no JSON null."""
    return issues.withColumns(
        {
            "rule_id": F.concat(F.lit(f"plugin.{plugin}."), F.col("rule_id")),
            "severity": F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("warning"),
            "category": F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("structured"),
            "detail_json": F.when(F.try_parse_json("detail_json").isNotNull(), F.col("detail_json")),
        }
    )


def run_analysis(analysis: str | Callable[[dict[str, DataFrame]], DataFrame], tables: dict[str, DataFrame]) -> DataFrame:
    """A user's analysis: a function of the tables, or one read-only statement over views of their names."""
    if callable(analysis):
        return analysis(tables)
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM (\n{analysis}\n)")
