"""Quality by hierarchical empirical Bayes over documents, paths and hosts.

A logistic classifier gives each document's own evidence. Sites then speak through grouped aggregation: the classifier's
posteriors add up by host and by path below it, each level is a beta-binomial whose strength comes from the moments of its
groups, and a sparse path shrinks toward its host, a sparse host toward the global rate. A document's final score adds the
odds of its path's posterior to its own likelihood ratio.

The classifier is fitted on a bounded, hash-ordered sample of labelled documents (MOST_DOCS of each label); everything else
covers all rows. Held-out documents (see :func:`crawlspan.llm.common.held_out`) never serve to fit it.

Defined cases: a null text counts as empty; null hosts and paths are groups of their own; rows without id are scored and not
learnt from; without labels of both kinds the classifier says one half for every text; repeated rows are each scored and
count in their groups; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.llm.common import held_out, settle, small_batches

MOST_DOCS = 4000
#: Strength bounds of a level's prior, in documents.
STRENGTH = (2.0, 1000.0)
_SYMBOLS = re.compile(r"[^\w\s.,;:'\"()!?-]")


def text_features(text: str | None) -> list[float]:
    """Shares that tell prose from debris; all of the whole text."""
    t = text or ""
    words, lines = t.split(), [x for x in t.split("\n") if x.strip()]
    n, m, k = max(1, len(t)), max(1, len(words)), max(1, len(lines))
    letters = sum(map(len, re.findall(r"[^\W\d_]+", t)))
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    return [
        1.0, math.log1p(len(words)), letters / n, len(_SYMBOLS.findall(t)) * 4 / m, t.count("|") * 4 / m, t.count("!") * 4 / m, upper / m,
        (t.count(".") + t.count(",")) * 4 / m, len(set(words)) / m, 1 - len(set(lines)) / k, sum(map(len, words)) / m / 10, sum(c.isdigit() for c in t) * 10 / n,
        sum(1 for x in lines if x.rstrip()[-1] in ".!?") / k,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w)) / 10
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(y) / 10 * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return w


def _evidence(texts: pd.Series, weights: list[float]) -> pd.Series:
    w = np.array(weights)
    return pd.Series([float(np.clip(np.dot(text_features(t), w), -12, 12)) for t in texts], dtype="float64")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Weights of :func:`text_features`, from a bounded sample with both labels."""
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).dropna().filter(~held_out("i")).groupBy("i").agg(F.min("y").alias("y")).withColumn("at", F.xxhash64("i"))
    sample = known.filter("y > 0").orderBy("at").limit(MOST_DOCS).unionByName(known.filter("y <= 0").orderBy("at").limit(MOST_DOCS))
    measure = F.pandas_udf(lambda s: s.map(lambda t: text_features(t), na_action=None) if len(s) else s, "array<double>")
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).join(sample, "i").select("at", "y", measure("t").alias("x")).orderBy("at", "x").limit(2 * MOST_DOCS).collect()
    y = np.array([float(r["y"] > 0) for r in rows])
    if not len(y) or y.min() == y.max():
        return [0.0] * len(text_features(""))
    return fit_logistic(np.array([r["x"] for r in rows]), y).tolist()


def _strength(groups: DataFrame, mean: str) -> F.Column:
    """Aggregate: documents that a level's prior counts for, by the moments of its groups' rates about ``mean``."""
    rate = F.col("k") / F.col("n")
    between = F.greatest(F.sum(F.col("n") * F.pow(rate - F.col(mean), 2)) / F.sum("n") - F.sum(rate * (1 - rate)) / F.sum("n"), F.lit(1e-6))
    middle = F.sum("k") / F.sum("n")
    return F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), middle * (1 - middle) / between - 1))


def score(docs: DataFrame, weights: list[float], host: F.Column, path: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, path, evidence (log odds of the text), host_rate, path_rate, score, kept."""
    small_batches(docs.sparkSession)
    look = F.pandas_udf(lambda texts: _evidence(texts, weights), "double")
    each = settle(docs.select(F.col(id_col).cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), look(F.col(text_col).cast("string")).alias("evidence")))
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = settle(each.groupBy("host", "path").agg(F.sum(p).alias("k"), F.count(F.lit(1)).cast("double").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    whole = hosts.agg((F.sum("k") / F.sum("n")).alias("global"))
    hosts = hosts.crossJoin(F.broadcast(whole))  # one row
    m = hosts.agg(_strength(hosts, "global").alias("m"))
    hosts = settle(hosts.crossJoin(F.broadcast(m)).select("host", "global", ((F.col("k") + F.col("m") * F.col("global")) / (F.col("n") + F.col("m"))).alias("host_rate")))
    h = hosts.withColumnRenamed("host", "h")
    paths = paths.join(h, paths["host"].eqNullSafe(h["h"])).drop("h")
    m = paths.agg(_strength(paths, "host_rate").alias("m"))
    paths = settle(paths.crossJoin(F.broadcast(m)).select(F.col("host").alias("h"), F.col("path").alias("q"), "global", "host_rate", ((F.col("k") + F.col("m") * F.col("host_rate")) / (F.col("n") + F.col("m"))).alias("path_rate")))
    odds = lambda c: F.log(F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(c))) / (1 - F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(c)))))
    out = each.join(paths, each["host"].eqNullSafe(paths["h"]) & each["path"].eqNullSafe(paths["q"]))
    final = F.col("evidence") + odds("path_rate") - odds("global")
    return out.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-final))).alias("score")).withColumn("kept", F.col("score") >= 0.5)


def url_levels(url: str) -> tuple[F.Column, F.Column]:
    """Host and first path part of a URL column, for tables of pages."""
    return F.expr(f"try_parse_url({url}, 'HOST')"), F.expr(f"split_part(try_parse_url({url}, 'PATH'), '/', 2)")
