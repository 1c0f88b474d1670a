"""Results of registered queries against plain versions of the same computation, and rows that nobody expects."""

import collections
import math
import re

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from crawlspan.llm import html_text, media, quality, queries, token_store, toxicity
from tests.conftest import DATA


def test_op1_is_noisy_or_over_sentences(spark):
    """The query's scores, from the model's weights and a sentence splitter of its own."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet"))

    def chance(sentence):
        z = model[""]
        for w in set(sentence.lower().split()):
            bare = w.strip(toxicity.EDGES)
            z += sum(model.get(f, 0.0) for f in toxicity.features(bare)) if bare else 0.0
        return 1 / (1 + math.exp(-max(-700.0, z)))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = 0
    for r in queries.op1_toxicity(spark, DATA).collect():
        parts = [s for s in re.split("[.!?\n。！？]", texts[r["doc_id"]]) if s.strip()]
        p = [chance(s) for s in parts]
        want = 1 - math.prod(1 - x for x in p)
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == (r["score"] >= 0.5) and r["offending"] == sum(x >= 0.5 for x in p)
        if r["offending"]:
            assert abs(chance(r["worst_sentence"]) - max(p)) < 1e-9
            seen += 1
    assert seen


def test_op6_is_extract_of_each_page(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    weights, pair = html_text.fit(pages)
    want = {r["page_id"]: html_text.extract(r["html"], weights, pair) for r in pages.collect()}
    got = queries.op6_html_text(spark, DATA).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_op6_odd_pages(spark):
    """Deep and long pages, rows repeated in full, columns named like results."""
    deep = "<div>" * 3000 + "<article><p>Deep words, and more of them.</p></article>" + "</div>" * 3000
    long = "<main>" + "<p>A sentence of the page, with words.</p>" * 30_000 + "</main>"
    rows = [(1, "u", deep, "x", 1), (2, "u", long, "x", 2), (3, "v", "<p>one</p>", "y", 3), (3, "v", "<p>one</p>", "y", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = collections.Counter((r["page_id"], r["n_chars"]) for r in html_text.extract_pages(df, html_text.START, html_text.START_PAIR).collect())
    assert got[1, len("Deep words, and more of them.")] == 1 and got[2, 30_000 * 36 - 1] == 1 and sum(n for (i, _), n in got.items() if i == 3) == 2


def test_op6_empty_table(spark, tmp_path):
    spark.read.parquet(f"{DATA}/pages.parquet").limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op6_html_text(spark, str(tmp_path)).collect() == []


def test_pipeline_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
    odd = [(None, None, None, None, None), (1, None, "en", None, 3), (2, "", "en", "a", 0), (3, "same words " * 20, "en", "a", 1), (3, "same words " * 20, "en", "a", 1), (4, "Same  words " * 20, "de", None, 1)]
    df = spark.createDataFrame(odd, docs.schema).withColumns({"kept": F.lit(1), "score": F.lit(0.5), "row": F.lit("r"), "text_sha256": F.lit("x")})
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, DATA)
        assert out.columns == df.columns, name
        df = spark.createDataFrame(out.collect(), df.schema)
    assert {r["doc_id"] for r in cp.STAGES[-1][1](spark, df, DATA).collect()} <= {3, 4}


def posteriors(each: pd.DataFrame) -> pd.DataFrame:
    """The hierarchy in plain arithmetic: rates of hosts about the whole, of paths about their hosts."""
    p = 1 / (1 + np.exp(-each["evidence"]))
    whole = p.mean()

    def strength(k, n, mean):
        rate = k / n
        between = max((n * (rate - mean) ** 2).sum() / n.sum() - (rate * (1 - rate)).sum() / n.sum(), 1e-6)
        middle = k.sum() / n.sum()
        return min(1000.0, max(2.0, middle * (1 - middle) / between - 1))

    sites = each.assign(k=p, n=1.0)
    hosts = sites.groupby("host", dropna=False)[["k", "n"]].sum().reset_index()
    m = strength(hosts["k"], hosts["n"], whole)
    hosts["host_rate"] = (hosts["k"] + m * whole) / (hosts["n"] + m)
    paths = sites.groupby(["host", "path"], dropna=False)[["k", "n"]].sum().reset_index().merge(hosts[["host", "host_rate"]], on="host")
    m = strength(paths["k"], paths["n"], paths["host_rate"])
    paths["path_rate"] = (paths["k"] + m * paths["host_rate"]) / (paths["n"] + m)
    out = each.merge(paths[["host", "path", "host_rate", "path_rate"]], on=["host", "path"])
    odds = lambda x: np.log(np.clip(x, 1e-4, 1 - 1e-4) / (1 - np.clip(x, 1e-4, 1 - 1e-4)))
    out["score"] = 1 / (1 + np.exp(-(out["evidence"] + odds(out["path_rate"]) - odds(whole))))
    return out


def hold(got: pd.DataFrame) -> None:
    want = posteriors(got[["doc_id", "host", "path", "evidence"]]).sort_values("doc_id")
    got = got.sort_values("doc_id")
    for c in ("host_rate", "path_rate", "score"):
        assert np.allclose(got[c], want[c], atol=1e-9), c


def test_op10_posteriors(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    weights = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scored = quality.score(docs, weights, F.col("source"), F.col("lang"))
    hold(scored.toPandas())
    query = {r["doc_id"]: r["score"] for r in queries.op10_quality(spark, DATA).collect()}
    assert all(abs(query[r["doc_id"]] - r["score"]) < 1e-12 for r in scored.collect())


def test_quality_of_pages_with_urls(spark):
    """Host and first path part of URLs; sites of one page shrink toward the whole, texts may be long, names may clash."""
    good = "A calm sentence with plain words, and another one. " * 8
    rows = [(i, good if i % 3 else "### @@ %% || $$$ " * 20, f"https://h{i % 7}.example/p{i % 3}/x", 0.1, "k") for i in range(120)]
    rows += [(500, "word " * 200_000, "https://alone.example/only/x", 0.1, "k"), (501, None, "no url", None, None), (502, good, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, evidence double, host string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    scored = quality.score(df, quality.fit(df, labels), *quality.url_levels("url"))
    got = scored.toPandas()
    hold(got)
    by = got.set_index("doc_id")
    assert len(got) == len(rows) and by.loc[500, "host"] == "alone.example" and by.loc[500, "path"] == "only"
    whole = (1 / (1 + np.exp(-got["evidence"]))).mean()
    own = 1 / (1 + math.exp(-by.loc[500, "evidence"]))
    assert min(own, whole) - 1e-9 <= by.loc[500, "path_rate"] <= max(own, whole) + 1e-9


@pytest.fixture
def store(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(40)
    return token_store.write_store(docs, P.path("word_bpe_49k.json"), 2, f"file://{tmp_path}/store")


def change(spark, store, part, how):
    """A copy of one table of a store, changed, in its place."""
    df = spark.read.parquet(f"{store}/{part}")
    rows = spark.createDataFrame(how(df).collect(), df.schema)
    (rows.write.mode("overwrite").partitionBy("part") if part == "recipes" else rows.write.mode("overwrite")).parquet(f"{store}/{part}")


@pytest.mark.parametrize("reader", [token_store.read_digests, token_store.read_documents])
@pytest.mark.parametrize(
    ("part", "how"),
    [
        ("manifest", lambda df: df.withColumn("root", F.lit(bytes(32)))),
        ("manifest", lambda df: df.withColumn("documents", F.col("documents") + 1)),
        ("root", lambda df: df.withColumn("root", F.lit(bytes(32)))),
        ("recipes", lambda df: df.filter("doc_id <> 5")),
        ("recipes", lambda df: df.withColumn("chunk_keys", F.reverse("chunk_keys"))),
        ("recipes", lambda df: df.withColumn("n_tokens", F.col("n_tokens") + (F.col("doc_id") == 5).cast("int"))),
        ("chunks", lambda df: df.filter("hex(sha) > '18'")),
        ("chunks", lambda df: df.withColumn("data", F.concat("data", F.lit(b"\0\0")))),
    ],
)
def test_damaged_stores_raise(spark, store, part, how, reader):
    reader(spark, store).collect()
    change(spark, store, part, how)
    with pytest.raises(Exception, match="root|manifest|missing|damaged|differ"):
        reader(spark, store).collect()


def test_cuts_depend_on_a_stream_alone():
    """Streams cut together or alone have the same chunks, of the right sizes."""
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 49_000, n).astype("<u2") for n in (0, 1, 63, 64, 5000, 20_000, 7, 3000)] + [np.zeros(9000, "<u2")]
    together = token_store.cuts(np.concatenate(streams), np.cumsum([0, *map(len, streams[:-1])]).tolist())
    assert together == [token_store.cuts(s, [0])[0] for s in streams]
    for s, ends in zip(streams, together, strict=True):
        sizes = np.diff([0, *ends])
        assert sizes.sum() == len(s) and (sizes <= token_store.LONGEST).all() and (sizes[:-1] >= token_store.SHORTEST).all()


def test_op4_features_from_plain_pixels(spark):
    """The feature string, from the payload's bytes alone."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()}
    got = {r["doc_id"]: r["feature"] for r in queries.op4_media(spark, DATA).collect()}
    for i, t in texts.items():
        payload = np.frombuffer(media.payload_of(t)[1], np.uint8).astype(float)
        mean = [payload[k::3].mean() for k in range(3)]
        dev = [payload[k::3].std() for k in range(3)]
        share = np.unique(payload, return_counts=True)[1] / len(payload)
        size, *values = re.split("[;,]", got[i])
        assert size == f"192x{len(payload) // 576}"
        assert np.allclose([float(v) for v in values], [*mean, *dev, -(share * np.log2(share)).sum()], atol=2e-2)
