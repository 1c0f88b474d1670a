"""The shared helpers: tables on the way, ids without moving rows, copies of a mix, sentences."""

import collections

import pytest
from pyspark.sql import functions as F

from crawlspan.llm import common, members, mixing, toxicity


@pytest.mark.parametrize("values", [1_200, 3_000, 6_000])
def test_filters_on_settled_columns(spark, values):
    """Pushed-down filters read the dictionary pages of a settled table."""
    df = common.settle(spark.range(12_000).select((F.xxhash64("id") % values).alias("n")))
    assert df.filter("n > 0").count() == spark.range(12_000).filter(F.xxhash64("id") % values > 0).count()


def test_steps_free_what_nothing_reads(spark):
    step = common.Steps()
    a, b = step(spark.range(5)), step(spark.range(7))
    step.free(b)
    assert b.count() == 7
    with pytest.raises(Exception, match="(?i)not.exist"):
        a.count()


@pytest.mark.parametrize("most", [members.MOST_SLOTS, 1 << 16])
def test_belongs(spark, monkeypatch, most):
    """The filters are never wrong, and leave few rows open unless they are full."""
    monkeypatch.setattr(members, "MOST_SLOTS", most)
    ids = spark.range(40_000)
    inside, outside = common.settle(ids.filter("id % 3 = 0")), common.settle(ids.filter("id % 3 > 0"))
    docs = ids.withColumnRenamed("id", "doc_id").unionByName(spark.createDataFrame([(None,)], "doc_id long"))
    got = docs.withColumn("told", members.belongs(inside, outside)).collect()
    assert all(r["told"] in (None, r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None)
    left_open = sum(r["told"] is None for r in got)
    assert [r["told"] for r in got if r["doc_id"] is None] == [None] and (left_open < 400 or most == 1 << 16)
    nobody = members.belongs(inside.limit(0), outside)
    assert {r[0] for r in docs.filter("doc_id is not null").select(nobody).collect()} == {False}


def test_apply_mix_takes_what_the_draw_says(spark):
    """Rows repeated in full, rows alike in id and size but not in source, null ids and sources."""
    rows = [(7, "a b c", "x")] * 5 + [(7, "a b d", "x")] * 3 + [(7, "e f g", "y")] * 4 + [(None, "h i", None)] * 6 + [(None, "j k", "y")] * 3
    rows += [(100 + i, "w " * (1 + i % 9), "xyz"[i % 3]) for i in range(300)] + [(i, None, "x") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = collections.Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["size"], r["src"]] += r["copies"]
    order = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    got = collections.Counter((r["doc_id"], len(r["text"].split()), order.index(r["source"])) for r in mixing.apply_mix(df).collect())
    assert got == +want


def test_one_splitter(spark):
    words = toxicity.Words({"": -4.0, "vile": 9.0, "bad": 4.5})
    text = "İ fine。 a bad one! you vile thing？ bye"
    score, offending, start, end = toxicity.judge(text, words)
    assert score > 0.99 and offending == 2 and text[start:end].strip() == "you vile thing"
    model = {"": -4.0, "vile": 9.0, "bad": 4.5}
    docs = spark.createDataFrame([(1, text, 0.0), (2, "bye. " * 20_000, 0.0), (2, "bye. " * 20_000, 0.0), (3, None, 1.0)], "doc_id long, text string, verdict double")
    found = toxicity.locate(docs, model)
    assert sorted(r["sentence_text"] for r in found.collect()) == ["a bad one", "you vile thing"]
    assert [tuple(r)[:1] for r in toxicity.reject(docs, {"": -40.0, "vile": 49.0}).orderBy("doc_id").collect()] == [(2,), (2,), (3,)]
    assert toxicity.reject(docs, model).columns == docs.columns
