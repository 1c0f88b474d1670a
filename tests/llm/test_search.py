"""Top-k search, hard negatives and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlspan.llm import negatives, queries, resample, tiles, topk
from crawlspan.llm.tiles import Block
from tests.conftest import DATA

VECTORS = "vec_id long, embedding array<float>, label int, score double, rank string, id int"


def vector_rows(n=400, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, dims)], int(rng.integers(0, 4)), 0.5, "r", 1) for i in range(n)]
    rows[3] = (3, None, 1, None, None, None)
    rows[5] = (5, [0.1, None, *[0.0] * (dims - 2)], 1, None, None, None)
    rows[20] = (20, [float("nan")] * dims, 1, None, None, None)
    rows[7] = (7, [float("inf")] * dims, 2, None, None, None)
    rows[9] = (9, rows[9][1], None, None, None, None)
    rows[11] = (11, [], 0, None, None, None)
    rows[13] = (13, [0.5, -0.5], 2, None, None, None)
    for i in range(100, 230):  # a third is one vector
        rows[i] = (i, rows[100][1], rows[i][2], None, None, None)
    rows.append((None, rows[1][1], 1, None, None, None))
    rows += [rows[150], rows[150]]
    return rows


def whole(rows, scale, need_label=False):
    out = []
    for i, v, label, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and not (need_label and label is None):
            out.append((i, label, [math.floor(scale * float(np.float32(x))) for x in v]))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_top(rows, k, every, scale):
    have = whole(rows, scale)
    out = []
    for i, _, q in sorted({r[0]: r for r in have if r[0] % every == 0}.values()):
        found = sorted((-dot(q, v), j) for j, _, v in have if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), VECTORS).repartition(3)


@pytest.mark.parametrize("sizes", [(4096, 1024, 64, 256), (16, 4, 2, 2)])
def test_top_k(vectors, monkeypatch, sizes):
    for name, n in zip(("ROWS", "QUERIES", "GROUP", "STRIP"), sizes, strict=True):
        monkeypatch.setattr(tiles, name, n)
    monkeypatch.setattr(topk, "STRIP", sizes[3])
    got = topk.top_k(vectors, k=20, every=20, scale=64)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(vector_rows(), 20, 20, 64)


def test_top_k_odd_tables(spark, vectors):
    assert topk.top_k(vectors.limit(0)).collect() == []
    assert topk.top_k(vectors.filter("vec_id % 20 = 1")).collect() == []
    one = spark.createDataFrame([(0, [1.0, -2.0], 0, 0.1, "r", 1)], VECTORS)
    assert topk.top_k(one).collect() == []
    dotted = one.unionByName(one.withColumn("vec_id", F.lit(1).cast("long"))).withColumnRenamed("vec_id", "vec.id")
    assert [tuple(r) for r in topk.top_k(dotted, id_col="vec.id").collect()] == [(0, 1, 1, 64 * 64 * 5)]


def test_bounds_never_drop_a_row():
    """Every resolution's bound is at least the score, on data that bounds cut well and on data that they don't."""
    rng = np.random.default_rng(4)
    smooth = np.repeat(rng.integers(-50, 50, (300, 8)), 8, axis=1) + rng.integers(-2, 3, (300, 64))
    for x in (smooth, rng.integers(-60, 60, (300, 64)), rng.integers(-(10**5), 10**5, (50, 37))):
        exact = x @ x.T
        length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        for s in topk.SEGMENTS:
            b = topk.segment_sketch(x, s)
            assert ((b @ b.T).astype(float) + topk.SLACK * length[:, None] * length[None, :] >= exact).all()
    q = Block(np.arange(40), None, smooth[:40])
    search, best = topk.Search(5), None
    for at in range(0, 300, 50):
        best = search.tile(q, [], Block(np.arange(at, at + 50) + 1000, None, smooth[at : at + 50]), best)
    want = [[int(j) + 1000 for j in np.lexsort((np.arange(300), -(smooth[i] @ smooth.T)))[:5]] for i in range(40)]
    assert best.ids.reshape(40, 5).tolist() == want
    sketch = topk.segment_sketch(smooth, 4)
    assert ((sketch[:40] @ sketch.T) < best.floor[:40, None]).mean() > 0.2  # coarse segments alone cut here


def test_scores_that_do_not_fit_raise():
    big = Block(np.arange(3), np.zeros(3, np.int64), np.full((3, 4), 2**40))
    with pytest.raises(OverflowError):
        topk.Search(2).tile(big, [], big, None)
    with pytest.raises(OverflowError):
        negatives.Packed(big.comps, 0, 2**40)


@pytest.mark.parametrize(("low", "high", "dims"), [(-256, 256, 64), (0, 7, 3), (-5, -1, 16), (-(2**20), 2**20, 10), (-(2**25), 2**25, 8), (0, 0, 4), (-1, 1, 1)])
def test_packed_products_are_exact(low, high, dims):
    rng = np.random.default_rng(3)
    rows, anchors = rng.integers(low, high + 1, (53, dims)), rng.integers(low, high + 1, (9, dims))
    packed = negatives.Packed(rows, int(anchors.min()), int(anchors.max()))
    assert (packed.scores(anchors) == anchors.astype(object) @ rows.T.astype(object)).all()
    assert packed.fields > 1 or packed.width > 26  # several rows to a word wherever a double has room


def brute_negatives(rows, every=50, scale=256):
    have = whole(rows, scale, need_label=True)
    have = [(i, (y + 1) % 10 if i % 7 == 0 else y, v) for i, y, v in have]
    out = []
    for i, y, a in sorted({r[0]: r for r in have if r[0] % every == 0}.values()):
        near = sorted((-dot(a, v), j) for j, z, v in have if z == y and j != i)[:5]
        far = sorted((-dot(a, v), j) for j, z, v in have if z != y and j != i)
        for p, j in near:
            hit = [(s, n) for s, n in far if 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n) in enumerate(hit)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4096, 1024, 64, 256), (16, 3, 2, 2)])
def test_hard_negatives(vectors, monkeypatch, sizes):
    for name, n in zip(("ROWS", "QUERIES", "GROUP", "STRIP"), sizes, strict=True):
        monkeypatch.setattr(tiles, name, n)
    monkeypatch.setattr(negatives, "STRIP", sizes[3])
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(vectors, label).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    want = brute_negatives(vector_rows())
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    assert negatives.mine(vectors.limit(0), label).collect() == [] and negatives.mine(vectors.filter("vec_id % 50 = 1"), label).collect() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(docs, target, percent, least, buckets, longest=1):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: WORD.findall(lower(t))
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(words(x))) for texts in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, text in docs:
        w = words(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in grams(w))
        rows.append([i, len(grams(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    can = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(can[: percent * len(can) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def odd_docs():
    rng = random.Random(6)
    vocabulary = ["Apple", "pear", "ÄRGER", "naïve", "東京", "x1", "don't", "a-b", "🙂", "plum tree", "Kiwi"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "  ,;. "), (903, "word " * 50_000), (None, "pear " * 30)]
    docs += [(904, "the same text of some words " * 10)] * 100  # a third alike, id and all
    return docs


@pytest.mark.parametrize(("few", "pivots", "per_range", "longest"), [(1000, 64, 200_000, 1), (3, 4, 7, 2)])
def test_importance_resampling(spark, monkeypatch, few, pivots, per_range, longest):
    monkeypatch.setattr(resample, "FEW", few)
    monkeypatch.setattr(resample, "PIVOTS", pivots)
    monkeypatch.setattr(resample, "RANGE", per_range)
    docs, target = odd_docs(), ["pear plum", None, "Kiwi apple kiwi"]
    df = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in docs], "doc_id long, text string, rank int, row string, score int").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, bench, percent=50, longest=longest).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == brute_resample(docs, target, 50, 20, 10000, longest)


def test_importance_resampling_odd_tables(spark):
    df = spark.createDataFrame(odd_docs(), "`doc.id` long, text string")
    none = spark.createDataFrame([], "text string")
    assert resample.resample(df.limit(0), none, id_col="doc.id").collect() == []
    got = resample.resample(df, none, id_col="doc.id")
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == brute_resample(odd_docs(), [], 10, 20, 10000)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_importance_resampling", "op13_exact_top_k"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DATA).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str) and got
