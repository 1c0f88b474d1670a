"""MinHash near-dedup: universal hash minima, banding, checks on full sets, components by alternating stars.

1. Each text becomes its set of word shingles (64-bit hashes), the minima of many universal hash functions over the set,
   and one bucket for each band of minima. Equal sets collapse to one class; only classes go on.
2. In each bucket every class pairs with the bucket's most popular class, the one that shares most buckets with others: a
   hot bucket costs its size, not its square, and the original of many near copies gets all of them. Pairs whose
   signatures agree too little are dropped, the rest are checked on the full sets.
3. Components come from alternating large-star and small-star steps over the links.
4. Where a bucket still holds several components, its members go through an exact set join: rare shingles first, two sets
   that are similar enough share one among the first few of each. Documents that merely have a large part in common differ
   in their rare shingles and never pair. Links found there make the components anew.

The bands are as many as make the chance to miss a pair at the threshold less than MISS.

Defined cases: a text with fewer words than a shingle is one shingle; a null text or one without words links with nothing; rows
under one id are one document; a row without id is alone, its component null, and stays; an empty table gives no rows; other
columns are ignored by :meth:`NearDedup.groups` and carried by :meth:`NearDedup.drop_near_copies`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlspan.llm.common import Settled, Steps, kept, small_batches
from crawlspan.llm.members import belongs

MISS = 1e-7
#: Cached word hashes of a worker.
WORDS = 150_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text; A-Z are lower-cased, the six ASCII spaces separate."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(kept("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * _MIX[0] + mixed(words[i : i + n] + np.uint64(1))
    return mixed(out)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted set of shingle hashes."""
    words = word_hashes(text)
    return np.unique(window_hashes(words, min(width, len(words)))) if len(words) else words


def bands_for(threshold: float, rows: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows))


def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n multiply-add hash functions modulo 2**64."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), ~np.uint64(0))
    for i in range(0, len(values), 1024):
        h = np.multiply.outer(a, values[i : i + 1024])
        h += b[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def _sketch(batches: Iterator[pa.RecordBatch], width: int, rows: int, bands: int, seed: int) -> Iterator[pa.RecordBatch]:
    a, b = _family(rows * bands, seed)
    salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in batches:
        n, h1, h2, buckets, signatures = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, width)
            n.append(len(s))
            key = xxhash.xxh3_128_intdigest(s.tobytes())
            h1.append((key >> 64) - (1 << 63))
            h2.append((key & ((1 << 64) - 1)) - (1 << 63))
            if len(s):
                m = minima(s, a, b) >> np.uint64(32)
                k = salt.copy()
                for i in range(rows):
                    k = mixed(k * _MIX[0] + m[i * bands : (i + 1) * bands])
                buckets.append(k.view(np.int64))
                signatures.append((m & np.uint64(0xFFFF)).astype(np.int16))
            else:
                buckets.append(None)
                signatures.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(signatures, pa.list_(pa.int16()))],
            names=["doc_id", "n", "h1", "h2", "buckets", "signature"],
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, width).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["node", "items"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), by alternating large-star and small-star steps.

    Each step replaces links so that components keep; it ends when both leave the links as they are, then every node
    hangs from the smallest of its component. No step brings links to the driver; a hot node is a skewed join side only.
    """
    links = Settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark, step = None, Steps()
    while True:
        e = links.df
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = step(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        large = step(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        low = step(large.groupBy("a").agg(F.min("b").alias("low")))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        nxt = Settled(small)
        now = nxt.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        step.free()
        links.drop()
        links = nxt
        if mark == tuple(now):
            break
        mark = tuple(now)
    leaves = links.df.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return leaves.unionByName(links.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class NearDedup:
    def __init__(self, width: int = 5, percent: int = 80, rows: int | None = None, seed: int = 7) -> None:
        self.width, self.percent, self.seed = width, percent, seed
        self.rows = rows or (5 if percent >= 85 else 4)
        self.bands = bands_for(percent / 100, self.rows)

    def _linked(self, pairs: DataFrame, signatures: DataFrame, sets: DataFrame, step: Steps) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough; signatures that agree six deviations too seldom spare a
        pair the full check."""
        n, t = self.rows * self.bands, self.percent / 100
        least = n * t - 6 * math.sqrt(n * t * (1 - t))
        sig = lambda k: signatures.select(F.col("node").alias(k), F.col("signature").alias(f"s{k}"))
        agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
        pairs = step(step(pairs.distinct()).join(sig("a"), "a").join(sig("b"), "b").filter(agree >= least).select("a", "b"))
        items = lambda k: sets.select(F.col("node").alias(k), F.col("items").alias(f"i{k}"))
        shared = F.size(F.array_intersect("ia", "ib"))
        near = pairs.join(items("a"), "a").join(items("b"), "b").select("a", "b", shared.alias("shared"), (F.size("ia") + F.size("ib")).alias("both"))
        return near.filter(100 * F.col("shared") >= self.percent * (F.col("both") - F.col("shared"))).select("a", "b").distinct()

    def _across(self, nodes: DataFrame, sets: DataFrame, step: Steps) -> DataFrame:
        """Pairs (a, b) of ``nodes`` (node, component) of different components that can be similar enough, by prefixes.

        With shingles in order of rarity, similar sets share one of the first |x| - 2t/(1+t)|x| + 1 of the smaller and
        the first |y| - t|y| + 1 of the larger set.
        """
        p = self.percent
        each = sets.join(nodes, "node").select("node", "component", F.size("items").alias("n"), F.explode("items").alias("item"))
        seen = step(each.groupBy("item").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("low"), F.max("component").alias("high")))
        place = F.row_number().over(Window.partitionBy("node").orderBy("df", "item"))
        ranked = each.join(seen, "item").withColumn("at", place).filter((F.col("low") != F.col("high")) & (F.col("at") <= F.col("n") - F.ceil(p * F.col("n") / 100) + 1))
        ranked = step(ranked.select("item", "node", "component", "n", "at"))
        x, y = ranked.filter(F.col("at") <= F.col("n") - F.ceil(2 * p * F.col("n") / (100 + p)) + 1).alias("x"), ranked.alias("y")
        sizes = (F.col("x.n") <= F.col("y.n")) & (p * F.col("y.n") <= 100 * F.col("x.n"))
        room = (100 + p) * (1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))) >= p * (F.col("x.n") + F.col("y.n"))
        pairs = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.component") != F.col("y.component")) & sizes & room)
        return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    def groups(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
        small_batches(docs.sparkSession)
        step = Steps()
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        sketch = step(rows.mapInArrow(partial(_sketch, width=self.width, rows=self.rows, bands=self.bands, seed=self.seed), "doc_id long, n long, h1 long, h2 long, buckets array<long>, signature array<smallint>"))
        each = step(sketch.select("doc_id", "n", "h1", "h2"))
        named = each.filter("doc_id is not null")
        # One class for each set; its node is its smallest id. Copies leave after this, however many they are.
        some = sketch.filter("n > 0 and doc_id is not null")
        classes = step(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("buckets").alias("buckets"), F.first("signature").alias("signature")))
        step.free(each, classes)
        in_bucket = step(classes.select("node", F.explode(F.array_distinct("buckets")).alias("bucket")))
        full_buckets = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        shared = step(in_bucket.join(full_buckets, "bucket"))
        step.free(each, classes, shared)
        popular = shared.groupBy("node").agg(F.sum("size").alias("popular"))
        leaders = step(shared.join(popular, "node").groupBy("bucket").agg(F.max_by("node", F.struct("popular", -F.col("node"))).alias("leader")))
        members = step(shared.select("bucket", "node").join(leaders, "bucket"))
        step.free(each, classes, members)
        nodes = step(members.select("node").distinct())
        signatures = step(classes.select("node", "signature").join(nodes, "node", "left_semi"))
        sets = step(rows.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").mapInArrow(partial(_sets, width=self.width), "node long, items array<long>"))
        links = step(self._linked(members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")), signatures, sets, step))
        # Rows under one id with different texts join their classes.
        again = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("doc_id")
        same = named.filter("n > 0").join(again, "doc_id").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b")
        links = step(links.unionByName(same))
        found = step(components(links))
        # Members of different components in one bucket, other than those that met its leader already.
        placed = step(members.filter("node <> leader").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")))
        mixed_up = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
        rest = step(placed.join(mixed_up, "bucket").select("node", "component").distinct())
        step.free(each, classes, signatures, sets, links, found, rest)
        more = step(self._linked(self._across(rest, sets, step), signatures, sets, step))
        if not more.isEmpty():
            found = step(components(links.unionByName(more)))
        placed_class = step(classes.select("h1", "h2", "node").join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component")))
        step.free(each, placed_class)
        out = named.filter("n > 0").join(placed_class, ["h1", "h2"]).select("doc_id", "n", "component")
        out = out.unionByName(each.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component")))
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))

    def drop_near_copies(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` without the rows whose component has a smaller id; all columns stay.

        Filters of ids tell where each row stands; only the few rows that they leave open shuffle.
        """
        step = Steps()
        told = step(self.groups(docs, id_col, text_col).filter("doc_id is not null").select(F.col("doc_id").alias("id"), "kept"))
        gone, stay = step(told.filter("not kept").select("id").distinct()), told.filter("kept").select("id")
        doomed = belongs(gone, stay, id_col)
        step.free(gone)
        names = [F.col(f"`{c}`") for c in docs.columns]
        marked = docs.select(F.struct(*names).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), doomed.alias("doomed"))
        open_rows = marked.filter("doomed is null").join(gone, "id", "left_anti")
        return marked.filter("not doomed").select("row.*").unionByName(open_rows.select("row.*"))
