"""Target-distribution importance resampling: array-scored weights, a Gumbel draw, distributed quickselect.

Words fall into ``buckets`` by their CRC-32. One pass counts the buckets of the documents, one those of the target texts;
each bucket's gain is the scaled log ratio of the two smoothed shares, and a document's weight is the sum of its words'
gains, looked up in one array of ``buckets`` numbers. Adding Gumbel noise, which is a function of seed and id, turns the
highest scores into a sample without replacement by weight.

The sample is cut at the k-th composite key (score from high to low, id, row), found by quickselect: random rows of what is
still open serve as pivots, one grouped job counts the rows between them, and the open interval shrinks to the gap that
holds the k-th. Only rows of the sample are then sorted, by ranges, and ranked by place in their range plus the rows of the
ranges before.

Defined cases: a null or empty text has no words, its weight is 0, and it is not drawn unless ``least_words`` is 0; a null
id draws its noise from ``<seed>:`` and ties after all other ids; repeated rows are drawn one by one, in any order among
themselves; an empty table gives no rows; without target texts all target counts are 0; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.llm.common import Steps, kept, settle, small_batches, small_table

#: Fixed: ASCII letters and digits and all bytes of other characters belong to words, A-Z in lower case.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Random pivots of a round, and how many open rows are few enough to be sorted at once.
PIVOTS, FEW = 64, 1000
#: Words whose buckets a worker remembers, by length at most; others are hashed each time.
KNOWN, LONG = 200_000, 24
#: Rows of a range of the ranked sample.
RANGE = 200_000


class Buckets:
    """Buckets of a text's features: runs of 1 to ``longest`` words joined by a space."""

    def __init__(self, buckets: int, longest: int) -> None:
        self.buckets, self.longest = buckets, longest
        self.known: dict[bytes, int] = {}

    def _of(self, word: bytes) -> int:
        b = zlib.crc32(word) % self.buckets
        if len(word) <= LONG and len(self.known) < KNOWN:
            self.known[word] = b
        return b

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()

    def features(self, words: list[bytes]) -> np.ndarray:
        known, of = self.known, self._of
        found = [[known[w] if w in known else of(w) for w in words]]
        found += [[of(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)] for n in range(2, self.longest + 1)]
        return np.fromiter((b for f in found for b in f), np.int64)


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """How often each bucket occurs in all texts: ``buckets`` numbers, summed by task, then by bucket."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = kept(("resample", buckets, longest), lambda: Buckets(buckets, longest))
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                total += np.bincount(hashed.features(hashed.words(text.as_py())), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    sums = texts.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) for each bucket."""
    size, s, t = len(corpus), corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of each row."""
    spark, size = docs.sparkSession, len(gain)
    small_batches(spark)
    sent = spark.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, gain = kept(("resample", size, longest), lambda: Buckets(size, longest)), sent.value
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for i, text in zip(ids, b.column(1), strict=True):
                words = hashed.words(text.as_py())
                features = hashed.features(words)
                weight = int(gain[features].sum())
                rows.append((len(features), len(words), weight, weight + noise(seed, i)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 4))], names=["doc_id", "n_features", "n_words", "weight", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_features long, n_words long, weight long, score long")


#: The composite key: smaller keys are drawn first; ``row`` makes it unique.
_KEY = ("down", "no_id", "id", "row")


def _key(values: tuple | None = None) -> F.Column:
    return F.struct(*(F.col(c) if values is None else F.lit(v).cast("boolean" if c == "no_id" else "long").alias(c) for c, v in zip(_KEY, values or _KEY, strict=True)))


def kth_key(keys: DataFrame, k: int) -> tuple:
    """The ``k``-th smallest key (from 1) of a settled table of keys, by quickselect."""
    step, rows, round_ = Steps(), keys, 0
    n = keys.count()
    while n > FEW:
        # A random row of each of PIVOTS hash classes; the table is settled, so a repeated task sees the same rows.
        pick = F.xxhash64(F.lit(round_), "row")
        pivots = sorted(tuple(r[0]) for r in rows.groupBy(F.pmod(pick, F.lit(PIVOTS)).alias("class")).agg(F.min_by(_key(), pick).alias("p")).select("p").collect())
        # Place 2i holds the keys before pivot i and after the one before, place 2i + 1 the pivot itself.
        place = sum(((_key() >= _key(p)).cast("int") + (_key() > _key(p)).cast("int") for p in pivots), F.lit(0))
        counts = dict(rows.groupBy(place.alias("place")).count().collect())
        at = 0
        while k > counts.get(at, 0):
            k -= counts.get(at, 0)
            at += 1
        if at % 2:
            step.free()
            return pivots[at // 2]
        low, high = pivots[at // 2 - 1] if at else None, pivots[at // 2] if at // 2 < len(pivots) else None
        if low is not None:
            rows = rows.filter(_key() > _key(low))
        if high is not None:
            rows = rows.filter(_key() < _key(high))
        rows, n, round_ = step(rows), counts[at], round_ + 1
        step.free(rows)
    found = sorted(tuple(r) for r in rows.select(*_KEY).collect())
    step.free()
    return found[k - 1]


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with rank: 1, 2, 3... in the order of the key."""
    n, ddl = rows.count(), ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n + 1, n + 1 + b.num_rows))], names=[*b.schema.names, "part", "nth"])
            n += b.num_rows

    sorted_ = rows.repartitionByRange(max(1, -(-n // RANGE)), *_KEY).sortWithinPartitions(*_KEY)
    numbered = settle(sorted_.mapInArrow(number, f"{ddl}, part int, nth long"))
    before, start = 0, []
    for part, most in sorted(numbered.groupBy("part").agg(F.max("nth")).collect()):
        start.append((part, before))
        before += most
    offsets = small_table(rows.sparkSession, start, "part int, before long")
    return numbered.join(offsets, "part").withColumn("rank", F.col("nth") + F.col("before"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10000, longest: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row; rank is null for rows that are not drawn."""
    step = Steps()
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    table = scored(docs, gain, longest, seed, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    table = step(table.select("*", (-F.col("score")).alias("down"), F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id")))
    can = table.filter(F.col("n_words") >= least_words)
    k = percent * can.count() // 100
    names = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return table.select(*names, F.lit(None).cast("long").alias("rank"))
    last = kth_key(can.select(*_KEY), k)
    drawn = (F.col("n_words") >= least_words) & (_key() <= _key(last))
    return ranked(table.filter(drawn)).select(*names, "rank").unionByName(table.filter(~drawn).select(*names, F.lit(None).cast("long").alias("rank")))
