"""Which rows of a wide table belong to a set of ids, without moving the rows.

Two Bloom filters are broadcast: one of the ids in the set, one of the ids outside it that the first filter takes for
members, which narrow tables of ids tell exactly. A row that misses the first is no member, one that hits the first and
misses the second is one for sure. Only rows that hit both, some hundredths, have to shuffle for an exact answer. The
filters have MOST_SLOTS bits at most (16 MB); with more than MOST_SLOTS / SLOTS ids they let more rows through to the exact
join, never a wrong answer.

Defined cases: a null id is always left to the exact join; an empty set has no members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.llm.common import kept

#: Bits for each id, hash functions, bits of a filter at most.
SLOTS, HASHES, MOST_SLOTS = 16, 4, 1 << 27
_SEEDS = range(101, 101 + HASHES)


def _bits(ids: DataFrame) -> np.ndarray:
    """A filter of the column ``id``, as 64-bit words."""
    n, words = ids.count(), 1 << 10
    while words * 64 < min(MOST_SLOTS, SLOTS * n):
        words *= 2
    slot = F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(s), F.col("id")), F.lit(words * 64)) for s in _SEEDS)))
    rows = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(words, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def _hit(slots: pa.StructArray, bits: np.ndarray) -> np.ndarray:
    hit = np.ones(len(slots), np.bool_)
    for c in slots.flatten():
        at = c.to_numpy() & (len(bits) * 64 - 1)
        hit &= (bits[at >> 6] >> (at & 63)) & 1 == 1
    return hit


def may_belong(inside: DataFrame, key: F.Column) -> F.Column:
    """A boolean column: false for keys that are certainly not in ``inside``, a settled table of one column ``id``."""
    bits = inside.sparkSession.sparkContext.broadcast(_bits(inside))

    def hit(h: pa.Array) -> pa.Array:
        return pa.array(_hit(h, bits.value))

    return F.arrow_udf(hit, "boolean")(F.struct(*(F.xxhash64(F.lit(s), key).alias(f"h{s}") for s in _SEEDS)))


def belongs(inside: DataFrame, outside: DataFrame, id_col: str = "doc_id") -> F.Column:
    """A boolean column over tables with ``id_col``: true for ids of ``inside``, false for those of ``outside``, null where
    only an exact join can tell. Both are tables of one column ``id``, settled; an id that is in both is always null."""
    spark = inside.sparkSession
    first = spark.sparkContext.broadcast(_bits(inside))
    hashes = lambda c: F.struct(*(F.xxhash64(F.lit(s), c).alias(f"h{s}") for s in _SEEDS))

    def hit(h: pa.Array) -> pa.Array:
        return pa.array(_hit(h, first.value))

    test = F.arrow_udf(hit, "boolean")
    taken = outside.filter(test(hashes(F.col("id"))))
    second = spark.sparkContext.broadcast(_bits(taken))

    def told(h: pa.Array) -> pa.Array:
        kept("nothing", int)
        one = _hit(h, first.value)
        return pa.array(one, mask=one & _hit(h, second.value))

    key = F.col(f"`{id_col}`").cast("long")
    return F.when(key.isNotNull(), F.arrow_udf(told, "boolean")(hashes(key)))
