"""Exact dedup by two-pass Bloom filtering.

Pass one sets bits for the digest of every text in two bit arrays, "seen" and "seen again"; the arrays of partitions
merge by ``again |= again' | (seen & seen')``, so the merged "seen again" array has all slots of every digest that occurs
twice anywhere. Pass two tests each digest against it: rows that miss can have no copy and go straight through, only the
others shuffle. A false positive costs a shuffled row, never a wrong result.

Defined cases: a null text counts as empty; null ``doc_id`` sorts after all others and stays a row; rows repeated in full
are one group of which one row stays; an empty table gives an empty result; other columns are ignored by
:func:`exact_groups` and carried by :func:`drop_copies`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.llm.common import Steps, kept, settle, small_batches
from crawlspan.llm.members import belongs

#: Bytes that do not count when texts are compared.
SPACES = b" \t\n\x0b\x0c\r"
#: Slots for each row, hash functions, and the most slots that a filter has (2**27 bits are 16 MB to broadcast).
SLOTS_PER_ROW, HASHES, MOST_SLOTS = 16, 3, 1 << 27
#: Bits of a segment of the filter; a merging task holds one segment of each partition at most, and merges as it reads.
SEGMENT = 1 << 19


def digest(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass").translate(None, SPACES)).digest()


def _slots(digests: pa.Array, slots: int) -> np.ndarray:
    """(rows, HASHES) slots: three words of each digest, read where they lie in the column."""
    if not len(digests):
        return np.empty((0, HASHES), np.int64)
    places = np.frombuffer(digests.buffers()[1], np.int64 if pa.types.is_large_binary(digests.type) else np.int32)[digests.offset : digests.offset + len(digests) + 1]
    words = np.frombuffer(digests.buffers()[2], np.uint8)[places[0] : places[-1]].view("<u8").reshape(-1, 4)[:, :HASHES]
    return (words % np.uint64(slots)).astype(np.int64)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept("nothing", int)
    for b in batches:
        texts = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([digest(t) for t in texts], pa.binary())],
            names=["doc_id", "n_chars", "sha"],
        )


def _seen(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """The two bit arrays of a partition, in segments; segments without any bit are left out."""
    seen, again = np.zeros(slots, np.bool_), np.zeros(slots, np.bool_)
    for b in batches:
        if not b.num_rows:
            continue
        at = np.sort(_slots(b.column(0), slots), axis=1)
        first = np.ones(at.shape, np.bool_)
        first[:, 1:] = at[:, 1:] != at[:, :-1]
        at, n = np.unique(at[first], return_counts=True)  # a row counts once in a slot
        again[at] |= seen[at] | (n > 1)
        seen[at] = True
    width = min(SEGMENT, slots)
    keep = [i for i in range(0, slots, width) if seen[i : i + width].any()]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([i // width for i in keep], pa.int32()),
            pa.array([np.packbits(seen[i : i + width]).tobytes() for i in keep], pa.binary()),
            pa.array([np.packbits(again[i : i + width]).tobytes() for i in keep], pa.binary()),
        ],
        names=["segment", "seen", "again"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for k, s, a in zip(*(c.to_pylist() for c in b.columns), strict=True):
            s, a = np.frombuffer(s, np.uint8), np.frombuffer(a, np.uint8)
            if k in got:
                old = got[k]
                got[k] = [old[0] | s, old[1] | a | (old[0] & s)]
            else:
                got[k] = [s, a]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(got), pa.int32()), pa.array([x[0].tobytes() for x in got.values()], pa.binary()), pa.array([x[1].tobytes() for x in got.values()], pa.binary())],
        names=["segment", "seen", "again"],
    )


_BITS = "segment int, seen binary, again binary"


def repeat_filter(digests: DataFrame, rows: int) -> np.ndarray:
    """Packed "seen again" bits for the ``sha`` column; its size is bounded by MOST_SLOTS whatever the table's size."""
    slots = SEGMENT // 8
    while slots < min(MOST_SLOTS, SLOTS_PER_ROW * rows):
        slots *= 2
    merged = digests.select("sha").mapInArrow(partial(_seen, slots=slots), _BITS).repartition("segment").mapInArrow(_merge, _BITS)
    width = min(SEGMENT, slots)
    again = np.zeros(slots // 8, np.uint8)
    for r in merged.select("segment", "again").toLocalIterator():
        again[r[0] * width // 8 : (r[0] + 1) * width // 8] = np.frombuffer(r[1], np.uint8)
    return again


def seen_again(again, many: bool = False):
    """A function of a digest column: whether all its slots were seen again. With ``many``, of a column of digest arrays."""

    def hit(digests: pa.Array) -> pa.Array:
        bits = again.value
        at = _slots(digests, len(bits) * 8)
        return pa.array(((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1), pa.bool_())

    def one(digests: pa.Array) -> pa.Array:
        return hit(digests)

    def each(lists: pa.Array) -> pa.Array:
        ends = lists.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), hit(lists.flatten())) if len(lists) else pa.array([], pa.list_(pa.bool_()))

    return F.arrow_udf(each, "array<boolean>") if many else F.arrow_udf(one, "boolean")


def _tested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_chars, sha of each row, and whether its digest may repeat."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    digests = settle(rows.mapInArrow(_digests, "doc_id long, n_chars long, sha binary"))
    again = spark.sparkContext.broadcast(repeat_filter(digests, digests.count()))
    return digests.withColumn("maybe", seen_again(again)(F.col("sha")))


def _groups(some: DataFrame) -> DataFrame:
    """sha, keep_id, group_size, most of each digest; copies shuffle once to be counted, a row of each task at most."""
    order = F.struct("n_chars", F.coalesce(-F.col("doc_id"), F.lit(-(2**63))))
    return some.groupBy("sha").agg(F.max_by("doc_id", order).alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max("n_chars").alias("most"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points stays, then the smallest id; of rows repeated in full, one stays.
    """
    tested = settle(_tested(docs, id_col, text_col))
    alone = tested.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    some = tested.filter("maybe")
    groups = settle(_groups(some))
    # Rows repeated in full under one id tie: the first of them stays, so they are counted as one row with a multiplicity.
    same = settle(some.groupBy("sha", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("times")))
    joined = same.join(groups, "sha").withColumn("wins", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most")))
    out = joined.select("doc_id", "keep_id", "group_size", "wins", F.lower(F.hex("sha")).alias("text_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"))
    out = out.select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("nth") == 1)).alias("kept"), "text_sha256")
    return alone.unionByName(out)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Texts are hashed once; only digests that may repeat shuffle. Filters of ids then tell which rows go, so that texts stay
    where they are but for rows that the filters leave open, or that share an id with a row that goes.
    """
    step = Steps()
    tested = step(_tested(docs, id_col, text_col))
    some = tested.filter("maybe")
    groups = step(_groups(some))
    judged = step(some.join(groups, "sha").groupBy("doc_id", "n_chars", "keep_id", "most").agg(F.count(F.lit(1)).alias("times")))
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most"))
    inside = step(judged.filter(~wins | (F.col("times") > 1)).select(F.col("doc_id").alias("id")).dropna())
    outside = tested.filter("not maybe").select("doc_id").unionByName(judged.filter(wins).select("doc_id")).select(F.col("doc_id").alias("id")).dropna()
    doomed = belongs(inside, outside, id_col)
    step.free(groups)
    names = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col(f"`{text_col}`").cast("string")
    marked = docs.select(F.struct(*names).alias("row"), F.col(f"`{id_col}`").cast("long").alias("i"), text.alias("text"), doomed.alias("doomed"))
    left = settle(marked.filter("doomed is null").select("row", "i", "text"))

    def digests(texts: pa.Array) -> pa.Array:
        return pa.array(map(digest, texts.to_pylist()), pa.binary())

    digest_of = F.arrow_udf(digests, "binary")
    left = left.select("row", "i", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), digest_of("text").alias("sha")).join(groups, "sha", "left")
    alone = left.filter("most is null")
    one = left.filter(F.col("i").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("most"))).groupBy("sha").agg(F.first("row").alias("row"))
    return marked.filter("not doomed").select("row.*").unionByName(alone.select("row.*")).unionByName(one.select("row.*"))
