"""Passages that repeat across documents, by a sparse suffix array over words.

Only suffixes at minimisers are kept: the K-word runs with the smallest hash among SPAN neighbouring ones. K + SPAN - 1
equals the shortest passage, so each copy of a passage keeps the same suffix at least once. Suffixes whose first K words
occur in one document only drop out by counting. The others are sorted as one table, range by range, and neighbours are
compared. Where a suffix occurs twice, the two are extended to the right and to the left, word by word, and count if they
come to LEAST words. Where it occurs more often, two that match need not be neighbours, since others that share less may sort
between them; there the array is made denser: each start of LEAST words whose minimiser the suffix is gets an entry, ordered
by those words' hash, so that entries which match are neighbours however many they are. A match of LEAST words has one
minimiser, so none is missed. Entries of a hot passage are ordered by document too and fall into many ranges; what a range
can't tell about its first and last passage, the ends of the other ranges do, two rows each. Words and runs are compared by
hashes of 64 bits throughout.

Words are runs between the six ASCII spaces, A-Z as a-z. Defined cases: null texts and texts of fewer than LEAST words have
no passage; rows without id are left out; rows under one id are one document, and repeats inside a document alone do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlspan.llm.common import Steps, small_batches, small_table
from crawlspan.llm.members import may_belong
from crawlspan.llm.near_dedup import window_hashes, word_hashes

#: Words of the shortest passage, of a suffix's first part, and neighbouring suffixes of which one is kept.
LEAST, K = 50, 25
SPAN = LEAST - K + 1
#: Words carried on each side of a suffix, as hashes of WIDE bytes; a passage's first and last minimiser are nearer to its ends.
AROUND, WIDE = SPAN - 1, 8


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the kept suffixes of a text, and the first of the LEAST-word windows of each."""
    h = window_hashes(words, K)
    if len(words) < LEAST:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    at, first = np.unique(np.lib.stride_tricks.sliding_window_view(h, SPAN).argmin(axis=1) + np.arange(len(h) - SPAN + 1), return_index=True)
    return at.astype(np.int32), h[at].view(np.int64), first


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [minimisers(word_hashes(t))[1] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "keys"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of a document whose hashes are in ``keys``, with the words after, and those before, nearest first.

    Those in ``many`` get their windows instead: the start of the first, and the hashes.
    """
    for b in batches:
        docs, keys, places, after, before, starts, windows = [], [], [], [], [], [], []
        for doc, text, wanted, many in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = word_hashes(text)
            at, h, first = minimisers(words)
            wide = words.astype(">u8")
            hit = np.isin(h, np.array(wanted, np.int64))
            dense = np.isin(h, np.array(many, np.int64))[hit]
            whole = window_hashes(words, LEAST).view(np.int64) if dense.any() else None
            ends = np.append(first[1:], len(words) - LEAST + 1)[hit] if hit.any() else first[hit]
            for p, k, m, i, j in zip(at[hit].tolist(), h[hit].tolist(), dense.tolist(), first[hit].tolist(), ends.tolist(), strict=True):
                docs.append(doc)
                keys.append(k)
                places.append(p)
                after.append(b"" if m else wide[p + K : p + K + AROUND].tobytes())
                before.append(b"" if m else wide[max(0, p - AROUND) : p][::-1].tobytes())
                starts.append(i)
                windows.append(whole[i:j] if m else None)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(after, pa.binary()), pa.array(before, pa.binary()), pa.array(starts, pa.int32()), pa.array(windows, pa.list_(pa.int64()))], names=["doc", "key", "at", "after", "before", "first", "windows"])


def shared(x: bytes, y: bytes) -> int:
    """Words that two runs of word hashes have in common at the start."""
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    if x == y:
        return n // WIDE
    return (n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8) // WIDE


def _extend(x: tuple, y: tuple) -> list[tuple[int, int, int, int]]:
    """(doc, start, end, other) of both rows (doc, key, at, after, before), if they share LEAST words."""
    right, left = shared(x[3], y[3]), shared(x[4], y[4])
    if left + K + right < LEAST:
        return []
    return [(a[0], a[2] - left, a[2] + K + right, b[0]) for a, b in ((x, y), (y, x))]


_OUT = "kind int, part int, doc long, start int, end int, other long, key long, at int, after binary, before binary"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares neighbours of a sorted range. Kind 0: a span; 1 and 2: rows at its start and end, for the next range.

    Rows of one document in a row are compared with the nearest row of another document on either side.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    run: list[tuple] = []  # the rows of one key and document read last
    other: tuple | None = None  # the row before them, of another document and the same key
    first_run: list[tuple] = []
    open_start = True

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    for b in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if run and run[-1][1] == row[1] and run[-1][0] == row[0]:
                run.append(row)
            else:
                if open_start and run:
                    first_run, open_start = run, False
                same = bool(run) and run[-1][1] == row[1]
                if same:
                    for x in run[:-1]:
                        out += [(0, part, *s, None, None, None, None) for s in _extend(x, row)]
                other, run = (run[-1] if same else None), [row]
            if other is not None:
                out += [(0, part, *s, None, None, None, None) for s in _extend(other, row)]
        if out:
            yield batch(out)
    if open_start:
        first_run = run
    edge = lambda kind, x: (kind, part, x[0], None, None, None, x[1], x[2], x[3], x[4])
    # The ends of a run stand for it: its rows share their beginnings.
    yield batch([edge(1, x) for x in first_run[:1]] + [edge(2, x) for x in run[-1:]])


def _spans(suffixes: DataFrame, step: Steps) -> DataFrame:
    """Spans (doc, start, end, other) of the suffixes that occur twice, from the sorted order."""
    ranged = suffixes.filter("windows is null").select("doc", "key", "at", "after", "before").repartitionByRange("key", "doc", "at").sortWithinPartitions("key", "doc", "at")
    found = step(ranged.mapInArrow(_neighbours, _OUT))
    edges = found.filter("kind > 0").orderBy("part", "kind").collect()  # two rows a task
    ends = [(r["kind"], (r["doc"], r["key"], r["at"], bytes(r["after"]), bytes(r["before"]))) for r in edges]
    more = [s for (j, x), (k, y) in zip(ends, ends[1:], strict=False) if (j, k) == (2, 1) and x[1] == y[1] and x[0] != y[0] for s in _extend(x, y)]
    spans = found.filter("kind = 0").select("doc", "start", "end", "other")
    return spans.unionByName(small_table(suffixes.sparkSession, more, "doc long, start int, end int, other long")) if more else spans


_ENTRY = "kind int, hash long, doc long, at int, start int, low long, high long"


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (hash, doc, at, start) of a sorted range that have neighbours of their hash in another document: kind 0, with
    the first and last document of the hash so far. Kind 1: entries of the range's first or last hash, for which it has one
    document only; kind 2: first and last document of these two hashes."""
    names = [x.split()[0] for x in _ENTRY.split(", ")]

    def out(kind: int, h, rows, low, high) -> pa.RecordBatch:
        n = len(rows[0])
        fill = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int64), n))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), fill(h), pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2]), fill(low), fill(high)], names=names)

    none = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    now = low = high = None  # the hash read last, its first and last document
    first = True  # whether it is the range's first
    wait: list[tuple] = []  # its entries, while they are of one document

    def ended(last: bool) -> Iterator[pa.RecordBatch]:
        """The hash read last is over; only at the range's ends may its entries go on elsewhere."""
        if now is not None and (first or last):
            yield out(2, now, tuple(np.zeros(1, x.dtype) for x in none), low, high)
            for rows in wait:
                yield out(1, now, rows, low, high)

    for b in batches:
        if not b.num_rows:
            continue
        h, *rows = (c.to_numpy() for c in b.columns)
        starts = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1]
        ends = np.r_[starts[1:], len(h)]
        lows, highs = rows[0][starts], rows[0][ends - 1]
        begin = 0
        if now is not None and h[0] == now:  # goes on
            part = tuple(x[: ends[0]] for x in rows)
            high = int(highs[0])
            if low == high:
                wait.append(part)
            else:
                for x in (*wait, part):
                    yield out(0, now, x, low, high)
                wait = []
            begin = 1
        if begin < len(starts):
            yield from ended(False)
            first = now is None
            shared = (lows != highs)[begin:]
            if first and len(starts) > 1:  # the range's first hash ends inside this batch
                yield out(2, h[0], tuple(np.zeros(1, x.dtype) for x in none), lows[0], highs[0])
                if not shared[0]:
                    yield out(1, h[0], tuple(x[: ends[0]] for x in rows), lows[0], highs[0])
                first = False
            sizes = (ends - starts)[begin:]
            hit = np.repeat(shared, sizes)
            at = slice(starts[begin], None)
            if hit.any():
                yield out(0, h[at][hit], tuple(x[at][hit] for x in rows), np.repeat(lows[begin:], sizes)[hit], np.repeat(highs[begin:], sizes)[hit])
            now, low, high = int(h[-1]), int(lows[-1]), int(highs[-1])
            wait = [] if shared[-1] else [tuple(x[starts[-1] :] for x in rows)]
    yield from ended(True)
    yield out(0, 0, none, 0, 0)


def _dense_spans(suffixes: DataFrame, step: Steps) -> DataFrame:
    """Spans (doc, start, end, other) of the suffixes that occur more often. Entries of one suffix overlap and are one span."""
    each = suffixes.filter("windows is not null").select("doc", "at", "first", F.posexplode("windows").alias("k", "hash")).select("hash", "doc", "at", (F.col("first") + F.col("k")).alias("start"))
    ranged = each.repartitionByRange("hash", "doc", "start").sortWithinPartitions("hash", "doc", "start")
    told = step(ranged.mapInArrow(_same, _ENTRY))
    edges = told.filter("kind = 2").groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high")
    open_ = told.filter("kind = 1").select("hash", "doc", "at", "start").join(edges, "hash")
    names = ["doc", "at", "start", "low", "high"]
    found = told.filter("kind = 0").select(*names).unionByName(open_.select(*names))
    other = F.when(F.col("low") == F.col("doc"), F.col("high")).otherwise(F.col("low"))
    return found.groupBy("doc", "at").agg(F.min("start").alias("start"), (F.max("start") + LEAST).alias("end"), F.min(other).alias("other")).drop("at")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, n_words, other_doc_id: each stretch of a document made of passages that occur in
    others; ``other_doc_id`` is the smallest of those that it was compared with."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("doc is not null")
    step = Steps()
    marks = step(texts.mapInArrow(_marks, "doc long, keys array<long>").filter(F.size("keys") > 0))
    each = marks.select("doc", F.explode("keys").alias("key"))
    repeated = step(each.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("key", (F.col("n") > 2).alias("many")))
    wanted = step(each.join(repeated, "key").groupBy("doc").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("many"), F.col("key"))).alias("many")))
    # A filter of ids keeps the texts of documents without such suffixes where they are.
    some = texts.filter(may_belong(wanted.select(F.col("doc").alias("id")), F.col("doc")))
    suffixes = step(some.join(wanted, "doc").select("doc", "text", "keys", "many").mapInArrow(_suffixes, "doc long, key long, at int, after binary, before binary, first int, windows array<long>"))
    step.free(suffixes)
    spans = step(_spans(suffixes, step).unionByName(_dense_spans(suffixes, step)))
    step.free(spans)
    # Overlapping and touching spans of a document become one.
    by_doc = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.groupBy("doc", "start", "end").agg(F.min("other").alias("other"))
    islands = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_doc))
    return islands.groupBy("doc", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other_doc_id")).select(
        F.col("doc").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id"
    )
