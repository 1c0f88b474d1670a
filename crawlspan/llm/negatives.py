"""Hard-negative mining by Kronecker-packed products.

Components of several rows are made non-negative by a bias and laid into separate fields of one wide integer, field j at bit
``j * width``. One multiplication of the wide integer by an anchor's component multiplies all the fields; after summing over
the components each field holds that row's inner product with the biased components, because ``width`` has room for the
largest sum. Unpacking takes the bias off again, so scores are exact integers. Words of up to 53 bits are multiplied as
doubles, which hold them exactly; wider ones as Python integers.

Two passes over the tiles of anchors and rows: the first keeps each anchor's first positives, the second, for each positive,
the first rows of another label whose score lies in the positive's window.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; shorter vectors count
as filled up with zeros; of anchor rows that share an id one asks (the least label, then the least vector), and rows with
its id are never its partners; repeated rows of another id each take a place; a positive without negatives gives no rows; an
empty table gives none; other columns are ignored. Scores must fit 63 bits, or the job raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.llm.common import Steps
from crawlspan.llm.tiles import STRIP, Best, Block, better, chosen, nothing_yet, query_blocks, ranked, tiled, vectors

#: Bits of integers that doubles hold, and fields of a wider word.
DOUBLE_BITS, WIDE_FIELDS = 53, 4


class Packed:
    """Rows packed for products with anchors whose components lie in ``[least, most]``."""

    def __init__(self, rows: np.ndarray, least: int, most: int) -> None:
        self.n, dims = rows.shape
        self.bias = -min(0, int(rows.min(initial=0)))
        self.least = min(0, least)
        top = int(rows.max(initial=0)) + self.bias
        largest = max(1, dims * top * (most - self.least))
        if max(1, dims) * max(top, self.bias) * max(abs(least), abs(most)) >= 2**62:
            raise OverflowError("a score does not fit 63 bits")
        self.width = largest.bit_length()
        self.fields = DOUBLE_BITS // self.width
        self.kind = np.float64 if self.fields >= 1 else object
        self.fields = self.fields or WIDE_FIELDS
        biased = np.zeros((-(-self.n // self.fields) * self.fields, dims), np.int64)
        biased[: self.n] = rows + self.bias
        self.sums = biased.sum(axis=1)
        wide = biased.reshape(-1, self.fields, dims).astype(np.int64 if self.kind is np.float64 else object)
        self.words = sum(wide[:, j] << j * self.width for j in range(self.fields)).T.astype(self.kind)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors, rows) exact inner products."""
        lifted = anchors - self.least  # no field may borrow from the next
        product = lifted.astype(self.kind) @ self.words
        if self.kind is np.float64:
            product = product.astype(np.int64)
        out = np.empty((len(anchors), product.shape[1], self.fields), np.int64)
        for j in range(self.fields):
            out[:, :, j] = (product >> j * self.width) & ((1 << self.width) - 1)
        out = out.reshape(len(anchors), -1)
        out += self.least * self.sums
        out -= self.bias * anchors.sum(axis=1)[:, None]
        return out[:, : self.n]


def _strips(q: Block, x: Block):
    """Each strip of anchors with its exact scores against the block."""
    dims = max(q.comps.shape[1], x.comps.shape[1])
    qc, xc = (np.pad(b.comps, ((0, 0), (0, dims - b.comps.shape[1]))) for b in (q, x))
    packed = Packed(xc, int(qc.min(initial=0)), int(qc.max(initial=0)))
    for at in range(0, len(q.ids), STRIP):
        own = slice(at, at + STRIP)
        yield at, packed.scores(qc[own]), q.labels[own, None] == x.labels[None, :], q.ids[own, None] != x.ids[None, :]


class Mining:
    def __init__(self, positives: int, negatives: int, low: int, high: int) -> None:
        self.positives, self.negatives, self.low, self.high = positives, negatives, low, high

    def alike(self, q: Block, _: list, x: Block, best: Best | None) -> Best:
        """First pass: the best rows of the anchor's own label."""
        best = nothing_yet(len(q.ids)) if best is None else best
        for at, scores, same, other in _strips(q, x):
            rows, cols = np.nonzero(same & other & (scores >= best.floor[at : at + len(scores), None]))
            best = better(best, at + rows, scores[rows, cols], x.ids[cols], self.positives)
        return best

    def unlike(self, q: Block, extra: list, x: Block, best: Best | None) -> Best:
        """Second pass: of other labels, the best rows in the window of each positive; ``extra`` has the positives' scores."""
        best = nothing_yet(len(q.ids) * self.positives) if best is None else best
        bounds = np.full((len(q.ids), self.positives, 2), (1, 0), np.int64)
        for i, scores in enumerate(extra):
            for j, s in enumerate(scores):
                bounds[i, j] = -(-self.low * s // 100), self.high * s // 100
        for at, scores, same, _ in _strips(q, x):
            for j in range(self.positives):
                keys = (at + np.arange(len(scores))) * self.positives + j
                least = np.maximum(bounds[at : at + len(scores), j, 0], best.floor[keys])[:, None]
                rows, cols = np.nonzero(~same & (scores >= least) & (scores <= bounds[at : at + len(scores), j, 1, None]))
                best = better(best, keys[rows], scores[rows, cols], x.ids[cols], self.negatives)
        return best

    @staticmethod
    def alike_rows(q: Block, best: Best) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(q.ids[best.keys]), pa.array(best.scores), pa.array(best.ids)], names=["anchor_id", "score", "id"])

    def unlike_rows(self, q: Block, best: Best) -> pa.RecordBatch:
        at, place = best.keys // self.positives, (best.keys % self.positives + 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(q.ids[at]), pa.array(place), pa.array(best.scores), pa.array(best.ids)], names=["anchor_id", "place", "score", "id"])


def mine(
    rows: DataFrame, label: F.Column, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides. A negative's score is ``low`` to ``high`` hundredths of its positive's.
    """
    step, mining = Steps(), Mining(positives, negatives, low, high)
    blocks = step(vectors(rows, scale, id_col, vector_col, label))
    anchors = chosen(blocks, every, step)
    packed, numbers = query_blocks(anchors)
    near = tiled(blocks, packed, numbers, mining.alike, mining.alike_rows, "anchor_id long, score long, id long")
    pairs = step(ranked(near, ["anchor_id"], positives, "place").select("anchor_id", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    lists = pairs.groupBy(F.col("anchor_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("marks"))
    asking = step(anchors.join(lists, "id"))
    packed, numbers = query_blocks(asking, "marks")
    far = tiled(blocks, packed, numbers, mining.unlike, mining.unlike_rows, "anchor_id long, place int, score long, id long")
    found = step(ranked(far, ["anchor_id", "place"], negatives).select("anchor_id", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))
    step.free(found, pairs)
    return found.join(pairs, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
