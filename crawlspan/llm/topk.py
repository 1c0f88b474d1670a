"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into segments of equal length; of each segment the mean and the deviation are kept. For two vectors the
squared distance is at least the sum over segments of ``length * ((mean - mean')^2 + (deviation - deviation')^2)``, and
finer segments give a closer bound. As ``2 * score = |q|^2 + |x|^2 - distance^2``, a lower bound of the distance is an upper
bound of the inner product. Each tile bounds all its pairs from coarse to fine segments, drops those that can't reach the
query's k-th score so far, and computes exact integer scores for the rest. Bounds carry a slack above their rounding error,
so no row is lost; equal scores are never dropped before ids are compared.

Defined cases: rows with a null id or vector, or with a null or non-finite component, take no part; shorter vectors count
as filled up with zeros; of query rows that share an id one asks, and rows with its id are never its results; repeated rows
of another id each take a place; an empty table or one without queries gives no rows; other columns are ignored. Scores
must fit 63 bits, or the job raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.llm.common import Steps
from crawlspan.llm.tiles import LOWEST, STRIP, Best, Block, better, chosen, nothing_yet, query_blocks, ranked, tiled, vectors

#: Segments of each resolution, coarse to fine.
SEGMENTS = (4, 16, 32)
#: Relative slack of a bound that is computed in 32-bit floats.
SLACK = 1e-5
#: Share of a strip up to which pairs are scored one by one, not by columns.
FEW = 0.02


def segment_sketch(comps: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 * segments): means and deviations, both times the root of the segment's length, so that the dot product of
    two sketches is an upper bound of the vectors' own."""
    n, dims = comps.shape
    length = max(1, -(-dims // segments))
    x = np.pad(comps, ((0, 0), (0, segments * length - dims))).reshape(n, segments, length).astype(np.float64)
    mean = x.mean(axis=2)
    deviation = np.sqrt(((x - mean[:, :, None]) ** 2).mean(axis=2))
    return (np.concatenate([mean, deviation], axis=1) * np.sqrt(length)).astype(np.float32)


def exact_kind(q: np.ndarray, x: np.ndarray) -> type:
    """The fastest number type in which all products and sums of these integers are exact."""
    most = max(1, q.shape[1]) * int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0))
    if most >= 2**63:
        raise OverflowError("a score does not fit 63 bits")
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class Search:
    """Top ``places`` rows of each query, tile by tile."""

    def __init__(self, places: int) -> None:
        self.places = places

    def tile(self, q: Block, _: list, x: Block, best: Best | None) -> Best:
        best = nothing_yet(len(q.ids)) if best is None else best
        dims = max(q.comps.shape[1], x.comps.shape[1])
        qc, xc = (np.pad(b.comps, ((0, 0), (0, dims - b.comps.shape[1]))) for b in (q, x))
        kind = exact_kind(qc, xc)
        sketches = [(segment_sketch(qc, s), segment_sketch(xc, s)) for s in SEGMENTS if s < dims]
        lengths = [np.sqrt((c.astype(np.float64) ** 2).sum(axis=1)) for c in (qc, xc)]
        qe, xe = qc.astype(kind), xc.astype(kind)
        for at in range(0, len(q.ids), STRIP):
            own = slice(at, at + STRIP)
            best = self._strip(best, at, q.ids[own], qe[own], x.ids, xe, [(a[own], b) for a, b in sketches], lengths[0][own], lengths[1])
        return best

    def _strip(self, best: Best, at: int, q_ids, q, x_ids, x, sketches, q_len, x_len) -> Best:
        floor = best.floor[at : at + len(q_ids), None]
        alive, cols = q_ids[:, None] != x_ids[None, :], np.arange(len(x_ids))
        if (floor > LOWEST).any():
            for qs, xs in sketches:
                need = floor - SLACK * float(q_len.max() * x_len.max())
                alive &= qs @ xs[cols].T >= need
                left = alive.any(axis=0)
                if np.count_nonzero(left) < len(cols) // 2:
                    cols, alive = cols[left], alive[:, left]
        if np.count_nonzero(alive) <= FEW * alive.size:
            rows, places = np.nonzero(alive)
            scores = np.einsum("ij,ij->i", q[rows], x[cols[places]])
            stay = scores >= floor[rows, 0]
            rows, places, scores = rows[stay], places[stay], scores[stay]
        else:
            every = np.where(alive, q @ x[cols].T, LOWEST)
            if len(cols) > self.places and (floor == LOWEST).any():  # no row below the k-th of this block can be among the first
                floor = np.maximum(floor, np.partition(every, -self.places, axis=1)[:, -self.places, None])
            rows, places = np.nonzero(alive & (every >= floor))
            scores = every[rows, places]
        return better(best, at + rows, scores.astype(np.int64), x_ids[cols[places]], self.places)

    @staticmethod
    def rows(q: Block, best: Best) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(q.ids[best.keys]), pa.array(best.scores), pa.array(best.ids)], names=["query_id", "score", "id"])


def top_k(rows: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, the ``k`` other rows of the highest inner
    product of ``floor(scale * x)`` components, ties to the smaller id."""
    step, search = Steps(), Search(k)
    blocks = step(vectors(rows, scale, id_col, vector_col, F.lit(0)))
    queries = chosen(blocks, every, step)
    packed, numbers = query_blocks(queries)
    found = step(tiled(blocks, packed, numbers, search.tile, search.rows, "query_id long, score long, id long"))
    step.free(found)
    return ranked(found, ["query_id"], k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
