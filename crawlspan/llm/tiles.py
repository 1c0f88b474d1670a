"""A stated set of query rows against all rows, in tiles.

Rows are packed where they lie into blocks of ROWS integer vectors; queries are dealt by a hash of their id into blocks of
QUERIES. Row blocks fall into groups of GROUP blocks at most. Each query block meets each group once, in one join on their
two numbers whose keys are all alike in size; a task reads the blocks of a group one after the other and holds one tile and
the best rows so far of one query block. So memory is bounded whatever the table's size, what a task emits is bounded for
each query and group, and nothing but packed blocks moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlspan.llm.common import Steps, kept, small_batches

#: Rows of a block, queries of a block, blocks of a group, queries of a tile.
ROWS, QUERIES, GROUP, STRIP = 4096, 1024, 64, 256
_BLOCK = "ids binary, labels binary, comps binary, dims int, n int"


class Block(NamedTuple):
    """ids (n,), labels (n,) and integer components (n, dims)."""

    ids: np.ndarray
    labels: np.ndarray
    comps: np.ndarray


def _matrix(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of ``flat`` between ``ends``, zeros after the ends of shorter ones."""
    lengths = np.diff(ends)
    dims = int(lengths.max(initial=0))
    if (lengths == dims).all():
        return flat[ends[0] : ends[-1]].reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), flat.dtype)
    out[np.arange(dims) < lengths[:, None]] = flat[ends[0] : ends[-1]]
    return out


def _whole(b: pa.RecordBatch, scale: int) -> Block:
    """The rows of a batch (id, label, vector) that take part: no null, no component that is null or not finite."""
    b = b.filter(pc.and_(pc.and_(b.column(0).is_valid(), b.column(1).is_valid()), b.column(2).is_valid()))
    lists = b.column(2)
    ends = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = bad[ends[1:]] == bad[ends[:-1]]
    if not fine.all():
        return _whole(b.filter(pa.array(fine)), scale)
    scaled = np.floor(scale * values)
    if np.abs(scaled[ends[0] : ends[-1]]).max(initial=0) >= 2**62:
        raise OverflowError("a component does not fit 63 bits")
    return Block(b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(scaled.astype(np.int64), ends))


def _join(parts: list[Block]) -> Block:
    dims = max(p.comps.shape[1] for p in parts)
    return Block(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)), np.concatenate([np.pad(p.comps, ((0, 0), (0, dims - p.comps.shape[1]))) for p in parts]))


def _bytes(x: Block) -> dict[str, object]:
    narrow = np.abs(x.comps).max(initial=0) < 2**15
    return {"ids": x.ids.astype("<i8").tobytes(), "labels": x.labels.astype("<i8").tobytes(), "comps": x.comps.astype("<i2" if narrow else "<i8").tobytes(), "dims": x.comps.shape[1], "n": len(x.ids)}


def unpack(ids: bytes, labels: bytes, comps: bytes, dims: int, n: int) -> Block:
    kind = "<i2" if len(comps) == 2 * n * dims else "<i8"
    return Block(np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(comps, kind).astype(np.int64).reshape(n, dims))


def vectors(df: DataFrame, scale: int, id_col: str, vector_col: str, label: F.Column) -> DataFrame:
    """Blocks of ``df``: components become ``floor(scale * x)``; rows with a null id, label or vector, or with a null or
    non-finite component, take no part. Rows stay in their partition."""
    small_batches(df.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("nothing", int)
        schema = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("comps", pa.binary()), ("dims", pa.int32()), ("n", pa.int32())])
        held: list[Block] = []
        for b in batches:
            if len((x := _whole(b, scale)).ids):
                held.append(x)
            while sum(len(x.ids) for x in held) >= ROWS:
                x = _join(held)
                yield pa.RecordBatch.from_pylist([_bytes(Block(*(c[:ROWS] for c in x)))], schema)
                held = [Block(*(c[ROWS:] for c in x))] if len(x.ids) > ROWS else []
        if held:
            yield pa.RecordBatch.from_pylist([_bytes(_join(held))], schema)

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    return rows.mapInArrow(pack, _BLOCK).withColumn("uid", F.monotonically_increasing_id())


def chosen(blocks: DataFrame, every: int, step: Steps) -> DataFrame:
    """Query rows as a table (id, label, vector of integers): ids that ``every`` divides. Of rows that share an id, the one
    with the least label, then the least vector."""

    def unpack_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = unpack(**r)
                at = np.flatnonzero(x.ids % every == 0)
                ends = np.arange(len(at) + 1, dtype=np.int32) * r["dims"]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.comps[at].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(x.ids[at]), pa.array(x.labels[at]), lists], names=["id", "label", "vector"])

    rows = blocks.drop("uid").mapInArrow(unpack_some, "id long, label long, vector array<long>")
    return step(rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.*"))


def query_blocks(queries: DataFrame, extra: str = "") -> tuple[DataFrame, int]:
    """Blocks of a settled table (id, label, vector and, if named, a column of long arrays), numbered ``qb``, and how many
    numbers there are."""
    many = max(1, ceil(queries.count() / QUERIES))

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ends = t["vector"].combine_chunks().offsets.to_numpy().astype(np.int64)
        x = Block(t["id"].to_numpy(), t["label"].to_numpy(), _matrix(t["vector"].combine_chunks().values.to_numpy(), ends))
        row = _bytes(x) | {"qb": t["qb"][0].as_py(), "extra": t["extra"].to_pylist()}
        kinds = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("comps", pa.binary()), ("dims", pa.int32()), ("n", pa.int32()), ("qb", pa.int32()), ("extra", pa.list_(pa.list_(pa.int64())))])
        return pa.Table.from_pylist([row], kinds)

    marks = F.col(extra) if extra else F.array().cast("array<long>")
    rows = queries.select("id", "label", "vector", marks.alias("extra"), F.pmod(F.xxhash64("id"), F.lit(many)).cast("int").alias("qb"))
    return rows.groupBy("qb").applyInArrow(pack, f"{_BLOCK}, qb int, extra array<array<long>>"), many


#: Work on a tile: query block, its extra lists, row block, state of the query block (None at first) -> state.
Tile = Callable[[Block, list, Block, object], object]


def tiled(blocks: DataFrame, queries: DataFrame, numbers: int, tile: Tile, rows_of: Callable[[Block, object], pa.RecordBatch], schema: str) -> DataFrame:
    """Runs ``tile`` over each pair of a query block and a row block. The state passes from a row block to the next of its
    group; ``rows_of`` turns the last state into rows."""
    n = blocks.agg(F.count(F.lit(1)), F.sum("n")).first()
    wanted = 2 * blocks.sparkSession.sparkContext.defaultParallelism
    groups = max(1, ceil(n[0] / GROUP), min(ceil((n[1] or 0) / ROWS), ceil(wanted / numbers)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, q, extra, state = None, None, [], None
        for b in batches:
            for r in b.to_pylist():
                if (r["qb"], r["g"]) != at:
                    if at is not None:
                        yield rows_of(q, state)
                    at, state, extra = (r["qb"], r["g"]), None, r["extra"]
                    q = unpack(*(r[f"q_{c}"] for c in ("ids", "labels", "comps", "dims", "n")))
                state = tile(q, extra, unpack(*(r[c] for c in ("ids", "labels", "comps", "dims", "n"))), state)
        if at is not None:
            yield rows_of(q, state)

    names = ("ids", "labels", "comps", "dims", "n")
    left = blocks.select(*names, F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(numbers - 1))).alias("qb"))
    right = queries.select("qb", "extra", *(F.col(c).alias(f"q_{c}") for c in names), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    return left.join(right, ["qb", "g"]).mapInArrow(work, schema)


class Best(NamedTuple):
    """The best rows so far of numbered keys, ordered by key, score from high to low and id, and each key's last score once
    it has all its places."""

    keys: np.ndarray
    scores: np.ndarray
    ids: np.ndarray
    floor: np.ndarray


LOWEST = np.iinfo(np.int64).min


def nothing_yet(keys: int) -> Best:
    none = np.zeros(0, np.int64)
    return Best(none, none, none, np.full(keys, LOWEST))


def better(best: Best, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, places: int) -> Best:
    """``best`` with more rows; each key keeps ``places`` of them."""
    if not len(keys):
        return best
    keys, scores, ids = (np.concatenate(x) for x in zip(best[:3], (keys, scores, ids), strict=True))
    order = np.lexsort((ids, -scores, keys))
    keys, scores, ids = keys[order], scores[order], ids[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    rank = np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))
    stay, floor = rank < places, best.floor.copy()
    full = rank == places - 1
    floor[keys[full]] = scores[full]
    return Best(keys[stay], scores[stay], ids[stay], floor)


def ranked(rows: DataFrame, keys: list[str], places: int, rank: str = "rank") -> DataFrame:
    """The first ``places`` rows of each key by score and id, with their rank from 1. Tasks cut their own rows first."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= places)
