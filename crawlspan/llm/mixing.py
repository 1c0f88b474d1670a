"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source whose target is f times its size is taken floor(f) times for sure and once more with probability
f - floor(f). The cube method draws those extra copies: within a block of documents it keeps moving the fractional
probabilities along the null space of the balancing constraints (number of documents, number of words) until each is 0
or 1 but for two at most. Blocks are small and of bounded size, so a source with a third of all rows is many blocks; what
blocks leave over meets in further rounds of blocks until one small landing problem for each source remains.

A reserve of each source, its SMALL smallest documents and SPREAD drawn at random, stays out until then. In the landing it
flies together with what is left over, the last units are rounded, and the words by which that misses the target are made up
by changing the choice among the reserve's documents, so that a source ends within half a small document of its target.

Defined cases: a null or wordless text has size 0 and is never taken, whatever its weight; a null source is a source of
its own, after all others; repeated rows are drawn as separate, interchangeable rows; an empty table gives an empty
result; other columns are ignored. A source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlspan.llm.common import Steps, kept, settle, small_table
from crawlspan.llm.members import belongs

#: Words of a text: runs of anything but the six ASCII spaces.
WORDS = r"[^\x20\x09-\x0D]+"
#: Documents in a block of one flight.
BLOCK = 2048
#: Documents of each source that wait for the landing: the smallest, and some of all sizes.
SMALL, SPREAD = 256, 768
#: Documents of which the landing tries all choices.
FEW = 14
#: Rows alike in id, source and size that one task lists at most.
ALIKE = 4096
#: A document is taken this many times at most.
MOST = 3.0


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = (1, 2, 3), most: float = MOST) -> dict[str | None, float]:
    """Target of each source: shares of the whole by weight, cut at ``most`` times its size, the excess shared anew.

    Sources go by code point, null last, and take ``weights`` in turn.
    """
    order = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    size = {s: int(n) for s, n in sizes}
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, capped = float(sum(size.values())), {}
    free = list(order)
    while free:
        left, share = total - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share > most * size[s]]
        if not over:
            return capped | {s: left * weight[s] / share for s in free}
        capped |= {s: most * size[s] for s in over}
        free = [s for s in free if s not in capped]
    return capped


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """One pass of the cube method over a block, balancing the count and the words; ``land`` also settles the rest.

    Units enter a window of three in turn. A direction u with sum(u) = 0 and sum(u * size) = 0 exists in the window; the
    probabilities move along it to one of the two ends, chosen so that expectations stay, and a unit that reached 0 or 1
    leaves. Landing drops the count and rounds the last units so that the words stay as near as they can.
    """
    p = p.copy()
    wait = [i for i in range(len(p)) if 1e-9 < p[i] < 1 - 1e-9]
    p[p <= 1e-9], p[p >= 1 - 1e-9] = 0.0, 1.0
    draws = iter(rng.random(len(p) + 8))
    window: list[int] = []
    at = 0

    def move(units: list[int], u: list[float]) -> list[int]:
        up = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(units, u, strict=True) if x)
        down = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(units, u, strict=True) if x)
        step = up if next(draws) * (up + down) < down else -down
        left = []
        for i, x in zip(units, u, strict=True):
            v = p[i] + step * x
            p[i] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
            if 0.0 < p[i] < 1.0:
                left.append(i)
        return left

    while True:
        while len(window) < 3 and at < len(wait):
            window.append(wait[at])
            at += 1
        if len(window) < 3:
            break
        a, b, c = (float(size[i]) for i in window)
        u = [b - c, c - a, a - b]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        window = move(window, u)
    if land and window:
        # At most two units are left: of the ways to round them, the one that keeps the words best.
        want = sum(p[i] * float(size[i]) for i in window)
        ways = sorted(product((0.0, 1.0), repeat=len(window)), key=lambda way: (abs(sum(x * float(size[i]) for x, i in zip(way, window, strict=True)) - want), way))
        p[window] = ways[0]
    return p


def settle_rest(x: np.ndarray, size: np.ndarray, miss: float) -> np.ndarray:
    """Changes a 0/1 choice so that its words move by ``-miss``, as nearly as the change of one document or of two at once
    gets there, one step after the other. Of a dozen documents or so all choices are looked at."""
    x = x.copy()
    if 0 < len(x) <= FEW:
        ways = (np.arange(1 << len(x))[:, None] >> np.arange(len(x))) & 1
        off = np.abs(ways @ size - (x @ size - miss))
        return ways[np.lexsort((np.abs(ways - x).sum(axis=1), off))[0]].astype(float)
    while len(x):
        turn = np.where(x > 0.5, -size, size)
        one = int(np.argmin(np.abs(miss + turn)))
        change = [one]
        if abs(miss + turn[one]) > 0.5 and len(x) > 1:
            order = np.argsort(turn, kind="stable")
            ranked = turn[order]
            want = -miss - ranked  # what the second of a pair should be
            near = np.searchsorted(ranked, want)
            both = np.stack([np.clip(near + k, 0, len(x) - 1) for k in (-1, 0, 1)])
            off = np.abs(miss + ranked + ranked[both])
            off[both == np.arange(len(x))] = np.inf
            k, i = np.unravel_index(int(np.argmin(off)), off.shape)
            if off[k, i] < abs(miss + turn[one]):
                change = [int(order[i]), int(order[both[k, i]])]
        after = miss + float(turn[change].sum())
        if abs(after) >= abs(miss):
            break
        x[change], miss = 1.0 - x[change], after
    return x


def _fly(key: tuple[pa.Scalar, ...], rows: pa.Table, seed: int, level: int, land: bool) -> pa.Table:
    """The flight over one block, largest documents first, so that small ones are left to land: the same rows give the
    same draw."""
    kept("nothing", int)
    rows = rows.drop_columns("block").combine_chunks()
    size, ids = rows["size"].to_numpy(), rows["doc_id"]
    order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), rows["at"].to_numpy(), -size))
    rows, size = rows.take(order), size[order].astype(float)
    rng = np.random.default_rng([seed, level, key[0].as_py() & 0xFFFFFFFF, key[1].as_py()])
    start = rows["p"].to_numpy()
    p = flight(start, size, rng, land)
    if land:
        p = settle_rest(p, size, float(((p - start) * size).sum()))
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p))


def _flyer(seed: int, level: int, land: bool = False) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    def fly(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _fly(key, rows, seed, level, land)

    return fly


_ROW = "doc_id long, src long, size long, at long, p double"
#: Whether a row is of the reserve, by the bounds of :func:`_reserved`.
_WAITS = "at <= spread OR struct(size, at) <= small"


def _numbered(sized: DataFrame) -> DataFrame:
    """doc_id, source, size, nth of each row; rows alike are counted first and numbered, in parts of ALIKE."""
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    few = alike.filter(F.col("n") <= ALIKE).withColumn("part", F.lit(0).cast("long"))
    many = alike.filter(F.col("n") > ALIKE).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ALIKE)))).repartition("doc_id", "size", "part")
    first = F.col("part") * ALIKE
    return few.unionByName(many).select("doc_id", "source", "size", F.explode(F.sequence(first + 1, F.least(first + ALIKE, "n"))).alias("nth"))


def _reserved(flying: DataFrame) -> DataFrame:
    """Bounds of each source's reserve: the last of its SMALL smallest rows, and of SPREAD rows in the order of a hash. Tasks
    cut their own rows first."""
    small = flying.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("size", "at"))).filter(F.col("n") <= SMALL)
    spread = flying.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("at"))).filter(F.col("n") <= SPREAD)
    return small.groupBy("src").agg(F.max(F.struct("size", "at")).alias("small")).join(spread.groupBy("src").agg(F.max("at").alias("spread")), "src")


@dataclass(frozen=True)
class Draw:
    """What a mix takes. ``rows``: doc_id, src, size, source_size, target, sure of each row (lazy); ``extra``: doc_id, src,
    size, extra, how many of the rows alike in these are taken once more than ``sure`` times; ``plan``: a row per source."""

    rows: DataFrame
    extra: DataFrame
    plan: DataFrame


def draw(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Draw:
    """Balances the extra copies of ``docs`` by the cube method."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORDS)), F.lit(0)).cast("long")
    sized = settle(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size")))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("rows")).collect()  # a row per source
    goal = targets([(r["source"], r["source_size"]) for r in per_source], weights)
    order = sorted((r["source"] for r in per_source if r["source"] is not None)) + [None]
    times = lambda r: float(goal[r["source"]] / r["source_size"]) if r["source_size"] else 0.0
    plan = small_table(
        spark,
        [(order.index(r["source"]), r["source"], r["source_size"], float(goal[r["source"]]), times(r), int(r["rows"])) for r in per_source],
        "src long, source string, source_size long, target double, times double, rows long",
    ).withColumn("sure", F.floor(F.col("times") + 1e-12))
    step = Steps()
    planned = lambda df: df.join(plan, df["source"].eqNullSafe(plan["source"])).drop(df["source"], plan["source"])
    p = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("times") - F.col("sure"))).otherwise(0.0)
    flying = step(planned(_numbered(sized)).withColumn("p", p).filter("p > 0 and p < 1").select("doc_id", "src", "size", F.xxhash64(F.lit(seed), "doc_id", "size", "nth").alias("at"), "p", "rows"))
    waits = _reserved(flying)
    reserve = step(flying.join(waits, "src").filter(_WAITS).select("doc_id", "src", "size", "at", "p"))
    # Level by level: blocks fly, the few that stay fractional in each block meet in fewer blocks.
    done, level = [], 0
    open_rows = flying.join(waits, "src").filter(f"NOT ({_WAITS})").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("long"))
    while True:
        dealt = open_rows.withColumn("block", F.pmod(F.xxhash64("at", F.lit(level)), F.greatest("blocks", F.lit(1)))).select("doc_id", "src", "size", "at", "p", "block")
        flown = step(dealt.groupBy("src", "block").applyInArrow(_flyer(seed, level), _ROW))
        done.append(flown.filter("p = 1"))
        rest = flown.filter("p > 0 and p < 1")
        counts = rest.groupBy("src").count().collect()  # a row per source
        if all(r["count"] <= BLOCK // 2 for r in counts):
            break
        fewer = small_table(spark, [(r["src"], -(-r["count"] // BLOCK)) for r in counts], "src long, blocks long")
        open_rows = rest.join(fewer, "src")
        level += 1
    last = rest.unionByName(reserve).withColumn("block", F.lit(0).cast("long"))
    done.append(step(last.groupBy("src", "block").applyInArrow(_flyer(seed, level + 1, land=True), _ROW)).filter("p = 1"))
    rows = planned(sized).select("doc_id", "src", "size", "source_size", "target", "sure")
    # Rows repeated in full are interchangeable, so the extra copies are counted per (id, source, size).
    extra = settle(reduce(DataFrame.unionByName, done).groupBy("doc_id", "src", "size").agg(F.count(F.lit(1)).alias("extra")))
    step.free()
    return Draw(rows, extra, plan)


def _with_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """``rows`` (doc_id, src, size, ...) with ``extra``, null where none is drawn."""
    e = extra.select(F.col("doc_id").alias("d"), F.col("src").alias("s"), F.col("size").alias("z"), "extra")
    return rows.join(e, rows["doc_id"].eqNullSafe(e["d"]) & (rows["src"] == e["s"]) & (rows["size"] == e["z"]), "left").drop("d", "s", "z")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies, src, taken for every row of ``docs``; ``copies`` is how often it is taken."""
    drawn = draw(docs, weights, seed, id_col, text_col, source_col)
    same = drawn.rows.groupBy("doc_id", "src", "size", "source_size", "target", "sure").agg(F.count(F.lit(1)).alias("times"))
    each = _with_extra(same, drawn.extra).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    copies = F.col("sure") + F.when(F.col("nth") <= F.coalesce("extra", F.lit(0)), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"), "src").withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns kept.

    Filters of ids tell which rows are taken once more, so that texts stay where they are. Rows that the filters leave
    open, and rows that share an id of which only some are taken once more, are numbered and matched exactly.
    """
    drawn, step = draw(docs, weights, seed, id_col, text_col, source_col), Steps()
    some = drawn.rows.filter("size > 0 and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    more = drawn.extra.groupBy("doc_id").agg(F.sum("extra").alias("extra"))
    told = step(some.join(more, "doc_id", "left").select(F.col("doc_id").alias("id"), F.coalesce("extra", F.lit(0)).alias("extra"), "times"))
    once_more = belongs(told.filter("extra > 0").select("id"), told.filter("extra < times").select("id"), id_col)
    step.free()
    names = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*names).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("from"), text.alias("of"), once_more.alias("once_more"))
    plan = drawn.plan.select("src", F.col("source").alias("s"), "sure")
    rows = rows.filter(F.col("of").rlike(WORDS))
    rows = rows.join(F.broadcast(plan), rows["from"].eqNullSafe(plan["s"]))  # a row per source
    repeat = lambda df, extra: df.select("row", F.explode(F.array_repeat(F.lit(0), (F.col("sure") + extra).cast("int"))).alias("nth")).select("row.*")
    plain = repeat(rows.filter("once_more is not null"), F.col("once_more").cast("int"))
    left = settle(rows.filter("once_more is null").select("row", "doc_id", "src", F.regexp_count("of", F.lit(WORDS)).cast("long").alias("size"), "sure", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    # Rows alike are numbered part by part, so that many of them don't meet in one task.
    alike = ["doc_id", "src", "size"]
    parts = left.groupBy(*alike, "part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(Window.partitionBy(*alike).orderBy("part")) - F.col("n"))
    parts = parts.select(*(F.col(c).alias(f"of_{c}") for c in (*alike, "part")), "before")
    numbered = left.withColumn("nth", F.row_number().over(Window.partitionBy(*alike, "part").orderBy("at")))
    numbered = numbered.join(parts, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*alike, "part"))))
    numbered = numbered.select("row", *alike, "sure", (F.col("before") + F.col("nth")).alias("nth"))
    exact = _with_extra(numbered, drawn.extra)
    return plain.unionByName(repeat(exact, F.when(F.col("nth") <= F.coalesce("extra", F.lit(0)), 1).otherwise(0)))
