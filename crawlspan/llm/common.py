"""Small helpers that the corpus operators share: tables, scratch files in the cluster's shared folder, what workers keep."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

T = TypeVar("T")

#: Rows and bytes that cross to a Python worker at once, so that a batch of very long texts still fits it.
ARROW_ROWS, ARROW_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Only a session on one machine (a test) may lack the setting; it
    gets a local folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("crawlspan.scratch.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="crawlspan-")
        spark.conf.set("crawlspan.scratch.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by rows and bytes. All operators set the same bounds, so it doesn't matter for lazy
    plans which of them came last; smaller bounds of the session's own stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        own = spark.conf.get(key).rstrip("b")
        if not own.isdigit() or not 0 < int(own) < most:
            spark.conf.set(key, str(most))


class Settled:
    """A table written to the shared folder. ``df`` reads it back with no lineage; ``drop()`` frees the files."""

    def __init__(self, df: DataFrame, codec: str = "snappy") -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/crawlspan-{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Steps:
    """The tables that an operator settles on its way; :meth:`free` deletes those that nothing reads any more."""

    def __init__(self) -> None:
        self.made: list[Settled] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.made.append(Settled(df))
        return self.made[-1].df

    def free(self, *read: DataFrame) -> None:
        """Deletes all tables but those in ``read``, which lazy results or later steps still need."""
        for s in self.made:
            if not any(s.df is x for x in read):
                s.drop()
        self.made = [s for s in self.made if any(s.df is x for x in read)]


def settle(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut and any executor may be lost afterwards."""
    return Settled(df).df


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's as a table, without Python workers."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], names=kinds.names))


def held_out(doc_id) -> F.Column:
    """True for the fifth of documents that never serve to learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


_kept: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """``make()``, kept by this worker process until another key is asked for: a worker that serves several operators in
    turn never holds the models and caches of two of them. Light functions ask for nothing, which frees what was kept."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            trim()
        _kept[key] = make()
    return _kept[key]


def trim() -> None:
    """Gives freed memory of this process back to the system, where the C library can: a worker lives on between tasks."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)
