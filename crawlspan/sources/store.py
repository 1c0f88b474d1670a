"""Stored crawls: tables whose partitions are crawls, changed by writing new versions and switching a pointer last.

A change writes the touched crawls' rows to new folders of Parquet files. Then it puts a pointer file, numbered one higher than
the newest, which names for every table and crawl the folder that counts. The pointer is written beside and renamed without
overwriting, so a reader sees the state before or the state after, a change that dies in between is as if it never began,
and of two changes made from the same state the later one raises :class:`Conflict` and is to be tried again.

Crawls that a change doesn't touch are neither read nor written by it. Folders that no pointer names any more are kept for
readers that still use them, until :meth:`CrawlStore.vacuum`.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The version counter of pointer files has this many digits, so that names sort as numbers.
DIGITS = 12


class Conflict(RuntimeError):
    """Another change was made meanwhile."""


class CrawlStore:
    """Tables of crawls below ``path``, each with a column ``crawl_id``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    # Pointers -------------------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The number of the newest state; 0 for an empty store."""
        return max((int(n.removesuffix(".json")) for n in self._names("pointers") if n.endswith(".json") and not n.startswith(".")), default=0)

    def state(self, version: int | None = None) -> dict:
        """{"schemas": {table: JSON}, "parts": {table: {crawl: folder}}} of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"schemas": {}, "parts": {}}
        stream = self._fs.open(self._at(f"pointers/{version:0{DIGITS}d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, state: dict, version: int) -> None:
        """Makes ``state`` the one after ``version``."""
        self._fs.mkdirs(self._at("pointers"))
        beside, final = self._at(f"pointers/.{uuid.uuid4().hex}"), self._at(f"pointers/{version + 1:0{DIGITS}d}.json")
        out = self._fs.create(beside, False)
        try:
            out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            out.close()
        fs, none = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, final, none)
        except Exception as e:
            self._fs.delete(beside, False)
            raise Conflict(f"version {version + 1} of {self.path} is there already") from e

    # Rows -----------------------------------------------------------------------------------------------------------

    def write(self, table: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows to a new folder that nothing points to yet: {crawl: folder}."""
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.write.partitionBy("crawl_id").parquet(f"{self.path}/{folder}")
        return {unquote(n.removeprefix("crawl_id=")): f"{folder}/{n}" for n in self._names(folder) if n.startswith("crawl_id=")}

    def read(self, table: str, crawls: set[str] | None = None, state: dict | None = None) -> DataFrame:
        """The rows of a table in a state (the newest by default), of all crawls or of some."""
        state = self.state() if state is None else state
        schema = StructType.fromJson(json.loads(state["schemas"][table]))
        by_base: dict[str, list[str]] = {}
        for crawl, folder in sorted(state["parts"][table].items()):
            if crawls is None or crawl in crawls:
                by_base.setdefault(folder.rsplit("/", 1)[0], []).append(f"{self.path}/{folder}")
        read = [self.spark.read.schema(schema).option("basePath", f"{self.path}/{base}").parquet(*folders).select(*schema.names) for base, folders in by_base.items()]
        return reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], schema)

    def tables(self) -> dict[str, DataFrame]:
        """All tables in one state, whatever is changed meanwhile."""
        state = self.state()
        return {t: self.read(t, state=state) for t in state["schemas"]}

    # Changes --------------------------------------------------------------------------------------------------------

    def put(self, tables: dict[str, DataFrame]) -> int:
        """Adds or replaces the crawls that ``tables`` have rows of, all tables in one step."""
        version = self.version()
        state = self.state(version)
        for name, rows in tables.items():
            state["schemas"].setdefault(name, rows.schema.json())
            state["parts"].setdefault(name, {}).update(self.write(name, rows.select(*StructType.fromJson(json.loads(state["schemas"][name])).names)))
        self.commit(state, version)
        return version + 1

    def upsert(self, updates: DataFrame, table: str = "pages", seq: str = "seq", all_ties: bool = False) -> int:
        """Rows by (crawl_id, url_hash): the newest of an update wins, but url and depth keep their first value (``all_ties``
        as in :func:`upsert_pages`). Only the crawls that ``updates`` name are read and written."""
        from crawlspan.sources.sinks import upsert_pages

        version = self.version()
        state = self.state(version)
        touched = {r[0] for r in updates.select("crawl_id").distinct().collect()}
        if touched:
            names = StructType.fromJson(json.loads(state["schemas"][table])).names
            merged = upsert_pages(self.read(table, touched, state), updates.select(*names, seq), seq, all_ties)
            state["parts"][table].update(self.write(table, merged))
            self.commit(state, version)
        return version + bool(touched)

    def delete(self, crawl_id: str) -> int:
        """Takes a crawl out of all tables; raises KeyError for one that is in none."""
        version = self.version()
        state = self.state(version)
        if not any(crawl_id in parts for parts in state["parts"].values()):
            raise KeyError(crawl_id)
        for parts in state["parts"].values():
            parts.pop(crawl_id, None)
        self.commit(state, version)
        return version + 1

    def vacuum(self) -> list[str]:
        """Deletes the folders that the newest state does not name, and older pointers; what was deleted. Not while another
        change is being written, whose folders nothing names yet."""
        version = self.version()
        state = self.state(version)
        live = {folder for parts in state["parts"].values() for folder in parts.values()}
        gone = []
        for table in state["schemas"]:
            for base in self._names(table):
                own = [f"{table}/{base}/{n}" for n in self._names(f"{table}/{base}") if n.startswith("crawl_id=")]
                dead = [f for f in own if f not in live]
                gone += [f"{table}/{base}"] if len(dead) == len(own) else dead
        gone += [f"pointers/{n}" for n in self._names("pointers") if n.startswith(".") or int(n.removesuffix(".json")) < version]
        for name in gone:
            self._fs.delete(self._at(name), True)
        return gone


def crawl_sizes(store: CrawlStore) -> DataFrame:
    """(crawl_id, table, n): how many rows each table has of each crawl."""
    counts = [df.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n")).select("crawl_id", F.lit(name).alias("table"), "n") for name, df in store.tables().items()]
    return reduce(DataFrame.unionByName, counts)
