"""A content-addressed store of token ids.

Each document's ids are cut into chunks where a rolling hash of the last ids says so; equal stretches give equal chunks.
``chunks/`` holds each distinct chunk once under its SHA-256, ``recipes/`` the documents in ascending id order as lists of
chunk keys with a Merkle root each, ``manifest/`` one row per recipe range with the Merkle root over its documents.

``root/`` holds the Merkle root over the ranges. Each document is encoded and cut once. Chunks that the two-pass Bloom filter
proves unique are written where they are made; only those that may repeat shuffle.

Reading back verifies the store from the top down: ranges against the root, documents against their range, chunk keys
against their document, and the content of every stored chunk against its key. Whatever is damaged, missing or added raises
ValueError (in a task or on the driver). Checksums of chunks are combined by recipe, so that no payload has to move to its
document; :func:`read_documents` rebuilds the ids themselves.

Defined cases: a null text is empty and has the end id only; null ids sort first; rows under one id are stored as rows of
their own, ordered by content; an empty table makes an empty store.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlspan.llm.common import Settled, kept, shared_dir, small_batches, small_table
from crawlspan.llm.exact_dedup import repeat_filter, seen_again

#: Ids in a chunk: at least, about, at most; ids that the rolling hash sees.
SHORTEST, USUAL, LONGEST, ROLLING = 64, 256, 1024, 8
#: Cached words of a worker's newer and of its older half; longer ones (characters) are not cached.
WORDS, LONG_WORD = 120_000, 48
#: Words of Latin-1 letters alone.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Marks at the end of a word that are a token run of their own; other letters than these before them may end in a
#: combining mark once they are lower-cased or composed.
MARKS = "([0-9A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:%$#&*]+)( |$)"
#: Documents of a recipe range, about.
RANGE = 50_000


class WordEncoder:
    """Encodes by the tokenizers library, white-space separated word by word, and keeps the ids of words seen lately.

    The tokenizer must drop white space and never look across it, make a digit a token of its own, part letters from
    marks, and lower-case; the caller chooses it so. Marks at the end of a word are parted from it; a batch is split, its
    words numbered and its ids put together by Arrow, so that Python sees each different word of a batch once. New words go
    to the tokenizer together, parted by the digit 0. If the file says that it lower-cases and writes bytes as characters, words of Latin-1
    letters alone go to its merges with both done to all of them at once; composing leaves such words as they are.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = _merges_alone(path)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.type = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.zero = self.tokenizer.encode("0", add_special_tokens=False).ids

    def _ids(self, stems: list[str], tokenizer) -> list[bytes]:
        """Ids of words without the digit 0."""
        out: list[bytes] = []
        for k in range(0, len(stems), 200):
            part = stems[k : k + 200]
            text = " 0 ".join(part)
            if tokenizer is self.merges:
                text = codecs.charmap_decode(text.lower().encode(), "strict", _BYTE_CHARS)[0]
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
            at = np.flatnonzero(ids == self.zero[0]) if len(self.zero) == 1 else ()
            if len(at) == len(part) - 1:
                raw, w = ids.tobytes(), ids.itemsize
                out += [raw[i:j] for i, j in zip([0, *((at + 1) * w).tolist()], [*(at * w).tolist(), len(raw)], strict=True)]
            else:
                out += self._plain(part)
        return out

    def _plain(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        letters = [w for w in new if LETTERS(w)] if self.merges else []
        others = new.difference(letters)
        zeros = [w for w in others if "0" in w]
        others = list(others.difference(zeros))
        for some, ids in ((letters, self._ids(letters, self.merges)), (others, self._ids(others, self.tokenizer)), (zeros, self._plain(zeros))):
            self.words.update(zip(some, ids, strict=True))

    def encode(self, texts: list[str | None] | pa.Array, end: int) -> list[bytes]:
        """The ids of each text with the end id, as integers of ``type``."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = pc.replace_substring(pc.fill_null(column, ""), "\n", " ")
        split = pc.split_pattern(pc.replace_substring_regex(column, MARKS, r"\1 \2\3"), " ")
        coded = split.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > WORDS:
            self.words, self.older = {}, self.words
        self.words[""] = b""
        new = set(different).difference(self.words)
        again = {w: self.older[w] for w in new if w in self.older}
        self.words.update(again)
        self._learn(new.difference(again))
        found = list(map(self.words.__getitem__, different))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)]), pa.py_buffer(b"".join(found))]).take(coded.indices)
        for w in [x for x in new if len(x) > LONG_WORD]:
            self.words.pop(w, None)
        places = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        ends = places[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist() if len(split) else [0]
        raw, last = memoryview(ids.buffers()[2] or b""), np.array([end], self.type).tobytes()
        return [bytes(raw[i:j]) + last for i, j in zip(ends, ends[1:], strict=False)]


def _merges_alone(path: str):
    """A tokenizer of the file's merges without its steps before them, for words that had these steps; None if its steps
    are others."""
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = lambda x, many: [y["type"] for y in (x or {}).get(many, [x] if x else [])]
    if set(steps(spec["normalizer"], "normalizers")) - {"NFC", "Replace"} != {"Lowercase"} or steps(spec["pre_tokenizer"], "pretokenizers")[-1:] != ["ByteLevel"]:
        return None
    return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))


def _byte_chars() -> str:
    """How byte-level vocabularies write each byte: printable Latin-1 as it is, the others in order from 256 on, but for
    the space, which parts words here."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return "".join(" " if b == 32 else chr(b if b in printable else 256 + rest.index(b)) for b in range(256))


_BYTE_CHARS = _byte_chars()


def word_encoder(path: str) -> WordEncoder:
    return kept(("words", path), lambda: WordEncoder(path))


def cuts(ids: np.ndarray, starts: list[int]) -> list[list[int]]:
    """Ends of the chunks of each of several id streams that stand one after the other, by content.

    The rolling hash runs on from one stream to the next, where no chunk can end yet: SHORTEST is more than ROLLING.
    """
    h = np.zeros(len(ids), np.uint32)
    x = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    x ^= x >> np.uint32(15)
    for i in range(min(ROLLING, len(ids))):
        h[i:] += x[: len(ids) - i] * np.uint32((0x9E3779B1 * (2 * i + 1)) & 0xFFFFFFFF)
    marks = np.flatnonzero((h >> np.uint32(11)) % np.uint32(USUAL) == 0) + 1
    of = np.searchsorted(marks, starts).tolist()
    marks = marks.tolist()
    out = []
    for start, end, i, j in zip(starts, [*starts[1:], len(ids)], of, [*of[1:], len(marks)], strict=True):
        ends, at = [], start
        for c in marks[i:j]:
            while c - at > LONGEST:
                at += LONGEST
                ends.append(at)
            if c - at >= SHORTEST and c <= end:
                ends.append(c)
                at = c
        while end - at > LONGEST:
            at += LONGEST
            ends.append(at)
        if at < end:
            ends.append(end)
        out.append([e - start for e in ends])
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests; an odd one out moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def joined(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``rows`` and ``size`` bytes: fewer of their words are different."""
    some: list[pa.RecordBatch] = []
    for b in batches:
        if some and (sum(x.num_rows for x in some) + b.num_rows > rows or sum(x.nbytes for x in some) + b.nbytes > size):
            yield pa.concat_batches(some)
            some = []
        some.append(b)
    if some:
        yield pa.concat_batches(some)


_STAGED = "doc_id long, n_tokens long, root binary, chunk_keys array<binary>, chunks array<binary>"


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    """Recipes, and the chunks themselves: each led by its width, so that equal bytes of different widths differ."""
    e = word_encoder(path)
    width = int(e.type[-1])
    lead = bytes([width])
    for b in joined(batches):
        docs = e.encode(b.column(1), end)
        n = [len(d) // width for d in docs]
        starts = np.cumsum([0, *n[:-1]]).tolist() if n else []
        chunks = [[lead + d[i * width : j * width] for i, j in zip([0, *ends], ends, strict=False)] for d, ends in zip(docs, cuts(np.frombuffer(b"".join(docs), e.type), starts), strict=True)]
        keys = [[hashlib.sha256(c).digest() for c in some] for some in chunks]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(map(merkle, keys), pa.binary()), pa.array(keys, pa.list_(pa.binary())), pa.array(chunks, pa.list_(pa.binary()))],
            names=["doc_id", "n_tokens", "root", "chunk_keys", "chunks"],
        )


_PART = "part int, documents long, n_tokens long, root binary"


def _part_root(pdf: pd.DataFrame) -> pd.DataFrame:
    """The manifest row of a range (about RANGE documents), after checking each document's root."""
    pdf = pdf.sort_values(["doc_id", "root"], na_position="first", kind="stable")
    roots = [bytes(x) for x in pdf["root"]]
    for root, keys in zip(roots, pdf["chunk_keys"], strict=True):
        if merkle([bytes(k) for k in keys]) != root:
            raise ValueError("chunk keys don't make their document's root")
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "documents": [len(pdf)], "n_tokens": [int(pdf["n_tokens"].sum())], "root": [merkle(roots)]})


def _part_roots(recipes: DataFrame) -> DataFrame:
    return recipes.select("part", "doc_id", "n_tokens", "root", "chunk_keys").groupBy("part").applyInPandas(_part_root, _PART)


def _top(parts: list) -> bytes:
    """The root over the manifest rows: one row a range."""
    return merkle([hashlib.sha256(f"{r['part']} {r['documents']} {r['n_tokens']} ".encode() + bytes(r["root"])).digest() for r in sorted(parts, key=lambda r: r["part"])])


def write_store(docs: DataFrame, path: str, end_id: int, out: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes ``docs`` with the tokenizer file at ``path`` and writes a store; returns its folder."""
    spark = docs.sparkSession
    small_batches(spark)
    out = out or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    staged = Settled(rows.mapInArrow(partial(_encode, path=path, end=end_id), _STAGED), codec="zstd")
    n = staged.df.count()
    ranges = max(1, min(n // 2000, 2 * spark.sparkContext.defaultParallelism), n // RANGE)
    recipes = staged.df.select("doc_id", "n_tokens", "chunk_keys", "root").repartitionByRange(ranges, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    recipes.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{out}/recipes")
    _part_roots(_recipe_table(spark, out)).write.parquet(f"{out}/manifest")
    parts = spark.read.schema(_PART).parquet(f"{out}/manifest").collect()
    small_table(spark, [(_top(parts),)], "root binary").coalesce(1).write.parquet(f"{out}/root")
    keys = staged.df.select(F.explode("chunk_keys").alias("sha"))
    again = spark.sparkContext.broadcast(repeat_filter(keys, keys.count()))
    made = staged.df.select(F.arrays_zip("chunk_keys", "chunks", seen_again(again, many=True)(F.col("chunk_keys")).alias("maybe")).alias("chunks"))
    made = made.select(F.inline("chunks")).toDF("sha", "data", "maybe")
    once = made.filter("not maybe").select("sha", "data")
    # Of chunks under one key any copy will do: they are equal.
    once.unionByName(made.filter("maybe").groupBy("sha").agg(F.first("data").alias("data"))).write.option("compression", "zstd").parquet(f"{out}/chunks")
    staged.drop()
    return out


def _recipe_table(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, chunk_keys array<binary>, root binary, part int").parquet(f"{store}/recipes")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checks stored chunks against their keys; checksums and lengths of their ids as 32-bit integers."""
    for b in batches:
        n, sums = [], []
        for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if hashlib.sha256(data).digest() != key:
                raise ValueError(f"chunk {key.hex()} is damaged")
            ids = np.frombuffer(data, f"<u{data[0]}", offset=1)
            n.append(len(ids))
            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(sums, pa.int64())], names=["key", "n", "crc"])


@lru_cache(maxsize=4096)
def _shift(n: int) -> tuple[int, ...]:
    """What ``n`` further zero bytes do to each bit of a CRC-32."""
    if n == 1:
        table = []
        for i in range(32):
            x = 1 << i
            for _ in range(8):
                x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
            table.append(x)
        return tuple(table)
    half = _shift(n // 2)
    twice = [_apply(half, half[i]) for i in range(32)]
    return tuple(_apply(_shift(1), x) for x in twice) if n % 2 else tuple(twice)


def _apply(op: tuple[int, ...], x: int) -> int:
    out = i = 0
    while x:
        if x & 1:
            out ^= op[i]
        x >>= 1
        i += 1
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of joined byte strings from (checksum, bytes) of each."""
    total = 0
    for crc, n in parts:
        total = _apply(_shift(n), total) ^ crc if n else total
    return total


def check_recipes(spark: SparkSession, store: str) -> DataFrame:
    """The recipes of a store, after holding them against its manifest and the manifest against the root."""
    recipes = _recipe_table(spark, store)
    manifest = spark.read.schema(_PART).parquet(f"{store}/manifest").collect()  # a row per range
    top = spark.read.schema("root binary").parquet(f"{store}/root").collect()
    if [bytes(r["root"]) for r in top] != [_top(manifest)]:
        raise ValueError("the manifest doesn't make the store's root")
    row = lambda r: (r["part"], r["documents"], r["n_tokens"], bytes(r["root"]))
    if sorted(map(row, manifest)) != sorted(map(row, _part_roots(recipes).collect())):
        raise ValueError("recipes don't make their manifest")
    return recipes


def read_digests(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of a store alone, verified."""
    recipes = check_recipes(spark, store)
    # The place of a range is the sum of those before it: one row for each range. Inside a range ids run on.
    manifest = spark.read.schema(_PART).parquet(f"{store}/manifest")
    before = manifest.select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("before"))
    row = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root", "nth")
    each = recipes.withColumn("nth", F.monotonically_increasing_id())
    placed = each.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.sum("n_tokens").over(row.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    placed = placed.withColumn("row", F.row_number().over(row)).select("part", "row", "doc_id", "start", "n_tokens", F.posexplode("chunk_keys").alias("seq", "key"))
    sums = Settled(spark.read.schema("sha binary, data binary").parquet(f"{store}/chunks").mapInArrow(_read, "key binary, n int, crc long")).df
    # A chunk that many documents have is a skewed key of the left side, which adaptive execution splits.
    parts = placed.join(sums, "key", "left").groupBy("part", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("seq", F.coalesce("n", F.raise_error(F.lit("a chunk is missing")).cast("int")).alias("n"), "crc"))).alias("parts"),
    )
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda total, x: total + x["n"]) == F.col("n_tokens")
    parts = parts.withColumn("parts", F.when(whole, F.col("parts")).otherwise(F.raise_error(F.lit("chunks and tokens differ in number"))))
    combine = F.pandas_udf(_combine, "long")
    return parts.select("doc_id", "start", "n_tokens", combine(F.col("parts")).alias("ids_crc32"))


def _combine(parts: pd.Series) -> pd.Series:
    return pd.Series([joined_crc([(x["crc"], 4 * x["n"]) for x in p]) for p in parts], dtype="int64")


def _rebuild(parts: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for p, tokens in zip(parts, n, strict=True):
        if any(x["data"] is None for x in p):
            raise ValueError("a chunk is missing")
        if any(hashlib.sha256(x["data"]).digest() != bytes(x["key"]) for x in p):
            raise ValueError("a chunk is damaged")
        ids = np.concatenate([np.frombuffer(x["data"], f"<u{x['data'][0]}", offset=1) for x in p]).astype(np.int32)
        if len(ids) != tokens:
            raise ValueError("chunks and tokens differ in number")
        out.append(ids)
    return pd.Series(out, dtype="object")


def read_documents(spark: SparkSession, store: str) -> DataFrame:
    """doc_id and ids (``array<int>``) of each document, rebuilt from its chunks and verified."""
    small_batches(spark)
    data = spark.read.schema("sha binary, data binary").parquet(f"{store}/chunks").withColumnRenamed("sha", "key")
    rows = check_recipes(spark, store).withColumn("row", F.monotonically_increasing_id())
    parts = rows.select("row", "doc_id", "n_tokens", F.posexplode("chunk_keys").alias("seq", "key")).join(data, "key", "left")
    parts = parts.groupBy("row", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("seq", "key", "data"))).alias("parts"))
    rebuild = F.pandas_udf(_rebuild, "array<int>")
    return parts.select("doc_id", rebuild(F.col("parts"), F.col("n_tokens")).alias("ids"))
