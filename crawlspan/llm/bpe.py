"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A piece of text (one match of the pattern) is encoded without replaying merges. Its bytes, written as Latin-1 characters,
run through an Aho-Corasick automaton of the vocabulary, which gives the longest token that starts at each place. The
encoder takes the longest token whose pair with its left neighbour is stable, falls back to shorter prefixes, and steps
back when none fits; each place is given up at most once, so the work is linear. A pair is stable when replaying the
merges over both tokens would not join or cut them differently; answers are kept, as are the ids of whole pieces. That
backtracking over stable pairs gives the very ids of the merges, and the walk that tells stable pairs, were published with the
open-source Rust crate ``bpe`` of github/rust-gems; this is a version of that walk for Python workers.

Defined cases: a null text is an empty one, with no ids; very long pieces take linear time and bypass the piece cache; a null
id stays null; repeated rows each give a row; an empty table gives none; other columns are ignored by :func:`round_trip` and
:func:`token_ids` and carried by the column functions.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.llm.common import kept, small_batches

#: Entries of the caches of a worker, for pieces and for token pairs; they bound its memory, not its results.
PIECES, PAIRS = 150_000, 120_000
#: Longer pieces (characters) are not cached.
LONG_PIECE = 64


class BytePairEncoder:
    def __init__(self, path: str, pattern: str) -> None:
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.pattern = regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.length = [len(t) for t in self.tokens]
        self.ranks = ranks
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = self._prefixes()
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.tokens))]
        self.joined: dict[tuple[int, int], int] = {}
        self.stable: dict[int, bool] = {}  # by both tokens in one number
        self._split_tokens()
        self.pieces = _Pieces(self)

    def _prefixes(self) -> list[int]:
        """For each token the longest other token that starts it, or -1."""
        out = []
        for t in self.tokens:
            n = len(t) - 1
            while n > 0 and t[:n] not in self.ranks:
                n -= 1
            out.append(self.ranks[t[:n]] if n > 0 else -1)
        return out

    def _split_tokens(self) -> None:
        """The two tokens whose merge makes each token, in order of rank; a pair counts only if merging reaches it."""
        for rank, token in enumerate(self.tokens):
            left = self.shorter[rank]
            while left >= 0:
                right = self.ranks.get(token[self.length[left] :])
                if right is not None and left < rank and right < rank and self._compatible(left, right):
                    self.halves[rank] = (left, right)
                    self.joined[left, right] = rank
                    break
                left = self.shorter[left]
        self.stable.clear()

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between the tokens alone: it unmerges both, last merge first, to see if a
        merge over the border would have come earlier."""
        limit, joined, halves = 1 << 62, self.joined, self.halves
        while True:
            over = joined.get((a, b))
            if over is not None and over < limit:
                return False
            if a > b:
                limit, a = a, halves[a][1]
                if a == limit:
                    limit, b = b + 1, halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, halves[b][0]
                if b + 1 == limit:
                    limit, a = a, halves[a][1]
                    if a == limit:
                        return True

    def fits(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        known = self.stable.get(pair)
        if known is None:
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            known = self.stable[pair] = self._compatible(a, b)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        length, shorter, fits = self.length, self.shorter, self.fits
        longest = [0] * len(data)
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            longest[end - length[rank] + 1] = rank  # ends come in order, so the longest comes last
        open_at = bytearray(b"\1") * (len(data) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0 and not (open_at[at + length[token]] and (last < 0 or fits(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at == len(data):
                    return out
                token = longest[at]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= length[token]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Ids of pieces seen lately."""

    def __init__(self, encoder: BytePairEncoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoder.encode_piece(piece), "<u4").tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder for each worker process."""
    return kept(("bpe", path, pattern), lambda: BytePairEncoder(path, pattern))


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    e = encoder(path, pattern)
    for b in batches:
        n, ids_sha, text_sha = [], [], []
        for text in b.column(1).to_pylist():
            ids = e.encode(text)
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes that they decode to, for each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_round_trip, path=path, pattern=pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    e = encoder(path, pattern)
    for b in batches:
        docs = [e.encode(text) for text in b.column(1).to_pylist()]
        n = np.array([len(d) // 4 for d in docs], np.int64)
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.frombuffer(b"".join(docs), "<i4"), pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), ids], names=["doc_id", "n_tokens", "ids"])


def token_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (``array<int>``) of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(partial(_ids, path=path, pattern=pattern), "doc_id long, n_tokens long, ids array<int>")


def encode_column(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with an ``array<int>`` column of ids."""
    small_batches(docs.sparkSession)

    def ids(texts):
        e = encoder(path, pattern)
        return texts.map(lambda t: np.frombuffer(e.encode(t), "<u4").astype(np.int32), na_action=None) if len(texts) else texts

    return docs.withColumn(out, F.pandas_udf(ids, "array<int>")(F.col(text_col)))


def decode_column(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with the text of an ``array<int>`` column; bytes that are no UTF-8 become replacement characters."""

    def text(ids):
        e = encoder(path, pattern)
        return ids.map(lambda x: None if x is None else b"".join(e.tokens[i] for i in x).decode("utf-8", "replace"), na_action=None) if len(ids) else ids

    return tokens.withColumn(out, F.pandas_udf(text, "string")(F.col(ids_col)))
