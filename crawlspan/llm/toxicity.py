"""Toxicity by multiple-instance learning: labels are of documents, scores are of sentences.

A sentence's probability is a logistic function of its words; a document's is their noisy-or,
``1 - prod(1 - p_sentence)``, so one bad sentence is enough and many harmless ones are not. Only document labels train
the word weights: the noisy-or passes the gradient of a toxic document mostly to its worst sentences. The same model then
says which sentences offend: one splitter serves training, scoring and locating. Words of a sentence are its lower-cased, white-space separated runs without punctuation at the ends. A word's evidence is
the sum of the weights of the word itself and of its beginnings, so that forms not seen in training share what their
relatives taught. Runs of letters of scripts without spaces give their pairs and triples as words. Training uses a bounded,
hash-ordered sample of labelled documents (MOST_DOCS of each label, half of MOST_CHARS for each) in one task; it is drawn on
ids and lengths. Documents of more than LONGEST characters come last in it, with their beginnings, so that no single text
uses up the sample. Scoring is one pass over the documents.

Defined cases: a null or empty text has no sentence and scores 0; null labels and labels of unknown documents are ignored;
a document with several labels counts as toxic if one says so; without labels of both kinds all scores are 0; rows
repeated in full are scored each; a column named like a result is replaced by it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlspan.llm.common import Steps, held_out, kept, small_batches, trim

#: The bound of the training sample: documents of each label, and characters in all.
MOST_DOCS, MOST_CHARS = 2500, 20_000_000
#: Characters up to which a document of the sample is whole.
LONGEST = 500_000
#: Documents of the sample in which a word must occur to get a weight.
MIN_DOCS = 3
#: Steps of the fit, the l1 penalty on word weights, the starting bias of a sentence.
STEPS, L1, BIAS = 120, 1e-4, -5.0
#: Weight of all toxic documents together against all others; lengths of word beginnings; cached words of a worker.
POSITIVE, PREFIXES, WORDS = 0.3, (5, 7, 4, 6), 150_000
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_=+~`/\\…“”‘’«»¡¿"
#: What ends a sentence, besides the full stop.
STOPS = "!?\n\u3002\uff01\uff1f"

#: Letters of Thai, Lao, Tibetan, Myanmar, Khmer, kana and Han.
_RUN = re.compile("[\u0e00-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17d3\u3005-\u3007\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{2,}")


def _grams(run: re.Match) -> str:
    s = run[0]
    return " ".join(["", *(s[k : k + 2] for k in range(len(s) - 1)), *(s[k : k + 3] for k in range(len(s) - 2)), ""])


def stretches(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of the stretches between sentence ends, by code points; one without words is no sentence. The
    words are lower-cased; runs without spaces are replaced by their pairs and triples of letters."""
    text = text or ""
    unspaced = not text.isascii() and _RUN.search(text)
    for c in STOPS:
        text = text.replace(c, ".")
    at = 0
    for part in text.split("."):
        low = part.lower()
        yield at, at + len(part), (_RUN.sub(_grams, low) if unspaced else low).split()
        at += len(part) + 1


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, by code points."""
    return [(start, end) for start, end, words in stretches(text) if words]


def _bags(text: str | None) -> list[set[str]]:
    out = []
    for _, _, words in stretches(text):
        bag = {w.strip(EDGES) for w in words}
        bag.discard("")
        if bag:
            out.append(bag)
    return out


def features(word: str) -> list[str]:
    """The word, and its beginnings with and without the word's length."""
    n = len(word)
    return [word, *(f"{word[:k]}*" for k in PREFIXES if n > k), *(f"{word[:k]}/{n}" for k in PREFIXES[:2] if n > k)]


def _coded(texts: list[str]) -> tuple[list[list[np.ndarray]], list[str]]:
    """Texts as lists of sentences of word numbers, and the words."""
    words: dict[str, int] = {}
    docs = [[np.array([words.setdefault(w, len(words)) for w in sorted(bag)], np.int32) for bag in _bags(t)] for t in texts]
    return docs, list(words)


def _vocabulary(docs: list[list[np.ndarray]], words: list[str]) -> tuple[np.ndarray, list[str]]:
    """Feature numbers of each word (-1: none) and the features that MIN_DOCS documents have."""
    width = 1 + len(PREFIXES) + 2
    hashes = np.zeros((len(words), width), np.uint64)
    for i, w in enumerate(words):
        h = [xxhash.xxh3_64_intdigest(f) | 1 for f in features(w)]
        hashes[i, : len(h)] = h
    values, ids = np.unique(hashes, return_inverse=True)
    ids = ids.reshape(hashes.shape).astype(np.int32)
    seen = np.zeros(len(values), np.int64)
    for d in docs:
        seen[np.unique(ids[np.unique(np.concatenate(d))])] += 1
    keep = (seen >= MIN_DOCS) & (values != 0)
    new = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)
    names = [""] * int(keep.sum())
    ids = new[ids]
    for i, w in enumerate(words):
        for k, f in zip(ids[i].tolist(), features(w), strict=False):
            if k >= 0:
                names[k] = f
    return ids, names


def fit_texts(texts: list[str], labels: list[int]) -> dict[str, float]:
    """Weights of features, and of "" for the bias, by proximal Adagrad on the noisy-or likelihood."""
    coded, words = _coded(texts)
    y = np.array([bool(t) for d, t in zip(coded, labels, strict=True) if d], bool)
    coded = [d for d in coded if d]
    if not coded or y.all() or not y.any():
        return {"": -40.0}
    ids, names = _vocabulary(coded, words)
    share = np.where(y, POSITIVE * len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum())) / len(y)
    blocks = []
    for k in range(0, len(coded), 200):  # the gradient adds up block by block, in little memory
        part = coded[k : k + 200]
        rows = [np.append((f := ids[s].ravel())[f >= 0], np.int32(len(names))) for d in part for s in d]  # the last is the bias
        sizes = np.array([len(r) for r in rows])
        per_doc = np.array([len(d) for d in part])
        blocks.append((np.concatenate(rows), np.cumsum(np.r_[0, sizes[:-1]]), sizes, np.cumsum(np.r_[0, per_doc[:-1]]), np.repeat(np.arange(len(part)), per_doc), y[k : k + 200], share[k : k + 200]))
    del coded
    w = np.zeros(len(names) + 1)
    w[-1] = BIAS
    power, rate = np.full(len(w), 1e-8), 0.5
    for _ in range(STEPS):
        g = np.zeros(len(w))
        for flat, starts, sizes, doc_at, doc_of, yes, weight in blocks:
            z = np.add.reduceat(w[flat], starts)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            total = np.add.reduceat(np.logaddexp(0, z), doc_at)
            pull = weight * np.where(yes, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), 1.0)
            g += np.bincount(flat, np.repeat(p * pull[doc_of], sizes), len(w))
        power += g * g
        step = rate / np.sqrt(power)
        w -= step * g
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step[:-1] * L1, 0)
    return {f: float(x) for f, x in zip(names, w, strict=False) if x} | {"": float(w[-1])}


def _fit(bag: pa.Table) -> pa.Table:
    kept("nothing", int)
    rows = sorted(zip(bag["at"].to_pylist(), bag["text"].to_pylist(), bag["y"].to_pylist(), strict=True))
    weights = fit_texts([r[1] for r in rows], [r[2] for r in rows])
    del rows
    trim()
    return pa.table({"word": list(weights), "weight": list(weights.values())})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, float]:
    """Trains on labelled documents outside the held-out fold. The weights are bounded by the sample's vocabulary."""
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).dropna().filter(~held_out("i")).groupBy("i").agg(F.max("y").alias("y"))
    known = known.withColumn("at", F.xxhash64("i"))
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sized = texts.select("i", F.xxhash64("text").alias("key"), F.char_length("text").alias("chars"))
    step = Steps()
    sized = step(sized.join(known, "i").distinct().select("i", "key", "at", (F.col("y") > 0).cast("int").alias("y"), (F.col("chars") > LONGEST).alias("long"), F.least("chars", F.lit(LONGEST)).alias("chars")))
    order = ("long", "at", "i", "key")
    drawn = sized.filter("y = 1").orderBy(*order).limit(MOST_DOCS).unionByName(sized.filter("y = 0").orderBy(*order).limit(MOST_DOCS))
    drawn = drawn.withColumn("used", F.sum("chars").over(Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") <= MOST_CHARS // 2)
    sample = texts.withColumn("key", F.xxhash64("text")).join(F.broadcast(drawn.select("i", "key", "at", "y")), ["i", "key"])  # 2 * MOST_DOCS ids at most
    bag = sample.select("i", "key", "at", "y", F.substring("text", 1, LONGEST).alias("text")).dropDuplicates(["i", "key"]).select("at", "text", "y", F.lit(0).alias("one"))
    rows = bag.groupBy("one").applyInArrow(_fit, "word string, weight double").collect()
    step.free()
    return {r["word"]: r["weight"] for r in rows} or {"": -40.0}


class Words(dict):
    """The evidence of words seen lately."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights, self.bias = weights, weights.get("", 0.0)

    def __missing__(self, word: str) -> float:
        if len(self) >= WORDS:
            self.clear()
        bare = word.strip(EDGES)
        self[word] = x = sum(self.weights.get(f, 0.0) for f in features(bare)) if bare else 0.0
        return x


def judge(text: str | None, words: Words) -> tuple[float, int, int | None, int | None]:
    """The noisy-or over the sentences of a text, how many of them have a probability of one half or more, and where the
    worst of these stands."""
    get, bias, total, offending, worst, start, end = words.__getitem__, words.bias, 0.0, 0, 0.0, None, None
    plain = math.log1p(math.exp(min(bias, 700)))
    for i, j, bag in stretches(text):
        if bag:
            z = sum(map(get, set(bag)))
            total += plain if not z else math.log1p(math.exp(min(bias + z, 700)))
            if bias + z >= 0:
                offending += 1
                if start is None or bias + z > worst:
                    worst, start, end = bias + z, i, j
    return min(1.0, max(0.0, -math.expm1(-total))), offending, start, end


def score_text(text: str | None, words: Words) -> float:
    return judge(text, words)[0]


def _words(weights) -> Words:
    """The words of a broadcast model."""
    model = weights.value
    return kept(("toxicity", id(model)), lambda: Words(model))


def verdict(spark: SparkSession, weights: dict[str, float], text: F.Column) -> F.Column:
    """A struct of ``score`` (the probability that the text is toxic), ``offending`` (sentences of one half or more),
    ``worst_start`` and ``worst_end`` (code points of the worst of these, or null)."""
    small_batches(spark)
    model = spark.sparkContext.broadcast(weights)

    def look(texts: pa.Array) -> pa.Array:
        w = _words(model)
        cols = list(zip(*(judge(t, w) for t in texts.to_pylist()), strict=True)) or [()] * 4
        kinds = [pa.float64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["score", "offending", "worst_start", "worst_end"])

    return F.arrow_udf(look, "score double, offending int, worst_start int, worst_end int")(text.cast("string"))


def with_score(docs: DataFrame, weights: dict[str, float], text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is toxic."""
    return docs.withColumn(out, verdict(docs.sparkSession, weights, F.col(f"`{text_col}`"))["score"])


def reject(docs: DataFrame, weights: dict[str, float], text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score less than ``least``; all columns stay, whatever their names."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), verdict(docs.sparkSession, weights, F.col(f"`{text_col}`")).alias("verdict"))
    return rows.filter(F.col("verdict.score") < least).select("row.*")


def _located(batches: Iterator[pa.RecordBatch], weights, least: float) -> Iterator[pa.RecordBatch]:
    w = _words(weights)
    for b in batches:
        out: list[tuple] = []
        for i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            k = 0
            for start, end, words in stretches(text):
                if words:
                    p = 1 / (1 + math.exp(-max(-700.0, w.bias + sum(map(w.__getitem__, set(words))))))
                    if p >= least:
                        out.append((i, k, start, end, p, text[start:end].strip()))
                    k += 1
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "sentence", "start", "end", "p", "sentence_text"])


def locate(docs: DataFrame, weights: dict[str, float], least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The offending sentences: one row for each with a probability of ``least`` or more."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_located, weights=spark.sparkContext.broadcast(weights), least=least), "doc_id long, sentence int, start int, end int, p double, sentence_text string")
