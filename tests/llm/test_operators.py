"""Operators against brute force, round trips and held-out accuracy."""

import base64
import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlspan.llm import bpe, exact_dedup, html_text, media, mixing, near_dedup, quality, queries, suffix_dedup, token_store, toxicity
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, kept int, size int"
ODD = [None, "", " \n\t", "x", "Hello world, again.", "Hello  world,\nagain.", "é" * 50, "the same text of some words " * 40, "the same text of some words " * 40]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, rows repeated in full, a long text, and columns whose names operators use themselves."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None, 0.5, "r", 1, 2) for i, t in enumerate(ODD)]
    rows += [rows[4], rows[4], (None, "Hello world, again.", "en", "s1", 1, None, None, None, None), (90, "word " * 40000, "en", "s0", 1, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def test_bpe_equals_tiktoken(texts):
    e = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(0x250), 0x2028, 0x3000, 0x4E00, 0x1F600, 0x301, 0xA0, 0x85, 0x660]]
    noise = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(400)] + ["a" * 3000, "ab" * 1500, " " * 500 + "x", "'s'll<|endoftext|>"]
    for t in [*texts.values(), *noise]:
        ids = e.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(t)
        assert e.decode(ids).decode() == t


def test_bpe_columns(odd):
    path = P.path("byte_bpe_50k.tiktoken")
    back = bpe.decode_column(bpe.encode_column(odd, path, P.PATTERN), path, P.PATTERN, out="again")
    assert back.filter("coalesce(text, '') <> again").count() == 0
    assert bpe.round_trip(odd, path, P.PATTERN).count() == odd.count()


def test_exact_groups(odd):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["text_sha256"]].append(r)
    assert all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in by.values())
    same = by[hashlib.sha256(b"Helloworld,again.").hexdigest()]
    assert len(same) == 5 and {r["keep_id"] for r in same} == {5}  # the longest original
    assert {r["keep_id"] for r in by[hashlib.sha256(b"").hexdigest()]} == {2}
    assert exact_dedup.drop_copies(odd).count() == len(by) and exact_dedup.drop_copies(odd).columns == odd.columns


def test_exact_oracle(spark, docs):
    duckdb.sql(f"create or replace view documents as select * from '{DATA}/documents.parquet'")
    want = duckdb.sql(queries.ORACLES["op9_exact_dedup"]).fetchall()
    got = queries.op9_exact_dedup(spark, DATA).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def brute_components(texts, width, percent):
    ids = sorted(texts)
    sets = {}
    for i in ids:
        w = texts[i].encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(docs, texts, width, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.NearDedup(width, percent).groups(docs).collect()}
    assert got == brute_components(texts, width, percent)


def test_near_dedup_chains_and_families(spark):
    """A chain of small changes is one component; a family that only shares most words stays apart."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows, cur = {}, base[:]
    for i in range(12):
        rows[i] = " ".join(cur)
        cur = [*cur[:-6], *(f"n{i}_{k}" for k in range(6))] if i % 2 else [*(f"m{i}_{k}" for k in range(6)), *cur[6:]]
    for i in range(100, 140):
        rows[i] = " ".join([*base[:160], *(f"own{i}_{k}" for k in range(20))])
    for i in range(200, 230):
        w = [f"z{k}" for k in range(150)]
        w[rng.randrange(150)] = f"q{i}"
        rows[i] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.NearDedup(3, 85).groups(df).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_dedup_odd_rows(odd):
    got = near_dedup.NearDedup().groups(odd).collect()
    assert len(got) == odd.count()
    of = {r["doc_id"]: r for r in got}
    assert of[None]["kept"] and of[None]["component_id"] is None
    assert (of[0]["n_shingles"], of[0]["component_id"]) == (0, 0) and of[8]["component_id"] == 7 and not of[8]["kept"] and of[5]["component_id"] == 4
    assert near_dedup.NearDedup().drop_near_copies(odd).columns == odd.columns


def test_mix_targets():
    t = mixing.targets([("a", 100), ("b", 10), ("c", 100), (None, 90)])
    assert t["b"] == 30 and abs(sum(t.values()) - 300) < 1e-9 and t["c"] > t["a"]
    assert abs(t["a"] - 270 / 5) < 1e-9 and abs(t[None] - 270 / 5) < 1e-9


def near_targets(rows):
    """Each source within 1 % of its target, or within half its smallest document that may be taken once more."""
    total, goal, small = collections.Counter(), {}, {}
    for r in rows:
        total[r["src"]] += r["taken"]
        goal[r["src"]] = r["target"]
        if r["size"]:
            small[r["src"]] = min(r["size"], small.get(r["src"], r["size"]))
    return all(abs(total[s] - goal[s]) <= max(0.01 * goal[s], small.get(s, 0) / 2) for s in goal)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mix_comes_near_its_targets(spark, sf):
    assert near_targets(mixing.mix(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect())


def test_mix_of_rows_alike(spark, monkeypatch):
    """Rows alike in id and size fly in many blocks; rows without id in two sources."""
    monkeypatch.setattr(mixing, "ALIKE", 100)
    seen = []
    fly = mixing._flyer
    monkeypatch.setattr(mixing, "_flyer", lambda seed, level, land=False: (seen.append(level), fly(seed, level, land))[1])
    df = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("some words of text").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    numbered = mixing._numbered(df.select("doc_id", "source", F.lit(4).cast("long").alias("size")))
    at = numbered.select("source", F.xxhash64(F.lit(17), "doc_id", "size", "nth").alias("at"))
    sizes = [r["count"] for r in at.groupBy("source", F.pmod(F.xxhash64("at", F.lit(0)), F.lit(4)).alias("block")).count().collect()]
    assert numbered.count() == 9000 and len(sizes) == 8 and max(sizes) < 1800
    got = mixing.mix(df).collect()
    assert len(got) == 9000 and near_targets(got) and seen


def test_settling_a_landing():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 14, 15, 60, 400):
        size, x = rng.integers(1, 500, n).astype(float), rng.integers(0, 2, n).astype(float)
        out = mixing.settle_rest(x, size, 123.4)
        assert set(out) <= {0.0, 1.0}
        off = abs(out @ size - (x @ size - 123.4))
        assert off <= 123.4 and (n < 60 or off <= 0.5)
        if n == 14:
            assert off == min(abs(np.array(w) @ size - (x @ size - 123.4)) for w in itertools.product((0, 1), repeat=14))


def test_mix_sql(spark):
    """Sizes, targets and limits against SQL, and what is taken against the targets."""
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, source,
        sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY source)::BIGINT AS source_size FROM documents""").fetchall()
    sizes = {source: n for _, _, source, n in want}
    goal = mixing.targets(list(sizes.items()))
    got = {r["doc_id"]: r for r in queries.op8_mixing(spark, DATA).collect()}
    assert {(i, got[i]["size"], got[i]["source_size"]) for i in got} == {(i, size, n) for i, size, _, n in want}
    assert all(abs(got[i]["target"] - goal[s]) < 1e-6 and got[i]["taken"] <= 3 * size for i, size, s, _ in want)


def test_mix(odd, docs):
    got = mixing.mix(docs).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert {r["doc_id"]: r["taken"] for r in got} == again and len(got) == docs.count()
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)
    assert near_targets(got)
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.apply_mix(docs).count() == sum(r["copies"] for r in got) and mixing.apply_mix(odd).columns == odd.columns


def test_flight_balances():
    rng = np.random.default_rng(2)
    size, p = rng.integers(1, 1000, 2000).astype(float), np.full(2000, 0.37)
    out = mixing.flight(p, size, rng, land=True)
    assert set(out) <= {0.0, 1.0}
    assert abs(out.sum() - p.sum()) <= 2 and abs((out * size).sum() - (p * size).sum()) <= 1000


def test_toxicity(spark, docs, labels):
    model = toxicity.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    scored = toxicity.with_score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), model).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    held = scored.filter("crc32(cast(doc_id as string)) % 5 = 0").select(((F.col("score") >= 0.5) == (F.col("toxic") == 1)).cast("int").alias("right")).agg(F.avg("right")).first()[0]
    assert held >= 0.9
    found = toxicity.locate(docs, model).collect()
    assert all(r["p"] >= 0.5 and r["sentence_text"] for r in found)


def test_toxicity_odd_rows(spark, odd, labels):
    assert [r["score"] for r in toxicity.with_score(odd.filter("coalesce(trim(text), '') = ''"), {"": -4.0, "x": 1.0}).collect()][:1] == [0.0]
    assert toxicity.fit(odd.limit(0), labels) == {"": -40.0} and toxicity.fit(odd, labels.limit(0)) == {"": -40.0}
    w = toxicity.Words({"": -4.0, "vile": 9.0})
    assert toxicity.score_text("All fine. You vile, thing! Good.", w) > 0.9 > 0.5 > toxicity.score_text("All fine. Good.", w)
    assert [toxicity.sentences("A b. C!\n d")[i] for i in range(3)] == [(0, 3), (4, 6), (8, 10)]


@pytest.mark.parametrize("long", ["first", "toxic"])
def test_toxicity_with_long_documents(spark, monkeypatch, long):
    """One document longer than the whole sample, first in its order, or long toxic documents only: the model stays."""
    monkeypatch.setattr(toxicity, "MOST_CHARS", 60_000)
    monkeypatch.setattr(toxicity, "LONGEST", 2_000, raising=False)
    ids = [r[0] for r in spark.range(100).filter(~toxicity.held_out("id")).orderBy(F.xxhash64("id")).collect()]
    rng = random.Random(1)
    text = lambda bad: ". ".join([" ".join(rng.choices(("mild", "sunny", "calm", "green", "early"), k=6)), *["you vile wretch"] * bad, "quiet days"])
    rows = [(i, text(k % 2), k % 2) for k, i in enumerate(ids)]
    if long == "first":
        rows[0] = (ids[0], text(0) + " calm" * 20_000, 0)
    else:
        rows = [(i, t + " calm" * 20_000 * y, y) for i, t, y in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    words = toxicity.Words(toxicity.fit(df.drop("toxic"), df.drop("text")))
    assert toxicity.score_text(text(1), words) > 0.5 > toxicity.score_text(text(0), words)


def test_toxicity_without_spaces(spark):
    """A phrase inside runs of letters without spaces is learned, found and located."""
    rng = random.Random(4)
    run = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(n))
    text = lambda bad: "。".join([run(12), run(rng.randrange(4, 9)) + ("\u6bd2\u8fa3\u8bdd" if bad else run(3)) + run(6), run(9)])
    weights = toxicity.fit_texts([text(k % 2) for k in range(200)], [k % 2 for k in range(200)])
    words = toxicity.Words(weights)
    new = [(text(k % 2), k % 2) for k in range(40)]
    assert all((toxicity.score_text(t, words) > 0.5) == bool(y) for t, y in new)
    found = toxicity.locate(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(new)], "doc_id long, text string"), weights).collect()
    assert {(r["doc_id"], r["sentence"]) for r in found} == {(k, 1) for k, (_, y) in enumerate(new) if y}


def brute_repeats(texts):
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    own = collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            own[tuple(w[k : k + 50])].add(i)
    cover = {i: set() for i in words}
    for i, w in words.items():
        for k in range(len(w) - 49):
            if len(own[tuple(w[k : k + 50])]) > 1:
                cover[i].update(range(k, k + 50))
    return cover


def test_repeated_passages(docs, texts, odd):
    got = {i: set() for i in texts}
    for r in suffix_dedup.repeated_passages(docs).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        assert r["n_words"] >= 50 and r["other_doc_id"] != r["doc_id"]
    assert got == brute_repeats(texts)
    assert {r["doc_id"] for r in suffix_dedup.repeated_passages(odd).collect()} == {7, 8}


def test_sorted_entries_across_ranges():
    """Entries of a hash that fill several ranges and batches, of one document or of many, against a plain count."""
    rng = random.Random(11)
    for trial in range(200):
        rows = sorted((rng.choice([1, 1, 1, 2, 3, 4, 5, 6]), rng.randrange(rng.choice([1, 2, 4])), k, 10 * k) for k in range(rng.randrange(1, 40)))
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(trial % 6))})
        told = []
        for a, b in zip(cuts, cuts[1:]):
            part, batches, at = rows[a:b], [], 0
            while at < len(part):
                n = rng.randrange(1, 9)
                h, d, k, s = zip(*part[at : at + n])
                batches.append(pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int32())], names=["hash", "doc", "at", "start"]))
                at += n
            told += [tuple(r.values()) for x in suffix_dedup._same(iter(batches)) for r in x.to_pylist()]
        docs, got = collections.defaultdict(set), set()
        for kind, h, *_, low, high in told:
            if kind == 2:
                docs[h] |= {low, high}
        for kind, h, doc, k, s, low, high in told:
            if kind == 0:
                assert low != high and doc in range(low, high + 1)
            if kind == 0 or kind == 1 and len(docs[h]) > 1:
                got.add((doc, k, s))
        many = collections.defaultdict(set)
        for h, d, _, _ in rows:
            many[h].add(d)
        assert got == {(d, k, s) for h, d, k, s in rows if len(many[h]) > 1}


@pytest.mark.parametrize("parts", ["9", "61"])
def test_repeated_passages_between_look_alikes(spark, parts):
    """Two documents share L+X+R; many others share only L+X or X+R with them, and sort in between."""
    rng = random.Random(7)
    fresh = iter(range(10**9))
    own = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    rows = []
    for left, middle, right in [(10, 35, 10), (12, 30, 13), (15, 30, 15)] * 8:
        l, x, r = own(left), own(middle), own(right)  # noqa: E741
        bodies = [l + x + r] * 2 + [l + x, x + r] * 10
        rows += [" ".join(own(30) + b + own(30)) for b in bodies]
    rng.shuffle(rows)
    texts = dict(enumerate(rows))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {i: set() for i in texts}
        for row in suffix_dedup.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
            got[row["doc_id"]].update(range(row["start_word"], row["end_word"]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = brute_repeats(texts)
    assert sum(map(bool, want.values())) == 48 and got == want


@pytest.mark.parametrize("kind", ["plain", "green", "predict", "cross", "palette", "cache", "copies"])
def test_webp_decoder(kind):
    """Streams with each feature, made by a small writer of its own."""
    rng = np.random.default_rng(len(kind))
    h, w = 13, 21
    px = rng.integers(0, 256, (h, w, 4), np.uint8)
    if kind == "palette":
        px = px[rng.integers(0, 2, (h, w)), rng.integers(0, 6, (h, w))]
    bits = media.BitWriter()
    bits.put(0x2F | (w - 1) << 8 | (h - 1) << 22, 36)
    bits.put(1, 1)
    bits.put(0, 3)
    flat = np.full(256, 8, np.uint8)

    def single(value):
        bits.put(0b101 | value << 3, 11)

    def image(argb, size=256, cache=0, symbols=None):
        """All literals under flat codes, or given (symbol, red, blue, alpha) rows."""
        bits.put(cache and 1 | cache << 1, 5 if cache else 1)
        if symbols is None:
            symbols = [((int(x) >> 8) & 255, (int(x) >> 16) & 255, int(x) & 255, int(x) >> 24) for x in argb.ravel()]
        n = 280 + (1 << cache if cache else 0)
        used = sorted({s[0] for s in symbols})
        weights = [0.0] * n
        for s in used + [s for s in range(256) if s not in used][: max(0, 2 - len(used))]:
            weights[s] = 1.0
        green = media.huffman_lengths(weights)
        return n, green, symbols

    def emit(argb, cache=0, symbols=None, main=False):
        n, green, symbols = image(argb, cache=cache, symbols=symbols)
        if main:
            bits.put(0, 1)
        media._put_code(bits, green)
        for _ in range(3):
            media._put_code(bits, flat)
        single(1)
        code, fc = media._codes(green), media._codes(flat)
        for s in symbols:
            bits.put(int(code[s[0]]), int(green[s[0]]))
            for v in s[1:] if s[0] < 256 else ():
                bits.put(int(fc[v]), 8)
            if 256 <= s[0] < 280 and s[0] >= 260:
                bits.put(s[1], (s[0] - 258) >> 1)

    argb = np.ascontiguousarray(px[..., [2, 1, 0, 3]]).view("<u4").reshape(h, w)
    ch = lambda x: np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(*x.shape, 4).astype(int)
    pack = lambda c: np.ascontiguousarray((c & 255).astype(np.uint8)).view("<u4").reshape(c.shape[:-1])
    if kind == "green":
        bits.put(0b101, 3)
        c = ch(argb)
        c[..., 0] -= c[..., 1]
        c[..., 2] -= c[..., 1]
        bits.put(0, 1)
        emit(pack(c), main=True)
    elif kind == "predict":
        bits.put(0b001, 3)
        bits.put(0, 3)  # blocks of 4
        modes = rng.integers(0, 14, ((h + 3) // 4, (w + 3) // 4))
        emit((modes.astype(np.uint32) << 8))
        c, out = ch(argb), np.zeros((h, w, 4), int)
        for y in range(h):
            for x in range(w):
                if x == y == 0:
                    p = [0, 0, 0, 255]
                elif y == 0:
                    p = c[0, x - 1].tolist()
                elif x == 0:
                    p = c[y - 1, 0].tolist()
                else:
                    right = c[y - 1, x + 1] if x + 1 < w else c[y, 0]
                    p = media._predicted(int(modes[y // 4, x // 4]), c[y, x - 1].tolist(), c[y - 1, x].tolist(), c[y - 1, x - 1].tolist(), right.tolist())
                out[y, x] = c[y, x] - np.array(p)
        bits.put(0, 1)
        emit(pack(out), main=True)
    elif kind == "cross":
        bits.put(0b011, 3)
        bits.put(0, 3)
        t = rng.integers(0, 256, ((h + 3) // 4, (w + 3) // 4, 4))
        emit(pack(t))
        c = ch(argb)
        sign = lambda v: (v + 128) % 256 - 128
        for y in range(h):
            for x in range(w):
                b = t[y // 4, x // 4]
                green, red = sign(c[y, x, 1]), sign(c[y, x, 2])
                c[y, x, 2] -= (sign(b[0]) * green) >> 5
                c[y, x, 0] -= ((sign(b[1]) * green) >> 5) + ((sign(b[2]) * red) >> 5)
        bits.put(0, 1)
        emit(pack(c), main=True)
    elif kind == "palette":
        colours, index = np.unique(argb, return_inverse=True)
        index = index.reshape(h, w)
        bits.put(0b111, 3)
        bits.put(len(colours) - 1, 8)
        c = ch(colours)
        c[1:] -= c[:-1].copy()
        emit(pack(c))
        per, size = (2, 4) if 4 < len(colours) <= 16 else (4, 2) if 2 < len(colours) <= 4 else (8, 1)
        wide = np.zeros((h, -(-w // per) * per), int)
        wide[:, :w] = index
        packed = sum(wide[:, k::per] << (size * k) for k in range(per))
        bits.put(0, 1)
        emit(packed.astype(np.uint32) << 8, main=True)
    elif kind == "cache":
        argb[3:6] = argb[0:3]
        px[3:6] = px[0:3]
        symbols, cache = [], [0] * 1024
        for x in map(int, argb.ravel()):
            k = (x * media.CACHE_HASH & 0xFFFFFFFF) >> 22
            symbols.append((280 + k,) if cache[k] == x else ((x >> 8) & 255, (x >> 16) & 255, x & 255, x >> 24))
            cache[k] = x
        assert any(len(s) == 1 for s in symbols)
        bits.put(0, 1)
        emit(None, cache=10, symbols=symbols, main=True)
    elif kind == "copies":
        argb[5:9], px[5:9] = argb[4, 20], px[4, 20]
        symbols = [((int(x) >> 8) & 255, (int(x) >> 16) & 255, int(x) & 255, int(x) >> 24) for x in argb.ravel()]
        symbols[5 * w : 9 * w] = [(256 + 12, 84 - 65)]  # 84 pixels back-referenced
        bits.put(0, 1)
        emit(None, symbols=symbols, main=True)
    else:
        bits.put(0, 1)
        emit(argb, main=True)
    stream = bits.bytes()
    data = b"RIFF" + (12 + len(stream)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    got, _ = media.read_webp(data)
    assert got.shape == px.shape and (got == px).all()
    with pytest.raises(ValueError):
        media.read_webp(data[: len(data) // 2])


def test_media(odd, texts):
    for t in [*texts.values(), *ODD, "ab" * 40000]:
        n, payload = media.payload_of(t)
        assert len(payload) % 576 == 0 and len(payload) > 0 and media.from_image(media.to_image(payload))[1] == payload
    rows = media.store_and_read(odd).collect()
    assert len(rows) == odd.count()
    for r, t in zip(sorted((r for r in rows if r["doc_id"] in range(9)), key=lambda r: r["doc_id"]), [ODD[i] for i in [0, 1, 2, 3, 4, 4, 4, 5, 6, 7, 8]], strict=True):
        n, payload = media.payload_of(t)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_token_store(spark, docs, odd, texts):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    store = token_store.write_store(docs, path, 2)
    want, at = {}, 0
    for i in sorted(texts):
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_digests(spark, store).collect()}
    assert got == {i: x[:3] for i, x in want.items()}
    assert {r["doc_id"]: list(r["ids"]) for r in token_store.read_documents(spark, store).collect()} == {i: x[3] for i, x in want.items()}
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("sha").distinct().count()
    odd_store = token_store.write_store(odd, path, 2)
    assert token_store.read_digests(spark, odd_store).count() == odd.count()


def test_damaged_store(spark, docs, tmp_path):
    store = token_store.write_store(docs.limit(20), P.path("word_bpe_49k.json"), 2, f"{tmp_path}/a")
    bad = spark.read.parquet(f"{store}/chunks").withColumn("data", F.concat("data", F.lit(b"\0\0")))
    bad.write.parquet(f"{tmp_path}/b/chunks")
    for part in ("recipes", "manifest"):
        (tmp_path / "b" / part).symlink_to(tmp_path / "a" / part)
    with pytest.raises(Exception, match="damaged"):
        token_store.read_digests(spark, f"{tmp_path}/b").collect()


def test_html(spark):
    rows = queries.op6_html_text(spark, DATA).collect()
    assert len(rows) == 50
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    weights, pair = html_text.fit(pages)
    x = '<div id="page"><div class="sidebar">Side stuff.</div><div class="post-content"><h2>Title &amp; more</h2><p>A long paragraph, with words. And\n many more words here to read, so it is long enough to be prose.</p><div class="comments"><p>Nice post, thanks. Really nice, I liked it a lot.</p></div></div><form><p>Name</p></form></div>'
    assert html_text.extract(x, weights, pair).split("\n") == ["Title & more", "A long paragraph, with words. And many more words here to read, so it is long enough to be prose."]
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p>a<b"), (3, "u", "<main>x<script>y</script><p>z")], "page_id long, url string, html string")
    assert [r["text"] for r in html_text.extract_pages(odd, weights, pair).collect()] == ["", "", "a", "x\nz"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t</title><body><p>early</p><article><header><h1>late</h1></header><p>end</article>", "early late end"),
        ("<head><title>t</title></HEAD ><p>a</p><header>b</header>", "a b"),
        ("<p>\u0130<SCRIPT>x()</SCRIPT><p>a<style>y</style><p>b<script>z</script><p>c", "\u0130 a b c"),
        ("<p>\u0130<noscript>n<p>a<script>x</script><p>b<style>y</STYLE><p>c<script>cut", "\u0130 n a b c"),
    ],
)
def test_skipping_ends_at_the_own_end_tag(page, want):
    assert " ".join(t for _, t in html_text.Dom(page).pieces if t.strip()) == want


def test_marginals_are_exact():
    import itertools
    import math

    parent, unary, (s1, s0) = [-1, 0, 0, 1, 1], [0.3, -1.0, 0.7, 2.0, -0.4], (0.9, 0.8)
    mass = np.zeros((5, 2))
    for y in itertools.product((0, 1), repeat=5):
        p = math.exp(sum(u * v for u, v in zip(unary, y, strict=True)))
        for i in range(1, 5):
            p *= (s1 if y[i] else 1 - s1) if y[parent[i]] else (1 - s0 if y[i] else s0)
        for i in range(5):
            mass[i, y[i]] += p
    assert np.allclose(html_text.marginals(parent, unary, (s1, s0)), mass[:, 1] / mass.sum(axis=1))


def test_quality(spark, odd):
    d = "/root/testdata/sf0.01"
    got = queries.op10_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.95
    assert quality.score(odd, [0.0] * 13, F.col("source"), F.col("lang")).count() == odd.count()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"pipeline", "op6_html_text"}))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "embeddings", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    df = queries.QUERIES[name](spark, str(tmp_path))
    assert df.collect() == [] and df.columns


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DATA).cache()
        assert kept.columns == docs.columns
        if name == "near_dedup":
            rows = {r[0]: r[1] for r in before.select("doc_id", "text").collect()}
            assert {r[0] for r in kept.select("doc_id").collect()} == {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
    want = collections.Counter(r[0] for r in kept.select("doc_id").collect())
    out = cp.run(spark, DATA).collect()
    assert collections.Counter(r["doc_id"] for r in out) == want and all(r["n_tokens"] == len(r["ids"]) for r in out)
