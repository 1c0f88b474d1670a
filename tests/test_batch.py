"""The batch of model calls against a loop over the pages, one after the other, and jobs that stop half way."""

import os
import random

import pytest

from crawlspan.operators.analysis import STOP_SHARE, TYPES
from crawlspan.plans import batch as ba

SCHEMA = "crawl_id string, page_id long, url string, title string, meta_desc string, body_text string"
KINDS = ("title_tag", "nonsense", "meta_desc")


def make_pages(n=24, seed=1):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices("alpha beta gamma delta BAD FAIL epsilon".split(), k=rng.randrange(1, 40))) for _ in range(n // 2)]
    return [("c", 3 * i + 1, f"https://t/{i}", None if i % 5 == 0 else f"Title {i}", None, rng.choice(texts)) for i in range(n)]


def answer(system, user, most, temperature):
    """A model whose answers follow from the text; some are no JSON, some calls fail. Calls are logged where the test says."""
    body = user.split("\n\n", 1)[1]
    words = body.split()
    if log := os.environ.get("CRAWLSPAN_TEST_CALLS"):
        with open(log, "a") as f:
            f.write(f"{most} {body}\n")
    if words[0] == "FAIL" and most == TYPES["meta_desc"][0]:
        raise RuntimeError("provider")
    text = "oops" if words[0] == "BAD" else f'{{"n": {len(words)}}}'
    return text, len(words), min(most, 3), "stub", 1


def loop(pages, kinds, budget, rates):
    """The same page by page."""
    cache, used, out = {}, 0, {"pages": 0, "input_tokens": 0, "output_tokens": 0, "errors": 0}
    exhausted = False
    for _, page, url, title, _, body in sorted(pages, key=lambda p: p[1]):
        if used >= STOP_SHARE * budget:
            exhausted = True
            break
        got = []
        try:
            for kind in kinds:
                if kind not in TYPES:
                    continue
                if (body, kind) not in cache:
                    text, n_in, n_out, *_ = answer("", f"x\n\n{body}", TYPES[kind][0], 0)
                    if text == "oops":
                        continue
                    cache[body, kind] = n_in, n_out
                got.append(cache[body, kind])
            for a, b in got:
                out["input_tokens"] += a
                out["output_tokens"] += b
                used += a + b
        except RuntimeError:
            out["errors"] += 1
        out["pages"] += 1
    cost = (out["input_tokens"] * rates[0] + out["output_tokens"] * rates[1]) / 1000
    return out | {"exhausted": exhausted, "cost_usd": cost}, {(k, b) for b, k in cache}


@pytest.fixture()
def calls(tmp_path, monkeypatch):
    path = f"{tmp_path}/calls"
    monkeypatch.setenv("CRAWLSPAN_TEST_CALLS", path)
    return path


def check(got, want):
    got = got.first().asDict()
    assert {k: got[k] for k in want if k != "cost_usd"} == {k: v for k, v in want.items() if k != "cost_usd"} and abs(got["cost_usd"] - want["cost_usd"]) < 1e-9


@pytest.mark.parametrize(("budget", "token_bytes"), [(400, 1.0), (400, 50.0), (10**7, 1.0)])
def test_sums_equal_the_loop(spark, tmp_path, budget, token_bytes):
    pages = make_pages()
    job = ba.Batch(KINDS, budget, f"file://{tmp_path}/job", rates=(0.5, 2.0), most=12, token_bytes=token_bytes, ranges=2)
    want, asked = loop(pages, KINDS, budget, job.rates)
    check(ba.analyse_batch(spark.createDataFrame(pages, SCHEMA), answer, job), want)
    rows = ba.analyses(spark, job.path).collect()
    bodies = {p[1]: p[5] for p in pages}
    found = {(r["analysis_type"], bodies[r["page_id"]]) for r in rows}
    assert len(rows) == len(found) and (found == asked if token_bytes == 1.0 else found >= asked)


def test_a_stopped_job_goes_on(spark, tmp_path, monkeypatch):
    """Stopped after a round's answers and before its ledger row, and again while a round is asked."""
    pages, job = make_pages(), ba.Batch(KINDS, 10**7, f"file://{tmp_path}/job", most=8, ranges=2)
    df, asked, book, round_ = spark.createDataFrame(pages, SCHEMA), [], ba._book, ba._round

    def counted(*args):
        asked.append(args[-1])
        round_(*args)

    monkeypatch.setattr(ba, "_round", counted)
    for stop in (0, 1):
        monkeypatch.setattr(ba, "_book", lambda *a, stop=stop: book(*a) if a[3] != stop else (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            ba.analyse_batch(df, answer, job)
    monkeypatch.setattr(ba, "_book", book)
    got = ba.analyse_batch(df, answer, job)
    check(got, loop(pages, KINDS, 10**7, job.rates)[0])
    assert len(asked) == len(set(asked)) == got.first()["rounds"]  # each round was asked once
    n = len(asked)
    check(ba.analyse_batch(df, answer, job), loop(pages, KINDS, 10**7, job.rates)[0])
    assert len(asked) == n  # a finished job asks nothing


def test_answers_of_earlier_jobs_are_not_asked_again(spark, tmp_path):
    pages = spark.createDataFrame(make_pages(), SCHEMA)
    first = ba.Batch(("meta_desc",), 10**7, f"file://{tmp_path}/a", most=100)
    ba.analyse_batch(pages, answer, first)
    second = ba.Batch(("meta_desc", "title_tag"), 10**7, f"file://{tmp_path}/b", most=100)
    sums = ba.analyse_batch(pages, answer, second, cache=ba.analyses(spark, first.path)).first()
    kinds = {r["analysis_type"] for r in ba.analyses(spark, second.path).collect()}
    assert kinds == {"title_tag"} and sums["pages"] == 24 and sums["input_tokens"] > 0
    every = ba.page_answers(pages, ba.analyses(spark, second.path))
    assert every.select("page_id").distinct().count() > ba.analyses(spark, second.path).select("page_id").distinct().count()


def test_odd_batches(spark, tmp_path):
    pages = spark.createDataFrame(make_pages(4), SCHEMA)
    with pytest.raises(ValueError):
        ba.analyse_batch(pages, answer, ba.Batch(("nonsense",), 10, f"file://{tmp_path}/x"))
    empty = ba.analyse_batch(pages.limit(0), answer, ba.Batch(KINDS, 10, f"file://{tmp_path}/y")).first()
    assert (empty["pages"], empty["rounds"], empty["exhausted"]) == (0, 0, False)
    none = ba.analyse_batch(pages, answer, ba.Batch(KINDS, 0, f"file://{tmp_path}/z")).first()
    assert (none["pages"], none["exhausted"]) == (0, True)
