"""What a parsing task holds does not grow with its partition."""

import pyarrow as pa

from crawlspan.operators import parse


def test_a_large_batch_is_parsed_in_parts(spark):
    from pyspark.sql.pandas.types import to_arrow_schema

    n = 1000
    schema = pa.schema([("page_id", pa.int64()), *to_arrow_schema(spark.createDataFrame([], parse.PARSED).schema)])
    whole = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"<title>t{i}</title>" for i in range(n)]), pa.array(["https://t.example/"] * n)], ["page_id", "__html", "__url"])
    parts = list(parse._parse(iter([whole]), schema, 1, None, {}))
    assert max(b.num_rows for b in parts) <= parse.HELD
    assert [(r["page_id"], r["title"]) for b in parts for r in b.select(["page_id", "title"]).to_pylist()] == [(i, f"t{i}") for i in range(n)]


def test_the_session_gets_small_batches(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    try:
        for rows, size, want in (("10000", "64MB", ("256", str(4 << 20))), ("100", "1000", ("100", "1000"))):
            spark.conf.set(keys[0], rows)
            spark.conf.set(keys[1], size)
            parse.parse_pages(spark.createDataFrame([(1, "https://t.example/", "<p>x")], "page_id long, url string, html string"))
            assert tuple(spark.conf.get(k).rstrip("b") for k in keys) == want
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
