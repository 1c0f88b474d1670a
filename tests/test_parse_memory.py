"""What a parsing task holds at its peak is the same for ten times the pages in one Arrow batch."""

import tracemalloc

import pyarrow as pa

from crawlspan.operators import parse


def _peak(schema: pa.Schema, n: int) -> int:
    html = "<title>t</title>" + "".join(f'<p>words of a page <a href="/{k}">link {k}</a> <img src="/{k}.png">' for k in range(20))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([html] * n), pa.array(["https://t.example/"] * n)], ["page_id", "__html", "__url"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in parse._parse(iter([batch]), schema, 1, None, {})) == n
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_the_peak_does_not_grow_with_the_batch(spark):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = pa.schema([("page_id", pa.int64()), *to_arrow_schema(spark.createDataFrame([], parse.PARSED).schema)])
    _peak(schema, 10)
    assert _peak(schema, 1280) < 1.5 * _peak(schema, 128)
