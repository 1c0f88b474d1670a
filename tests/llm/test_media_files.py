"""Lossless streams that other programs wrote, and pixel arrays as a column."""

import os
import struct
import zlib

import numpy as np
import pytest

from crawlspan.llm import media


def find(name: str) -> str:
    """A picture among the test data of this Python, where it has any."""
    import sysconfig

    for folder in ("test_email/data", "imghdrdata"):
        path = os.path.join(sysconfig.get_path("stdlib"), "test", folder, name)
        if os.path.exists(path):
            return path
    pytest.skip("this Python has no test data")


def png_alpha(path: str) -> np.ndarray:
    """The alpha of a PNG file with a palette and unfiltered or simply filtered rows."""
    data, at, parts = open(path, "rb").read(), 8, {}
    while at < len(data):
        n = struct.unpack_from(">I", data, at)[0]
        parts[data[at + 4 : at + 8]] = parts.get(data[at + 4 : at + 8], b"") + data[at + 8 : at + 8 + n]
        at += 12 + n
    width, height = struct.unpack_from(">II", parts[b"IHDR"])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, width + 1)
    assert not rows[:, 0].any()
    alpha = np.full(256, 255, np.uint8)
    alpha[: len(parts[b"tRNS"])] = np.frombuffer(parts[b"tRNS"], np.uint8)
    return alpha[rows[:, 1:]]


def test_stream_of_another_encoder():
    """The alpha plane of a WebP file is a lossless stream without a header; the PNG file shows the same picture."""
    data, at, parts = open(find("python.webp"), "rb").read(), 12, {}
    while at + 8 <= len(data):
        n = struct.unpack_from("<I", data, at + 4)[0]
        parts[data[at : at + 4]] = data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    assert parts[b"ALPH"][0] == 1  # lossless, unfiltered
    got = (media.read_stream(media.Bits(parts[b"ALPH"][1:]), 16, 16) >> np.uint32(8)) & np.uint32(255)
    assert (got == png_alpha(find("python.png"))).all()


def test_pixel_arrays(spark):
    texts = ["", None, "abc", "words and words " * 900, "é" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = media.media_column(df)
    files = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for r in media.decode(stored).collect():
        want, _ = media.read_webp(files[r["doc_id"]])
        px = np.array(r["pixels"], np.int64) & 0xFFFFFFFF
        assert (r["height"], r["width"]) == want.shape[:2] and r["media_bytes"] == len(files[r["doc_id"]])
        assert (np.stack([px >> 16 & 255, px >> 8 & 255, px & 255, px >> 24], axis=1).reshape(want.shape) == want).all()
        raw = want[..., :3].tobytes()[: r["payload_bytes"]]
        assert raw == media.payload_of(texts[r["doc_id"]])[1]
    assert len({r["feature"] for r in media.media_features(stored.filter("doc_id < 2")).collect()}) == 1
