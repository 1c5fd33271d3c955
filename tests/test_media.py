from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from voxlake.sources import media


def test_png_chunks_and_pixels():
    values = np.arange(2 * 3 * 3) % 256
    data = media.png(values, 3, 3)
    at, chunks = 8, {}
    while at < len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        assert struct.unpack_from(">I", data, at + 8 + size)[0] == zlib.crc32(name + body)
        chunks[name], at = body, at + 12 + size
    assert list(chunks) == [b"IHDR", b"IDAT", b"IEND"] and struct.unpack(">IIBBBBB", chunks[b"IHDR"]) == (3, 2, 8, 2, 0, 0, 0)
    lines = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(2, 10)
    assert not lines[:, 0].any() and lines[:, 1:].ravel().tolist() == values.tolist()


def test_signed_tiff():
    data = media.tiff16(np.array([-5, 7, 300, -32768]), 2)
    entries = {t: v for t, _, _, v in (struct.unpack_from("<HHII", data, 10 + 12 * i) for i in range(10))}
    assert (entries[256], entries[257], entries[339]) == (2, 2, 2)
    assert np.frombuffer(data, "<i2", offset=entries[273]).tolist() == [-5, 7, 300, -32768]


def test_pictures_of_odd_frames(spark):
    rows = [("a", 0, 1, 2, 1, [1, 2, 3, 4]), ("b", 0, 1, 2, 1, [1, 2, 3]), ("c", 0, 1, 2, 1, None), ("d", 0, 1, None, 1, [1]), ("e", 11, 12345, 1, 3, [1, 2, 3])]
    frames = spark.createDataFrame(rows, "base string, frame int, frames int, columns int, samples int, pixels array<int>")
    found = {r.file_path: r.content is not None for r in media.pictures(frames).collect()}
    assert found == {"a_frame0001.png": True, "b_frame0001.png": False, "c_frame0001.png": False, "d_frame0001.png": False, "e_frame00012.png": True}
    assert media.pictures(frames.limit(0), "tiff").count() == 0
    with pytest.raises(ValueError):
        media.pictures(frames, "gif")


def test_archives_that_are_none(spark):
    files = spark.createDataFrame([("a.zip", None), ("b.zip", b"")], "file_path string, content binary")
    assert [(r.archive, r.member, r.disposition, r.error is not None) for r in media.zip_members(files).orderBy("archive").collect()] == [("a.zip", None, None, True), ("b.zip", None, None, True)]
