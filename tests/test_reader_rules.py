"""Navigation headers of each file, and grey of colours."""

import struct
import zlib

import numpy as np
import pytest

from fathomline.sources import readers


def test_each_navigation_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# banner\nPing,LAT,Lon,Hdg\n0,12.9,80.3,350\n1,bad,80.3,1\n")
    (tmp_path / "b.csv").write_text("longitude,latitude,ping\n80.1,12.5,7\n")
    got = readers.nav_table(readers.lines(spark, str(tmp_path))).orderBy("ping").collect()
    assert [(r.ping, r.latitude, r.longitude, r.heading) for r in got] == [(0.0, 12.9, 80.3, 350.0), (7.0, 12.5, 80.1, None)]
    (tmp_path / "c.csv").write_text("speed,sound\n1,2\n")
    with pytest.raises(ValueError):
        readers.nav_table(readers.lines(spark, str(tmp_path)))


def png(pixels):
    height, width, channels = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    depth = pixels.dtype.itemsize
    raw = b"".join(b"\0" + row.astype(pixels.dtype.newbyteorder(">")).tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", width, height, 8 * depth, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_grey_of_colours():
    pure = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]], dtype=np.uint8)
    assert readers.decode_raster(png(pure)).tolist() == [[76, 150, 29, 255]]
    flat = np.full((2, 2, 1), 700, dtype=np.uint16)
    assert readers.decode_raster(png(flat)).tolist() == [[0, 0], [0, 0]]
