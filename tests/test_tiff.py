"""TIFF, BMP and other rasters: planted files of both byte orders, every packing, and what can't be read."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import geo as G
from fathomline.sources import readers, tiff

RNG = np.random.default_rng(2)


def pack_bits(data):
    out, at = b"", 0
    while at < len(data):
        run = 1
        while at + run < len(data) and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out, at = out + bytes([257 - run, data[at]]), at + run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and (end + 1 >= len(data) or data[end] != data[end + 1]):
            end += 1
        out, at = out + bytes([end - at - 1]) + data[at:end], end
    return out + b"\x80"


def pack_lzw(data):
    codes, table, width, word = [(256, 9)], {bytes((i,)): i for i in range(256)}, 9, b""
    free = 258
    for byte in data:
        longer = word + bytes((byte,))
        if longer in table:
            word = longer
            continue
        codes.append((table[word], width))
        table[longer], free = free, free + 1
        if free == 4094:
            codes.append((256, width))
            table, free, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif free >= 1 << width and width < 12:
            width += 1
        word = bytes((byte,))
    if word:
        codes.append((table[word], width))
        free += 1
        if free >= 1 << width and width < 12:
            width += 1
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


PACK = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: pack_bits}


def tiff_file(image, order="<", compression=1, rows=None, tile=None, predictor=1, planar=1, photometric=1, extra=()):
    """A TIFF of an image of height by width (by samples)."""
    pixels = image if image.ndim == 3 else image[..., None]
    height, width, samples = pixels.shape
    kind = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    pieces = []
    planes = [pixels[..., k : k + 1] for k in range(samples)] if planar == 2 else [pixels]
    for plane in planes:
        if tile:
            wide = np.pad(plane, ((0, -height % tile[0]), (0, -width % tile[1]), (0, 0)))
            cells = [wide[y : y + tile[0], x : x + tile[1]] for y in range(0, height, tile[0]) for x in range(0, width, tile[1])]
        else:
            cells = [plane[y : y + (rows or height)] for y in range(0, height, rows or height)]
        for cell in cells:
            if predictor == 2:
                cell = np.concatenate([cell[:, :1], np.diff(cell, axis=1)], axis=1).astype(cell.dtype)
            pieces.append(PACK[compression](cell.astype(cell.dtype.newbyteorder(order)).tobytes()))
    tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [8 * pixels.dtype.itemsize] * samples), (259, "H", [compression]), (262, "H", [photometric]), (277, "H", [samples]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [kind] * samples), *extra]
    body, offsets = b"", []
    for piece in pieces:
        offsets.append(8 + len(body))
        body += piece + b"\0" * (len(piece) % 2)
    tags += [(324, "I", offsets), (325, "I", list(map(len, pieces))), (322, "I", [tile[1]]), (323, "I", [tile[0]])] if tile else [(273, "I", offsets), (279, "I", list(map(len, pieces))), (278, "I", [rows or height])]
    return assembled(tags, body, order)


def assembled(tags, body, order):
    code = {"H": 3, "I": 4, "d": 12}
    at = 8 + len(body)
    entries, rest = b"", b""
    for tag, kind, values in sorted(tags):
        raw = struct.pack(f"{order}{len(values)}{kind}", *values)
        if len(raw) <= 4:
            where = raw.ljust(4, b"\0")
        else:
            where = struct.pack(order + "I", at + 2 + 12 * len(tags) + 4 + len(rest))
            rest += raw
        entries += struct.pack(order + "HHI", tag, code[kind], len(values)) + where
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + body + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + rest


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("compression", PACK)
def test_strips_and_tiles(order, compression):
    smooth = np.cumsum(RNG.integers(0, 3, (37, 45)), axis=1).astype(np.uint8)
    for kind in ("u1", "u2", "u4", "i2", "f4", "f8"):
        image = smooth.astype(kind)
        for shape in ({"rows": 8}, {"tile": (16, 32)}, {}):
            assert np.array_equal(tiff.read(tiff_file(image, order, compression, **shape)).pixels, image)
        if kind in ("u1", "u2"):
            assert np.array_equal(tiff.read(tiff_file(image, order, compression, rows=10, predictor=2)).pixels, image)
    colours = RNG.integers(0, 256, (19, 23, 3), dtype=np.uint8)
    for planar in (1, 2):
        assert np.array_equal(tiff.read(tiff_file(colours, order, compression, rows=5, planar=planar)).pixels, colours)
        assert np.array_equal(tiff.read(tiff_file(colours, order, compression, tile=(16, 16), planar=planar)).pixels, colours)


def test_lzw_over_a_full_table():
    noise = RNG.integers(0, 256, (120, 200), dtype=np.uint8)
    assert np.array_equal(tiff.read(tiff_file(noise, ">", 5)).pixels, noise)
    assert np.array_equal(tiff.read(tiff_file(np.zeros((300, 300), np.uint8), "<", 5)).pixels, np.zeros((300, 300)))


def test_grey_of_tiffs():
    white = tiff.read(tiff_file(np.array([[0, 255]], np.uint8), photometric=0))
    assert tiff.grey(white, readers.LUMA).tolist() == [[255, 0]]
    table = np.zeros((3, 256), int)
    table[:, 5] = [65535, 0, 0]
    palette = tiff.read(tiff_file(np.array([[5, 0]], np.uint8), photometric=3, extra=[(320, "H", table.ravel().tolist())]))
    assert tiff.grey(palette, readers.LUMA).tolist() == [[76, 0]]
    assert readers.decode_raster(tiff_file(np.array([[[255, 0, 0], [255, 255, 255]]], np.uint8))).tolist() == [[76, 255]]
    assert readers.decode_raster(tiff_file(np.array([[0.5, 1.5, 1.0]], np.float32))).tolist() == [[0, 255, 127]]
    bits = assembled([(256, "I", [10]), (257, "I", [2]), (258, "H", [1]), (259, "H", [1]), (262, "H", [1]), (273, "I", [8]), (278, "I", [2]), (279, "I", [4])], bytes([0b10100000, 0b01000000, 0xFF, 0xC0]), "<")
    assert readers.decode_raster(bits).tolist() == [[255, 0, 255, 0, 0, 0, 0, 0, 0, 255], [255] * 10]


def test_broken_tiffs():
    good = tiff_file(RNG.integers(0, 9, (9, 9), dtype=np.uint8), rows=3)
    for bad in (b"", b"II*\0", good[:30], good[:-40], good.replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0))):
        with pytest.raises(tiff.Unreadable):
            tiff.read(bad)
    for cut in range(0, len(good), 7):
        try:
            tiff.read(good[:cut])
        except tiff.Unreadable:
            pass


PLACED = [(33550, "d", [0.5, 0.25, 0.0]), (33922, "d", [10.0, 20.0, 0.0, 423000.0, 1426000.0, 0.0]), (34735, "H", [1, 1, 0, 1, 3072, 0, 1, 32644])]


def test_files_and_their_places(spark, tmp_path):
    image = RNG.integers(0, 256, (6, 8), dtype=np.uint8)
    matrix = [0.1, 0.01, 0.0, 80.0, 0.02, -0.1, 0.0, 13.0, 0, 0, 0, 0, 0, 0, 0, 1]
    (tmp_path / "utm.tif").write_bytes(tiff_file(image, ">", 5, extra=PLACED))
    (tmp_path / "degrees.TIFF").write_bytes(tiff_file(image, extra=[(34264, "d", list(map(float, matrix)))]))
    (tmp_path / "plain.tif").write_bytes(tiff_file(image, compression=8))
    (tmp_path / "broken.tif").write_bytes(b"II*\0rubbish")
    (tmp_path / "photo.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "notes.txt").write_text("no image")
    (tmp_path / "x.pgm").write_bytes(b"P5\n8 6\n255\n" + image.tobytes())
    line = [image[5 - y].repeat(3).tobytes() for y in range(6)]
    (tmp_path / "y.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 8, 6, 1, 24, 0, 0, 0, 0, 0, 0) + b"".join(line))
    frames = readers.read_frames(spark, str(tmp_path))
    rows = {r.path.rpartition("/")[2]: r for r in frames.collect()}
    assert set(rows) == {p.name for p in tmp_path.iterdir()}
    for name in ("utm.tif", "degrees.TIFF", "plain.tif", "x.pgm", "y.bmp"):
        assert (rows[name].height, rows[name].width, rows[name].error) == (6, 8, None) and np.array_equal(np.array(rows[name].pixels) * 255, image.ravel())
    assert rows["utm.tif"].georef == ([0.5, 0.0, 423000.0 - 5.0, 0.0, -0.25, 1426000.0 + 5.0], 32644) and rows["degrees.TIFF"].georef == ([0.1, 0.01, 80.0, 0.02, -0.1, 13.0], 4326)
    assert rows["plain.tif"].georef is None and rows["x.pgm"].georef is None
    out = {r.path.rpartition("/")[2]: r.error for r in readers.left_out(frames).collect()}
    assert set(out) == {"broken.tif", "photo.jpg", "notes.txt"} and out["photo.jpg"] == "no decoder for .jpg" and out["notes.txt"] == "not a raster: .txt"
    with_decoder = {r.path.rpartition("/")[2]: r for r in readers.read_frames(spark, str(tmp_path), {".jpg": lambda data: np.full((2, 3, 3), len(data), np.uint8)}).collect()}
    assert with_decoder["photo.jpg"].error is None and with_decoder["photo.jpg"].pixels == [4 / 255] * 6
    assert readers.read_rasters(spark, str(tmp_path)).select("frame").distinct().count() == 5

    fixes = {r.frame: r for r in frames.select("frame", G.locate(F.lit(10), F.lit(20), F.col("georef"), F.col("height"), F.col("width")).alias("fix"), G.describe_georeference(F.col("georef")).alias("told")).collect()}
    east, north = G.utm_project(F.lit(fixes["utm"].fix.latitude), F.lit(fixes["utm"].fix.longitude), F.lit(44), F.lit(False))
    back = spark.range(1).select(east.alias("e"), north.alias("n")).first()
    assert (back.e, back.n) == (pytest.approx(423000.0, abs=1e-4), pytest.approx(1426000.0, abs=1e-4))
    assert fixes["utm"].fix.uncertainty_m == 0.5 and fixes["utm"].told.available and fixes["utm"].told.epsg == 32644
    assert (fixes["degrees"].fix.longitude, fixes["degrees"].fix.latitude) == (pytest.approx(80 + 1 + 0.2), pytest.approx(13 + 0.2 - 2))
    assert fixes["plain"].fix is None and not fixes["plain"].told.available


@pytest.mark.parametrize("epsg", [32601, 32660, 32701, 32760, 32631])
def test_utm_and_back(spark, epsg):
    zone, south = epsg % 100, epsg // 100 == 327
    rows = [((-1 if south else 1) * lat, zone * 6 - 183 + off) for lat in (0.0, 0.001, 12.9, 45.0, 71.3, 84.0) for off in (-3.0, -0.5, 0.0, 1.7, 3.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    east, north = G.utm_project(F.col("lat"), F.col("lon"), F.lit(zone), F.lit(south))
    lat, lon = G.to_wgs84(F.col("e"), F.col("n"), F.lit(epsg))
    for r in df.withColumns({"e": east, "n": north}).withColumns({"lat2": lat, "lon2": lon}).collect():
        assert abs(r.lat - r.lat2) * 111320 < 1e-4 and abs(r.lon - r.lon2) * 111320 < 1e-4


def test_unknown_systems_have_no_place(spark):
    georef = F.struct(F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))).alias("affine"), F.lit(2056).alias("epsg"))
    r = spark.range(1).select(G.locate(F.lit(1), F.lit(2), georef, F.lit(3), F.lit(3)).alias("fix"), G.describe_georeference(georef).alias("told")).first()
    assert r.fix is None and not r.told.available and r.told.note == "coordinate system not supported"
