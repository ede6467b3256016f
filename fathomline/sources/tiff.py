"""TIFF files to arrays, and the tags that place them on the earth."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from fathomline.functions.geo import affine_from_tiepoint, epsg_from_geokeys

#: Bytes of each field type. Fixed values of the format.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: Tags by number. Fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, COLOURS, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 317, 320, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORMATION, GEO_KEYS = 33550, 33922, 34264, 34735


class Unreadable(ValueError):
    """What this reader can't decode, and why."""


@dataclass
class Tiff:
    pixels: np.ndarray  # height by width, or height by width by samples
    tags: dict[int, tuple]


def directory(data: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, tags) of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise Unreadable("no TIFF header")
    (at,) = struct.unpack(order + "I", data[4:8])
    (count,) = struct.unpack(order + "H", data[at : at + 2])
    tags = {}
    for k in range(count):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        size = SIZES.get(kind, 0) * n
        if not size:
            continue
        where = entry[8:12] if size <= 4 else data[struct.unpack(order + "I", entry[8:12])[0] :]
        raw = where[:size]
        if len(raw) < size:
            raise Unreadable(f"tag {tag} lies outside the file")
        if kind in CODES:
            tags[tag] = struct.unpack(f"{order}{n}{CODES[kind]}", raw)
        elif kind in (5, 10):
            pairs = struct.unpack(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", raw)
            tags[tag] = tuple(a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True))
        else:
            tags[tag] = (raw,)
    return order, tags


def unpack_bits(data: bytes) -> bytes:
    """Runs and literals of PackBits."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends."""
    out: list[bytes] = []
    table: list[bytes] = []
    width, held, bits, last = 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [], 9, b""
            continue
        if code < 256:
            now = bytes((code,))
        elif code - 258 < len(table):
            now = table[code - 258]
        elif last and code - 258 == len(table):
            now = last + last[:1]
        else:
            raise Unreadable("broken LZW codes")
        out.append(now)
        if last:
            table.append(last + now[:1])
            # The width grows one code early.
            if len(table) + 258 >= (1 << width) - 1 and width < 12:
                width += 1
        last = now
    return b"".join(out)


def unpacked(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression == 5:
        return unpack_lzw(data)
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 32773:
        return unpack_bits(data)
    raise Unreadable(f"compression {compression}")


def sample_type(order: str, bits: int, kind: int) -> np.dtype:
    letter = {1: "u", 2: "i", 3: "f"}.get(kind)
    if letter is None or bits not in (8, 16, 32, 64) or (letter == "f" and bits < 32):
        raise Unreadable(f"samples of {bits} bits, format {kind}")
    return np.dtype(f"{order}{letter}{bits // 8}")


def read(data: bytes) -> Tiff:
    """The first image: strips or tiles, chunky or planar, of 1 or 8 to 64 bits; ``Unreadable`` otherwise."""
    try:
        order, tags = directory(data)
        one = lambda tag, other=None: tags[tag][0] if tag in tags else other
        height, width, samples = one(HEIGHT), one(WIDTH), one(SAMPLES, 1)
        bits = set(tags.get(BITS, (1,)))
        if not height or not width or len(bits) != 1:
            raise Unreadable("no size, or samples of different bits")
        (bits,) = bits
        kind, compression, predictor = one(FORMAT, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
        if predictor not in (1, 2) or (predictor == 2 and (kind == 3 or bits == 1)):
            raise Unreadable(f"predictor {predictor}")
        planes = samples if one(PLANAR, 1) == 2 else 1
        inside = samples // planes
        tiled = TILE_OFFSETS in tags
        rows = one(TILE_HEIGHT) if tiled else min(one(ROWS_PER_STRIP, height), height)
        columns = one(TILE_WIDTH) if tiled else width
        offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags.get(STRIP_COUNTS, (len(data),)))
        dtype = np.dtype("u1") if bits == 1 else sample_type(order, bits, kind)
        across, down = -(-width // columns), -(-height // rows)
        if len(offsets) < across * down * planes:
            raise Unreadable("fewer pieces than the image needs")
        image = np.zeros((down * rows, across * columns, samples), dtype=dtype.newbyteorder("="))
        for k, (at, size) in enumerate(zip(offsets, counts, strict=False)):
            plane, place = divmod(k, across * down)
            top, left = place // across * rows, place % across * columns
            high = rows if tiled else min(rows, height - top)
            raw = unpacked(data[at : at + size], compression)
            line = -(-columns * inside // 8) if bits == 1 else columns * inside * dtype.itemsize
            if len(raw) < high * line:
                raise Unreadable("a piece is cut off")
            if bits == 1:
                piece = np.unpackbits(np.frombuffer(raw, np.uint8, high * line).reshape(high, line), axis=1)[:, : columns * inside].reshape(high, columns, inside)
            else:
                piece = np.frombuffer(raw, dtype, high * columns * inside).reshape(high, columns, inside)
                if predictor == 2:
                    piece = np.cumsum(piece, axis=1, dtype=dtype.newbyteorder("="))
            image[top : top + high, left : left + columns, plane : plane + inside] = piece
        image = image[:height, :width]
        return Tiff(image[..., 0] if samples == 1 else image, tags | {BITS: (bits,)})
    except (struct.error, IndexError, KeyError, zlib.error, TypeError, ZeroDivisionError) as error:
        raise Unreadable(f"broken TIFF: {error!r}") from error


def grey(tiff: Tiff, luma: np.ndarray) -> np.ndarray:
    """One channel: colours by their shares in grey, palettes by their colours, white as the largest value."""
    pixels, tags = tiff.pixels, tiff.tags
    photometric = tags.get(PHOTOMETRIC, (1,))[0]
    if photometric == 3 and COLOURS in tags:
        table = np.array(tags[COLOURS], dtype=float).reshape(3, -1).T / 257
        return (table[pixels.astype(int)] @ luma).round().astype(np.uint8)
    if tags[BITS][0] == 1:
        pixels = pixels * np.uint8(255)
    if pixels.ndim == 3:
        one = pixels[..., :3].astype(float) @ luma if pixels.shape[-1] >= 3 else pixels[..., 0].astype(float)
        pixels = (one if pixels.dtype.kind == "f" else np.rint(one)).astype(pixels.dtype)
    if photometric == 0 and pixels.dtype.kind == "u":
        return np.iinfo(pixels.dtype).max - pixels
    return pixels


def georeference(tags: dict[int, tuple]) -> dict | None:
    """``affine`` (six terms), ``epsg``, or None where the file says nothing of its place.

    A transformation matrix comes before pixel scale and tie point. Without
    an EPSG code in place among the keys, degrees on WGS84 are meant.
    """
    if len(tags.get(TRANSFORMATION, ())) >= 8:
        m = tags[TRANSFORMATION]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif len(tags.get(PIXEL_SCALE, ())) >= 2 and len(tags.get(TIE_POINT, ())) >= 6:
        affine = affine_from_tiepoint(tags[PIXEL_SCALE][:2], tags[TIE_POINT][:6])
    else:
        return None
    return {"affine": [float(a) for a in affine], "epsg": epsg_from_geokeys(list(tags.get(GEO_KEYS, ()))) or 4326}
