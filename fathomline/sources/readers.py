"""Readers of label files, box lists, navigation tables and rasters.

Parsers work on text that Spark has read (columns ``path`` and ``value``), so
any storage that Spark reaches will do, and files of any number are read by
all executors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fathomline.functions.boxes import from_centre
from fathomline.operators.images import to_pixels
from fathomline.sources import tiff

RASTER_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".pgm")

#: Names under which a navigation table's columns are known. Fixed values of the format.
NAV_ALIASES = {
    "latitude": ("lat", "latitude", "lat_deg", "y", "northing_deg", "gps_lat"),
    "longitude": ("lon", "long", "longitude", "lon_deg", "x", "easting_deg", "gps_lon"),
    "heading": ("heading", "hdg", "course", "cog", "heading_deg", "track_deg", "azimuth"),
    "altitude": ("altitude", "alt", "height", "fish_altitude", "altitude_m", "range_to_bottom"),
    "ping": ("ping", "ping_id", "record_num", "index", "chunk_i", "ping_number"),
    "depth": ("depth", "water_depth", "depth_m"),
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, value`` of every line of the files at ``path``."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def normal_name(name: Column) -> Column:
    """A column name in lower case without blanks and marks."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[^\p{Alnum}_]", "")


def is_comment(line: Column) -> Column:
    return line.rlike(r"^\s*(#|;|//)") | (F.trim(line) == "")


def yolo_labels(text: DataFrame, width: int, height: int) -> DataFrame:
    """``frame, cls, x0, y0, x1, y1`` in pixels from label lines "class cx cy w h"; lines that aren't five numbers are left out.

    A file without lines has no row here; join the frames to keep it.
    """
    part = F.split(F.trim("value"), r"\s+")
    parsed = text.select(stem(F.col("path")).alias("frame"), F.size(part).alias("n"), *[F.expr(f"try_cast(get(split(trim(value), '\\\\s+'), {k}) as double)").alias(c) for k, c in enumerate(("cls", "cx", "cy", "w", "h"))])
    fine = parsed.filter("n = 5 and cls is not null and cx is not null and cy is not null and w is not null and h is not null")
    corners = from_centre(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(width), F.lit(height))
    return fine.select("frame", F.col("cls").cast("int").alias("cls"), *[v.alias(k) for k, v in corners.items()])


BOX_SCHEMA = "file_name string, objects struct<bbox array<array<double>>, category array<string>, categories array<string>>"


def jsonl_boxes(text: DataFrame) -> DataFrame:
    """``file_name, idx, category, x0, y0, x1, y1`` from JSON lines with lists of (x, y, width, height)."""
    record = text.select(F.from_json("value", BOX_SCHEMA).alias("r")).select("r.file_name", F.coalesce("r.objects.category", "r.objects.categories").alias("names"), F.posexplode("r.objects.bbox").alias("idx", "b"))
    x, y, w, h = (F.get("b", F.lit(k)) for k in range(4))
    return record.select("file_name", "idx", F.get("names", F.col("idx")).alias("category"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def class_id(name: Column, names: list[str]) -> Column:
    """A class name's place in ``names``, else its own number, else 0."""
    at = F.array_position(F.array(*map(F.lit, names)), name)
    return F.coalesce(F.when(at > 0, at - 1), F.when(name.rlike(r"^\d+$"), name.cast("long")), F.lit(0).cast("long"))


def nav_columns(header: str) -> dict[str, int]:
    """Where the known columns are in a header line; an error if a coordinate is missing."""
    names = ["".join(c for c in part.strip().lower() if c.isalnum() or c == "_") for part in header.split(",")]
    found = {c: next((names.index(a) for a in aliases if a in names), None) for c, aliases in NAV_ALIASES.items()}
    if found["latitude"] is None or found["longitude"] is None:
        raise ValueError(f"navigation needs latitude and longitude; the columns are {names}")
    return {c: k for c, k in found.items() if k is not None}


def nav_table(text: DataFrame, header: str | None = None) -> DataFrame:
    """``path, latitude, longitude, heading, altitude, ping, depth`` from navigation lines.

    Banner lines and headers go, as do lines whose coordinates can't be read;
    other values that can't be are null. Without ``header`` each file has one
    of its own, the line that names both coordinates. A file without such a
    line, or no line at all, is a ValueError.
    """
    body = text.filter(~is_comment(F.col("value")))
    value = lambda at: F.expr(f"try_cast(trim(get(split(value, ','), {at})) as double)")
    if header:
        at = nav_columns(header)
        rows = body.filter(F.col("value") != header).select("path", *[(value(at[c]) if c in at else F.lit(None).cast("double")).alias(c) for c in NAV_ALIASES])
    else:
        names = F.transform(F.split("value", ","), lambda part: F.regexp_replace(F.lower(F.trim(part)), r"[^\p{L}\p{N}_]", ""))
        places = {c: F.coalesce(*[F.nullif(F.array_position("names", a), F.lit(0)) for a in aliases]) - 1 for c, aliases in NAV_ALIASES.items()}
        named = body.withColumn("names", names).withColumns({f"at_{c}": place for c, place in places.items()})
        is_header = F.col("at_latitude").isNotNull() & F.col("at_longitude").isNotNull()
        heads = named.filter(is_header).groupBy("path").agg(F.min(F.struct(*[f"at_{c}" for c in NAV_ALIASES])).alias("head")).select("path", "head.*")
        missing = text.select("path").distinct().join(heads, "path", "left_anti").head()
        if missing or heads.isEmpty():
            raise ValueError(f"navigation needs latitude and longitude; no line names them in {missing['path'] if missing else 'no file'}")
        rows = named.filter(~is_header).select("path", "value").join(heads, "path").select("path", *[value(f"cast(at_{c} as int)").alias(c) for c in NAV_ALIASES])
    return rows.filter("latitude is not null and longitude is not null")


def taxonomy(spark: SparkSession, mapping: Mapping, source: str) -> DataFrame:
    """``class_id, native_name, level1, level2, note`` of one source of a class mapping.

    An unknown source is a KeyError, a class of an undefined level a ValueError.
    """
    if source not in mapping["sources"]:
        raise KeyError(f"unknown source {source!r}; known are {sorted(mapping['sources'])}")
    rows = []
    for number, spec in mapping["sources"][source]["native_classes"].items():
        if spec["level2"] not in mapping["level2"]:
            raise ValueError(f"class {number} of {source} maps to undefined level {spec['level2']!r}")
        rows.append((int(number), spec["native_name"], spec["level1"], spec["level2"], spec.get("note", "")))
    return spark.createDataFrame(rows, "class_id int, native_name string, level1 string, level2 string, note string")


#: Shares of red, green and blue in grey (ITU-R BT.601).
LUMA = np.array([0.299, 0.587, 0.114])


Decoder = Callable[[bytes], np.ndarray]


def to_8_bits(image: np.ndarray) -> np.ndarray:
    """Levels of 16 bits are stretched between their 0.1st and 99.9th percentile, other values between their extremes."""
    if image.dtype == np.uint8:
        return image
    values = image.astype(np.float64)
    if image.dtype == np.uint16:
        low, high = np.percentile(values, [0.1, 99.9])
        return (np.clip((values - low) / max(high - low, 1.0), 0, 1) * 255).astype(np.uint8)
    low, high = values.min(), values.max()
    return ((values - low) / max(high - low, 1e-6) * 255).astype(np.uint8)


def decoded(data: bytes, suffix: str = "", decoders: Mapping[str, Decoder] | None = None) -> tuple[np.ndarray, dict | None]:
    """(grey image of 8 bits, georeference or None) of a file's bytes; a ValueError says why there is none.

    A decoder given for the suffix (with its dot, in lower case) comes first
    and returns an array of height by width, or by width by channels. Else the
    bytes themselves tell PNG, TIFF, BMP and PGM apart.
    """
    if decoders and suffix in decoders:
        image = np.asarray(decoders[suffix](data))
        if image.ndim == 3:
            image = image[..., :3].astype(float) @ LUMA if image.shape[-1] >= 3 else image[..., 0]
            image = np.rint(image).astype(np.uint8) if image.max(initial=0) <= 255 else image
        return to_8_bits(image), None
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return to_8_bits(_png(data)), None
        if data[:2] == b"P5":
            return to_8_bits(_pgm(data)), None
        if data[:2] == b"BM":
            return _bmp(data), None
        if data[:4] in (b"II*\0", b"MM\0*"):
            file = tiff.read(data)
            return to_8_bits(tiff.grey(file, LUMA)), tiff.georeference(file.tags)
    except (IndexError, struct.error, zlib.error) as error:
        raise ValueError(f"broken file: {error!r}") from error
    raise ValueError(f"no decoder for {suffix}" if data else "empty file")


def decode_raster(data: bytes) -> np.ndarray | None:
    """A grey image of 8 bits from PNG, TIFF, BMP or PGM bytes; None if it can't be read."""
    try:
        return decoded(data)[0]
    except ValueError:
        return None


def _bmp(data: bytes) -> np.ndarray:
    """Uncompressed bitmaps of 8, 24 or 32 bits."""
    (start, _, width, height, _, depth, packed) = struct.unpack("<IIiiHHI", data[10:34])
    if packed not in (0, 3) or depth not in (8, 24, 32) or width <= 0:
        raise ValueError(f"bitmap of {depth} bits, compression {packed}")
    line = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)
    rows = rows[::-1] if height > 0 else rows
    pixels = rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)
    if depth == 8:
        (used,) = struct.unpack("<I", data[46:50])
        (head,) = struct.unpack("<I", data[14:18])
        table = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + head).reshape(-1, 4)
        pixels = table[pixels[..., 0]]
    return np.rint(pixels[..., 2::-1].astype(float) @ LUMA).astype(np.uint8)


def _pgm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields
    kind = np.dtype(np.uint8 if top < 256 else ">u2")
    return np.frombuffer(data, dtype=kind, count=width * height, offset=at + 1).reshape(height, width).astype(np.uint8 if top < 256 else np.uint16)


def _png(data: bytes) -> np.ndarray:
    at, packed = 8, b""
    width = height = depth = colour = 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
            if depth not in (8, 16) or colour not in (0, 2, 4, 6) or laced:
                raise ValueError("unsupported PNG")
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(height, 1 + width * step)
    rows = np.zeros((height, width * step), dtype=np.uint8)
    above = np.zeros(width * step, dtype=np.uint8)
    for y in range(height):
        method, line = raw[y, 0], raw[y, 1:].copy()
        if method == 2:
            line += above
        elif method == 1:
            line = np.cumsum(line.reshape(width, step), axis=0, dtype=np.uint8).ravel()
        elif method:
            for x in range(len(line)):
                left, up, corner = int(line[x - step]) if x >= step else 0, int(above[x]), int(above[x - step]) if x >= step else 0
                if method == 3:
                    guess = (left + up) // 2
                else:
                    guess = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
                line[x] = (int(line[x]) + guess) & 255
        rows[y] = above = line
    pixels = rows.view(">u2" if depth == 16 else np.uint8).reshape(height, width, channels)
    grey = pixels[..., :3].astype(float) @ LUMA if channels > 2 else pixels[..., 0].astype(float)
    return grey.round().astype(np.uint16 if depth == 16 else np.uint8)


GEOREFERENCE = "struct<affine: array<double>, epsg: int>"


def read_frames(spark: SparkSession, path: str, decoders: Mapping[str, Decoder] | None = None) -> DataFrame:
    """``path, frame, height, width, pixels, georef, error`` of every file at ``path``: an image, or why it is none.

    Pixels are 8-bit levels over 255 in reading order. ``georef`` is null for
    files that say nothing of their place. Files of other suffixes than
    RASTER_SUFFIXES and those of ``decoders`` are reported like undecodable
    ones, with null pixels; nothing is left out. Formats without a decoder here
    (JPEG) need one given by suffix; it runs on the executors.
    """
    known = {*RASTER_SUFFIXES, *(decoders or {})}
    files = spark.read.format("binaryFile").load(path).select("path", stem(F.col("path")).alias("frame"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "content")
    schema = f"path string, frame string, height int, width int, pixels array<double>, georef {GEOREFERENCE}, error string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, frame, suffix, data in zip(*[batch.column(c).to_pylist() for c in ("path", "frame", "suffix", "content")], strict=True):
                row = {"path": name, "frame": frame}
                try:
                    if suffix not in known:
                        raise ValueError(f"not a raster: {suffix or 'no suffix'}")
                    image, georef = decoded(data, suffix, decoders)
                    row |= {"height": image.shape[0], "width": image.shape[1], "pixels": image.ravel() / 255, "georef": georef}
                except ValueError as error:
                    row["error"] = str(error)
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    return files.mapInArrow(decode, schema)


def left_out(frames: DataFrame) -> DataFrame:
    """``path, error`` of the files that gave no image."""
    return frames.filter("error is not null").select("path", "error")


def read_rasters(spark: SparkSession, path: str, decoders: Mapping[str, Decoder] | None = None) -> DataFrame:
    """``frame, ping, bin, v`` of all images at ``path``; ``left_out`` of ``read_frames`` tells which files are none."""
    return to_pixels(read_frames(spark, path, decoders).filter("error is null"))
