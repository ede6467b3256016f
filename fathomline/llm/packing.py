"""Packing token sequences by minimum bin slack over a histogram of remaining lengths."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch, salts

CAPACITY = 1024
#: The splitting pattern of byte-level BPE files of this kind (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """The vocabulary of a byte-level BPE file by bytes, and its special strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    # A byte that can't be printed is written as the next character from 256 on.
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}, special


_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(path: str, sent: Broadcast) -> tiktoken.Encoding:
    """This worker's encoder. It gives the ids of the tokenizers library for the same file, three times as fast."""
    if path not in _encoders:
        ranks, special = sent.value
        _encoders[path] = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of full pieces and the rest."""
    raw = np.ascontiguousarray(ids, dtype="<u4")
    return [(at, len(part), zlib.crc32(part.tobytes())) for at in range(0, len(raw), capacity) for part in (raw[at : at + capacity],)]


def tokenize(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens`` of every piece."""
    sent = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, sent)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["id"].tolist(), batch["body"].tolist(), strict=True):
                ids = encode.encode_to_numpy(text, allowed_special="all")
                ids = np.append(ids, np.uint32(end_id))
                rows += [(doc_id, *piece, len(ids)) for piece in cut(ids, capacity)]
            yield pd.DataFrame(rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return source.mapInPandas(pieces, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: np.ndarray, room: int) -> dict[int, int]:
    """Lengths, each at most counts[length] times, whose sum is as near below ``room`` as can be.

    Subset sums are the bits of an integer; copies of a length enter in powers
    of two. Each step's bits are kept, and the way back through them tells how
    many copies of each length were used.
    """
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, copies = min(int(counts[length]), room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << length * copies) & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + copies
            at -= length * copies
    return used


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths of a window, how many such windows) until every length is used up.

    Each window starts with the longest length left, so that the short ones
    stay for filling; ``fill`` closes it. A window is repeated as often as the
    counts allow, so there are about as many kinds as lengths, whatever the
    number of documents.
    """
    counts, windows = counts.copy(), []
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        counts[longest] -= 1
        used = fill(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(int(counts[length]) // k for length, k in used.items())
        for length, k in used.items():
            counts[length] -= k * times
        windows.append((used, times))
    return windows


def lines(windows: list[tuple[dict[int, int], int]], full: int, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies in a window, first offset) for each length of each kind of window."""
    out, taken, sequence = [], {}, 0
    for used, times in windows:
        offset = 0
        for length in sorted(used, reverse=True):
            k = used[length]
            begin = taken.get(length, 0)
            out.append((length, begin, begin + k * times, sequence, k, offset))
            taken[length] = begin + k * times
            offset += k * length
        sequence += times
    if full:
        out.append((capacity, 0, full, sequence, 1, 0))
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its token ids and then ``end_id``, so null and empty texts
    are one token long. Full pieces of ``capacity`` ids are sequences of their
    own; the rests are packed by ``plan``, which sees only how many rests have
    each length (at most capacity - 1 numbers). Which document gets which place
    follows from its rank among rests of its length, found in two steps so that
    a length that a third of all documents share is dealt over many tasks.
    Repeated rows and rows without identifier are packed like any other; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.table(tokenize(docs, path, id_col, text_col, capacity, end_id))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    n = salts(int(counts.sum()))
    full = int(counts[capacity])
    counts[capacity] = 0
    # Bounded by the kinds of windows and their lengths, not by the input.
    places = spark.createDataFrame(lines(plan(counts, capacity), full, capacity), "length long, low long, high long, sequence long, copies long, begin long")

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(n)).cast("int"))
    cell = Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = salted.groupBy("length", "salt").count().withColumn("ahead", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = salted.withColumn("k", F.row_number().over(cell)).join(ahead, ["length", "salt"]).withColumn("rank", F.col("k") - 1 + F.col("ahead"))
    place = F.col("rank") - F.col("low")
    return (
        ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("low") <= F.col("rank")) & (F.col("rank") < F.col("high")))
        .select(
            F.col("id").alias(id_col), "start", ranked["length"], "ids_crc32", "doc_tokens",
            (F.col("sequence") + F.floor(place / F.col("copies"))).alias("sequence_id"),
            (F.col("begin") + place % F.col("copies") * ranked["length"]).alias("offset"),
        )
    )
