"""Removal of repeated byte strings by suffix arrays that are built by linear grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.anchors import anchors, prefix_sums, stretch_hash
from fathomline.llm.common import Scratch, membership_filter, with_membership

LENGTH = 400
PORTION = 1_000_000
SLICE = 1 << 22
SPANS = "array<struct<start: bigint, end: bigint>>"


def suffix_array(text: bytes) -> list[int]:
    """The suffixes of ``text`` in order; a suffix comes before those that it begins.

    First phase: suffixes start in groups by their first byte. Groups are taken
    in descending order. For each of a group's suffixes the nearest suffix to
    its left in a lesser group is found by following the pointers of greater
    ones. Such a suffix's Lyndon prefix grows by the group's; it leaves its
    group for a new one right behind, those pointed to most often ending up
    highest. In the end a group is the suffixes of one Lyndon prefix.
    Second phase: going through the array upwards from the end of the text,
    each suffix puts the chain of pointers before it into their groups' next
    places. No string is renamed and nothing recurses.
    """
    n = len(text) + 1
    codes = [0, *(b + 1 for b in reversed(text))][::-1]  # the end is least of all
    size = [0] * 257
    for c in codes:
        size[c] += 1
    start, total = [0] * 257, 0
    for c in range(257):
        start[c], total = total, total + size[c]
    group = [start[c] for c in codes]
    last = {start[c]: start[c] + size[c] - 1 for c in range(257) if size[c]}
    first_at = {e: s for s, e in last.items()}  # a group's start by its end
    members: dict[int, list[int]] = {s: [] for s in last}
    for i, g in enumerate(group):
        members[g].append(i)
    left = [-1] * n
    g = first_at[n - 1]
    while True:
        here = [i for i in members.pop(g) if group[i] == g]
        here.sort()
        times: dict[int, int] = {}
        for i in here:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = left[p]
            left[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        by_times: dict[int, dict[int, list[int]]] = {}
        for p, k in times.items():
            by_times.setdefault(k, {}).setdefault(group[p], []).append(p)
        for k in sorted(by_times, reverse=True):
            for old, moved in by_times[k].items():
                end = last[old]
                new = end - len(moved) + 1
                if new == old:
                    continue  # the whole group goes on together
                last[old], last[new] = new - 1, end
                first_at[new - 1], first_at[end] = old, new
                for p in moved:
                    group[p] = new
                members[new] = moved
        if g == 0:
            break
        g = first_at[g - 1]
    free = dict.fromkeys(set(group), 0)
    free.update({s: s for s in free})
    order, placed = [-1] * n, [False] * n
    order[0], placed[n - 1] = n - 1, True
    for r in range(n):
        s = order[r] - 1
        while s >= 0 and not placed[s]:
            at = free[group[s]]
            free[group[s]] = at + 1
            order[at] = s
            placed[s] = True
            s = left[s]
    return order[1:]


def equal_windows(whole: bytes, starts: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each window of ``length`` bytes, the same for equal bytes and for them only, and how often each number is met.

    Windows of one hash are compared with the first of them, stretch by
    stretch; one that differs from it is numbered by its bytes.
    """
    values, index, kind, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    met = np.flatnonzero(counts[kind] > 1)
    mine, other = starts[met], starts[index[kind[met]]]
    breaks = np.flatnonzero((np.diff(mine) != 1) | (np.diff(other) != 1)) + 1
    apart: dict[bytes, int] = {}
    for lo, hi in zip([0, *breaks.tolist()], [*breaks.tolist(), len(met)], strict=True):
        if lo == hi or mine[lo] == other[lo]:
            continue
        if whole[mine[lo] : mine[hi - 1] + length] == whole[other[lo] : other[hi - 1] + length]:
            continue
        for k in range(lo, hi):
            window = whole[mine[k] : mine[k] + length]
            if window != whole[other[k] : other[k] + length]:
                kind[met[k]] = apart.setdefault(window, len(values) + len(apart))
    return kind, np.bincount(kind, minlength=len(values) + len(apart))


def repeated_windows(regions: list[bytes], length: int) -> list[np.ndarray]:
    """For each region which of its windows of ``length`` bytes occur in another region too.

    The regions are those of one anchor, aligned by it, so a window occurs once
    in a region at most. Windows whose bytes are met once can't be repeated; of
    the others each stretch goes into the suffix array until all its windows
    are there twice. Repeated are the windows that the suffix array puts next
    to an equal one.
    """
    hashes, starts, begin = [], [], 0
    for region in regions:
        sums = prefix_sums(np.frombuffer(region, dtype=np.uint8))
        at = np.arange(len(region) - length + 1)
        hashes.append(stretch_hash(sums, at, at + length))
        starts.append(begin + at)
        begin += len(region)
    kind_of, counts = equal_windows(b"".join(regions), np.concatenate(starts), np.concatenate(hashes), length)
    bounds = np.cumsum([len(h) for h in hashes])[:-1]
    kinds = np.split(kind_of, bounds)
    need = np.where(counts > 1, 2, 0)
    text, at, asked = bytearray(), [], []
    for region, kind in zip(regions, kinds, strict=True):
        wanted = np.flatnonzero(need[kind] > 0)
        for run in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1) if len(wanted) else []:
            lo, hi = int(run[0]), int(run[-1])
            at += range(len(text), len(text) + hi - lo + 1)
            asked += kind[lo : hi + 1].tolist()
            text += region[lo : hi + length]
            need[kind[lo : hi + 1]] -= 1
    confirmed = np.zeros(len(counts), dtype=bool)
    if text:
        whole = bytes(text)
        kind_at = dict(zip(at, asked, strict=True))
        # Equal windows are neighbours among the asked ones; others, which reach into the next stretch, may lie between.
        order = [s for s in suffix_array(whole) if s in kind_at]
        for a, b in zip(order, order[1:], strict=False):
            if whole[a : a + length] == whole[b : b + length]:
                confirmed[kind_at[a]] = confirmed[kind_at[b]] = True
    return [confirmed[kind] for kind in kinds]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def slices(c1: list, c2: list, bodies: list[bytes], length: int) -> Iterator[tuple[list, list, list, list[bytes]]]:
    """Documents in portions; a very long one in slices that overlap by length - 1 bytes. Gives keys, begins and bytes."""
    keys1, keys2, begins, parts, held = [], [], [], [], 0
    for a, b, body in zip(c1, c2, bodies, strict=True):
        for at in range(0, max(1, len(body) - length + 1), SLICE):
            part = body[at : at + SLICE + length - 1]
            keys1.append(a), keys2.append(b), begins.append(at), parts.append(part)
            held += len(part)
            if held >= PORTION:
                yield keys1, keys2, begins, parts
                keys1, keys2, begins, parts, held = [], [], [], [], 0
    if parts:
        yield keys1, keys2, begins, parts


def anchor_table(source: DataFrame, length: int) -> DataFrame:
    """``c1, c2, hash, content, first, last`` of every anchor.

    ``first`` and ``last`` are window starts in the document, ``content`` is a
    128-bit digest of the windows' bytes.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [b.encode("utf-8", "surrogatepass") for b in batch.column("body").to_pylist()]
            for k1, k2, begins, parts in slices(batch.column("c1").to_pylist(), batch.column("c2").to_pylist(), bodies, length):
                joined = b"".join(parts)
                ends = np.cumsum([len(p) for p in parts])
                hashes, first, last = anchors(np.frombuffer(joined, dtype=np.uint8), ends, length)
                content = [hashlib.blake2b(joined[a : b + length], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                doc = np.searchsorted(ends, first, side="right")
                shift = (np.array(begins) - (ends - [len(p) for p in parts]))[doc] if len(doc) else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(k1, dtype=np.int64)[doc]), pa.array(np.array(k2, dtype=np.int64)[doc]), pa.array(hashes.view(np.int64)), pa.array(content, pa.binary()), pa.array(first + shift), pa.array(last + shift)],
                    ["c1", "c2", "hash", "content", "first", "last"],
                )

    return source.mapInArrow(find, "c1 long, c2 long, hash long, content binary, first long, last long")


def cut_regions(wanted: DataFrame, length: int) -> DataFrame:
    """``hash, content, region`` bytes, from rows of ``body`` and the list ``places``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, contents, regions = [], [], []
            for body, places in zip(batch.column("body").to_pylist(), batch.column("places").to_pylist(), strict=True):
                raw = body.encode("utf-8", "surrogatepass")
                for p in places:
                    hashes.append(p["hash"]), contents.append(p["content"]), regions.append(raw[p["first"] : p["last"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(contents, pa.binary()), pa.array(regions, pa.binary())], ["hash", "content", "region"])

    return wanted.mapInArrow(cut, "hash long, content binary, region binary")


def decide(regions: DataFrame, length: int) -> DataFrame:
    """``hash, content, lo, hi``: the runs of repeated windows in each region, counted from its first window.

    Rows come sorted by ``hash``; one anchor's regions are held at a time.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []

        def flush() -> pa.RecordBatch:
            found = [(h, c, lo, hi) for (h, c, _), flags in zip(held, repeated_windows([r for _, _, r in held], length), strict=True) for lo, hi in runs(flags)]
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["hash", "content", "lo", "hi"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("hash", "content", "region")], strict=True):
                if held and held[0][0] != row[0]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    return regions.mapInArrow(judge, "hash long, content binary, lo long, hi long")


def remove(bodies: DataFrame, length: int) -> DataFrame:
    """``c1, c2, n_removed, n_spans, kept_sha256, removed_spans`` from ``body`` and the list ``found`` of window runs."""
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c1, c2, body, found in zip(*[batch.column(c).to_pylist() for c in ("c1", "c2", "body", "found")], strict=True):
                raw = body.encode("utf-8", "surrogatepass")
                step = np.zeros(len(raw) + 1, dtype=np.int64)
                np.add.at(step, [f["first"] for f in found], 1)
                np.add.at(step, [f["last"] + length for f in found], -1)
                covered = np.cumsum(step)[:-1] > 0
                kept = np.frombuffer(raw, dtype=np.uint8)[~covered].tobytes()
                spans = [{"start": lo, "end": hi + 1} for lo, hi in runs(covered)]
                rows.append((c1, c2, int(covered.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["c1", "c2", "n_removed", "n_spans", "kept_sha256", "removed_spans"])

    return bodies.mapInArrow(apply, f"c1 long, c2 long, n_removed long, n_spans long, kept_sha256 string, removed_spans {SPANS}")


def with_text(source: DataFrame, keys: DataFrame, column: Column | str) -> DataFrame:
    """One row per text in ``keys`` (c1, c2 and ``column``) with its ``body``; other texts are not shuffled, copies collapse before the shuffle."""
    probed = with_membership(source, F.col("c1"), membership_filter(keys.select("c1"), "c1"), "maybe").filter("maybe")
    texts = probed.groupBy("c1", "c2").agg(F.first("body").alias("body"))
    return texts.join(keys, ["c1", "c2"]).select("c1", "c2", "body", column)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256, removed_spans`` of every row.

    Removed is each byte covered by a string of ``length`` bytes that also
    starts anywhere else in the input, in the same document or another, copies
    included. ``removed_spans`` are the maximal removed runs as byte offsets,
    the end not included. Null counts as empty; texts shorter than ``length``
    lose nothing. Rows repeated with one identifier, or without one, are copies
    like any other. An empty table gives an empty result; further columns of
    ``docs`` are ignored.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    body = F.coalesce(F.col(text_col), F.lit(""))
    # A text is named by the first 128 bits of its SHA-256.
    c1, c2 = (F.conv(F.substring(F.sha2(body, 256), at, 16), 16, -10).cast("long") for at in (1, 17))
    source = docs.select(F.col(id_col).alias("id"), body.alias("body"), c1.alias("c1"), c2.alias("c2"))
    table = scratch.table(anchor_table(source, length))
    contents = scratch.table(table.groupBy("hash", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("c1", "c2", "first", "last")).alias("one")))
    several = contents.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("hash")
    # A region that occurs twice as a whole is repeated as a whole; the others meet in suffix arrays.
    open_ = contents.join(several, "hash").select("hash", "content", "one.*")
    places = scratch.table(open_.groupBy("c1", "c2").agg(F.collect_list(F.struct("hash", "content", "first", "last")).alias("places")))
    regions = cut_regions(with_text(source, places, "places"), length)
    shards = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    partial = scratch.table(decide(regions.repartition(4 * shards, "hash").sortWithinPartitions("hash"), length))
    whole = contents.filter("n > 1").select("hash", "content", F.lit(0).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    verdicts = whole.unionByName(partial.join(whole.select("hash", "content"), ["hash", "content"], "left_anti"))
    windows = table.join(verdicts, ["hash", "content"]).select("c1", "c2", (F.col("first") + F.col("lo")).alias("a"), F.coalesce(F.col("first") + F.col("hi"), F.col("last")).alias("b"))
    found = scratch.table(windows.distinct().groupBy("c1", "c2").agg(F.collect_list(F.struct(F.col("a").alias("first"), F.col("b").alias("last"))).alias("found")))
    removed = scratch.table(remove(with_text(source, found, "found"), length))
    facts = source.select("id", "c1", "c2", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("own"))
    result = facts.join(removed, ["c1", "c2"], "left")
    zero = F.lit(0).cast("long")
    return result.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "own").alias("kept_sha256"),
        F.coalesce("removed_spans", F.array().cast(SPANS)).alias("removed_spans"),
    )
