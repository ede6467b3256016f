"""Similarity join on word n-grams by prefix filters under several global token orders."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch, drop_ids, fresh, membership_filter, with_membership, with_row_key
from fathomline.llm.components import connected_components

#: Counters of shingles, 2 to these powers; a worker holds one byte of each, 128 MB at most, and one bit of each is broadcast.
LEAST_BITS = 20
MOST_BITS = 27
BLOCK = 1 << 14
LEAST_COMMON = 16
#: Members up to which all pairs of a bucket of prefix tokens are looked at; larger ones are centred on a pivot.
PAIRED = 100
#: The same for buckets of differences from a pivot.
COMPARED = 1024
#: How often large buckets are centred anew before all their pairs are looked at.
LEVELS = 3
ORDERS = 3
PORTION = 1_000_000
#: Rows of an Arrow batch: two sets of a long text each are some 300 KB a row.
BATCH = 256
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Primes and bases of the word hash: two polynomials modulo primes, so that no word is hit by the structure of powers of two.
FIELDS = ((2147483647, 1103515245), (2147483629, 1566083941))
#: Words are hashed in runs of about this many bytes, which bounds the memory; a longer word is a run of its own.
RUN = 1 << 19
#: Up to this many bytes a sum of byte times power stays below 2**64.
UNREDUCED = 1 << 24
_powers: dict[int, list[np.ndarray]] = {}


def powers(n: int) -> list[np.ndarray]:
    """For each field, powers of its base, at least n of them."""
    size = 1 << max(10, n.bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = [np.ones(size, dtype=np.uint64) for _ in FIELDS]
        for steps, (prime, base) in zip(_powers[size], FIELDS, strict=True):
            have = 1
            while have < size:
                steps[have : 2 * have] = steps[:have] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
                have *= 2
    return _powers[size]


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes, 62 bits from two fields and its length."""
    out = np.zeros(len(starts), dtype=np.uint64)
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + RUN)))
        sizes = ends[begin:end] - starts[begin:end]
        at = np.cumsum(sizes) - sizes
        within = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
        values = data[within + np.repeat(starts[begin:end], sizes)].astype(np.uint64) + np.uint64(1)
        longest = int(sizes.max())
        for (prime, _), up in zip(FIELDS, powers(longest), strict=True):
            terms = values * up[within]
            sums = np.add.reduceat(terms if longest < UNREDUCED else terms % np.uint64(prime), at) % np.uint64(prime)
            out[begin:end] = (out[begin:end] << np.uint64(31)) | sums
        begin = end
    return mix(out ^ mix((ends - starts).astype(np.uint64), 3))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles.

    A-Z count as a-z; words are cut at space and tab to carriage return. A
    text of fewer than k words is one shingle, one without words has none.
    Word hashes come from prefix sums over all bytes of all texts at once.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
    with np.errstate(over="ignore"):
        inside = np.concatenate([[False], ~_BLANK[data]])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        words = stretch_hashes(data, starts, ends)
        borders = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
        grams = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
        for j in range(k):
            grams = grams * np.uint64(BASE) + words[j : j + len(grams)]
        grams = mix(grams)
        out, begin = [], 0
        for end in borders.tolist():
            if end - begin >= k:
                out.append(np.unique(grams[begin : end - k + 1]))
            elif end > begin:
                whole = reduce(lambda h, w: h * np.uint64(BASE) + w, words[begin:end], np.uint64(end - begin))
                out.append(mix(np.array([whole], dtype=np.uint64), 7))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            begin = end
    return out


def arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column of hashes."""
    values, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(at, at[1:], strict=False))


def ordered(grams: np.ndarray, order: int, last: np.ndarray, take: int) -> np.ndarray:
    """The first ``take`` of a set under one global order: those marked in ``last`` behind the others, else by a hash of the order's own."""
    with np.errstate(over="ignore"):
        rank = (mix(grams, 100 + order) >> np.uint64(2)) | (last.astype(np.uint64) << np.uint64(62))
    take = min(take, len(grams))
    if not take:
        return grams[:0]
    first = np.argpartition(rank, take - 1)[:take]
    return grams[first[np.argsort(rank[first])]]


class Common:
    """Which shingles are common, as a bitmap over their counters."""

    def __init__(self, counter_bits: int, bits: np.ndarray):
        self.shift, self.bits = np.uint64(64 - counter_bits), bits

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        slot = grams >> self.shift
        return ((self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)


def prefix(grams: np.ndarray, percent: int, order: int, common: Common) -> np.ndarray:
    """The first shingles of a set under one global order, common ones last.

    Two sets whose Jaccard similarity reaches ``percent`` share one of their
    first n - ceil(n * percent / 100) + 1 shingles, whatever the order.
    """
    return ordered(grams, order, common(grams), len(grams) + (-percent * len(grams) // 100) + 1)


def batched(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PORTION or i == len(texts) - 1:
            yield ids[begin : i + 1], texts[begin : i + 1]
            begin, size = i + 1, 0


def lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(parts).view(kind) if parts else np.zeros(0, kind))


def common_shingles(source: DataFrame, k: int, scratch: Scratch) -> Common:
    """The shingles that are in many documents.

    They are counted over all of ``source``, in counters that shingles share by
    hash: about one for four shingles, 2**LEAST_BITS to 2**MOST_BITS of them. Each task adds
    up its own, and blocks of counters are added across tasks. Common is what
    is counted well above what chance puts into a counter; the driver gets one
    bit of each. Only costs depend on it, never the result.
    """
    size = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    counter_bits = max(LEAST_BITS, min(MOST_BITS, int(size // 24).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << counter_bits, dtype=np.uint8)
        for batch in batches:
            for _, texts in batched([0] * batch.num_rows, batch.column("body").to_pylist()):
                at, times = np.unique(np.concatenate(shingle_sets(texts, k)) >> np.uint64(64 - counter_bits), return_counts=True)
                seen[at] = np.minimum(seen[at] + times, 255)
        for b in range(len(seen) // BLOCK):
            part = seen[b * BLOCK : (b + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, part in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                totals[b] = totals.get(b, np.zeros(BLOCK, dtype=np.uint32)) + np.frombuffer(zlib.decompress(part), dtype=np.uint8)
        for b, part in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([int(part.sum())], pa.int64())], ["block", "counts", "total"])

    counted = source.select("body").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary, total long")
    counted = scratch.table(counted)
    mean = (counted.agg(F.sum("total")).first()[0] or 0) / (1 << counter_bits)
    limit = mean + 6 * mean**0.5 + LEAST_COMMON

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(c, dtype=np.uint32) > limit, bitorder="little").tobytes() for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(bits, pa.binary())], ["block", "bits"])

    marked = np.zeros((1 << counter_bits) // 8, dtype=np.uint8)
    for row in counted.mapInArrow(mark, "block int, bits binary").collect():
        marked[row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    scratch.drop(counted)
    return Common(counter_bits, marked)


def sketches(source: DataFrame, k: int, percent: int, common: Broadcast) -> DataFrame:
    """``id, n, k1, k2, rare, prefix``: set size, two hashes of the whole set, its prefix under the first order and how many of that are not common."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in batched(batch.column("id").to_pylist(), batch.column("body").to_pylist()):
                sets = shingle_sets(texts, k)
                with np.errstate(over="ignore"):
                    k1 = np.array([mix(s, 1).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                    k2 = np.array([np.bitwise_xor.reduce(mix(s, 2)) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
                leading = [prefix(s, percent, 0, common.value) for s in sets]
                rare = [int((~common.value(p)).sum()) for p in leading]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field("id").type), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), pa.array(rare, pa.int32()), lists(leading)],
                    ["id", "n", "k1", "k2", "rare", "prefix"],
                )

    return source.mapInArrow(sketch, f"id {source.schema['id'].dataType.simpleString()}, n long, k1 long, k2 long, rare int, prefix array<long>")


def further_prefixes(source: DataFrame, k: int, percent: int, common: Broadcast) -> DataFrame:
    """``id, p1, p2, ...``: the prefixes under the further orders, as 32-bit hashes, which may agree by chance but never miss."""
    names = [f"p{o}" for o in range(1, ORDERS)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in batched(batch.column("id").to_pylist(), batch.column("body").to_pylist()):
                sets = shingle_sets(texts, k)
                parts = [lists([prefix(s, percent, o, common.value).astype(np.uint32) for s in sets], np.int32) for o in range(1, ORDERS)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), *parts], ["id", *names])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(make, f"id {kind}, " + ", ".join(f"{p} array<int>" for p in names))


def full_sets(source: DataFrame, k: int) -> DataFrame:
    """``id, grams``: the whole sets."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in batched(batch.column("id").to_pylist(), batch.column("body").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), lists(shingle_sets(texts, k))], ["id", "grams"])

    return source.mapInArrow(make, f"id {source.schema['id'].dataType.simpleString()}, grams array<long>")


def ends_of(source: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``source`` that may occur in ``pairs`` (columns a, b); the others are not shuffled."""
    ends = pairs.select(F.xxhash64("a").alias("key")).unionByName(pairs.select(F.xxhash64("b").alias("key")))
    return with_membership(source, F.xxhash64("id"), membership_filter(ends, "key"), "maybe").filter("maybe").drop("maybe")


def of_pairs(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """The pairs with ``columns`` of both ends."""
    left, right = (sets.select(F.col("id").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in columns]) for e in ("a", "b"))
    return pairs.join(right, "b").join(left, "a")


def needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """How many shingles sets of these sizes must have in common."""
    return F.ceil((n_a + n_b) * percent / F.lit(100.0 + percent) - 1e-9)


def like_sizes(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def share_prefixes(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose ends share a prefix token under every further order."""
    orders = [f"p{o}" for o in range(1, ORDERS)]
    shared = reduce(lambda x, y: x & y, [F.arrays_overlap(f"a_{p}", f"b_{p}") for p in orders])
    return of_pairs(pairs, sets, *orders).filter(shared).select(pairs.columns)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity."""
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    whole = of_pairs(pairs.select("a", "b"), sets, "grams")
    return whole.filter(both * 100 >= (F.size("a_grams") + F.size("b_grams") - both) * percent).select("a", "b").distinct()


def recentred(members: DataFrame, sets: DataFrame, percent: int, common: Broadcast) -> DataFrame:
    """``pivot, rep, n, size, same, away, tokens``: how each member's set differs from its pivot's.

    ``size`` is the pivot's, ``same`` what both have in common, ``away`` how
    many shingles only one of them has. Taking the same set away from two sets
    doesn't change in how many shingles they differ; what all members of a
    group have is gone from the differences, though. ``tokens`` is a prefix of
    the difference, long enough for two similar members to share one of it.
    It has what only the member has and is not common first, then common
    shingles that it lacks; what most members will have in theirs comes last.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = (arrays(batch.column(c)) for c in ("grams", "pivot_grams"))
            sizes, tokens = [], []
            for x, p in zip(mine, other, strict=True):
                only, lacks = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
                same, away = len(x) - len(only), len(only) + len(lacks)
                # Of an earlier kind first: 0 own and rare, 1 lacking and common, 2 own and common, 3 lacking and rare.
                kind = np.concatenate([common.value(only) * 2, 3 - common.value(lacks) * 2])
                value = (100 + percent) * same - percent * len(x)
                near = (percent * len(p) - value) <= 0  # similar to the pivot
                gap = (100 * len(p) - value) // (100 + percent) + 1 if near else -((value - percent * len(p)) // (100 + percent))
                shared = max(1, gap, away - (100 - percent) * len(x) // percent)
                tokens.append(ordered(np.concatenate([only, lacks]), 50, kind, away - shared + 1 if away >= shared else 0))
                sizes.append((len(x), len(p), same, away))
            columns = list(zip(*sizes, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("rep"), *[pa.array(c, pa.int64()) for c in columns], lists(tokens)], ["pivot", "rep", "n", "size", "same", "away", "tokens"])

    kind = sets.schema["id"].dataType.simpleString()
    own, pivots = (sets.select(F.col("id").alias(e), F.col("grams").alias(g)) for e, g in (("rep", "grams"), ("pivot", "pivot_grams")))
    joined = members.join(own, "rep").join(pivots, "pivot").select("pivot", "rep", "grams", "pivot_grams")
    return joined.mapInArrow(compare, f"pivot {kind}, rep {kind}, n long, size long, same long, away long, tokens array<long>")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """``id_col, n_shingles, component_id`` of every row: the classes of documents linked by a Jaccard similarity of ``percent`` / 100 or more.

    Null and empty texts, and texts of blanks, have no shingle and are linked
    with nothing. A row without identifier is linked with nothing either and
    has a null component. Rows repeated with one identifier count as one
    document. ``component_id`` is the least identifier of the component. An
    empty table gives an empty result; further columns of ``docs`` are ignored.

    Documents of equal sets form one class, and classes are joined. Buckets
    are the prefix tokens under the first order. All pairs of a small bucket
    that the places of their tokens and the other orders leave are verified,
    the likeliest first; pairs inside a component need no look. A large bucket
    is centred on one of its classes, the pivot: all are compared with it, and
    two that are both unlike it can only be similar if prefixes of their
    differences from it meet. These are buckets again, and large ones of them
    are centred anew. Nothing is left out, so no link between components is lost.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    scratch.arrow_rows = BATCH
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    named = source.filter("id is not null")
    common = spark.sparkContext.broadcast(common_shingles(named, k, scratch))
    sketched = scratch.table(sketches(source, k, percent, common))
    alike = sketched.filter("n > 0 and id is not null").groupBy("k1", "k2", "n")
    classes = scratch.table(alike.agg(F.min("id").alias("rep"), F.min("rare").alias("rare"), F.min("prefix").alias("prefix")))

    entries = classes.select("rep", "n", F.col("rare").alias("off"), F.posexplode("prefix").alias("at", "bucket"))
    # Shingles that are not common are in few documents, so no bucket of them is too large for a window.
    rare = entries.filter("at < off").withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).filter("members > 1")
    often = entries.filter("at >= off")
    often = often.join(often.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "bucket")
    shared = scratch.table(rare.unionByName(often))
    links: DataFrame | None = None
    tried: DataFrame | None = None
    components: DataFrame | None = None

    def join_up(found: DataFrame) -> None:
        nonlocal links, components
        links = found if links is None else links.unionByName(found)
        components = connected_components(links, scratch).drop("changed")

    def likely_of(pairs: DataFrame) -> DataFrame:
        """The pairs that the other orders leave, too."""
        others = scratch.table(further_prefixes(ends_of(named, pairs), k, percent, common))
        likely = scratch.table(share_prefixes(pairs, others))
        scratch.drop(others, pairs)
        return likely

    def attempt(candidates: DataFrame) -> None:
        """Verifies those candidates that were not tried yet; then joins the components anew."""
        nonlocal tried
        now = candidates.select("a", "b").distinct()
        now = scratch.table(now.join(tried, ["a", "b"], "left_anti") if tried is not None else now)
        tried = now if tried is None else tried.unionByName(now)
        sets = scratch.table(full_sets(ends_of(named, now), k))
        join_up(scratch.table(verify(now, sets, percent)))
        scratch.drop(sets)

    def apart(candidates: DataFrame) -> DataFrame:
        """Candidates whose ends are in different components."""
        with_a = candidates.join(components.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        with_b = with_a.join(components.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        return with_b.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))

    def placed(rows: DataFrame) -> DataFrame:
        """The rows with their component, without buckets that lie within one."""
        with_component = rows.join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        spread = with_component.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("total")).filter("lo <> hi")
        return with_component.join(spread.select("bucket", "total"), "bucket")

    def other(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select("bucket", *[F.col(c).alias(f"o_{c}") for c in ("rep", "n", "at", *columns)])

    small = shared.filter(F.col("members") <= PAIRED)
    met = small.join(other(small), "bucket").filter(F.col("rep") < F.col("o_rep"))
    reach = F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at")) >= needed(F.col("n"), F.col("o_n"), percent)
    met = met.filter(like_sizes(F.col("n"), F.col("o_n"), percent) & reach)
    likely = likely_of(scratch.table(met.groupBy(F.col("rep").alias("a"), F.col("o_rep").alias("b")).count()))
    best = Window.partitionBy("b").orderBy(F.desc("count"), "a")
    attempt(likely.withColumn("k", F.row_number().over(best)).filter("k = 1"))
    attempt(apart(likely))
    scratch.drop(likely)

    large = shared.filter(F.col("members") > PAIRED).select("rep", "bucket", "off")
    for level in range(LEVELS):
        here = scratch.table(placed(large))
        if here.isEmpty():
            break
        # The member that has least of its own; which one it is makes no difference to the result.
        pivots = here.groupBy("bucket").agg(F.min(F.struct("off", F.xxhash64("rep").alias("h"), "rep")).alias("least"))
        members = scratch.table(here.join(pivots.select("bucket", F.col("least.rep").alias("pivot")), "bucket").select("rep", "pivot").distinct())
        sets = scratch.table(full_sets(ends_of(named, members.select(F.col("rep").alias("a"), F.col("pivot").alias("b"))), k))
        compared = scratch.table(recentred(members, sets, percent, common))
        scratch.drop(here, members, sets)
        similar = F.col("same") * 100 >= (F.col("n") + F.col("size") - F.col("same")) * percent
        join_up(scratch.table(compared.filter(similar & (F.col("rep") != F.col("pivot"))).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()))
        # Ends of two differences need this much in common beside what the pivot has.
        rows = compared.select("rep", "n", "size", "same", "away", F.posexplode("tokens").alias("at", "token"), F.xxhash64("pivot", "token").alias("bucket")).drop("token")
        spread = scratch.table(placed(rows))
        near = spread.filter(F.col("total") <= COMPARED) if level + 1 < LEVELS else spread
        met = near.join(other(near, "same", "away", "component"), "bucket").filter((F.col("rep") < F.col("o_rep")) & (F.col("component") != F.col("o_component")))
        left = F.least(F.col("away") - F.col("at"), F.col("o_away") - F.col("o_at"))
        met = met.filter(like_sizes(F.col("n"), F.col("o_n"), percent) & (left >= needed(F.col("n"), F.col("o_n"), percent) + F.col("size") - F.col("same") - F.col("o_same")))
        attempt(likely_of(scratch.table(met.select(F.col("rep").alias("a"), F.col("o_rep").alias("b")).distinct())))
        large = spread.filter(F.col("total") > COMPARED).select("rep", "bucket", F.col("away").alias("off"))

    labelled = classes.select("k1", "k2", "n", "rep").join(components.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    placed_docs = sketched.select("id", "n", "k1", "k2").join(labelled, ["k1", "k2", "n"], "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    result = scratch.table(placed_docs.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id")))
    scratch.keep(result)
    return result


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that are linked to a document of a lesser identifier; rows without identifier stay.

    Where an identifier stands for several texts, each of them is a document.
    Null and empty texts stay, as do all repeats of a row that stays. Further
    columns pass unchanged, whatever their names; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "similar-dropped")
    (key,) = fresh(docs.columns, "_key")
    keyed = with_row_key(docs, id_col, text_col, key)
    classes = similar_components(keyed.select(key, text_col), key, text_col, k, percent, scratch)
    dropped = scratch.table(classes.filter(F.col(key) != F.col("component_id")).select(key).distinct())
    scratch.keep(dropped)
    return drop_ids(keyed, key, dropped, key).select(docs.columns)
