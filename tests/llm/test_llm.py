"""Each operator against a brute-force version on small tables, and on odd ones."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter as Count
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomline.llm import queries
from fathomline.llm.decontamination import LEAST_WORDS, MASKS, WINDOW_WORDS, contaminated, drop_contaminated
from fathomline.llm.exact_dedup import drop_exact_copies, lsm_dedup
from fathomline.llm.ngram_join import drop_similar, similar_components
from fathomline.llm.packing import fill, pack, plan
from fathomline.llm.quality import fit_quality, score_quality
from fathomline.llm.sharding import label_propagation_shards, quotas
from fathomline.llm.suffix_dedup import remove_repeats, suffix_array
from fathomline.llm.token_counts import count_tokens
from fathomline.llm.toxicity import fit_toxicity, held_out, marginals, score_toxicity
from fathomline.llm.url_filter import judge_urls

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    odds = rng.random(11) * 3
    first = np.array([True, False, False, True, True, False, False, False, False, False, False])
    stay = np.array([[1.0, 0.4], [0.7, 1.9]])
    p, expected = marginals(odds, first, 0.8, stay)
    want, pairs, begin = [], np.zeros((2, 2)), 0
    for end in [3, 4, 11]:
        total, hit = 0.0, np.zeros(end - begin)
        seen = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=end - begin):
            w = np.prod([odds[begin + t] if v else 1.0 for t, v in enumerate(y)]) * (0.8 if y[0] else 1.0)
            for a, b in zip(y, y[1:], strict=False):
                w *= stay[a, b]
            total += w
            hit += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                seen[a, b] += w
        want += list(hit / total)
        pairs += seen / total
        begin = end
    assert p == pytest.approx(want)
    assert expected == pytest.approx(pairs)


def test_toxicity_learns_planted_words(spark, odd, empty):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    rows = []
    for i in range(600):
        words = list(rng.choice(vocabulary, 40))
        toxic = i % 3 == 0
        if toxic:
            words[5] = ["zorgum", "quaxel", "zorgumik"][i // 3 % 3]
        rows.append((i, " ".join(words), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.select("doc_id", "toxic").filter(~held_out())
    model = fit_toxicity(table.select("doc_id", "text"), labels)
    got = score_toxicity(table, model).filter(held_out()).collect()
    assert all((r.score >= 0.5) == bool(r.toxic) for r in got)
    assert all(r.text[r.toxic_spans[0].start : r.toxic_spans[0].end].startswith(("zorgum", "quaxel")) for r in got if r.toxic)
    marked = score_toxicity(odd, model).collect()
    assert len(marked) == 12 and all(0 <= r.score <= 1 for r in marked)
    assert score_toxicity(empty, fit_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_quality_held_out(spark, odd, empty, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = fit_quality(docs, labels.filter(~held_out()))
    got = score_quality(docs, model).join(labels, "doc_id").filter(held_out()).collect()
    assert np.mean([(r.score >= 0.3) == bool(r.quality) for r in got]) > 0.93
    assert all(0 <= r.score <= 1 for r in score_quality(odd, model).collect())
    assert score_quality(empty, fit_quality(empty, labels.limit(0))).count() == 0


def shingles(text, k):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_components(texts, k, percent):
    sets = {d: shingles(t, k) for d, t in texts.items()}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_ngram_join(spark, texts, docs, odd, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(docs, k=4, percent=85).collect()}
    assert got == brute_components(texts, 4, 85)
    few = {r.doc_id: r.component_id for r in similar_components(odd, k=4, percent=85).collect()}
    assert few == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 4, None: None, 8: 8, 9: 8, 10: 10, 11: 11}
    assert similar_components(empty).count() == 0
    kept = drop_similar(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 8, 10, 11]


def test_ngram_join_of_a_large_group(spark):
    """Near copies of one text, some linked in chains only, all in the same buckets."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = {}
    for i in range(120):
        words = list(base)
        for j in rng.choice(60, rng.integers(0, 6), replace=False):
            words[j] = f"x{rng.integers(0, 3)}"
        rows[i] = " ".join(words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), k=4, percent=85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_swaps_keep_sizes():
    rng = np.random.default_rng(2)
    wanted = rng.integers(0, 50, (6, 6))
    np.fill_diagonal(wanted, 0)
    free = rng.integers(0, 40, 6)
    allowed, left = quotas(wanted, free)
    assert (allowed <= wanted).all() and (left >= 0).all()
    assert (allowed.sum(axis=0) - allowed.sum(axis=1) + left - free == 0).all()


def test_sharding(spark, docs, texts, odd, empty):
    got = label_propagation_shards(docs, shards=7).collect()
    sizes = Count(r.shard for r in got)
    assert len(got) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    places = defaultdict(list)
    groups = defaultdict(set)
    for r in got:
        body = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(body) + 8, zlib.crc32(body))
        places[r.shard].append(r.slot)
        groups[body].add(r.shard)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(len(s) == 1 for s in groups.values())
    assert sorted(Count(r.shard for r in label_propagation_shards(odd, shards=5).collect()).values()) == [2, 2, 2, 3, 3]
    assert label_propagation_shards(empty).count() == 0
    hot = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    spread = label_propagation_shards(hot, shards=10).collect()
    assert set(Count(r.shard for r in spread).values()) == {10}
    assert len({r.shard for r in spread if r.doc_id % 2 == 0}) <= 6


def test_fill_is_closest():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = np.zeros(61, dtype=np.int64)
        for length in rng.choice(np.arange(1, 60), 5, replace=False):
            counts[length] = rng.integers(1, 4)
        used = fill(counts, 60)
        items = [n for n in range(61) for _ in range(counts[n])]
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= 60)
        assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())
    counts = np.zeros(1025, dtype=np.int64)
    counts[1:1024] = rng.integers(0, 1000, 1023)
    windows = plan(counts)
    total = np.zeros_like(counts)
    for used, times in windows:
        assert sum(n * k for n, k in used.items()) <= 1024
        for n, k in used.items():
            total[n] += k * times
    assert (total == counts).all()
    assert 1 - (counts * np.arange(1025)).sum() / (1024 * sum(t for _, t in windows)) < 0.05


def check_packing(rows, texts):
    t = Tokenizer.from_file(BPE)
    ids = {d: np.array([*e.ids, 0], dtype="<u4") for d, e in zip(texts, t.encode_batch([x or "" for x in texts.values()], add_special_tokens=False), strict=True)}
    at, sequences = Count(), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert at == {d: len(i) for d, i in ids.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024


def test_packing(spark, docs, texts, odd, empty):
    check_packing(pack(docs, BPE).collect(), texts)
    single = odd.filter("doc_id is not null and doc_id <> 6")
    check_packing(pack(single, BPE).collect(), {r.doc_id: r.text for r in single.collect()})
    assert pack(odd, BPE).agg(F.sum("length")).first()[0] > 0
    assert pack(empty, BPE).count() == 0


def test_token_counts(spark, odd, empty):
    rng = np.random.default_rng(4)
    pool = list("ab'srelvmdt \n\té中1२!<|>_😀  ")
    hard = ["".join(rng.choice(pool, rng.integers(0, 400))) for _ in range(150)] + ["it's we'll 's !'s  ''re", "x" * 3000, "a<|endoftext|> b<|endoftext|>", "  \n a", "don't'll\x85\x1c"]
    table = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    t = Tokenizer.from_file(BPE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(table, BPE).collect()}
    for i, x in enumerate(hard):
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert got[i] == (len(x.encode()), n, n > 1024)
    assert {r.doc_id: r.n_tokens for r in count_tokens(odd, BPE).collect()}[1] == 0
    assert count_tokens(empty, BPE).count() == 0


def test_masks_hit_every_tolerated_alignment():
    for n in range(LEAST_WORDS, WINDOW_WORDS + 1):
        for wrong in itertools.combinations(range(n), n // 5):
            bad = set(wrong)
            assert any(not bad & {p + o for o in mask} for mask in MASKS for p in range(n - mask[-1]))


def test_decontamination(spark, odd, empty):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    items = [[word() for _ in range(n)] for n in (8, 12, 20, 30, 57)]
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (10, "too short")], "item_id long, text string")
    rows, want = [], set()
    for i in range(60):
        body = [word() for _ in range(50)]
        k = i % 5
        part = list(items[k])
        wrong = int(len(part) * (0.2 if i < 30 else 0.5))
        for j in rng.choice(len(part), wrong, replace=False):
            part[j] = word()
        rows.append((i, " ".join(body[:20] + part + body[20:]).title()))
        # The rule itself, by brute force.
        text, item = rows[-1][1].lower().split(), items[k]
        size = min(24, len(item))
        if any(sum(0 <= d + j < len(text) and text[d + j] == item[j] for j in range(s, s + size)) >= np.ceil(0.8 * size - 1e-9) for d in range(-len(item), len(text)) for s in range(len(item) - size + 1)):
            want.add((i, k))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(table, tests).collect()} == want and len(want) >= 25
    assert drop_contaminated(table, tests).count() == 60 - len({d for d, _ in want})
    assert drop_contaminated(odd, tests).count() == 12 and drop_contaminated(odd, tests).columns == odd.columns
    assert contaminated(empty, tests).count() == 0 and contaminated(table, tests.limit(0)).count() == 0


@pytest.mark.parametrize("memtable", [2_000_000, 40, 7])
def test_exact_dedup(spark, docs, texts, memtable):
    groups = defaultdict(list)
    for d, t in texts.items():
        groups[t].append(d)
    want = {(d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    assert {tuple(r) for r in lsm_dedup(docs, keep="largest", memtable_rows=memtable).collect()} == want


def test_exact_dedup_odd(spark, odd, empty):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in lsm_dedup(odd).collect()}
    assert got[11] == (1, 3, False) and got[6] == (4, 3, False) and got[5] == (5, 1, True) and got[None] == (None, 1, True)
    kept = drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 8, 9, 10]
    assert lsm_dedup(empty).count() == 0 and drop_exact_copies(empty).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(7)
    for k in range(400):
        text = bytes(rng.choice(list(b"ab" if k % 2 else b"abcd"), rng.integers(0, 30)).astype(np.uint8)) * (1 + k % 3)
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_removal(texts, length):
    seen = Count(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for d, t in texts.items():
        covered = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = True
        kept = bytes(b for b, c in zip(t, covered, strict=False) if not c)
        out[d] = (len(t), int(covered.sum()), int((covered[1:] < covered[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, texts, odd, empty):
    rows = remove_repeats(docs).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == brute_removal({d: t.encode() for d, t in texts.items()}, 400)
    for r in rows:
        raw, at = texts[r.doc_id].encode(), [0, *(x for s in r.removed_spans for x in s), r.n_bytes]
        assert len(r.removed_spans) == r.n_spans and at == sorted(at)
        assert hashlib.sha256(b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2], strict=True))).hexdigest() == r.kept_sha256
    few = {r.doc_id: r.n_removed for r in remove_repeats(odd, length=100).collect()}
    assert few[1] == few[4] == 0 and few[8] > 50_000 and few[9] == few[8]
    assert remove_repeats(empty).count() == 0


def test_url_rules(spark, empty):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "org"), ("allow", "a.org/x")]
    urls = ["http://Example.com/en/71?q", "https://x.example.com/en/8", "http://example.com", "http://com/en/", "http://notcom/en/", None, "", "nothing", "ftp://b.ORG#f", "http://a.org/xy", "http://a.org:8/xy"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()]
    assert got == [
        ("example.com", "/en/71", "example.com/en/7", "allow"), ("x.example.com", "/en/8", "com/en/", "block"), ("example.com", "", None, "allow"), ("com", "/en/", "com/en/", "block"), ("notcom", "/en/", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.org", "", "org", "block"), ("a.org", "/xy", "a.org/x", "allow"), ("a.org:8", "/xy", None, "allow"),
    ]
    assert judge_urls(empty.withColumnRenamed("text", "url"), rules).count() == 0
    assert judge_urls(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), []).first().verdict == "allow"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    twin = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, sf_dir).select(twin.columns)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(twin.fetchall(), key=repr)


def thue_morse(n, letters="ab"):
    word = letters[0]
    while len(word) < n:
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


def test_words_that_powers_of_two_confuse(spark):
    """A Thue-Morse word and its complement agree under any polynomial modulo 2**64; they are different words."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"{one} {other} c d e"), (4, f"{one} {one} c d e"), (5, one)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(docs, k=4, percent=85).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 3), 4: (2, 4), 5: (1, 1)}


def test_hosts_of_many_labels(spark):
    """Only as many labels as a rule's host has are looked at, so a host of 100,000 labels is one of a few probes."""
    rules = [("block", "com/"), ("allow", "a.example.com/x")]
    urls = [("http://" + "l." * 100_000 + "com/y",), ("http://" + "l." * 100_000 + "a.example.com/xy",), ("http://com/",), ("http://" + "." * 1000 + "/",), (None,)]
    began = time.perf_counter()
    got = judge_urls(spark.createDataFrame(urls, "url string"), rules).collect()
    assert [(r.rule, r.verdict) for r in got] == [("com/", "block"), ("a.example.com/x", "allow"), ("com/", "block"), (None, "allow"), (None, "allow")]
    assert time.perf_counter() - began < 20
