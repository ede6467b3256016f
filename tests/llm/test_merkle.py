"""The manifest against a tree built level by level in lists."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomline.llm.common import lower_ascii
from fathomline.llm.merkle import Appender, Witness, digest, manifest
from fathomline.llm.queries import ORACLE_SQL, op13_merkle_manifest

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 16])))
        i //= 16
    return out


def brute(rows):
    leaf = lambda r: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = {}
    for r in rows:
        shown = r
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            shown = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), leaf(shown)))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels_of([x[2] for x in sorted(groups[k])]) for k in keys}
    top = levels_of([trees[k][-1][0] for k in keys])
    out = []
    for j, k in enumerate(keys):
        for i, x in enumerate(sorted(groups[k])):
            way = siblings(trees[k], i) + siblings(top, j)
            node = x[3]
            for left, right in way:
                node = h(left + node + right)
            out.append((x[1] if x[0] else None, x[2], trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in way)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def checked(docs):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    shown = F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return manifest(docs, presented=[F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), shown])


def test_given_documents_and_twin(spark, sf_dir):
    df = op13_merkle_manifest(spark, sf_dir)
    got = sorted(map(tuple, df.collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.sql(ORACLE_SQL["op13_merkle_manifest"]).fetchall(), key=repr)
    assert got == brute(con.sql("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall())


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257, 4095, 4097, 9000])
def test_heights(spark, n):
    """Sources of one leaf, of full and of barely overfull runs, and one of several blocks; a null and an empty source."""
    rows = [(i, "big", None, i, f"T{i}") for i in range(n)] + [(i, s, "en", 1, "X é") for i, s in enumerate([None, "", "a", "é", None, "B"])]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert sorted(map(tuple, checked(df).collect()), key=repr) == brute(rows)


def test_many_sources(spark):
    rows = [(i, f"s{i % 300}", "en", i, None) for i in range(600)]
    assert sorted(map(tuple, checked(spark.createDataFrame(rows, COLUMNS)).collect()), key=repr) == brute(rows)


def test_odd_empty_and_clashing(spark, odd, empty):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    wide = odd.withColumns({c: F.lit(c) for c in ("key", "pos", "node", "levels", "block", "id", "leaf", "root", "siblings")})
    assert sorted(map(tuple, checked(wide).collect()), key=repr) == brute(rows)
    none = checked(empty)
    assert none.collect() == [] and none.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_siblings_lead_to_the_root(spark):
    rows = [(i, "ab"[i % 2], "en", i, f"Text {i}") for i in range(70)]
    for r in manifest(spark.createDataFrame(rows, COLUMNS), siblings=True).collect():
        node = r.leaf
        for s in r.siblings:
            node = digest(s.left, node, s.right)
        assert node == r.root == r.folded_root and r.verified


def test_witnesses_grow_as_siblings_complete():
    tree, ws = Appender(2), [Witness() for _ in range(20)]
    for i, w in enumerate(ws[:15]):
        tree.append(h(str(i)), [w])
    assert not any(w.levels for w in ws)
    tree.append(h("15"), [ws[15]])
    assert [len(w.levels) for w in ws[:16]] == [1] * 16 and not ws[16].levels
    for i in range(16, 20):
        tree.append(h(str(i)), [ws[i]])
    levels = levels_of([h(str(i)) for i in range(20)])
    assert tree.finish() == levels[-1][0] and [w.levels for w in ws] == [siblings(levels, i) for i in range(20)]
