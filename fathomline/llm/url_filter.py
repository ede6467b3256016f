"""URL rules in a sorted array of 64-bit digests, memory-mapped by the workers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import fresh, lower_ascii

Rule = tuple[str, str]  # verdict, host followed by path


class DigestArray:
    """Rules as three mapped arrays: sorted digests, text offsets, and the texts themselves.

    A probe is a vectorised binary search over the digests; the stored string
    is compared in full, so two rules of one digest are both looked at.
    """

    def __init__(self, folder: str):
        self.keys = np.load(f"{folder}.keys.npy", mmap_mode="r")
        self.ends = np.load(f"{folder}.ends.npy", mmap_mode="r")
        self.verdicts = np.load(f"{folder}.verdicts.npy", mmap_mode="r")
        self.texts = np.load(f"{folder}.texts.npy", mmap_mode="r")

    @staticmethod
    def write(rules: Sequence[Rule], folder: str) -> list[str]:
        rows = sorted({text: verdict for verdict, text in rules}.items(), key=lambda r: (xxhash.xxh64_intdigest(r[0].encode()), r[0]))
        encoded = [text.encode() for text, _ in rows]
        np.save(f"{folder}.keys.npy", np.array([xxhash.xxh64_intdigest(e) for e in encoded], dtype=np.uint64))
        np.save(f"{folder}.ends.npy", np.cumsum([0, *map(len, encoded)], dtype=np.int64))
        np.save(f"{folder}.verdicts.npy", np.array([v == "allow" for _, v in rows], dtype=bool))
        np.save(f"{folder}.texts.npy", np.frombuffer(b"".join(encoded), dtype=np.uint8))
        return [f"{folder}.{part}.npy" for part in ("keys", "ends", "verdicts", "texts")]

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """The index of the rule equal to each candidate, else -1."""
        digests = np.fromiter((xxhash.xxh64_intdigest(c) for c in candidates), dtype=np.uint64, count=len(candidates))
        at = np.searchsorted(self.keys, digests)
        found = np.full(len(candidates), -1, dtype=np.int64)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:
                if self.texts[self.ends[j] : self.ends[j + 1]].tobytes() == candidates[i]:
                    found[i] = j
                    break
                j += 1
        return found


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host, path, rule, verdict`` to ``urls``; earlier columns of these names are replaced.

    A rule fits its host and every subdomain when the path starts with the
    rule's path. Of several that fit the longest wins, then the longer host.
    Where none fits ``rule`` is null and ``verdict`` is ``default``; that holds
    for null, empty and malformed URLs, whose host and path are empty.
    """
    spark = urls.sparkSession
    if not rules:
        return urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col)), "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    name = ship(spark, rules)
    lengths = sorted({len(text) - text.find("/") if "/" in text else 0 for _, text in rules})
    most = max(text.partition("/")[0].count(".") + 1 for _, text in rules)
    with_parts = urls.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        array = DigestArray(SparkFiles.get(name))
        for hosts, paths in batches:
            yield _judge(array, lengths, most, hosts, paths, default)

    (judged,) = fresh(with_parts.columns, "_judged")
    return with_parts.withColumn(judged, judge("host", "path")).withColumn("rule", F.col(judged)["rule"]).withColumn("verdict", F.col(judged)["verdict"]).drop(judged)


def _judge(array: DigestArray, lengths: list[int], most: int, hosts: pd.Series, paths: pd.Series, default: str) -> pd.DataFrame:
    """Rules for hosts and paths; a suffix of more than ``most`` labels is longer than any rule's host."""
    candidates: list[bytes] = []
    owner: list[int] = []
    rank: list[tuple[int, int]] = []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        labels = host.rsplit(".", most)[-most:]
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for n in lengths:
                if n <= len(path) and suffix:
                    candidates.append((suffix + path[:n]).encode("utf-8", "surrogatepass"))
                    owner.append(i)
                    rank.append((len(suffix) + n, len(suffix)))
    best: dict[int, tuple[tuple[int, int], int]] = {}
    for c, j in enumerate(array.probe(candidates)):
        if j >= 0 and (owner[c] not in best or rank[c] > best[owner[c]][0]):
            best[owner[c]] = (rank[c], int(j))
    rule = [None] * len(hosts)
    verdict = [default] * len(hosts)
    for i, (_, j) in best.items():
        rule[i] = array.texts[array.ends[j] : array.ends[j + 1]].tobytes().decode()
        verdict[i] = "allow" if array.verdicts[j] else "block"
    return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})


def ship(spark: SparkSession, rules: Sequence[Rule]) -> str:
    """Writes the array once on the driver and sends the files to every executor through Spark."""
    folder = Path(tempfile.mkdtemp(prefix="url-rules-")).resolve()
    name = f"rules-{uuid.uuid4().hex}"
    for file in DigestArray.write(rules, str(folder / name)):
        spark.sparkContext.addFile(file)
    return name
