"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One row per 32768-bit block; 256 blocks are 1 MB, which bounds the broadcast.
FILTER_BLOCKS = 256
FILTER_BITS = FILTER_BLOCKS * 32768
#: Spark's setting that removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of how many rows an Arrow batch has at most.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset and the master is local (tests) a temporary folder of the
    driver is used and remembered as the session's checkpoint folder; on a
    cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    named = tempfile.mkdtemp(prefix="fathomline-")
    spark.conf.set("spark.checkpoint.dir", named)
    spark.sparkContext.setCheckpointDir(named)
    return named


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has, in whatever case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Intermediate Parquet tables in the shared folder.

    Writing a table cuts the lineage and survives lost executors: every later
    stage reads files that all machines see. The shuffle files of a table are
    removed once it is written. ``drop`` and ``keep`` free tables that no
    lazily evaluated result still needs. Where ``arrow_rows`` is set, Arrow
    batches of what is written hold at most so many rows, for rows that may be
    long lists.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.arrow_rows: int | None = None
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def table(self, df: DataFrame, sort: str | None = None, **options: str) -> DataFrame:
        path = self.path()
        out = df.sortWithinPartitions(sort) if sort else df
        during = {CLEANUP: "true"} | ({ARROW_ROWS: str(self.arrow_rows)} if self.arrow_rows else {})
        before = {key: self.spark.conf.get(key, "false" if key == CLEANUP else "10000") for key in during}
        try:
            for key, value in during.items():
                self.spark.conf.set(key, value)
            out.write.options(compression="zstd", **options).parquet(path)
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df.scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Frees all tables but these."""
        wanted = {df.scratch_path for df in tables}
        for path in (f"{self.root}/{i}" for i in range(1, self.n + 1)):
            if path not in wanted:
                self._delete(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def membership_filter(keys: DataFrame, key: str) -> DataFrame:
    """A one-hash bitmap filter over a column of longs, at most 1 MB whatever the input.

    False positives only cost work later; there are no false negatives.
    """
    bit = F.pmod(F.col(key), F.lit(FILTER_BITS)) + 1
    return (
        keys.select(F.bitmap_bucket_number(bit).alias("_block"), F.bitmap_bit_position(bit).alias("_bit"))
        .groupBy("_block")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )


def with_membership(df: DataFrame, key: Column, bitmap: DataFrame, flag: str) -> DataFrame:
    """Adds ``flag``: false where ``key`` is certainly not in the filter.

    The bitmap has at most FILTER_BLOCKS rows of 4 KB, so it may be broadcast.
    """
    bit = F.pmod(key, F.lit(FILTER_BITS)) + 1
    # A null key has no bit; it can't be a member.
    place, block, bits = fresh([*df.columns, flag], "_place", "_block", "_bits")
    probed = df.withColumn(place, F.bitmap_bit_position(bit)).withColumn(block, F.bitmap_bucket_number(bit))
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast({place} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(F.col(place), F.lit(8)).cast("int")) == 1, F.lit(False))
    named = bitmap.select(F.col("_block").alias(block), F.col("_bits").alias(bits))
    return probed.join(F.broadcast(named), block, "left").withColumn(flag, hit).drop(block, bits, place)


def salts(rows: int, per_salt: int = 50_000, least: int = 64, most: int = 4096) -> int:
    """Into how many salts a hot key is dealt: grows with the input, within bounds."""
    return max(least, min(most, -(-rows // per_salt)))


def drop_ids(docs: DataFrame, id_col: str, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``docs`` whose identifier is not in ``ids`` (a written table without repeats); null identifiers stay.

    Only rows that pass the filter over ``ids`` are joined; the texts of all others are not shuffled.
    """
    gone, maybe = fresh(docs.columns, "_dropped", "_maybe")
    dropped = ids.select(F.col(column).alias(gone))
    bitmap = membership_filter(dropped.select(F.xxhash64(gone).alias("key")), "key")
    marked = with_membership(docs, F.xxhash64(id_col), bitmap, maybe)
    clean = marked.filter(~F.col(maybe)).select(docs.columns)
    rest = marked.filter(maybe).select(docs.columns)
    return clean.unionByName(rest.join(dropped, rest[id_col] == F.col(gone), "left_anti"))


def with_row_key(docs: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """Adds ``key``: the identifier, or identifier and text digest if some identifier stands for several texts; null without identifier.

    Keys are in the order of the identifiers. The test is one aggregation of
    hashes; texts are not shuffled.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(body).alias("_h"), F.xxhash64(F.lit(1), body).alias("_g"))
    ends = hashed.groupBy("_id").agg(*[f(c).alias(f"{f.__name__}{c}") for f in (F.min, F.max) for c in ("_h", "_g")])
    if ends.filter("min_h <> max_h or min_g <> max_g").isEmpty():
        return docs.withColumn(key, F.col(id_col))
    return docs.withColumn(key, F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.unhex(F.sha2(body, 256)).alias("digest"))))
