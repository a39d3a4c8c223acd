"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words, and stripped around line keys: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Unset, it is a temporary one where all run on one
    host (tests), and an error on a cluster, where each host would have its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lexitide-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one, removed when the application ends."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lexitide-{context.applicationId}")
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not system.exists(path):
        system.mkdirs(path)
        system.deleteOnExit(path)
    return str(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read again: cuts lineage and keeps costly results. Frames
    that an operator returns read such files, so they stay until the application ends."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def row_key(id_col: Column, text_col: Column) -> Column:
    """128 bits that are never null and equal for repeated rows only, as a struct (a, b)."""
    return F.struct(F.xxhash64(id_col, text_col).alias("a"), F.xxhash64(F.lit(7), id_col, text_col).alias("b"))


#: Hashes are dealt over 2**HOT_BITS buckets; one with more than 2**-HOT_SHARE of the rows, and more than HOT_ROWS, is hot,
#: so at most 2**HOT_SHARE are.
HOT_BITS, HOT_SHARE, HOT_ROWS = 16, 12, 256


def hot_buckets(hashes: DataFrame) -> DataFrame:
    """(__bucket, __salts) of the hot buckets of a column of 64-bit hashes: at most 2**HOT_SHARE rows, whatever the data, and one more.

    __salts deals a bucket's rows into parts of at most that share, or HOT_ROWS. Counts are summed where rows lie; one job,
    run here, brings the 2**HOT_BITS sums at most to the driver, so that plans hold a small table and not its making."""
    counts = hashes.toDF("h").groupBy(_bucket(F.col("h")).alias("b")).agg(F.count("*").alias("n")).toArrow()
    n = counts.column("n").to_numpy()
    salts = np.ceil(n / max(n.sum() / 2**HOT_SHARE, HOT_ROWS))
    hot = salts > 1
    # And a bucket that no hash has: so the table is never empty, and plans are alike whether keys are hot or not.
    table = {"__bucket": np.append(counts.column("b").to_numpy()[hot], -1).astype(np.int32), "__salts": np.append(salts[hot], 1).astype(np.int32)}
    return hashes.sparkSession.createDataFrame(pa.table(table))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - HOT_BITS).cast("int")


def salted(rows: DataFrame, h: Column, hot: DataFrame, spread: Column) -> DataFrame:
    """rows with __hot, whether the hash h is in a hot bucket, and __salt: 0, or in a hot one a number below its salts, by the hash `spread`."""
    both = rows.withColumn("__bucket", _bucket(h)).join(F.broadcast(hot), "__bucket", "left")
    return both.withColumn("__salt", F.pmod(spread, F.coalesce("__salts", F.lit(1))).cast("int")).withColumn("__hot", F.col("__salts").isNotNull()).drop("__bucket", "__salts")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], counted: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """left.join(right, keys) with rows of left that share a hot key dealt over several tasks by the columns `spread`.

    right's rows of hot buckets are copied to each salt; at most 2**(HOT_SHARE + 1) salts over 2**HOT_BITS buckets make
    that an eighth more rows on average. `counted`, by default left, is a frame that is cheap to read and has the keys of left; it is counted when called."""
    h = F.xxhash64(*keys)
    hot = hot_buckets((left if counted is None else counted).select(h.alias("h")))
    own = salted(left, h, hot, F.xxhash64(F.lit(3), *spread)).drop("__hot")
    other = right.withColumn("__bucket", _bucket(h)).join(F.broadcast(hot), "__bucket", "left")
    other = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__bucket", "__salts")
    return own.join(other, [*keys, "__salt"], how).drop("__salt")


#: Bits of the filter that lets most rows pass a join where they lie.
FILTER_BITS = 24


def split_by_key(rows: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows that may have a key (a 64-bit hash) among the only column of `wanted`, and rows that surely have none.

    The filter is a table of at most 2**(FILTER_BITS - 6) words of bits, broadcast from one file, whatever the number of
    rows, so big rows that need no join are not shuffled. Once very many keys are wanted it stops few rows, and never a wrong one."""
    i = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))")
    words = wanted.toDF("h").groupBy(F.shiftrightunsigned(i, 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    words = F.broadcast(written(words.repartition(1), "key-filter"))
    both = rows.withColumn("__h", key).withColumn("__word", F.shiftrightunsigned("__h", 64 - FILTER_BITS + 6)).join(words, "__word", "left")
    hit = F.coalesce(F.expr(f"(shiftright(__bits, cast(shiftrightunsigned(__h, {64 - FILTER_BITS}) & 63 as int)) & 1) = 1"), F.lit(False))
    pick = lambda keep: both.filter(hit if keep else ~hit).select(*rows.columns)
    return pick(True), pick(False)


def without_rows(rows: DataFrame, rk: Column, lost: DataFrame) -> DataFrame:
    """rows but those whose row key is in `lost` (rk). Only rows that the filter can't clear are shuffled."""
    some, rest = split_by_key(rows.withColumn("__rk", rk), F.col("__rk.a"), lost.select("rk.a"))
    return some.join(lost.select(F.col("rk").alias("__rk")), "__rk", "left_anti").select(*rows.columns).unionByName(rest.select(*rows.columns))


def bitmap_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, as bytes, with those set that are the top bits of a value of the only column, a 64-bit hash.

    Fixed in size: at most 2**(bits - 6) words reach the driver however many rows there are. As a filter it lets
    others pass by chance, the more the fuller it is, and never stops a row that belongs."""
    rows = hashes.toDF("h").select(F.shiftrightunsigned("h", 64 - bits).alias("i"))
    words = rows.groupBy(F.shiftrightunsigned("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
