"""Helpers shared by the operators: tables, scratch storage, word bytes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves in local mode; on a cluster
    that would not be shared, so it is an error there.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, with A-Z in lower case and nothing else changed."""
    return text.encode().lower().split() if text else []


#: Bits of a membership bitmap, at least and at most: 32 to 4,096 rows of 4 KB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def bitmap(keys: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """A bitmap of the hashes of ``columns`` in the shared folder, and its bits: 16 a key, and 16 MB at most, so it may be broadcast."""
    bits = min(max(1 << (16 * max(keys.count(), 1)).bit_length(), LEAST_BITS), MOST_BITS)
    at = F.pmod(F.xxhash64(*columns), F.lit(bits))
    placed = keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    return materialize(placed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "bitmap"), bits


def marked(df: DataFrame, held: tuple[DataFrame, int], *columns: str, name: str = "maybe") -> DataFrame:
    """Adds ``name``: false where the row's key is surely not in the bitmap.

    More keys only make more rows true; what is true must be looked up exactly.
    """
    rows, bits = held
    at = F.pmod(F.xxhash64(*columns), F.lit(bits))
    placed = df.withColumns({"bucket": F.bitmap_bucket_number(at), "bit": F.bitmap_bit_position(at)}).join(F.broadcast(rows), "bucket", "left")
    found = F.expr("conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10)").cast("int").bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0
    return placed.select(*df.columns, F.coalesce(found, F.lit(False)).alias(name))


def slices(parts, rows: int = 512):
    """Arrow batches cut into smaller ones; what the worker no longer needs goes back at the end.

    Workers stay for later tasks, so memory that they keep is lost to those.
    """
    import ctypes

    import pyarrow as pa

    for part in parts:
        for b in range(0, max(part.num_rows, 1), rows):
            yield part.slice(b, rows)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(df: DataFrame) -> DataFrame:
    """Texts go to Python a thousand rows at a time: the session's default of 10,000 rows is meant for numbers."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10_000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df
