"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the setting, else, in local mode only, a folder of the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_task(df: DataFrame, buckets: int, most: int) -> DataFrame:
    """df dealt by its column `bucket` and sorted by it: no task has more buckets than it must, one where there are at most `most`."""
    tasks = min(buckets, most)
    return df.repartitionById(tasks, (F.col("bucket") % tasks).cast("int")).sortWithinPartitions("bucket")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def row_key(*cols: Column) -> Column:
    """A non-null 64-bit key of a row's identity; equal rows share it, so results are joined back without loss."""
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\x00null")) for c in cols])


def row_name(*cols: Column) -> Column:
    """A non-null key of a row's identity: the first column as text and 128 bits of hashes of all of them."""
    known = [F.coalesce(c.cast("string"), F.lit("\x00null")) for c in cols]
    return F.concat_ws(":", known[0], F.hex(F.xxhash64(*known)), F.hex(F.xxhash64(F.lit("b"), *known)))


def as_rows(docs: DataFrame) -> DataFrame:
    """(row, _key): each row of docs in one column, so that its names, whatever they are, meet no others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_name(F.col("doc_id"), F.col("text")).alias("_key"))


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether df has at most `limit` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """df marked for broadcast when it has at most `limit` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if small_enough(df, limit) else df


def zipped(texts: DataFrame) -> DataFrame:
    """texts (_t and others) with `_z`, the compressed UTF-8 bytes, in place of _t: what is shuffled is less than half.

    Workers get bytes, not text: text would be held twice more, decoded and encoded again.
    """

    @F.pandas_udf("binary")
    def pack(t: pd.Series) -> pd.Series:
        c = zstandard.ZstdCompressor(level=1)
        return pd.Series([c.compress(x) for x in t], dtype=object)

    return texts.withColumn("_z", pack(F.col("_t").cast("binary"))).drop("_t")


def unzipped(column: pd.Series) -> Iterator[bytes]:
    d = zstandard.ZstdDecompressor()
    return (d.decompress(x) for x in column)
