"""Sums over a stream of records, kept as partial sums of its batches.

A batch writes its sums into a folder of its own number, so a batch that is run again after a failure replaces what it wrote,
and no state grows with the stream.  Totals are the sums of the parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import sam


def sam_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Records of the SAM files of a folder as they arrive, `files` in a batch at most."""
    reader = spark.readStream.format("text")
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return sam.decode(reader.load(path).withColumnRenamed("value", "line"))


def accumulate(stream: DataFrame, path: str, keys: list[str], sums: dict[str, Column], prepare: Callable[[DataFrame], DataFrame] = lambda df: df, once: bool = False) -> StreamingQuery:
    """Starts to add up `sums` (aggregates that are sums, such as counts) by `keys` over what `prepare` makes of each batch.

    Parts and the checkpoint stand below `path`, a folder that driver and executors share.  With `once` the query ends when it
    has read what is there.
    """

    def part(batch: DataFrame, number: int) -> None:
        prepare(batch).groupBy(*keys).agg(*[v.alias(c) for c, v in sums.items()]).write.mode("overwrite").parquet(f"{path}/parts/batch={number}")

    writer = stream.writeStream.foreachBatch(part).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def totals(spark: SparkSession, path: str, keys: list[str], sums: list[str]) -> DataFrame:
    """The sums of all batches so far."""
    return spark.read.parquet(f"{path}/parts").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
