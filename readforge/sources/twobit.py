"""2bit genomes: a Python data source whose rows are the chunks that `operators.genome` joins.

Each task reads a stretch of one sequence by its place in the file, so a genome never passes through one task.  Unknown
bases are N, soft-masked ones lower case.  Both byte orders are read; a version other than 0 is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import intervals
from ..operators.genome import CHUNK
from ..operators.tables import written
from .bam import _opened

SCHEMA = "ref_id bigint, name string, length bigint, chunk bigint, seq string"
#: Fixed values of the format: the first four bytes, and the letters of the codes.
SIGNATURE, LETTERS = 0x1A412743, b"TCAG"
#: Bases that one task reads.
TASK_BASES = 1 << 22
#: How often windows that touch unknown bases are drawn again.
ROUNDS = 200
_FOUR = np.frombuffer(LETTERS, np.uint8)[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TwoBitSource)


class _Words:
    """Numbers of four bytes in the file's byte order."""

    def __init__(self, f):
        self.f = f
        head = f.read(4)
        order = next((o for o in "<>" if len(head) == 4 and struct.unpack(o + "I", head)[0] == SIGNATURE), None)
        if order is None:
            raise ValueError("no 2bit file: the first bytes differ")
        self.order = order
        if self.one() != 0:
            raise ValueError("a 2bit file of an unknown version")

    def one(self) -> int:
        return int(self.many(1)[0])

    def many(self, n: int) -> np.ndarray:
        data = self.f.read(4 * n)
        if len(data) < 4 * n:
            raise ValueError("a 2bit file ends too soon")
        return np.frombuffer(data, self.order + "u4").astype(np.int64)

    def blocks(self) -> list[tuple[int, int]]:
        n = self.one()
        start, size = self.many(n), self.many(n)
        return list(zip(start.tolist(), (start + size).tolist()))


def catalog(path: str) -> list[tuple[str, int, int]]:
    """name, place in the file and length of each sequence, in the order of the file."""
    system, inner = _opened(path)
    with system.open_input_file(inner) as f:
        words = _Words(f)
        found = []
        n = words.one()
        words.one()
        for _ in range(n):
            name = f.read(f.read(1)[0]).decode()
            found.append((name, words.one()))
        out = []
        for name, at in found:
            f.seek(at)
            out.append((name, at, words.one()))
        return out


def bases(path: str, at: int, start: int, end: int) -> str:
    """The bases from start to end of the sequence that stands at `at`."""
    system, inner = _opened(path)
    with system.open_input_file(inner) as f:
        words = _Words(f)
        f.seek(at)
        end = min(end, words.one())
        unknown, soft = words.blocks(), words.blocks()
        words.one()
        f.seek(f.tell() + start // 4)
        packed = f.read((end + 3) // 4 - start // 4)
        if len(packed) < (end + 3) // 4 - start // 4:
            raise ValueError("a 2bit file ends too soon")
    text = _FOUR[np.frombuffer(packed, np.uint8)].ravel()[start % 4 : start % 4 + end - start].copy()
    for found, change in ((unknown, lambda x: np.full_like(x, ord("N"))), (soft, lambda x: x | 32)):
        for a, b in found:
            if a < end and b > start:
                where = slice(max(a, start) - start, min(b, end) - start)
                text[where] = change(text[where])
    return text.tobytes().decode()


class _Stretch(InputPartition):
    def __init__(self, ref: int, name: str, at: int, length: int, start: int):
        super().__init__((ref, name, at, length, start))


class TwoBitReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Stretch(i, name, at, n, s) for i, (name, at, n) in enumerate(catalog(self.path)) for s in range(0, n, TASK_BASES)]

    def read(self, partition):
        if partition is None:
            return
        ref, name, at, length, start = partition.value
        text = bases(self.path, at, start, min(start + TASK_BASES, length))
        for i in range(0, len(text), CHUNK):
            yield ref, name, length, (start + i) // CHUNK, text[i : i + CHUNK]


class TwoBitSource(DataSource):
    """spark.read.format("twobit").load(file); sequences without bases have no rows, but stand in `catalog`."""

    @classmethod
    def name(cls):
        return "twobit"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TwoBitReader(self.options["path"])


def unknown_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, start, end) of the stretches of unknown bases; each sequence is a task's row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ref, at in zip(b["ref_id"], b["at"]):
                system, inner = _opened(path)
                with system.open_input_file(inner) as f:
                    words = _Words(f)
                    f.seek(at)
                    words.one()
                    rows += [(ref, start, end) for start, end in words.blocks()]
            yield pd.DataFrame(rows, columns=["ref_id", "start", "end"])

    known = spark.createDataFrame([(i, at) for i, (_, at, _) in enumerate(catalog(path))], "ref_id bigint, at bigint")
    return known.mapInPandas(run, "ref_id bigint, start bigint, end bigint")


def random_windows(spark: SparkSession, path: str, n: int, length: int, seed: int, known: bool = False) -> DataFrame:
    """n random ranges (window, ref_id, start, end, reversed) of `length` bases, uniform over places and strands.

    Ranges that leave their sequence are not among them.  With `known` none has an unknown base; else those that have show
    them as N once fetched.
    """
    return windows(spark, [size for _, _, size in catalog(path)], n, length, seed, unknown_blocks(spark, path) if known else None)


def windows(spark: SparkSession, sizes: list[int], n: int, length: int, seed: int, unknown: DataFrame | None = None) -> DataFrame:
    """As `random_windows`, for sequences of the given sizes and stretches of unknown bases (ref_id, start, end).

    A window's place is a hash of its number, the seed and the round, so the same seed gives the same windows however the work
    is dealt.  Those that touch an unknown stretch are drawn again in the next round, up to ROUNDS times.
    """
    kind = "ref_id bigint, start bigint"
    ends = np.cumsum(np.maximum(np.array(sizes, np.int64) - length + 1, 0))
    if not len(ends) or not ends[-1]:
        return spark.createDataFrame([], f"window bigint, {kind}, end bigint, reversed boolean")

    @F.pandas_udf(kind)
    def placed(p: pd.Series) -> pd.DataFrame:
        ref = np.searchsorted(ends, p.to_numpy(), side="right")
        return pd.DataFrame({"ref_id": ref, "start": p.to_numpy() - np.where(ref, ends[ref - 1], 0)})

    todo, done = spark.range(n).select(F.col("id").alias("window")), None
    for k in range(ROUNDS):
        key = [F.col("window"), F.lit(seed), F.lit(k)]
        drawn = todo.select("window", placed(F.pmod(F.xxhash64(*key), F.lit(int(ends[-1])))).alias("at"), (F.pmod(F.xxhash64(*key, F.lit("strand")), F.lit(2)) == 1).alias("reversed"))
        drawn = drawn.select("window", "at.ref_id", "at.start", (F.col("at.start") + length).alias("end"), "reversed")
        if unknown is None:
            return drawn
        drawn = written(drawn, "windows")
        reads = drawn.select("window", "ref_id", F.col("start").alias("pos"), F.lit(length).alias("aligned"))
        bad = written(intervals.semi_join(reads, unknown, longest=length).select("window"), "windows-again")
        good = drawn.join(bad, "window", "left_anti").select(drawn.columns)
        done, todo = good if done is None else done.unionByName(good), bad
        if not bad.take(1):
            return done
    raise ValueError(f"after {ROUNDS} rounds some windows still touch unknown bases")
