"""Indexes of sorted files: BAI, CSI and tabix, as rows, and the stretches of a file that regions need.

An index file is one row of Spark's binary source.  Its bins become rows (bin, from, to); the least place of any record
from a window on becomes a row for each window, carried forward where the index says nothing.  `build` makes an index from the records of sorted files, `write` puts it beside them,
and `scan` reads only the stretches that regions need.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import reads as R
from ..operators import intervals
from ..operators.tables import written
from . import bam
from .bam import blocks, is_bgzf

SCHEMA = "path string, ref_id bigint, name string, min_shift int, depth int, bin bigint, window bigint, start bigint, end bigint"
#: Fixed values of BAI and tabix: bits of the smallest bin, levels below the first.
SHIFT, DEPTH = 14, 5
#: Bits of a file place that are merged together: 16 MB of file.
MERGE_BITS = 40


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        size = struct.calcsize("<" + form)
        if self.at + size > len(self.data):
            raise ValueError("an index ends too soon")
        self.at += size
        return struct.unpack_from("<" + form, self.data, self.at - size)


def _left_end(number: int, shift: int, depth: int) -> int:
    """The first position of a bin."""
    for level in range(depth, -1, -1):
        first = ((1 << 3 * level) - 1) // 7
        if number >= first:
            return (number - first) << (shift + 3 * (depth - level))
    return 0


def parse(data: bytes) -> Iterator[tuple]:
    """ref_id, name, min_shift, depth, bin, window, start, end: of a stretch of a bin, or of a window, which has no end."""
    if is_bgzf(data[:18]):
        data = b"".join(part for _, part in blocks(io.BytesIO(data)))
    b = _Bytes(data)
    magic, names = bytes(b.take("4s")[0]), []
    shift, depth = SHIFT, DEPTH
    if magic == b"CSI\1":
        shift, depth, skipped = b.take("3i")
        b.take(f"{skipped}s")
        (refs,) = b.take("i")
    elif magic == b"TBI\1":
        refs, _, _, _, _, _, _, size = b.take("8i")
        names = b.take(f"{size}s")[0].decode().split("\0")
    elif magic == b"BAI\1":
        (refs,) = b.take("i")
    else:
        raise ValueError("no index: the first bytes differ")
    most = ((1 << 3 * (depth + 1)) - 1) // 7
    for ref in range(refs):
        head = (ref, names[ref] if ref < len(names) else None, shift, depth)
        known: dict[int, int] = {}
        for _ in range(b.take("i")[0]):
            (number,) = b.take("I")
            if magic == b"CSI\1":
                place, offset = _left_end(number, shift, depth) >> shift, b.take("q")[0]
                if number < most:
                    known[place] = min(known.get(place, offset), offset)
            found = b.take(f"{2 * b.take('i')[0]}q")
            if number < most:  # a number beyond all bins holds counts
                for start, end in sorted(zip(found[::2], found[1::2])):
                    yield *head, number, None, start, end
        if magic != b"CSI\1":
            known = {i: x for i, x in enumerate(b.take(f"{b.take('i')[0]}q")) if x}
        last = 0
        for i in range(max(known, default=-1) + 1):
            last = known.get(i, last)
            yield *head, None, i, last, None


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA of all index files (.bai, .csi, .tbi) of a file, a folder or a pattern."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                out = pd.DataFrame(list(parse(content)), columns=["ref_id", "name", "min_shift", "depth", "bin", "window", "start", "end"], dtype=object)
                out.insert(0, "path", name)
                yield out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, SCHEMA)


def segments(index: DataFrame, regions: DataFrame) -> DataFrame:
    """path, start, end: the stretches of each file, as disjoint places in it, that hold all records of regions
    (ref_id, start, end).

    Bins that touch a region meet the index by an equi-join; what lies before the region's window is cut off.  Stretches
    that overlap or touch are merged.
    """
    refs = index.groupBy("path", "ref_id").agg(F.first("min_shift").alias("min_shift"), F.first("depth").alias("depth"), F.max("window").alias("_last"))
    asked = regions.where("end > start").select("ref_id", F.col("start").alias("_from"), F.col("end").alias("_to")).distinct().join(refs, "ref_id")
    first = "(shiftleft(1L, 3 * l) - 1) div 7"
    touched = F.expr(f"""flatten(transform(sequence(0, depth), l -> sequence(
        {first} + shiftright(_from, min_shift + 3 * (depth - l)), {first} + shiftright(_to - 1, min_shift + 3 * (depth - l)))))""")
    windows = index.where("window is not null")
    asked = asked.withColumn("window", F.least(F.expr("shiftright(_from, min_shift)"), "_last"))
    asked = asked.join(windows.select("path", "ref_id", "window", F.col("start").alias("_low")), ["path", "ref_id", "window"], "left")
    asked = asked.select("path", "ref_id", F.explode(touched).alias("bin"), F.coalesce("_low", F.lit(0)).alias("_low"))
    met = index.where("bin is not null").select("path", "ref_id", "bin", "start", "end").join(asked, ["path", "ref_id", "bin"])
    met = met.select(F.col("path").alias("ref_id"), F.greatest("start", "_low").alias("start"), "end").where("start < end")
    return intervals.union(met, MERGE_BITS).select(F.col("ref_id").alias("path"), "start", "end")


def _touched(low: int, high: int, shift: int, depth: int) -> set[int]:
    """Bins that hold any position of [low, high)."""
    out: set[int] = set()
    for level in range(depth + 1):
        bits = shift + 3 * (depth - level)
        out.update(range(((1 << 3 * level) - 1) // 7 + (low >> bits), ((1 << 3 * level) - 1) // 7 + ((high - 1) >> bits) + 1))
    return out


def places(rows: list[tuple], ref: int, low: int, high: int, most: int) -> list[tuple[int, int]]:
    """The stretches of one file, from rows of `parse`, that hold all records which touch [low, high) of a reference.

    Stretches that touch are joined up to `most` bytes of file.  As the file is sorted, nothing is read from the first record
    on that stands in a smallest bin behind the region.
    """
    own = [r for r in rows if r[0] == ref]
    if not own or high <= low:
        return []
    bins = _touched(low, high, own[0][2], own[0][3])
    least = max((r[6] for r in own if r[5] is not None and r[5] <= low >> own[0][2]), default=0)
    leaves = ((1 << 3 * own[0][3]) - 1) // 7
    behind = min((r[6] for r in own if r[4] is not None and r[4] > leaves + ((high - 1) >> own[0][2])), default=1 << 62)
    out: list[tuple[int, int]] = []
    for start, end in sorted((max(r[6], least), min(r[7], behind)) for r in own if r[4] in bins and r[7] > least and r[6] < behind):
        if out and start <= out[-1][1] and (end >> 16) - (out[-1][0] >> 16) <= most:
            out[-1] = out[-1][0], max(end, out[-1][1])
        elif not out or end > out[-1][1]:
            out.append((max(start, out[-1][1]) if out else start, end))
    return out


def _length(packed: bytes) -> int:
    return sum(n for n, o in bam.operations(bam.show_operations(packed)) if o in "MDN=X")


def _runs(found: Iterator[tuple[int, bytes]], name: str, last: int) -> Iterator[tuple]:
    """(path, ref_id, bin, window, start, end): runs of records of one bin, and of each run the windows it reaches."""
    run = None  # the run that is not yet at its end
    while rows := list(islice(found, bam.BATCH)):
        data, fixed, (_, _, ops, seq, *_) = bam.fixed_parts(x for _, x in rows)
        at, ref, pos = np.array([at for at, _ in rows], np.int64), fixed["ref_id"].astype(np.int64), fixed["pos"].astype(np.int64)
        different, codes = bam.alike(data, ops, seq)
        end = pos + np.maximum(np.array([_length(x) for x in different], np.int64)[codes], 1) - 1
        placed = (pos >= 0) & (ref != R.INVALID_REF)
        ref, number = np.where(placed, ref, -1), np.where(placed, bam.smallest_bins(pos, end), -1)
        begins = np.flatnonzero((np.diff(ref, prepend=-2) != 0) | (np.diff(number, prepend=-2) != 0))
        for i in begins.tolist():
            if run is None or run[:2] != (ref[i], number[i]):
                if run is not None and run[0] >= 0:
                    yield name, run[0], run[1], None, run[2], int(at[i])
                run = int(ref[i]), int(number[i]), int(at[i])
        of, low = np.cumsum(np.isin(np.arange(len(at)), begins)), pos >> SHIFT
        n = np.where(placed, (end >> SHIFT) - low + 1, 0)
        each = np.repeat(np.arange(len(at)), n)  # a row for each window that a record reaches
        window = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        for i in np.unique(np.stack([of[each], window]), axis=1, return_index=True)[1].tolist():
            yield name, int(ref[each[i]]), None, int(window[i]), int(at[each[i]]), None
    if run is not None and run[0] >= 0:
        yield name, run[0], run[1], None, run[2], last


def build(spark: SparkSession, path: str, split: int = bam.SPLIT) -> DataFrame:
    """Rows of SCHEMA, an index as BAI has it, for a BAM file sorted by place or a folder of them.

    Each task reads stretches of a file, all once; the end of its last record is the place where the next task begins, which is
    found after all have been read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start, end in zip(batch["path"], batch["start"], batch["end"]):
                system, inner = bam._opened(name)
                with system.open_input_file(inner) as f:
                    found = _runs(bam.records(f, start, end, split), name, end << 16)
                    while rows := list(islice(found, 100_000)):
                        yield pd.DataFrame(rows, columns=["path", "ref_id", "bin", "window", "start", "end"], dtype=object)

    rows = written(bam.stretches(spark, path, split).mapInPandas(run, "path string, ref_id bigint, bin bigint, window bigint, start bigint, end bigint"), "index-runs")
    bins = rows.where("bin is not null").groupBy("path", "ref_id", "bin", "start").agg(F.max("end").alias("end")).withColumn("window", F.lit(None).cast("bigint"))
    least = rows.where("window is not null").groupBy("path", "ref_id", "window").agg(F.min("start").alias("start"))
    # windows that no record reaches take the place of the one before: at most 32,768 windows for each reference
    every = least.groupBy("path", "ref_id").agg(F.max("window").alias("_m")).select("path", "ref_id", F.explode(F.expr("sequence(0L, _m)")).alias("window"))
    filled = F.coalesce(F.last("start", ignorenulls=True).over(Window.partitionBy("path", "ref_id").orderBy("window")), F.lit(0))
    windows = every.join(least, ["path", "ref_id", "window"], "left").withColumn("start", filled)
    none = lambda kind: F.lit(None).cast(kind)
    both = bins.unionByName(windows.withColumns({"bin": none("bigint"), "end": none("bigint")}))
    return both.select("path", "ref_id", none("string").alias("name"), F.lit(SHIFT).alias("min_shift"), F.lit(DEPTH).alias("depth"), "bin", "window", "start", "end")


def pack(rows: list[tuple], refs: int) -> bytes:
    """A BAI file from (ref_id, bin, window, start, end)."""
    out = [b"BAI\1", struct.pack("<i", refs)]
    for ref in range(refs):
        own = [r for r in rows if r[0] == ref]
        bins = sorted((int(r[1]), int(r[3]), int(r[4])) for r in own if r[1] is not None)
        each = {k: [(a, b) for _, a, b in v] for k, v in groupby(bins, key=lambda r: r[0])}
        out.append(struct.pack("<i", len(each)))
        for number, found in each.items():
            out.append(struct.pack(f"<Ii{2 * len(found)}q", number, len(found), *[x for pair in found for x in pair]))
        windows = [int(r[3]) for r in sorted((r for r in own if r[2] is not None), key=lambda r: r[2])]
        out.append(struct.pack(f"<i{len(windows)}q", len(windows), *windows))
    return b"".join(out)


def write(index: DataFrame) -> DataFrame:
    """Puts the index of each file beside it, with `.bai` added to its name; (path, bytes) of what was written.

    The index of one file is made in one task; it has a row for each run of records and each 16,384 positions.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        path = group["path"].iloc[0]
        rows = group[["ref_id", "bin", "window", "start", "end"]].astype(object)
        rows = [tuple(None if pd.isna(x) else int(x) for x in r) for r in rows.itertuples(index=False)]
        data = pack(rows, len(bam.header_of(path)[1]))
        system, inner = bam._opened(path + ".bai")
        with system.open_output_stream(inner, compression=None) as f:
            f.write(data)
        return pd.DataFrame({"path": [path + ".bai"], "bytes": [len(data)]})

    return index.groupBy("path").applyInPandas(run, "path string, bytes long")


def scan(spark: SparkSession, index: DataFrame, regions: DataFrame) -> DataFrame:
    """The records of the files of an index, each once, that touch regions (ref_id, start, end).

    Only the stretches that the index names are read, each by one task; what they hold beside is then tested.  index has
    the paths of the data, as `build` gives them; for rows of `read` cut `.bai` off.
    """
    asked = segments(index, regions)
    n = max(1, min(asked.count(), 4 * spark.sparkContext.defaultParallelism))
    found = written(bam.read_places(asked.repartition(n, "path", "start")), "scan")
    found = found.where(~R.has_flag(F.col("flag"), "unmapped")).withColumn("aligned", F.greatest(R.aligned_length(F.col("cigar")), F.lit(1)))
    return intervals.semi_join(found, regions).drop("aligned")
