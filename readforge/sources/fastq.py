"""FASTA and FASTQ text, multi-line records included, read in stretches of files.

A record's first mark can also begin a line of qualities, so where a record begins is not plain from one line.  A task finds
the first record of its stretch by what follows it, and the task before reads up to that place; it knows where records truly
begin and fails if none begins there, so no line of qualities is ever taken for a record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from . import bam

#: Letters that stand for a base in such files.
BASES = b"ACGTUBDHVSWMKRYNacgtubdhvswmkryn"
#: Bytes of a file that a task reads, records that must follow a guessed start, and records in a batch.
SPLIT, FOLLOWING, BATCH = 64 << 20, 4, 10_000
_SPACE = b" \t\r\v\f"


class _Lines:
    """Lines of a file from a place on, each with its place; line ends go."""

    def __init__(self, f, at: int):
        self.f, self.at, self.held, self.i = f, at, b"", 0

    def next(self) -> tuple[int, bytes] | None:
        end = self.held.find(b"\n", self.i)
        while end < 0:
            chunk = self.f.read(1 << 20)
            if not chunk:
                break
            self.held, self.i = self.held[self.i :] + chunk, 0
            end = self.held.find(b"\n")
        if end < 0:
            end = len(self.held)
            if self.i == end:
                return None
        line, place = self.held[self.i : end], self.at
        self.at += end + 1 - self.i
        self.i = min(end + 1, len(self.held))
        return place, line[:-1] if line.endswith(b"\r") else line


def _records(lines: _Lines) -> Iterator[tuple[int, bytes, bool]]:
    """(place, text without the first mark, whole) of the records; a quality line may begin with a mark too, so bases are
    counted.  whole is whether there are qualities, as many as bases, or none at all."""
    held: list[bytes] = []
    place = bases = quals = 0
    inside = False  # among the qualities
    while (found := lines.next()) is not None:
        at, line = found
        if line[:1] in (b">", b"@") and not (inside and quals < bases):
            if held:
                yield place, b"\n".join(held), not inside or quals == bases
            held, place, bases, quals, inside = [line[1:]], at, 0, 0, False
        elif held:
            held.append(line)
            if inside:
                quals += len(line.translate(None, _SPACE))
            elif line.startswith(b"+"):
                inside = True
            else:
                bases += len(line) - len(line.translate(None, BASES))
    if held:
        yield place, b"\n".join(held), not inside or quals == bases


def _fits(f, at: int) -> bool:
    """Whether records follow one another from a line with a mark on: bases of letters only, then as many qualities; the
    first has a line at least, as a line of qualities often comes right before a mark."""
    f.seek(at)
    for n, (_, text, whole) in enumerate(_records(_Lines(f, at)), 1):
        body = text.split(b"\n+", 1)[0].split(b"\n", 1)
        if not whole or n == 1 and b"\n" not in text or len(body) > 1 and body[1].translate(None, BASES + _SPACE + b".-\n"):
            return False
        if n == FOLLOWING:
            break
    return True


def _first(f, start: int, end: int | None) -> int | None:
    """The first place in [start, end) where a line begins a record."""
    f.seek(max(start - 1, 0))
    lines = _Lines(f, max(start - 1, 0))
    if start:
        lines.next()  # what is left of the line that begins before
    while (found := lines.next()) is not None and (end is None or found[0] < end):
        if found[1][:1] in (b">", b"@"):
            after = f.tell()
            if _fits(f, found[0]):
                return found[0]
            f.seek(after)
    return None


def records(f, start: int, end: int | None) -> Iterator[str]:
    """Texts of the records that begin in bytes [start, end) of a file, without their first mark; to its end if that is None."""
    at = _first(f, start, end) if start else 0
    if at is None:
        return
    border = None if end is None else _first(f, end, None)
    f.seek(at)
    for place, text, _ in _records(_Lines(f, at)):
        if border is not None and place >= border:
            if place == border:
                return
            break
        yield text.decode("utf-8", "replace")
    if border is not None:
        raise ValueError(f"no record can be told from qualities after byte {end}: read the file with another split")


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """qname, description, seq, qual (empty where there is none) of the records of one or more files.

    Lines before the first record are skipped; an empty file has none.  Files whose names end in .gz or .bz2 are unpacked by
    one task each, line by line; others are read in stretches of `split` bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start, end in zip(batch["path"], batch["start"], batch["end"]):
                system, inner = bam._opened(name)
                packed = name.endswith((".gz", ".bz2"))
                with system.open_input_stream(inner) if packed else system.open_input_file(inner) as f:
                    found = (t.decode("utf-8", "replace") for _, t, _ in _records(_Lines(f, 0))) if packed else records(f, start, None if end < 0 else end)
                    rows: list[str] = []
                    for one in found:
                        rows.append(one)
                        if len(rows) >= BATCH:
                            yield pd.DataFrame({"body": pd.Series(rows, dtype=object)})
                            rows = []
                    yield pd.DataFrame({"body": pd.Series(rows, dtype=object)})

    rows = []
    for name, size in bam.files_of(path):
        if name.endswith((".gz", ".bz2")):
            rows.append((name, 0, -1))
        else:
            rows += [(name, a, a + split if a + split < size else -1) for a in range(0, max(size, 1), split)]
    parts = spark.createDataFrame(rows, "path string, start long, end long").repartition(max(1, len(rows)), "path", "start")
    return parts.mapInPandas(run, "body string").select(S.record_text(F.col("body")).alias("r")).select("r.*")
