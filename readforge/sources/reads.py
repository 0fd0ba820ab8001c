"""Reads of files that may be BAM (BGZF, gzip or plain) or SAM text, told apart by their first bytes.

Each file has its own dictionary of references.  Files are grouped by dictionary, and the numbers of each group are turned
into those of one dictionary for all: names in the order in which the files, by path, show them first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reads import INVALID_REF
from . import bam, sam


def _head(path: str) -> tuple[str, list[tuple[str, int]]]:
    """What a file is, and its references."""
    system, inner = bam._opened(path)
    with system.open_input_file(inner) as f:
        kind = bam.kind_of(f.read(18))
        f.seek(0)
        if kind == "gzip" and path.endswith(".sam.gz"):
            kind = "sam"
        if kind != "sam":
            return ("empty" if kind == "empty" else "bam"), (bam.header_of(path)[1] if kind != "empty" else [])
    with system.open_input_stream(inner) as f:  # unpacks by the ending of the name
        return "sam", [(n, k) for n, k, _ in bam.parse_header(sam.header_text(f))["refs"]]


def heads(spark: SparkSession, path: str) -> tuple[list[tuple[str, str, int]], list[list[tuple[str, int]]]]:
    """([(path, kind, number of its dictionary)], dictionaries).  Files are opened by tasks; each dictionary comes back once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *_head(p)) for p in b["path"]]
            yield pd.DataFrame({"path": [r[0] for r in rows], "kind": [r[1] for r in rows], "refs": ["\n".join(f"{n}\t{k}" for n, k in r[2]) for r in rows]})

    files = spark.createDataFrame([(p,) for p, _ in bam.files_of(path)], "path string")
    found = files.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(run, "path string, kind string, refs string")
    told = found.groupBy(F.sha2("refs", 256).alias("id")).agg(F.first("refs").alias("refs"), F.sort_array(F.collect_list(F.struct("path", "kind"))).alias("files"))
    rows = sorted(told.collect(), key=lambda r: r["files"][0]["path"])
    text = [[(x.split("\t")[0], int(x.split("\t")[1])) for x in r["refs"].split("\n") if x] for r in rows]
    return sorted((f["path"], f["kind"], i) for i, r in enumerate(rows) for f in r["files"]), text


def references(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, length) of all references of the files, in the order of their numbers; lengths that differ are an error."""
    return _joined(heads(spark, path)[1])


def _joined(dictionaries: list[list[tuple[str, int]]]) -> list[tuple[str, int]]:
    known: dict[str, int] = {}
    for refs in dictionaries:
        for name, length in refs:
            if known.setdefault(name, length) != length:
                raise ValueError(f"files give reference {name} different lengths")
    return list(known.items())


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of `bam.SCHEMA` of a file or of all files of a folder; ref_id and mate_ref_id are places in `references`.

    Records of text have no virt_offset.  Empty files have no records.
    """
    bam.register(spark)
    files, dictionaries = heads(spark, path)
    place = {name: i for i, (name, _) in enumerate(_joined(dictionaries))}
    kinds = dict(x.rsplit(" ", 1) for x in ["qname string", "flag int", "ref_id bigint", "pos int", "mapq int", "cigar string", "mate_ref_id bigint", "mate_pos int", "isize int", "seq string"])
    out = spark.createDataFrame([], bam.SCHEMA)
    for i, refs in enumerate(dictionaries):
        binary = [p for p, kind, d in files if d == i and kind == "bam"]
        text = [p for p, kind, d in files if d == i and kind == "sam"]
        if text:
            names = spark.createDataFrame([(place[n], n) for n, _ in refs], "ref_id bigint, name string")
            found = sam.decode(spark.read.text(text).withColumnRenamed("value", "line"), names)
            found = found.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], F.col("qual").cast("array<int>").alias("qual"), "tags", F.lit(None).cast("bigint").alias("virt_offset"))
            out = out.unionByName(found)
        if binary:
            found = spark.read.format("bam").option("paths", "\n".join(binary)).load()
            if [place[n] for n, _ in refs] != list(range(len(refs))):
                turn = spark.createDataFrame([(k, place[n]) for k, (n, _) in enumerate(refs)], "_from bigint, _to bigint")
                for c in ("ref_id", "mate_ref_id"):
                    found = found.join(turn, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", F.lit(INVALID_REF))).drop("_from", "_to")
            out = out.unionByName(found)
    return out
