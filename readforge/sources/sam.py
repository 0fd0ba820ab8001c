"""SAM text: records as lines, and back.

References have names in the text and numbers in the records.  `refs`, a table (ref_id, name), gives them, and is joined as
Spark sees fit; without it the name of number N is `refN`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reads import INVALID_REF
from ..functions.tags import KIND

#: The most text that is looked through for a header at once.
_HEAD = 1 << 20


def _names(df: DataFrame, refs: DataFrame | None, number: str, out: str) -> DataFrame:
    """df with the name of a reference number, null for an unknown one."""
    if refs is None:
        return df.withColumn(out, F.when(F.col(number) != INVALID_REF, F.concat(F.lit("ref"), F.col(number).cast("string"))))
    return df.join(refs.select(F.col("ref_id").cast("bigint").alias(number), F.col("name").alias(out)), number, "left")


def _numbers(df: DataFrame, refs: DataFrame | None, name: str, out: str) -> DataFrame:
    if refs is None:
        number = F.when(F.col(name).rlike("^ref[0-9]+$"), F.substring(name, 4, 20).try_cast("bigint"))
        return df.withColumn(out, F.coalesce(number, F.lit(INVALID_REF)))
    return df.join(refs.select(F.col("name").alias(name), F.col("ref_id").cast("bigint").alias("_id")), name, "left").withColumn(out, F.coalesce("_id", F.lit(INVALID_REF))).drop("_id")


def encode(reads: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """One `line` per record; positions count from 1, `=` stands for the record's own reference, `*` for what is missing.

    The length of the template is isize, and tags follow, where reads has these columns; qualities of 255 are missing.
    """
    c = F.col
    own = reads.select("*", c("ref_id").cast("bigint").alias("_ref"), c("mate_ref_id").cast("bigint").alias("_mate"))
    own = _names(_names(own, refs, "_ref", "_name"), refs, "_mate", "_mate_name")
    mate = F.when(c("_mate") == INVALID_REF, F.lit("*")).when(c("_mate") == c("_ref"), F.lit("=")).otherwise(F.coalesce("_mate_name", F.lit("*")))
    star = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.lit("*")).otherwise(x)
    qual = F.when(F.exists("qual", lambda q: q != 255), F.array_join(F.transform("qual", lambda q: F.char((q + 33).cast("bigint"))), ""))
    s = lambda x: x.cast("string")
    tags = F.transform("tags", lambda t: F.concat_ws(":", t["key"], t["typ"], t["value"])) if "tags" in reads.columns else F.lit(None).cast("array<string>")
    size = s(c("isize")) if "isize" in reads.columns else F.lit("0")
    fields = [c("qname"), s(c("flag").cast("bigint").bitwiseAND(F.lit(0xFFFF))), F.coalesce("_name", F.lit("*")), s(c("pos") + 1), s(c("mapq")), star(c("cigar")), mate, s(c("mate_pos") + 1), size, star(c("seq")), star(qual)]
    return own.select(F.concat_ws("\t", *fields, tags).alias("line"))


def decode(lines: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Records of the lines that are no header; an unknown reference name is invalid, missing qualities are 255."""
    f = lambda i: F.col("_f")[i]
    plain = lambda x: F.when(x == "*", F.lit("")).otherwise(x)
    number = lambda x: x.cast("bigint")
    split = lines.where(~F.col("line").startswith("@") & (F.trim("line") != "")).select(F.split("line", "\t").alias("_f"))
    tag = lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.substring(x, 4, 1).alias("typ"), F.substring(x, 6, 1 << 30).alias("value"))
    # fields are named in a step of their own, so that a line is split once
    named = split.select(
        f(0).alias("qname"), number(f(1)).alias("flag"), f(2).alias("_name"), (number(f(3)) - 1).alias("pos"), number(f(4)).alias("mapq"), plain(f(5)).alias("cigar"),
        F.when(f(6) == "=", f(2)).otherwise(f(6)).alias("_mate_name"), (number(f(7)) - 1).alias("mate_pos"), number(f(8)).alias("isize"), plain(f(9)).alias("seq"), f(10).alias("_qual"),
        F.transform(F.slice("_f", F.lit(12), F.greatest(F.size("_f") - 11, F.lit(0))), tag).cast(KIND).alias("tags"),
    )
    named = _numbers(_numbers(named, refs, "_name", "ref_id"), refs, "_mate_name", "mate_ref_id")
    qual = F.when(F.col("_qual") == "*", F.array_repeat(F.lit(255).cast("bigint"), F.length("seq"))).otherwise(F.transform(F.split("_qual", ""), lambda x: (F.ascii(x) - 33).cast("bigint")))
    return named.select("qname", "flag", "ref_id", "pos", "mapq", "cigar", "mate_ref_id", "mate_pos", "isize", "seq", qual.alias("qual"), "tags")


def write(reads: DataFrame, path: str, header: str, refs: DataFrame | None = None) -> None:
    """One text file for each partition, each with the header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"line": header.splitlines()})
        yield from batches

    encode(reads, refs).mapInPandas(run, "line string").write.text(path)


def header_text(f) -> str:
    """The lines with @ that a file begins with."""
    out, rest = [], b""
    while chunk := f.read(_HEAD):
        *lines, rest = (rest + chunk).split(b"\n")
        head = [x for x in lines if x.startswith(b"@")]
        out += head
        if len(head) < len(lines):
            return b"".join(x + b"\n" for x in out).decode("utf-8", "replace")
    out += [rest] if rest.startswith(b"@") else []
    return b"".join(x + b"\n" for x in out).decode("utf-8", "replace")


