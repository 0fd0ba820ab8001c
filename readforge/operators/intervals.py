"""Interval sets and interval joins over (ref_id, start, end), half-open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 14
#: Bins in which a union is formed first: 2^20 positions.
UNION_BITS = 20


def _merge(regions: DataFrame, *by: str) -> DataFrame:
    """Overlapping and touching intervals of each group merged."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = regions.withColumn("_new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    marked = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def union(regions: DataFrame, bits: int = UNION_BITS) -> DataFrame:
    """Overlapping and touching intervals of each reference merged; empty ones are left out.

    They are merged in bins first; then only those that reach the edge of a bin, two a bin at most, meet in one group for
    each reference.
    """
    some = regions.select("ref_id", "start", "end").where(F.col("start") < F.col("end"))
    low = F.col("_bin").cast("bigint") * (1 << bits)
    high = low + (1 << bits)
    kind = lambda c: F.col(c).cast(regions.schema[c].dataType).alias(c)
    cut = with_bins(some, "start", "end", bits).select("ref_id", "_bin", F.greatest("start", low).alias("start"), F.least("end", high).alias("end"))
    merged = _merge(cut, "ref_id", "_bin")
    edge = (F.col("start") == low) | (F.col("end") == high)
    inner = merged.where(~edge).select("ref_id", "start", "end")
    return inner.unionByName(_merge(merged.where(edge).select("ref_id", "start", "end"), "ref_id")).select("ref_id", kind("start"), kind("end"))


def with_bins(df: DataFrame, start: str, end: str, bits: int = BIN_BITS) -> DataFrame:
    """One row for each bin of 2^bits positions that [start, end) touches."""
    return df.withColumn("_bin", F.explode(F.sequence(F.shiftright(F.col(start), bits), F.shiftright(F.greatest(F.col(end) - 1, F.col(start)), bits))))


def semi_join(reads: DataFrame, regions: DataFrame, bits: int = BIN_BITS, longest: int | None = None) -> DataFrame:
    """Reads (with ref_id, pos, aligned) that overlap a region: an equi-join on the bin of the read's start, then the exact test.

    Regions stand in each bin in which a read that reaches them can start, so reads are neither repeated nor grouped: each
    row comes out as often as it came in, with all its columns.  `longest` is a bound on `aligned`; without it, it is taken
    from the reads.  Reads with nulls in these columns overlap nothing; a hot bin is split like any skewed join.
    """
    if longest is None:
        longest = reads.agg(F.max("aligned")).first()[0] or 0
    wide = union(regions).withColumn("_from", F.col("start") - longest)
    cut = with_bins(wide, "_from", "end", bits)
    test = (F.col("l.ref_id") == F.col("r.ref_id")) & (F.shiftright("l.pos", bits) == F.col("r._bin")) & (F.col("l.pos") < F.col("r.end")) & (F.col("r.start") < F.col("l.pos") + F.col("l.aligned"))
    return reads.alias("l").join(cut.alias("r"), test, "left_semi")
