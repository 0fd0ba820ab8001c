"""Piles with everything a caller of variants asks for: strands, effective qualities, offsets for damage, reference, indels.

A pile is no list in one row: equal bases of a site are one row with their number, so no site, however deep, is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fused as U
from ..functions import reads as R
from ..functions import tags as T
from .pileup import MISSING_QUALITY, usable

#: Fixed value: what a letter of the BQ tag is above the number it stands for.
BQ_ZERO = 64
#: Columns that tell one base of a pile, one change behind a site, and reads at a site from others.
BASE, CHANGE = ["reversed", "base", "q", "offset", "ref"], ["reversed", "mapq", "del", "ins", "ins_q", "ins_offset"]


def effective_quality(base: Column, qual: Column, bq: Column, mapq: Column) -> Column:
    """The quality of a base: what BQ adds is added to it (null: nothing), a missing one (255) is 30, the mapping quality is
    its upper limit, and what is none of A, C, G and T has 0."""
    q = F.when(qual == 255, MISSING_QUALITY).otherwise(qual) + F.coalesce(bq - BQ_ZERO, F.lit(0))
    return F.when(base.isin(*"ACGT"), F.least(F.greatest(q, F.lit(0)), mapq)).otherwise(0).cast("bigint")


def decompose(reads: DataFrame, by: list[str], md: Column | None = None, bq: Column | None = None) -> DataFrame:
    """One row per aligned base of usable reads: by, site, reversed, base, q, offset, ref, mapq, on, del, ins, ins_q, ins_offset.

    base is A where the read has none of A, C, G and T; q is the effective quality; offset counts from the start of the read
    in its first half and is negative, from its end, in the other one, so a model of damage can be looked up by it; ref is the
    reference's base by MD text (N where that says nothing or does not fit).  on: whether the read has another base after this
    one without a gap (N) between; del and ins are the reference's bases deleted and the read's bases inserted between them,
    ins_q and ins_offset the qualities and offsets of the latter.  Clips are left out; insertions and deletions before the
    first base, behind the last or beside a gap are too.

    md and bq are the texts of the tags MD and BQ unless given; BQ may be shorter than the read.  Null qualities are missing
    ones, a null mapping quality is the unknown one (255); bases beyond the read's sequence (or of a null one), records with a
    null flag, reference, position or CIGAR give no rows.  Columns of `by` may be any of the reads', such
    as the library whose model of damage holds.
    """
    bq = F.when(F.exists("tags", lambda t: t["key"] == "BQ"), T.as_string(F.col("tags"), "BQ")) if bq is None else bq
    md = T.md_text(F.col("tags")) if md is None else md
    whole = usable(reads).where("pos is not null").select(*by, "pos", F.coalesce("mapq", F.lit(R.UNKNOWN_MAPQ)).alias("mapq"), R.has_flag(F.col("flag"), "reversed").alias("reversed"), F.col("seq").alias("_seq"), F.col("qual").alias("_qual"), F.coalesce(bq, F.lit("")).alias("_bq"), U.runs(F.col("cigar"), md).alias("_runs"))
    whole = whole.where("_seq is not null and _seq <> ''").withColumn("_len", F.length("_seq"))
    letters = F.split("_seq", "")  # made once for each read by the generator
    bqs = F.when(F.col("_bq") != "", F.split("_bq", ""))
    made = F.array(F.struct(letters.alias("base"), bqs.alias("bq")))
    whole = whole.withColumn("_x", F.explode(made))
    quality = F.transform("_x.base", lambda b, i: effective_quality(b, F.coalesce(F.get("_qual", i), F.lit(255)), F.ascii(F.get("_x.bq", i)), F.col("mapq")))
    whole = whole.withColumn("_y", F.explode(F.array(F.struct(quality.alias("q"), F.transform("_x.base", lambda b: F.when(b.isin(*"ACGT"), b).otherwise("A")).alias("base")))))
    offset = lambda i: R.damage_position(i, F.col("_len")).cast("bigint")
    put = lambda r: F.flatten(F.transform(r["ins"], lambda x: F.sequence(x["q"], x["q"] + x["n"] - 1)))
    own = lambda c, r: F.slice(c, r["q"] + 1, r["n"])

    def told(r: Column) -> Column:
        """A run with what belongs to it alone, so that no row carries the whole read on."""
        base = F.arrays_zip(own("_x.base", r).alias("own"), own("_y.base", r).alias("base"), own("_y.q", r).alias("q"))
        at = [F.transform(put(r), lambda i: F.get("_y.base", i)), F.transform(put(r), lambda i: F.get("_y.q", i)), F.transform(put(r), offset)]
        return F.struct(*[r[c].alias(c) for c in ("q", "r", "n", "ref", "on", "del")], base.alias("bases"), F.array_join(at[0], "").alias("ins"), at[1].alias("ins_q"), at[2].alias("ins_offset"))

    runs = whole.select(*by, "pos", "mapq", "reversed", "_len", F.explode(F.transform("_runs", told)).alias("_r"))
    one = runs.select(*by, "pos", "mapq", "reversed", "_len", *[F.col(f"_r.{c}").alias(f"_{c}") for c in ("q", "r", "n", "ref", "on", "del", "ins", "ins_q", "ins_offset")], F.posexplode("_r.bases").alias("_k", "_b"))
    at, last = F.col("_q") + F.col("_k"), F.col("_k") == F.col("_n") - 1
    more = F.col("_on") & last & (at + 1 < F.col("_len"))
    none = F.array().cast("array<bigint>")
    return one.select(
        *by, (F.col("pos") + F.col("_r") + F.col("_k")).alias("site"), "reversed", "_b.base", "_b.q", offset(at).alias("offset"), F.coalesce("_ref", "_b.own").alias("ref"), "mapq",
        (~last & (at + 1 < F.col("_len")) | more).alias("on"), *[F.when(more, F.col(f"_{c}")).otherwise("").alias(c) for c in ("del", "ins")], *[F.when(more, F.col(f"_{c}")).otherwise(none).alias(c) for c in ("ins_q", "ins_offset")],
    )


def bases(parts: DataFrame, by: list[str]) -> DataFrame:
    """Base piles of what `decompose` gives: by, site, reversed, base, q, offset, ref and n, the number of such bases."""
    return parts.groupBy(*by, "site", *BASE).agg(F.count("*").alias("n"))


def changes(parts: DataFrame, by: list[str]) -> DataFrame:
    """Indel piles of what `decompose` gives, for the gap behind each site: by, site, reversed, mapq, del, ins, ins_q,
    ins_offset and n.  Reads that go on without a change have del and ins empty, so a caller knows how many show none."""
    return parts.where("on").groupBy(*by, "site", *CHANGE).agg(F.count("*").alias("n"))


def statistics(parts: DataFrame, by: list[str]) -> DataFrame:
    """Per site: depth, mapq0, sum_mapq, sum_mapq2 of all bases, and the same with on_ before it of reads that go on behind."""
    def sums(prefix: str, value: Column) -> list[Column]:
        return [F.count(value).alias(f"{prefix}depth"), F.count(F.when(value == 0, 1)).alias(f"{prefix}mapq0"), F.coalesce(F.sum(value), F.lit(0)).alias(f"{prefix}sum_mapq"), F.coalesce(F.sum(value * value), F.lit(0)).alias(f"{prefix}sum_mapq2")]

    return parts.groupBy(*by, "site").agg(*sums("", F.col("mapq")), *sums("on_", F.when(F.col("on"), F.col("mapq"))))


def likelihoods(base: Column, q: Column, matrix: Column) -> Column:
    """Array of 4: how likely the read base is if the molecule's was A, C, G or T, by the rates of a substitution matrix
    (`functions.molecules`) and an error that makes each of the other three bases alike."""
    error = F.pow(F.lit(10.0), -q / 10)
    seen = lambda y: F.when(base == "ACGT"[y], 1 - error).otherwise(error / 3)
    return F.array(*[sum((F.get(matrix, F.lit(4 * y + x)) * seen(y) for y in range(4)), F.lit(0.0)) for x in range(4)])
