"""Pileup, consensus and duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reads as R

MISSING_QUALITY = 30


def usable(reads: DataFrame) -> DataFrame:
    return reads.where(~R.has_flag(F.col("flag"), "unmapped") & ~R.has_flag(F.col("flag"), "duplicate") & R.valid_ref(F.col("ref_id")))


def blocks(cigar: Column) -> Column:
    """Array of structs (q, r, len, ins, del) of the runs of aligned bases: offsets in the read and from its place, length, and
    the read's bases and those of the reference between the run and the next one (both 0 after the last and before a gap).

    M consumes both, I and S the read, D and N the reference; H and P nothing.  N is a gap: what stands beside it is lost.
    """
    kind = "struct<q:bigint,r:bigint,len:bigint,ins:bigint,del:bigint>"
    zero = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("q", "r", "ins", "del")], F.lit(False).alias("gap"), F.array().cast(f"array<{kind}>").alias("at"))
    last = lambda at: F.try_element_at(at, F.lit(-1))

    def step(a, x):
        # what stands between runs is told to the run before when the next one begins
        own = F.struct(a["q"].alias("q"), a["r"].alias("r"), x["len"].alias("len"), F.lit(0).cast("bigint").alias("ins"), F.lit(0).cast("bigint").alias("del"))
        told = F.struct(last(a["at"])["q"].alias("q"), last(a["at"])["r"].alias("r"), last(a["at"])["len"].alias("len"), F.when(a["gap"], 0).otherwise(a["ins"]).cast("bigint").alias("ins"), F.when(a["gap"], 0).otherwise(a["del"]).cast("bigint").alias("del"))
        before = F.when(F.size(a["at"]) > 0, F.concat(F.slice(a["at"], F.lit(1), F.size(a["at"]) - 1), F.array(told))).otherwise(a["at"])
        m = (x["op"] == "M") & (x["len"] > 0)
        return F.struct(
            (a["q"] + F.when(x["op"].isin("M", "I", "S"), x["len"]).otherwise(0)).alias("q"),
            (a["r"] + F.when(x["op"].isin("M", "D", "N"), x["len"]).otherwise(0)).alias("r"),
            F.when(m, 0).otherwise(a["ins"] + F.when(x["op"] == "I", x["len"]).otherwise(0)).cast("bigint").alias("ins"),
            F.when(m, 0).otherwise(a["del"] + F.when(x["op"] == "D", x["len"]).otherwise(0)).cast("bigint").alias("del"),
            (~m & (a["gap"] | (x["op"] == "N"))).alias("gap"),
            F.when(m, F.concat(before, F.array(own))).otherwise(a["at"]).alias("at"),
        )

    return F.aggregate(R.cigar_ops(cigar), zero, step, lambda a: a["at"])


def walk(reads: DataFrame, keep: list[str], bases: bool = True) -> DataFrame:
    """One row per aligned base: site, base, q (the lower of base and mapping quality), i (offset in the read), by CIGAR.

    Without `bases` letters and qualities are neither read nor made: only site, i, read_len and mapq.
    """
    if not bases:
        one = usable(reads).select(*keep, "pos", F.length("seq").cast("bigint").alias("read_len"), "mapq", F.explode(blocks(F.col("cigar"))).alias("_b"))
        one = one.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_b.len") - 1)).alias("_k"))
        return one.select(*keep, (F.col("pos") + F.col("_b.r") + F.col("_k")).alias("site"), (F.col("_b.q") + F.col("_k")).alias("i"), "read_len", "mapq")
    one = usable(reads).select(*keep, "pos", "seq", "qual", "mapq", F.explode(blocks(F.col("cigar"))).alias("_b"))
    pairs = F.arrays_zip(F.split(F.substring("seq", F.col("_b.q").cast("int") + 1, F.col("_b.len").cast("int")), "").alias("base"), F.slice("qual", F.col("_b.q").cast("int") + 1, F.col("_b.len").cast("int")).alias("q"))
    one = one.select(*keep, "pos", "mapq", "_b", F.length("seq").cast("bigint").alias("read_len"), F.posexplode(pairs).alias("_k", "_x"))
    i = F.col("_b.q") + F.col("_k")
    q = F.coalesce(F.col("_x.q"), F.lit(255))
    q = F.when(~F.col("_x.base").isin(*"ACGT"), F.lit(0)).when(q == 255, F.lit(MISSING_QUALITY)).otherwise(q)
    return one.select(*keep, (F.col("pos") + F.col("_b.r") + F.col("_k")).alias("site"), F.col("_x.base").alias("base"), F.least(q.cast("bigint"), F.col("mapq")).alias("q"), i.alias("i"), "read_len", "mapq")


def indel_piles(reads: DataFrame, by: list[str]) -> DataFrame:
    """by, site, ins, del, n, q: at the gap behind each site, how many reads go on without a gap (ins empty, del 0) and how
    many with each insertion and length of a deletion; q is the sum of their mapping qualities.

    `by` has ref_id and more.  Reads that have a base at the site and end there say nothing.  The reads that go on are those at
    the site without those whose run of bases ends there, so they are counted from depths and not made one by one.
    """
    runs = usable(reads).select(*by, "pos", "seq", "mapq", F.explode(blocks(F.col("cigar"))).alias("_b"))
    site = F.col("pos") + F.col("_b.r") + F.col("_b.len") - 1
    seen = F.col("_b.ins") + F.col("_b.del") > 0
    text = F.substring("seq", (F.col("_b.q") + F.col("_b.len")).cast("int") + 1, F.col("_b.ins").cast("int"))
    ends = runs.select(*by, site.alias("site"), text.alias("ins"), F.col("_b.del").alias("del"), seen.alias("_seen"), "mapq")
    gaps = ends.where("_seen").groupBy(*by, "site", "ins", "del").agg(F.count("*").alias("n"), F.sum("mapq").alias("q"))
    depth = walk(reads, by, bases=False).groupBy(*by, "site").agg(F.count("*").alias("n"), F.sum("mapq").alias("q"))
    less = ends.groupBy(*by, "site").agg((-F.count("*")).alias("n"), (-F.sum("mapq")).alias("q"))
    plain = depth.unionByName(less).groupBy(*by, "site").agg(F.sum("n").alias("n"), F.sum("q").alias("q")).where("n > 0")
    return gaps.unionByName(plain.select(*by, "site", F.lit("").alias("ins"), F.lit(0).cast("bigint").alias("del"), "n", "q"))


def call_stats(bases: DataFrame, by: list[str]) -> DataFrame:
    """Depth, reads of mapping quality 0, and sums of mapping quality and its square: sums, so partial sums come first."""
    return bases.groupBy(*by).agg(F.count("*").alias("depth"), F.sum((F.col("mapq") == 0).cast("bigint")).alias("mapq0"), F.sum("mapq").alias("sum_mapq"), F.sum(F.col("mapq") * F.col("mapq")).alias("sum_mapq2"))


def consensus(bases: DataFrame, by: list[str], most: int = 60) -> DataFrame:
    """Base with the largest sum of qualities and the lead over the second, at most `most`; N and 0 if the lead is 3 or less."""
    sums = bases.groupBy(*by, "base").agg(F.sum("q").alias("s"))
    pivot = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), F.col("base").alias("b")))).alias("t"))  # at most five letters
    lead = F.least(-F.element_at("t", 1)["s"] - F.coalesce(-F.try_element_at("t", F.lit(2))["s"], F.lit(0)), F.lit(most))
    return pivot.select(*by, F.when(lead > 3, F.element_at("t", 1)["b"]).otherwise(F.lit("N")).alias("base"), F.when(lead > 3, lead).otherwise(F.lit(0)).cast("bigint").alias("q"))


def duplicate_class() -> Column:
    flag, ff = F.col("flag"), F.col("ff")
    lost = R.has_flag(flag, "unmapped") | R.has_flag(flag, "mate_unmapped")
    return (
        F.when(~R.has_flag(flag, "paired") & (R.has_ext_flag(ff, "merged") | R.has_ext_flag(ff, "trimmed")), "merged")
        .when(~R.has_flag(flag, "paired"), "single")
        .when(~lost, "pair")
        .when(R.has_flag(flag, "unmapped"), "half_unaligned")
        .otherwise("half_aligned")
    )


def add_counts(xp: Column) -> Column:
    """Sum of copy counts, in which an unknown one (-1) makes the whole unknown; missing ones count one."""
    xp = F.coalesce(xp, F.lit(1))
    return F.when(F.min(xp) == -1, F.lit(-1)).otherwise(F.sum(xp)).cast("bigint")


def cheap_collapse(reads: DataFrame, keys: list[str]) -> DataFrame:
    """The record with the least name of each cluster of duplicates, with the copies of all of it.  A minimum and sums:
    clusters of any size are aggregated before the shuffle.  A record alone keeps its count, also an absent one."""
    out = reads.groupBy(*keys).agg(F.min("qname").alias("qname"), F.count("*").alias("cluster"), add_counts(F.col("xp")).alias("xp"), F.min("xp").alias("_own"), F.min_by("seq", "qname").alias("seq"))
    return out.withColumn("xp", F.when(F.col("cluster") == 1, F.col("_own")).otherwise(F.col("xp"))).drop("_own")


def majority(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent value, the greatest of those that tie."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*by).agg(F.max(F.struct("_n", value)).alias("_m")).select(*by, F.col(f"_m.{value}").alias(value))


def number_in_group(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def hits_union(df: DataFrame, by: list[str], hits: str) -> DataFrame:
    """Hits of all rows of a group, separated by semicolons, each once and in order."""
    one = df.select(*by, F.explode(F.split(hits, ";")).alias("_h")).where("_h <> ''").distinct()
    return one.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("_h")), ";").alias(hits))


def molecule_way(bases: DataFrame) -> DataFrame:
    """Rows of a walk (with `flag`) of reversed reads turned round: offsets count from the other end, bases are complements."""
    back = R.has_flag(F.col("flag"), "reversed")
    return bases.select("*", F.when(back, F.col("read_len") - 1 - F.col("i")).otherwise(F.col("i")).alias("_i"), F.when(back, F.translate("base", R.BASES, R.COMPLEMENTS)).otherwise(F.col("base")).alias("_b")).drop("i", "base").withColumnsRenamed({"_i": "i", "_b": "base"})


def duplicate_key() -> list[Column]:
    """What makes two records of one group and place duplicates: the class (half-aligned mates count as single), the strand,
    and for pairs the mate's place and which mate it is, for merged reads the aligned length.  Mates that are not aligned are
    never duplicates: `own` is their name.  (`duplicates.remove` also settles classes among one another.)"""
    c = duplicate_class()
    far = F.when(c == "pair", F.col("mate_pos")).when(c == "merged", R.aligned_length(F.col("cigar")))
    return [F.when(c == "half_aligned", "single").otherwise(c).alias("class"), R.has_flag(F.col("flag"), "reversed").alias("rev"), ((c == "pair") & R.has_flag(F.col("flag"), "first_mate")).alias("first"), far.alias("far"), F.when(c == "half_unaligned", F.col("qname")).alias("own")]
