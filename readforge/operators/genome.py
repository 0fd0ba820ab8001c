"""Reference sequence as chunks (ref_id, chunk, seq), joined by chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R

CHUNK = 256


def fetch(ranges: DataFrame, genome: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `bases` of each range (ref_id, start, end), as often as it comes; N stands where the reference has no base.

    An equi-join on the chunk; the few chunks of each different range are put together again, so a group is as long as its
    range, and its bases are joined to all equal ones.
    """
    first = F.floor(F.col("start") / CHUNK)
    cut = ranges.select("ref_id", "start", "end").distinct().withColumn("chunk", F.explode(F.sequence(first, F.floor((F.greatest("end", F.col("start") + 1) - 1) / CHUNK))))
    cut = cut.join(genome, ["ref_id", "chunk"], "left")
    low = F.greatest(F.col("start") - F.col("chunk") * CHUNK, F.lit(0)).cast("int")
    high = F.least(F.col("end") - F.col("chunk") * CHUNK, F.lit(CHUNK)).cast("int")
    part = F.substring(F.rpad(F.coalesce("seq", F.lit("")), CHUNK, "N"), low + 1, F.greatest(high - low, F.lit(0)))
    parts = cut.groupBy("ref_id", "start", "end").agg(F.sort_array(F.collect_list(F.struct("chunk", part.alias("part")))).alias("_p"))
    parts = parts.select("ref_id", "start", "end", F.array_join("_p.part", "").alias("bases"))
    return ranges.select(*keys, "ref_id", "start", "end").join(parts, ["ref_id", "start", "end"]).select(*keys, "ref_id", "start", "end", "bases")


def fetch_stranded(ranges: DataFrame, genome: DataFrame, keys: list[str]) -> DataFrame:
    """As `fetch`, for ranges on both strands: one with a negative start is the reverse complement of what lies between
    -start - length and -start on the forward strand.  Lower case, which marks soft masks, is kept."""
    back = F.col("start") < 0
    turned = ranges.select(*keys, "ref_id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.when(back, -F.col("end")).otherwise(F.col("start")).alias("start"), F.when(back, -F.col("start")).otherwise(F.col("end")).alias("end"))
    found = fetch(turned, genome, [*keys, "_s", "_e"])
    both = lambda x: x + x.lower()
    bases = F.when(F.col("_s") < 0, F.reverse(F.translate("bases", both(R.BASES), both(R.COMPLEMENTS)))).otherwise(F.col("bases"))
    return found.select(*keys, "ref_id", F.col("_s").alias("start"), F.col("_e").alias("end"), bases.alias("bases"))


def substitutions(bases: DataFrame, genome: DataFrame, by: list[str], cpg: bool = False) -> DataFrame:
    """Counts of (reference, read) bases for the rows of a pileup walk, by the columns `by`; only where both are A, C, G or T.

    cpg: also by whether the reference base is the C or the G of a CG.  Chunks carry their neighbours' edges for that.

    Spark counts the rows of a walk as the reads they are made of, and so would send them all to the driver for an inner join;
    in an outer one only the genome can be broadcast, if it is small.  The filter needs columns of both sides, as Spark makes an
    inner join of one that the genome's alone decide.
    """
    if cpg:
        # each chunk tells its neighbours a letter, by a grouping: joins with itself would count as the product of their sizes
        none = F.lit(None).cast("string")
        told = lambda shift, **own: F.struct((F.col("chunk") + shift).alias("chunk"), *[own.get(c, none).alias(c) for c in ("seq", "before", "behind")])
        each = F.array(told(0, seq=F.col("seq")), told(1, before=F.right("seq", F.lit(1))), told(-1, behind=F.left("seq", F.lit(1))))
        genome = genome.select("ref_id", F.explode(each).alias("_t")).select("ref_id", "_t.*")
        genome = genome.groupBy("ref_id", "chunk").agg(F.max("seq").alias("seq"), F.max("before").alias("_before"), F.max("behind").alias("_behind")).where("seq is not null")
    at = bases.withColumn("chunk", F.floor(F.col("site") / CHUNK)).join(genome, ["ref_id", "chunk"], "left")
    place = (F.col("site") - F.col("chunk") * CHUNK).cast("int") + 1
    at = at.withColumn("ref_base", F.coalesce(F.substring("seq", place, F.lit(1)), F.lit("")))
    if cpg:
        wide = F.concat(F.coalesce("_before", F.lit("N")), "seq", F.coalesce("_behind", F.lit("N")))
        at = at.withColumn("cpg", (F.substring(wide, place + 1, F.lit(2)) == "CG") | (F.substring(wide, place, F.lit(2)) == "CG"))
    proper = F.col("ref_base").isin(*"ACGT") & F.col("base").isin(*"ACGT")
    return at.where(proper).groupBy(*by, "ref_base", "base", *(["cpg"] if cpg else [])).agg(F.count("*").alias("c"))


def merged_counts(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Statistics of several inputs added: counts `c` by the columns `by`."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*by).agg(F.sum("c").alias("c"))


def frozen_rates(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Rates of substitution (x to y) from counts (x, y, c) at both ends: those of the far end count for the complements,
    and one is added to each of the sixteen."""
    turn = lambda c: F.translate(c, "ACGT", "TGCA")
    spark = forward.sparkSession
    empty = spark.createDataFrame([(x, y, 0) for x in "ACGT" for y in "ACGT"], "x string, y string, c bigint")
    total = merged_counts([forward.select("x", "y", "c"), backward.select(turn(F.col("x")).alias("x"), turn(F.col("y")).alias("y"), "c"), empty], ["x", "y"])
    rows = total.groupBy("x").agg(F.sum("c").alias("_all"))
    return total.join(rows, "x").select("x", "y", ((F.col("c") + 1) / (F.col("_all") + 4.0)).alias("rate"))


def masked(ranges: DataFrame, unknown: DataFrame, soft: DataFrame) -> DataFrame:
    """ranges (ref_id, start, end, plain) with the same bases under each policy of masks: `hard` (unknown bases as N),
    `soft` (lower case in soft masks) and `both`.

    Masks (ref_id, start, end) meet the ranges by chunk; each range gets the few that touch it and is cut at their edges.
    """
    cut = lambda df: df.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.greatest("end", F.col("start") + 1) - 1) / CHUNK))))
    masks = unknown.select("ref_id", "start", "end", F.lit(True).alias("n")).unionByName(soft.select("ref_id", "start", "end", F.lit(False).alias("n")))
    masks = cut(masks).select("ref_id", "chunk", F.struct(F.col("start").alias("s"), F.col("end").alias("e"), "n").alias("m"))
    met = cut(ranges).join(masks, ["ref_id", "chunk"], "left").where("m is null or m.s < end and m.e > start")
    met = met.groupBy("ref_id", "start", "end").agg(F.collect_set("m").alias("_m"))
    out = ranges.join(met, ["ref_id", "start", "end"], "left")
    letters = F.split("plain", "")
    under = lambda p, n: F.exists(F.coalesce("_m", F.array()), lambda m: (m["n"] == n) & (m["s"] <= p) & (m["e"] > p))

    def text(hard: bool, low: bool):
        def one(c, i):
            p = F.col("start") + i
            c = F.when(under(p, True), "N").otherwise(c) if hard else c
            return F.when(under(p, False), F.lower(c)).otherwise(c) if low else c

        return F.array_join(F.transform(letters, one), "")

    return out.select("ref_id", "start", "end", text(True, False).alias("hard"), text(False, True).alias("soft"), text(True, True).alias("both"), "plain")
