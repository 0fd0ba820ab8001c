"""Removal of duplicate records, with classes that resolve one another, and consensus records.

Records of one label that begin at one place are clustered by class: merged or trimmed reads by their aligned length,
pairs by the mate's place, and single reads, among them mates whose partner is not aligned, all together.  Mates that are
not aligned stand at their partner's place and are never clustered.

Everything is a sum, a minimum or a vote over keys, so partial results meet before any shuffle and no cluster or place has
to fit into a row: a consensus is voted from counts of (cluster, column, base).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fused as U
from ..functions import reads as R
from ..functions import sequences as S
from ..functions import tags as T
from . import pileup
from .tables import written

MERGED, PAIR, SINGLE, UNALIGNED = range(4)
#: The quality of a base whose record has none.
NO_QUALITY = 23
#: Tags that a consensus takes by majority, by root mean square, and those that it loses.
BY_VOTE = "X0 X1 XT XS XF XE BC LB RG XI XJ YI YJ".split()
BY_MEAN = "AM AS MQ PQ SM UQ".split()
LOST = "BQ CM FZ Q2 R2 XM XO XG YQ EN CQ CS E2 FS OQ OP OC U2 H0 H1 H2 HI NH IH ZQ".split()
_PAIR_FLAGS = sum(R.FLAGS[k] for k in ("paired", "proper", "mate_unmapped", "mate_reversed", "first_mate", "second_mate"))
_C = ["_at", "_rev", "_kind", "_f1", "_f2", "_f3"]


def _set(flag: Column, bits: int) -> Column:
    return flag.bitwiseOR(F.lit(bits))


def _clear(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(0xFFFF ^ bits))


def _copies(tags: Column) -> Column:
    return T.as_int(tags, "XP", 1)


def _sum_copies(a: Column, b: Column) -> Column:
    return F.when((a == -1) | (b == -1), F.lit(-1)).otherwise(a + b).cast("bigint")


def _with_copies(row: Column, n: Column) -> Column:
    return row.withField("tags", T.update(row["tags"], "XP", T.tag("XP", "i", n)))


def clustered(reads: DataFrame, label: Column, strand_preserved: bool, order: list[str]) -> DataFrame:
    """Each record as `row`, with its order `_o`, and the columns that make up the key of its cluster.

    Without strands kept, records of both strands and both mates are alike.
    """
    flag, ff = F.col("flag"), T.as_int(F.col("tags"), "FF")
    paired, kept = R.has_flag(flag, "paired"), F.lit(strand_preserved)
    whole = R.has_ext_flag(ff, "merged") | R.has_ext_flag(ff, "trimmed")
    lost = R.has_flag(flag, "unmapped") | R.has_flag(flag, "mate_unmapped")
    kind = F.when(~paired & whole, MERGED).when(~paired, SINGLE).when(~lost, PAIR).when(R.has_flag(flag, "unmapped"), UNALIGNED).otherwise(SINGLE)
    far = F.when(kind == MERGED, R.aligned_length(F.col("cigar"))).when(kind == PAIR, F.col("mate_ref_id"))
    return reads.select(
        F.struct(*[F.col(f"`{c}`") for c in reads.columns]).alias("row"),
        F.struct(*[F.col(f"`{c}`") for c in order]).alias("_o"),
        F.struct(F.coalesce(label.cast("string"), F.lit("\x00")).alias("label"), F.col("ref_id").cast("bigint").alias("ref_id"), F.col("pos").cast("bigint").alias("pos")).alias("_at"),
        (kept & R.has_flag(flag, "reversed")).alias("_rev"),
        kind.alias("_kind"),
        F.coalesce(far.cast("bigint"), F.lit(0)).cast("bigint").alias("_f1"),
        F.coalesce(F.when(kind == PAIR, F.col("mate_pos")), F.lit(0)).cast("bigint").alias("_f2"),
        (kept & (kind == PAIR) & R.has_flag(flag, "first_mate")).alias("_f3"),
    )


def _first_tags(tags: Column) -> Column:
    """The first tag of each key."""
    keys = F.transform(tags, lambda t: t["key"])
    return F.filter(tags, lambda t, i: F.array_position(keys, t["key"]) == i + 1)


def _rms(v: Column) -> Column:
    return F.bround(F.sqrt(F.avg(v.cast("double") * v.cast("double"))), 0).cast("bigint")


def _voted_tags(rows: DataFrame) -> DataFrame:
    """(key columns, front, hits): the tags taken by vote and by mean, and the alternative hits, each list of them once."""
    wanted = F.filter(_first_tags(F.col("row.tags")), lambda t: t["key"].isin(*BY_VOTE, *BY_MEAN, "XA"))
    each = rows.select(*_C, F.explode(wanted).alias("t")).select(*_C, "t.*")
    rank = F.when(F.col("typ") == "i", 0).when(F.col("typ") == "f", 1).when(F.col("typ") == "Z", 2).when(F.col("typ") == "H", 3).when(F.col("typ") == "A", 4).otherwise(5)
    votes = each.where(F.col("key").isin(*BY_VOTE)).groupBy(*_C, "key", "typ", "value").agg(F.count("*").alias("n"))
    number = F.when(F.col("typ") == "i", F.col("value").try_cast("bigint"))
    votes = votes.groupBy(*_C, "key").agg(F.max(F.struct("n", rank.alias("rank"), number.alias("number"), "value", "typ")).alias("m")).select(*_C, "key", "m.typ", "m.value")
    means = each.where(F.col("key").isin(*BY_MEAN) & (F.col("typ") == "i")).groupBy(*_C, "key").agg(_rms(F.col("value").try_cast("bigint")).alias("value"))
    means = means.select(*_C, "key", F.lit("i").alias("typ"), F.col("value").cast("string").alias("value"))
    place = F.array_position(F.array(*[F.lit(k) for k in [*BY_VOTE, *BY_MEAN]]), F.col("key"))
    front = votes.unionByName(means).groupBy(*_C).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "key", "typ", "value"))).alias("front"))
    front = front.withColumn("front", F.transform("front", lambda t: F.struct(t["key"].alias("key"), t["typ"].alias("typ"), t["value"].alias("value"))))
    lists = each.where((F.col("key") == "XA") & (F.col("typ") == "Z")).select(*_C, F.split("value", ";").alias("h"), "value").distinct()
    hits = lists.groupBy(*_C).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "value"))), lambda x: x["value"]), ";").alias("hits"))
    return front.join(hits, _C, "full")


def _consensus(rows: DataFrame, clusters: DataFrame, most: int) -> DataFrame:
    """(key columns, row): the consensus record of each cluster of several records."""
    many = clusters.where("n > 1").select(*_C, F.col("row").alias("b0"), "n", "copies", "fails")
    rows = written(rows.join(many.select(*_C), _C), "cluster-rows")  # read for CIGARs, columns and tags
    shape = F.transform(R.cigar_ops(F.col("row.cigar")), lambda x: F.struct(F.instr(F.lit("MIDNSHP"), x["op"]).alias("o"), x["len"].alias("n")))
    votes = rows.groupBy(*_C, F.col("row.cigar").alias("cigar")).agg(F.count("*").alias("k"), F.first(shape).alias("shape"))
    votes = votes.groupBy(*_C).agg(F.max(F.struct("k", "shape", "cigar")).alias("m")).select(*_C, F.col("m.cigar").alias("_cigar"))
    good = rows.join(votes, _C).where(F.col("row.cigar").eqNullSafe(F.col("_cigar")))
    md = F.when(T.as_string(F.col("row.tags"), "MD") != "", F.struct(F.col("row.seq").alias("seq"), T.as_string(F.col("row.tags"), "MD").alias("md")))
    told = good.groupBy(*_C, "_cigar").agg(
        _rms(F.col("row.mapq")).alias("mapq"), F.min_by(F.length("row.seq"), "_o").alias("_len"), F.min_by(md, F.when(md.isNotNull(), F.col("_o"))).alias("old"),
    )
    letters = F.arrays_zip(F.split("row.seq", "").alias("base"), F.coalesce(F.col("row.qual"), F.array()).alias("q"))
    bases = good.select(*_C, F.posexplode(letters).alias("i", "x")).where("x.base is not null and x.base <> ''")
    q = F.when(F.coalesce(F.col("x.q"), F.lit(255)) == 255, NO_QUALITY).otherwise(F.col("x.q")).cast("bigint")
    bases = pileup.consensus(bases.select(*_C, "i", F.col("x.base").alias("base"), q.alias("q")), [*_C, "i"], most)
    # as many columns as the read has bases
    columns = bases.groupBy(*_C).agg(F.array_sort(F.collect_list(F.struct("i", "base", "q"))).alias("cols"))
    out = many.join(told, _C).join(columns, _C, "left").join(_voted_tags(rows), _C, "left")
    cols = F.slice(F.coalesce("cols", F.array().cast("array<struct<i:int,base:string,q:bigint>>")), F.lit(1), F.coalesce("_len", F.lit(0)))
    out = out.withColumn("seq", F.array_join(F.transform(cols, lambda c: c["base"]), "")).withColumn("qual", F.transform(cols, lambda c: c["q"]))
    out = out.withColumn("md", U.rebuilt_md(F.col("_cigar"), F.col("old.md"), F.col("old.seq"), F.col("seq")))
    gaps = F.aggregate(F.filter(R.cigar_ops(F.col("_cigar")), lambda x: x["op"].isin("I", "D")), F.lit(0).cast("bigint"), lambda a, x: a + x["len"])
    changes = F.coalesce(F.size(F.filter(S.md_ops(F.col("md")), lambda x: x["kind"] == "rep")), F.lit(0))
    extra = F.array(T.tag("NM", "i", gaps + changes), T.tag("XP", "i", F.col("copies")))
    extra = F.concat(extra, F.when(F.col("hits").isNotNull(), F.array(T.tag("XA", "Z", F.col("hits")))).otherwise(F.array().cast(T.KIND)))
    extra = F.concat(extra, F.when(F.col("md").isNotNull(), F.array(T.tag("MD", "Z", F.col("md")))).otherwise(F.array().cast(T.KIND)))
    fresh = F.concat(F.coalesce("front", F.array().cast(T.KIND)), extra)
    taken = F.transform(fresh, lambda t: t["key"])
    rest = F.filter(F.col("b0.tags"), lambda t: ~F.array_contains(taken, t["key"]) & ~t["key"].isin(*LOST))
    flag = F.when(2 * F.col("fails") > F.col("n"), _set(F.col("b0.flag"), R.FLAGS["fails_qc"])).otherwise(_clear(F.col("b0.flag"), R.FLAGS["fails_qc"]))
    kinds = {f.name: f.dataType for f in rows.schema["row"].dataType}
    new = {"qname": F.concat(F.col("b0.qname"), F.lit("c")), "flag": _clear(flag, R.FLAGS["duplicate"]), "mapq": F.col("mapq"), "cigar": F.col("_cigar"), "seq": F.col("seq"), "qual": F.col("qual"), "tags": F.concat(fresh, rest)}
    if "virt_offset" in kinds:
        new["virt_offset"] = F.lit(0)
    row = F.col("b0")
    for name, value in new.items():
        row = row.withField(name, value.cast(kinds[name].simpleString()))
    return out.select(*_C, row.alias("_made"))


def remove(reads: DataFrame, label: Column, strand_preserved: bool = True, most: int | None = None, keep: bool = False, order: tuple[str, ...] = ("qname", "flag")) -> DataFrame:
    """The records that stay, with `copies_seen`: how many records each stands for.

    reads has the columns of a BAM table (qname, flag, ref_id, pos, mapq, cigar, mate_ref_id, mate_pos, seq, qual, tags;
    others are carried along).  Records of different labels are never duplicates.  With `most` None a cluster is
    represented by its first record in `order`, whose XP counts the copies of all; a cluster of one is untouched.  Else a
    cluster becomes a consensus record: the CIGAR by majority, of the records that have it each column by the sums of
    qualities (at most `most`), the MD text made anew, the name of the first record with a c; a single record with
    qualities above `most` is lowered to it, also with a c.

    At a place and strand the first merged or else paired cluster takes in the single reads: their copies are added and
    copies_seen is that of the single reads; unaligned mates then go.  Otherwise the single cluster stays: a represented
    one with at most one unaligned mate of its own, a consensus as a single read.

    What goes is dropped, or, with `keep`, stays with the duplicate flag and copies_seen 0.  Records at no place (reference
    or position unknown) pass with 1.  Records of a cluster must differ in `order`; a null label is a label of its own.
    """
    placed = R.valid_ref(F.col("ref_id")) & (F.col("pos") >= 0)
    rows = clustered(reads.where(F.coalesce(placed, F.lit(False))), label, strand_preserved, list(order))
    unplaced = reads.where(~F.coalesce(placed, F.lit(False)))

    single = rows.where(F.col("_kind") < UNALIGNED)
    clusters = single.groupBy(*_C).agg(
        F.min_by("row", "_o").alias("row"), F.min("_o").alias("_first"), F.count("*").alias("n"), pileup.add_counts(_copies(F.col("row.tags"))).alias("copies"),
        F.sum(R.has_flag(F.col("row.flag"), "fails_qc").cast("int")).alias("fails"),
    )
    clusters = written(clusters, "clusters")
    if most is None:
        made = F.when(F.col("n") > 1, _with_copies(F.col("row"), F.col("copies"))).otherwise(F.col("row"))
        clusters = clusters.withColumn("represented", F.lit(True)).withColumn("row", made)
    else:
        low = F.col("row").withField("qual", F.transform("row.qual", lambda q: F.least(q, F.lit(most).cast(rows.schema["row"].dataType["qual"].dataType.elementType)))).withField("qname", F.concat(F.col("row.qname"), F.lit("c")))
        if "virt_offset" in reads.columns:
            low = low.withField("virt_offset", F.lit(0).cast(reads.schema["virt_offset"].dataType))
        fits = (F.col("n") == 1) & F.coalesce(F.forall("row.qual", lambda q: q <= most), F.lit(True))
        voted = _consensus(single, clusters, most)
        clusters = clusters.join(voted, _C, "left").withColumn("represented", fits)
        clusters = clusters.withColumn("row", F.when(F.col("represented"), F.col("row")).when(F.col("n") == 1, low).otherwise(F.col("_made"))).drop("_made")
        clusters = written(clusters, "cluster-records")
    clusters = clusters.withColumn("_xp", _copies(F.col("row.tags")))

    # of each place and strand: the cluster that takes in the single one, and the single one
    of_single = F.when(F.col("_kind") == SINGLE, F.struct("n", F.col("_xp").alias("xp"), "represented", F.col("row.qname").alias("qname"), F.col("row.flag").cast("int").alias("flag")))
    taker = F.when(F.col("_kind") < SINGLE, F.struct("_kind", "_f1", "_f2", "_f3"))
    info = clusters.groupBy("_at", "_rev").agg(F.min(taker).alias("_taker"), F.max(of_single).alias("_single"))
    told = clusters.join(info, ["_at", "_rev"])
    takes = (F.struct("_kind", "_f1", "_f2", "_f3") == F.col("_taker")) & F.col("_single").isNotNull()
    row = F.when(takes, _with_copies(F.col("row"), _sum_copies(F.col("_single.xp"), F.col("_xp"))))
    row = row.when((F.col("_kind") == SINGLE) & ~F.col("represented"), F.col("row").withField("flag", _clear(F.col("row.flag"), _PAIR_FLAGS).cast(reads.schema["flag"].dataType))).otherwise(F.col("row"))
    gone = (F.col("_kind") == SINGLE) & F.col("_taker").isNotNull()
    kept = told.where(~gone).select(row.alias("row"), F.when(takes, F.col("_single.n")).otherwise(F.col("n")).alias("copies_seen"))

    mates = rows.where(F.col("_kind") == UNALIGNED).join(info, ["_at", "_rev"], "left")
    own = F.col("_taker").isNull() & F.col("_single.represented") & (F.col("row.qname") == F.col("_single.qname")) & R.has_flag(F.col("_single.flag"), "paired")
    own = F.coalesce(own & (R.has_flag(F.col("_single.flag"), "first_mate") == R.has_flag(F.col("row.flag"), "second_mate")), F.lit(False))
    chosen = mates.where(own).groupBy("_at", "_rev").agg(F.min_by("row", "_o").alias("row"), F.min("_o").alias("_first"))
    out = kept.unionByName(chosen.select("row", F.lit(1).cast("bigint").alias("copies_seen")))
    if keep:
        left = single.join(clusters.select(*_C, "_first", "represented"), _C).where(~F.col("represented") | (F.col("_o") != F.col("_first"))).select("row")
        left = left.unionByName(told.where(gone & F.col("represented")).select("row"))
        left = left.unionByName(mates.select("_at", "_rev", "row", "_o").join(chosen.select("_at", "_rev", "_first"), ["_at", "_rev"], "left").where(F.col("_first").isNull() | (F.col("_o") != F.col("_first"))).select("row"))
        marked = F.col("row").withField("flag", _set(F.col("row.flag"), R.FLAGS["duplicate"]).cast(reads.schema["flag"].dataType))
        out = out.unionByName(left.select(marked.alias("row"), F.lit(0).cast("bigint").alias("copies_seen")))
    return out.select("row.*", "copies_seen").unionByName(unplaced.withColumn("copies_seen", F.lit(1).cast("bigint")))
