"""Whole records cut, merged, split and aligned: what becomes of a read's bases, CIGAR, MD text, tags and place together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fused as U
from ..functions import molecules as M
from ..functions import reads as R
from ..functions import sequences as S
from ..functions import tags as T
from . import mates

#: Tags whose text has a letter for each base.
BY_BASE = "BQ CQ CS E2 OQ U2".split()
#: The most that a merged base's quality can be, whatever the score says.
MOST = 63
_PAIR_FLAGS = sum(R.FLAGS[k] for k in ("paired", "proper", "mate_unmapped", "mate_reversed", "first_mate", "second_mate"))


def _fused(reads: DataFrame) -> DataFrame:
    md = T.as_string(F.col("tags"), "MD")
    return reads.withColumn("_f", U.fuse(F.col("cigar"), F.when(F.exists("tags", lambda t: t["key"] == "MD"), md)))


def _with_md(tags: Column, fused: Column) -> Column:
    """MD text of the list in place of the old one, none where it is not known; records without MD get none."""
    md = U.md_of(fused)
    return F.when(F.exists(tags, lambda t: t["key"] == "MD"), F.when(md.isNotNull(), T.update(tags, "MD", T.tag("MD", "Z", md))).otherwise(T.delete(tags, "MD"))).otherwise(tags)


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with columns computed from the old ones, all at once, of the old types."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.withColumns({c: v.cast(kinds[c]) for c, v in new.items() if c in kinds})


def trim_3(reads: DataFrame, n: Column) -> DataFrame:
    """Records without the last n bases of the molecule, which are the first ones of a reversed record.

    Bases, qualities, CIGAR, position, MD text and the tags that go along with bases are cut; a read shorter than n is left
    without bases.  n of 0 or less changes nothing.
    """
    f = _fused(reads.withColumn("_n", F.greatest(F.least(n.cast("int"), F.length("seq")), F.lit(0))))
    back = ~R.has_flag(F.col("flag"), "reversed")
    left = F.length("seq") - F.col("_n")
    end, _ = S.trimmed_cigar(F.col("cigar"), F.col("_n"), True)
    front, shift = S.trimmed_cigar(F.col("cigar"), F.col("_n"), False)
    text = lambda t: F.when(back, F.substring(t, F.lit(1), F.greatest(F.length(t) - F.col("_n"), F.lit(0)))).otherwise(F.substring(t, F.col("_n") + 1, F.length(t)))
    cut = F.transform("tags", lambda t: F.when(t["key"].isin(*BY_BASE) & (t["typ"] == "Z"), F.struct(t["key"].alias("key"), t["typ"].alias("typ"), text(t["value"]).alias("value"))).otherwise(t))
    tags = F.when(back, _with_md(cut, U.cut(F.col("_f"), F.col("_n"), True))).otherwise(_with_md(cut, U.cut(F.col("_f"), F.col("_n"), False)))
    qual = F.when(back, F.slice("qual", F.lit(1), F.greatest(F.least(left, F.size("qual")), F.lit(0)))).otherwise(F.slice("qual", F.col("_n") + 1, F.greatest(F.size("qual"), F.lit(0))))
    same = F.col("_n") == 0
    new = {"seq": text(F.col("seq")), "qual": qual, "cigar": F.when(back, end).otherwise(front), "pos": F.when(back, F.col("pos")).otherwise(F.col("pos") + shift), "tags": tags}
    return _replace(f, {c: F.when(same, F.col(c)).otherwise(v) for c, v in new.items()}).drop("_n", "_f")


def trim_3_while(reads: DataFrame, holds) -> DataFrame:
    """Records without the longest stretch at the molecule's end all of whose own stretches from that end satisfy
    holds(bases, qualities), a condition on a text and an array, each from the molecule's end inwards.

    Cut as `trim_3` cuts.  Reads without bases stay; qualities that are missing give shorter arrays than texts.
    """
    back = R.has_flag(F.col("flag"), "reversed")
    ends = F.array(F.struct(F.when(back, F.col("seq")).otherwise(F.reverse("seq")).alias("s"), F.when(back, F.col("qual")).otherwise(F.reverse("qual")).alias("q")))
    ended = reads.withColumn("_e", F.explode(ends))
    n = R.trailing_while(F.coalesce(F.length("_e.s"), F.lit(0)), lambda k: holds(F.substring("_e.s", F.lit(1), k), F.slice("_e.q", F.lit(1), k)))
    return trim_3(ended.withColumn("_k", n), F.col("_k")).drop("_e", "_k")


def bcl_clusters(cycles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster, data): the bytes of each cluster by cycle, out of one row for each cycle of a tile.

    cycles has keys (which tell tiles apart), cycle (a number) and data (binary), a byte for each cluster from 0 on.  A row
    holds as many bytes as there are cycles.  Null data have no clusters; a cluster that a cycle lacks has a shorter array.
    """
    byte = lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("int")
    many = F.length("data")
    each = cycles.where(many > 0).select(*keys, "cycle", F.posexplode(F.transform(F.sequence(F.lit(1), many), byte)).alias("cluster", "_b"))
    rows = each.groupBy(*keys, "cluster").agg(F.array_sort(F.collect_list(F.struct("cycle", "_b"))).alias("_a"))
    return rows.select(*keys, "cluster", F.transform("_a", lambda x: x["_b"]).alias("data"))


def on_circle(reads: DataFrame, circles: DataFrame) -> DataFrame:
    """Records moved into their circle: places and mates' places modulo its size.

    circles has ref_id, name and size; it is small and joined as Spark sees fit.  A record whose only other hit is the same
    place on the circle gets mapping quality 37 and loses its XA.  `moved` tells whether the position became smaller.
    Records of other references pass.
    """
    c = circles.select(F.col("ref_id").cast("bigint").alias("ref_id"), F.col("name").alias("_name"), F.col("size").cast("bigint").alias("_size"))
    r = reads.join(c, "ref_id", "left").select(*[F.col(f"`{x}`") for x in reads.columns], "_name", "_size")
    on = F.col("_size").isNotNull()
    same = on & M.other_hit_is_same(T.as_string(F.col("tags"), "XA"), F.col("_name"), F.col("_size"), F.col("pos"), R.has_flag(F.col("flag"), "reversed"))
    r = r.withColumn("moved", F.coalesce(on & (F.col("pos") >= F.col("_size")), F.lit(False)))
    into = lambda x: F.when(on, F.pmod(F.col(x), F.col("_size"))).otherwise(F.col(x))
    return _replace(r, {"pos": into("pos"), "mate_pos": into("mate_pos"), "mapq": F.when(same, 37).otherwise(F.col("mapq")), "tags": F.when(same, T.delete(F.col("tags"), "XA")).otherwise(F.col("tags"))}).drop("_name", "_size")


def wrapped(reads: DataFrame, circles: DataFrame) -> DataFrame:
    """Records inside their circle; one that hangs over its end becomes two, each with the bases of the other clipped.

    The second begins at 0 and has `moved` set; it is out of order.  Unmapped records and those of other references pass.
    circles has ref_id and size.
    """
    c = circles.select(F.col("ref_id").cast("bigint").alias("ref_id"), F.col("size").cast("bigint").alias("_size"))
    r = _fused(reads).join(c, "ref_id", "left").select(*[F.col(f"`{x}`") for x in reads.columns], "_f", "_size")
    over = ~R.has_flag(F.col("flag"), "unmapped") & (F.col("pos") < F.col("_size")) & (F.col("_size") < F.col("pos") + R.aligned_length(F.col("cigar")))
    a, b = U.split_at(F.col("_f"), F.col("_size") - F.col("pos"))
    r = r.withColumn("_over", F.coalesce(over, F.lit(False))).withColumn("_a", a).withColumn("_b", b)
    r = r.withColumn("moved", F.explode(F.when(F.col("_over"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    part = F.when(F.col("moved"), F.col("_b")).otherwise(F.col("_a"))
    new = {"cigar": U.cigar_of(part), "tags": _with_md(F.col("tags"), part), "pos": F.when(F.col("moved"), 0).otherwise(F.col("pos"))}
    return _replace(r, {c: F.when(F.col("_over"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_f", "_size", "_over", "_a", "_b")


def merge_trim(reads: DataFrame, low: int, high: int, order: list[str], forward: list[str] = mates.FORWARD, reverse: list[str] = mates.REVERSE, raw: bool = False) -> DataFrame:
    """Pairs merged and single reads trimmed: for each molecule its mates (or read), the merged or trimmed record, or both.

    Scores decide (`mates.merge_decision`).  All records get YM and YN; merged ones have FF 2 (and 1 if shorter than the first
    mate), trimmed ones 1, and 4 is added where both forms stay.  Made records are unmapped, of no place, named and tagged as
    the first mate, their qualities at most the lower of YM and 63.  Molecules of no length go.  With `raw`, bases that only
    the second mate shows stay as they were read.  Mates without their partner pass unchanged.  reads has qname, flag, seq,
    qual and tags; places, if there, are reset.
    """
    p = mates.paired(reads, order).withColumn("_pair", F.col("first").isNotNull() & F.col("second").isNotNull())
    lone = p.where("single is null and not _pair").select(F.coalesce("first", "second").alias("row"))
    p = p.where("single is not null or _pair").withColumn("_one", F.coalesce("single", "first"))
    seq2, none = F.coalesce("second.seq", F.lit("")), F.array().cast(reads.schema["qual"].dataType.simpleString())
    p = p.withColumn("_s", mates.insert_size(F.col("_one.seq"), F.col("_one.qual"), seq2, F.coalesce("second.qual", none), forward, reverse))
    n1, n2 = F.length("_one.seq"), F.length(seq2)
    p = p.withColumn("_fate", mates.merge_decision(F.col("_s.size"), F.col("_s.ym"), n1, n2, low, high, F.col("_pair")))
    p = p.withColumn("_m", S.merged(F.col("_s.size"), F.col("_one.seq"), F.col("_one.qual"), seq2, F.coalesce("second.qual", none), F.least(F.col("_s.ym"), F.lit(MOST)), raw))
    kinds = {f.name: f.dataType.simpleString() for f in reads.schema}

    def told(row: Column, extra: Column) -> Column:
        """The row with its scores and FF bits."""
        tags = row["tags"]
        ff = T.as_int(tags, "FF").bitwiseOR(extra.cast("bigint"))
        tags = F.when(extra != 0, T.update(tags, "FF", T.tag("FF", "i", ff))).otherwise(tags)
        tags = T.update(T.update(tags, "YN", T.tag("YN", "i", F.col("_s.yn"))), "YM", T.tag("YM", "i", F.col("_s.ym")))
        return row.withField("tags", tags.cast(kinds["tags"]))

    one, size = F.col("_one"), F.col("_s.size")
    both = F.when(F.col("_fate") == "all", R.EXT_FLAGS["alternative"]).otherwise(0)
    flag = one["flag"].bitwiseOR(F.lit(R.FLAGS["unmapped"]))
    flag = F.when(F.col("_pair"), flag.bitwiseAND(F.lit(0xFFFF ^ _PAIR_FLAGS))).otherwise(flag)
    length = F.greatest(size, F.lit(0)).cast("int")
    seq = F.when(F.col("_pair"), F.array_join(F.transform("_m", lambda x: x["base"]), "")).otherwise(F.substring(one["seq"], F.lit(1), length))
    qual = F.when(F.col("_pair"), F.transform("_m", lambda x: x["q"])).otherwise(F.slice(one["qual"], F.lit(1), length).cast("array<bigint>"))
    made = {"flag": flag, "seq": seq, "qual": qual, "ref_id": F.lit(R.INVALID_REF), "pos": F.lit(-1), "mapq": F.lit(0), "cigar": F.lit(""), "mate_ref_id": F.lit(R.INVALID_REF), "mate_pos": F.lit(-1), "isize": F.lit(0), "virt_offset": F.lit(0)}
    new = one
    for c, v in made.items():
        if c in kinds:
            new = new.withField(c, v.cast(kinds[c]))
    bits = F.when(F.col("_pair"), F.when(size < n1, 3).otherwise(2)).otherwise(1)
    whole = F.col("_fate").isin("mates", "all")
    rows = F.array(
        F.when(whole, told(one, both)), F.when(whole & F.col("_pair"), told(F.col("second"), both)), F.when(F.col("_fate").isin("merged", "all"), told(new, bits.bitwiseOR(both))),
    )
    out = p.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("row"))
    return out.unionByName(lone).select("row.*")


def damage_classes(aligned: DataFrame, width: int) -> DataFrame:
    """end (5 or 3), offs (from 0 at the front, from -1 at the back), class, x, y, c: substitutions near both ends of molecules.

    aligned has flag, kind (`functions.tags.fragment_type`), n (the number of bases) and the texts ref and read of an
    alignment (`fused.aligned`).  Reversed records are turned round.  Class `all` counts each base, `d5` and `d3` those of
    molecules whose first or last pair is C to T, `dd` both; `cpg` those at a C before a G and at that G.  Only pairs of A, C,
    G and T count.  Molecules with both ends are read to half their length from each, others from their own end.
    """
    back = R.has_flag(F.col("flag"), "reversed")
    turn = lambda t: F.when(back, R.reverse_complement(t)).otherwise(t)
    a = aligned.where("ref is not null and ref <> ''").select("kind", turn(F.col("ref")).alias("ref"), turn(F.col("read")).alias("read"), F.col("n").cast("int").alias("n"))
    size = F.length("ref")
    reach = F.least(F.when(F.col("kind") == "complete", F.expr("n div 2").cast("int")).otherwise(F.col("n")), F.lit(width))
    a = a.select("ref", "read", size.alias("size"), F.when(F.col("kind") != "trailing", reach).otherwise(0).alias("n5"), F.when(F.col("kind") != "leading", reach).otherwise(0).alias("n3"),
        ((F.left("ref", F.lit(1)) == "C") & (F.left("read", F.lit(1)) == "T")).alias("d5"), ((F.right("ref", F.lit(1)) == "C") & (F.right("read", F.lit(1)) == "T")).alias("d3"))
    # one base more than counted, as the other half of a CG may lie there
    last = lambda n: F.least(F.col(n), F.col("size") - 1, F.lit(width - 1))
    places = lambda end, n: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), last(n)), lambda i: F.struct(F.lit(end).alias("end"), i.alias("i"))))
    empty = F.array().cast("array<struct<end:int,i:int>>")
    rows = a.select("*", F.explode(F.concat(F.coalesce(places(5, "n5"), empty), F.coalesce(places(3, "n3"), empty))).alias("p")).select("*", "p.*")
    front = F.col("end") == 5
    at = F.when(front, F.col("i")).otherwise(F.col("size") - 1 - F.col("i")) + 1
    letter = lambda t, k: F.when((k >= 1) & (k <= F.col("size")), F.substring(t, k, F.lit(1)))
    rows = rows.select("end", "i", "d5", "d3", F.when(front, F.col("n5")).otherwise(F.col("n3")).alias("n"), letter("ref", at).alias("x"), letter("read", at).alias("y"), letter("ref", at - 1).alias("_p"), letter("ref", at + 1).alias("_n"))
    inside = F.col("i") < F.col("n")
    c_of, g_of = (F.col("x") == "C") & (F.col("_n") == "G"), (F.col("x") == "G") & (F.col("_p") == "C")
    # a CG counts if its half nearer to the end is counted
    cpg = F.coalesce(F.when(F.col("end") == 5, c_of & inside | g_of & (F.col("i") >= 1)).otherwise(g_of & inside | c_of & (F.col("i") >= 1)), F.lit(False))
    named = F.array(F.when(inside, F.lit("all")), F.when(inside & F.col("d5"), F.lit("d5")), F.when(inside & F.col("d3"), F.lit("d3")), F.when(inside & F.col("d5") & F.col("d3"), F.lit("dd")), F.when(cpg, F.lit("cpg")))
    rows = rows.where(F.col("x").isin(*"ACGT") & F.col("y").isin(*"ACGT"))
    rows = rows.select("end", F.when(F.col("end") == 5, F.col("i")).otherwise(-F.col("i") - 1).alias("offs"), F.explode(F.array_compact(named)).alias("class"), "x", "y")
    return rows.groupBy("end", "offs", "class", "x", "y").agg(F.count("*").alias("c"))
