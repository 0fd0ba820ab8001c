"""Queries on whole duplicate removal: classes that resolve one another, kept originals, consensus records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions import tags as T
from ..operators import duplicates as D
from ..operators import mates
from . import fixtures as X
from .queries import _query

# Records of a library: at each place single reads, merged and trimmed ones, pairs, and mates whose partner is not aligned,
# with clipped and plain CIGARs; every second such mate has its partner in the table, and half of those do not fit it.
_OWN = [
    "k", "case when k % 7 = 5 then concat('h', cast(k as varchar(20))) else qname end qname",
    "cast(case when k % 7 = 4 then 3 + case when k % 2 = 0 then 64 else 128 end when k % 7 = 5 then 73 else 0 end + case when (k * 3) % 5 < 2 then 16 else 0 end + case when k % 11 = 0 or k % 4 = 1 then 512 else 0 end as int) flag",
    "ref_id", "pos", "mapq",
    "case when k % 7 in (2, 3) and k % 5 = 0 then concat(cast(len - 4 as varchar(9)), 'M4S') when k % 7 in (0, 1, 5) and k % 3 = 0 then concat('3S', cast(len - 3 as varchar(9)), 'M') else cigar end cigar",
    "cast(case when k % 7 in (4, 5) then ref_id else 4294967295 end as bigint) mate_ref_id",
    "cast(case when k % 7 = 4 then pos + 100 + (k % 3) * 10 when k % 7 = 5 then pos else -1 end as bigint) mate_pos",
    "seq", "qual", "cast(case when k % 7 = 2 then 2 when k % 7 = 3 then 1 else 0 end as bigint) ff",
    "cast(case when k % 13 = 0 then -1 when k % 3 = 0 then null else 1 + k % 4 end as bigint) xp", "concat('rg', cast(k % 2 as varchar(9))) rg",
    "case when k % 7 in (2, 3) and k % 5 = 0 or k % 7 in (0, 1, 5) and k % 3 = 0 then null when substr(seq, 3, 1) = 'C' then cast(len as varchar(9)) else concat('2C', cast(len - 3 as varchar(9))) end md",
    "cast(k % 3 as bigint) x0", "cast(mapq + k % 5 as bigint) score",
]
_MATE = [
    "k", "qname", "cast(5 + case when k % 4 = 0 then 64 else 128 end + case when (k * 3) % 5 < 2 then 16 else 0 end as int) flag", "ref_id", "pos", "cast(0 as bigint) mapq", "'' cigar",
    "ref_id mate_ref_id", "pos mate_pos", "seq", "qual", "cast(0 as bigint) ff", "cast(null as bigint) xp", "rg", "cast(null as varchar(9)) md", "x0", "score",
]
_MATES = "k % 7 = 5 and k % 2 = 0"
_SQL = X.SQL.rstrip() + f", own as (select {', '.join(_OWN)} from reads), lib as (select * from own union all select {', '.join(_MATE)} from own where {_MATES})"


def library(spark, sf):
    """The records in Spark, with their tags."""
    own = X.reads(spark, sf).selectExpr(*_OWN)
    lib = own.unionByName(own.where(_MATES).selectExpr(*_MATE))
    tags = [T.tag("FF", "i", F.col("ff")), T.tag("XP", "i", F.col("xp")), T.tag("RG", "Z", F.col("rg")), T.tag("MD", "Z", F.col("md")), T.tag("X0", "i", F.col("x0")), T.tag("AS", "i", F.col("score"))]
    return lib.withColumn("tags", F.filter(F.array(*tags), lambda t: t["value"].isNotNull())).drop("ff", "xp", "rg", "md", "x0", "score", "k")


def _clusters(strands: bool) -> str:
    rev = "flag & 16 <> 0" if strands else "false"
    first = "flag & 64 <> 0" if strands else "false"
    return f""", r as (select *, {rev} rev, case when flag & 1 = 0 and ff & 3 <> 0 then 0 when flag & 1 = 0 then 2 when flag & 12 = 0 then 1 when flag & 4 <> 0 then 3 else 2 end kind from lib where ref_id <> 4294967295 and pos >= 0),
 s as (select *, cast(case when kind = 0 then case when cigar like '%M4S' then length(seq) - 4 else length(seq) end when kind = 1 then mate_ref_id else 0 end as bigint) f1,
   cast(case when kind = 1 then mate_pos else 0 end as bigint) f2, kind = 1 and {first} f3 from r),
 c as (select rg, ref_id, pos, rev, kind, f1, f2, f3, min((qname, flag)) o, count(*) n, cast(case when min(coalesce(xp, 1)) = -1 then -1 else sum(coalesce(xp, 1)) end as bigint) copies, sum(case when flag & 512 <> 0 then 1 else 0 end) fails
   from s where kind < 3 group by all)"""


_SAME = "rg = {0}.rg and {1}.ref_id = {0}.ref_id and {1}.pos = {0}.pos and {1}.rev = {0}.rev and {1}.kind = {0}.kind and {1}.f1 = {0}.f1 and {1}.f2 = {0}.f2 and {1}.f3 = {0}.f3"
_PLACE = "{1}.rg = {0}.rg and {1}.ref_id = {0}.ref_id and {1}.pos = {0}.pos and {1}.rev = {0}.rev"


def _cheap_sql(strands: bool, keep: bool) -> str:
    same = f"{{1}}.{_SAME}"
    left = f""" union all select s.qname, s.flag | 1024, s.xp, 0 from s join c on {same.format("c", "s")} where (s.qname, s.flag) <> c.o
 union all select b.qname, b.flag | 1024, b.xp, 0 from b join i on {_PLACE.format("i", "b")} where kind = 2 and taker is not null
 union all select m.qname, m.flag | 1024, m.xp, 0 from m left join picked p on {_PLACE.format("p", "m")} where p.o is null or p.o <> (m.qname, m.flag)"""
    return (
        _SQL + _clusters(strands) + f""",
 b as (select c.*, s.qname, s.flag, case when n > 1 then copies else s.xp end xp from c join s on {same.format("c", "s")} and (s.qname, s.flag) = c.o),
 i as (select rg, ref_id, pos, rev, min((kind, f1, f2, f3)) filter (kind < 2) taker, max(n) filter (kind = 2) n, max(coalesce(xp, 1)) filter (kind = 2) xp, max(qname) filter (kind = 2) qname, max(flag) filter (kind = 2) flag from b group by all),
 m as (select * from s where kind = 3),
 picked as (select m.rg, m.ref_id, m.pos, m.rev, min((m.qname, m.flag)) o from m join i on {_PLACE.format("i", "m")} and taker is null and m.qname = i.qname and i.flag & 1 <> 0 and (i.flag & 64 <> 0) = (m.flag & 128 <> 0) group by all),
 out as (select b.qname, b.flag, case when i.n is null or (kind, f1, f2, f3) <> taker or taker is null then b.xp when i.xp = -1 or coalesce(b.xp, 1) = -1 then -1 else i.xp + coalesce(b.xp, 1) end xp,
   case when i.n is not null and (kind, f1, f2, f3) = taker then i.n else b.n end copies_seen from b join i on {_PLACE.format("i", "b")} where kind < 2 or taker is null
 union all select m.qname, m.flag, m.xp, 1 from m join picked p on {_PLACE.format("p", "m")} and p.o = (m.qname, m.flag)
 union all select qname, flag, xp, 1 from lib where ref_id = 4294967295 or pos < 0{left if keep else ""})
 select qname, flag, cast(xp as bigint) xp, cast(copies_seen as bigint) copies_seen from out"""
    )


def _cheap(spark, sf, strands: bool, keep: bool):
    out = D.remove(library(spark, sf), T.as_string(F.col("tags"), "RG"), strands, None, keep)
    xp = F.when(F.exists("tags", lambda t: t["key"] == "XP"), T.as_int(F.col("tags"), "XP"))
    return out.select("qname", "flag", xp.alias("xp"), "copies_seen")


@_query(_cheap_sql(True, False))
def rmdup_cheap(spark, sf):
    return _cheap(spark, sf, True, False)


@_query(_cheap_sql(False, False))
def rmdup_cheap_unstranded(spark, sf):
    return _cheap(spark, sf, False, False)


@_query(_cheap_sql(True, True))
def rmdup_cheap_keep(spark, sf):
    return _cheap(spark, sf, True, True)


MOST = 35


def _full_sql(strands: bool, keep: bool) -> str:
    same = f"{{1}}.{_SAME}"
    key = "rg, ref_id, pos, rev, kind, f1, f2, f3"
    left = f""" union all select s.qname, s.flag | 1024, s.mapq, s.cigar, s.seq, s.qual, s.xp, null, s.x0, s.score, 0 from s join b on {same.format("b", "s")} where not represented
 union all select b.qname, b.flag | 1024, b.mapq, b.cigar, b.seq, b.qual, b.xp, null, b.x0, b.score, 0 from b join i on {_PLACE.format("i", "b")} where kind = 2 and taker is not null and b.represented
 union all select m.qname, m.flag | 1024, m.mapq, m.cigar, m.seq, m.qual, m.xp, null, m.x0, m.score, 0 from m left join picked p on {_PLACE.format("p", "m")} where p.o is null or p.o <> (m.qname, m.flag)"""
    return (
        _SQL + _clusters(strands) + f""",
 g as (select {key}, cigar, count(*) k, case when cigar like '3S%' then 2 when cigar like '%S' then 0 else 1 end shape from s where kind < 3 group by all),
 v as (select {key}, arg_max(cigar, (k, shape)) cigar from g group by all),
 good as (select s.* from s join v on {same.format("v", "s")} and s.cigar = v.cigar),
 told as (select {key}, cast(round_even(sqrt(avg(mapq * mapq)), 0) as bigint) mapq, arg_min(seq, (qname, flag)) filter (md is not null) old from good group by all),
 sums as (select {key}, p, substr(seq, cast(p as int), 1) base, sum(qual[p]) q from good, unnest(range(1, length(seq) + 1)) u(p) group by all),
 tops as (select {key}, p, base, least(q - coalesce(lead(q) over (partition by {key}, p order by q desc, base), 0), {MOST}) d, row_number() over (partition by {key}, p order by q desc, base) w from sums),
 made as (select {key}, string_agg(case when d > 3 then base else 'N' end, '' order by p) seq, list(cast(case when d > 3 then d else 0 end as bigint) order by p) qual from tops where w = 1 group by all),
 voted as (select {key}, arg_max(x0, (k, x0)) x0 from (select {key}, x0, count(*) k from s where kind < 3 group by all) x group by all),
 mean as (select {key}, cast(round_even(sqrt(avg(score * score)), 0) as bigint) score from s where kind < 3 group by all),
 first as (select c.*, s.qname, s.flag, s.xp, s.mapq, s.cigar, s.seq, s.qual, s.x0, s.score from c join s on {same.format("c", "s")} and (s.qname, s.flag) = c.o),
 b as (select f.rg, f.ref_id, f.pos, f.rev, f.kind, f.f1, f.f2, f.f3, f.n, f.n = 1 and list_max(f.qual) <= {MOST} represented,
   case when f.n = 1 and list_max(f.qual) <= {MOST} then f.qname else f.qname || 'c' end qname,
   case when f.n = 1 then f.flag when 2 * f.fails > f.n then f.flag | 512 else f.flag & ~512 end flag, case when f.n = 1 then f.xp else f.copies end xp,
   case when f.n = 1 then f.mapq else told.mapq end mapq, case when f.n = 1 then f.cigar else v.cigar end cigar, case when f.n = 1 then f.seq else made.seq end seq,
   case when f.n = 1 then list_transform(f.qual, lambda x: least(x, {MOST})) else made.qual end qual,
   case when f.n = 1 then null else coalesce(list_sum(list_transform(range(1, length(old) + 1), lambda p: case when made.seq[p] = case when p = 3 then 'C' else old[p] end then 0 else 1 end)), 0) end nm,
   case when f.n = 1 then f.x0 else voted.x0 end x0, case when f.n = 1 then f.score else mean.score end score
   from first f join v on {same.format("v", "f")} join told on {same.format("told", "f")} join made on {same.format("made", "f")} join voted on {same.format("voted", "f")} join mean on {same.format("mean", "f")}),
 i as (select rg, ref_id, pos, rev, min((kind, f1, f2, f3)) filter (kind < 2) taker, max(n) filter (kind = 2) n, max(coalesce(xp, 1)) filter (kind = 2) xp, max(qname) filter (kind = 2) qname,
   max(flag) filter (kind = 2) flag, bool_or(represented) filter (kind = 2) represented from b group by all),
 m as (select * from s where kind = 3),
 picked as (select m.rg, m.ref_id, m.pos, m.rev, min((m.qname, m.flag)) o from m join i on {_PLACE.format("i", "m")} and taker is null and i.represented and m.qname = i.qname and i.flag & 1 <> 0 and (i.flag & 64 <> 0) = (m.flag & 128 <> 0) group by all),
 out as (select b.qname, case when kind = 2 and not b.represented then b.flag & ~235 else b.flag end flag, b.mapq, b.cigar, b.seq, b.qual,
   case when i.n is null or (kind, f1, f2, f3) <> taker or taker is null then b.xp when i.xp = -1 or coalesce(b.xp, 1) = -1 then -1 else i.xp + coalesce(b.xp, 1) end xp, nm, x0, score,
   case when i.n is not null and (kind, f1, f2, f3) = taker then i.n else b.n end copies_seen from b join i on {_PLACE.format("i", "b")} where kind < 2 or taker is null
 union all select m.qname, m.flag, m.mapq, m.cigar, m.seq, m.qual, m.xp, null, m.x0, m.score, 1 from m join picked p on {_PLACE.format("p", "m")} and p.o = (m.qname, m.flag)
 union all select qname, flag, mapq, cigar, seq, qual, xp, null, x0, score, 1 from lib where ref_id = 4294967295 or pos < 0{left if keep else ""})
 select qname, flag, mapq, cigar, seq, qual, cast(xp as bigint) xp, cast(nm as bigint) nm, x0, score, cast(copies_seen as bigint) copies_seen from out"""
    )


def _full(spark, sf, strands: bool, keep: bool):
    out = D.remove(library(spark, sf), T.as_string(F.col("tags"), "RG"), strands, MOST, keep)
    number = lambda key, name: F.when(F.exists("tags", lambda t: t["key"] == key), T.as_int(F.col("tags"), key)).alias(name)
    return out.select("qname", "flag", "mapq", "cigar", "seq", "qual", number("XP", "xp"), number("NM", "nm"), number("X0", "x0"), number("AS", "score"), "copies_seen")


@_query(_full_sql(True, False))
def rmdup_full(spark, sf):
    return _full(spark, sf, True, False)


@_query(_full_sql(False, True))
def rmdup_full_keep(spark, sf):
    return _full(spark, sf, False, True)


@_query(_SQL + " select a.qname, a.pos pos1, b.pos pos2, a.flag & 8 <> 0 half from lib a join lib b on a.qname = b.qname and a.flag & 65 = 65 and b.flag & 129 = 129")
def mate_join(spark, sf):
    """First and second mates of one name, half-aligned ones among them; mates without a partner stay out."""
    both = mates.paired(library(spark, sf), ["flag"]).where("first is not null and second is not null")
    half = R.has_flag(F.col("first.flag"), "mate_unmapped")
    return both.select(F.col("first.qname").alias("qname"), F.col("first.pos").alias("pos1"), F.col("second.pos").alias("pos2"), half.alias("half"))
