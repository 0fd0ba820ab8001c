"""Queries on whole records cut, merged, wrapped and aligned, on gaps between piles, and on damage by class."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fused as U
from ..functions import molecules as M
from ..functions import tags as T
from ..operators import mates, molecules, pileup
from . import fixtures as X
from . import pairs
from .queries import _on_reads, _query


def _tagged(r, **texts):
    """Reads with the given expressions as text tags, nulls left out."""
    tags = F.array(*[T.tag(k, "Z", F.expr(v) if isinstance(v, str) else v) for k, v in texts.items()])
    return r.withColumn("tags", F.filter(tags, lambda t: t["value"].isNotNull()))


def _text(key: str):
    return F.when(F.exists("tags", lambda t: t["key"] == key), T.as_string(F.col("tags"), key))


# --- cutting the ends of records

_CUT = "k % 9"


@_on_reads(f"""select qname, case when back then pos + n else pos end pos, concat(cast(len - n as varchar(9)), 'M') cigar, case when back then substr(seq, cast(n as int) + 1) else substr(seq, 1, cast(len - n as int)) end seq,
  case when back then qual[n + 1:] else qual[1:len - n] end qual, case when back then substr(seq, cast(n as int) + 1) else substr(seq, 1, cast(len - n as int)) end bq,
  case when not back then '2C' || cast(len - 3 - n as varchar(9)) when n = 0 then '2C' || cast(len - 3 as varchar(9)) when n = 1 then '1C' || cast(len - 3 as varchar(9)) when n = 2 then 'C' || cast(len - 3 as varchar(9)) else cast(len - n as varchar(9)) end md
  from (select *, {_CUT} n, flag & 16 <> 0 back from reads) x""")
def trim_3(spark, sf):
    r = _tagged(X.reads(spark, sf), MD="concat('2C', len - 3)", BQ="seq", ZZ="seq")
    out = molecules.trim_3(r, F.expr(_CUT))
    return out.select("qname", "pos", "cigar", "seq", "qual", _text("BQ").alias("bq"), _text("MD").alias("md"))


# --- merging and trimming to records

_MOLECULE_SQL = f"""with a as ({pairs._MOLECULES.format("customer")}), """ + pairs._MATES_SQL.split("), ", 1)[1]


def _fates(second: bool, name: str) -> str:
    """The CTEs of the best size, with names of their own, and the fate."""
    text = pairs._best_sql(second)
    for c in "efg":
        text = text.replace(f"{c} as (select", f"{c}{name} as (select").replace(f"from {c})", f"from {c}{name})").replace(f"from {c} group", f"from {c}{name} group")
    short = " or size < n1 - 20 or size < n2 - 20" if second else ""
    return text + f""", h{name} as (select k, size, ym, yn, case when ym < 20 or size < 0 then 'mates' when size = 0 and ym >= 60 then 'none' when ym >= 60{short} then 'merged' else 'all' end fate from g{name})"""


_SECOND = "case when k % 3 <> 0 then true else false end"


@_query(_MOLECULE_SQL + ", " + _fates(True, "2") + ", " + _fates(False, "1") + f""", w as (select d.*, size, ym, yn, fate, translate(r2, 'ACGTN', 'TGCAN') c from d join h2 using (k) where {_SECOND}),
 v as (select d.*, size, ym, yn, fate from d join h1 using (k) where not {_SECOND})
 select k, flag, seq, qual, cast(ff as bigint) ff, cast(ym as bigint) ym, cast(yn as bigint) yn from (
  select k, 77 flag, r1 seq, q1 qual, case when fate = 'all' then 4 else 0 end ff, ym, yn from w where fate in ('mates', 'all')
  union all select k, 141, r2, q2, case when fate = 'all' then 4 else 0 end, ym, yn from w where fate in ('mates', 'all')
  union all select k, 4, array_to_string(list_transform(range(0, size), lambda p: case when p < n1 and size - 1 - p < n2 then case when r1[p + 1] = c[size - p] or q1[p + 1] > q2[size - p] then r1[p + 1] else c[size - p] end when p < n1 then r1[p + 1] else c[size - p] end), ''),
    list_transform(range(0, size), lambda p: case when p < n1 and size - 1 - p < n2 then case when r1[p + 1] = c[size - p] then least(q1[p + 1] + q2[size - p], ym, 63) else abs(q1[p + 1] - q2[size - p]) end when p < n1 then q1[p + 1] else q2[size - p] end),
    case when size < n1 then 3 else 2 end + case when fate = 'all' then 4 else 0 end, ym, yn from w where fate in ('merged', 'all')
  union all select k, 4, r1, q1, case when fate = 'all' then 4 else 0 end, ym, yn from v where fate in ('mates', 'all')
  union all select k, 4, substr(r1, 1, cast(size as int)), q1[1:size], 1 + case when fate = 'all' then 4 else 0 end, ym, yn from v where fate in ('merged', 'all')) x""")
def merge_trim(spark, sf):
    d = pairs._mates(spark, sf)
    none = F.array().cast(T.KIND).alias("tags")
    row = lambda flag, seq, qual: [F.col("k"), F.col("k").cast("string").alias("qname"), F.lit(flag).alias("flag"), F.col(seq).alias("seq"), F.col(qual).alias("qual"), none]
    second = F.expr(_SECOND)
    reads = d.where(second).select(*row(77, "r1", "q1")).unionByName(d.where(second).select(*row(141, "r2", "q2"))).unionByName(d.where(~second).select(*row(4, "r1", "q1")))
    out = molecules.merge_trim(reads, 20, 60, ["k"])
    return out.select("k", "flag", "seq", "qual", *[T.as_int(F.col("tags"), t).alias(t.lower()) for t in ("FF", "YM", "YN")])


# --- circles

_SIZE = 4000
_WRAP = "concat('2S', cast(10 as varchar(9)), 'M2D', cast(len - 16 as varchar(9)), 'M2I2M')", "concat('4A5^GT', cast(len - 14 as varchar(9)))"


@_on_reads(f"""select qname, moved, case when moved then 0 else p end pos, case
   when p >= {_SIZE} or p + span <= {_SIZE} or unmapped then cg when s < 10 and not moved then concat('2S', s, 'M', len - 2 - s, 'S') when s < 10 then concat(2 + s, 'S', 10 - s, 'M2D', len - 16, 'M2I2M')
   when s = 10 and not moved then concat('2S10M', len - 12, 'S') when s = 10 then concat('12S2D', len - 16, 'M2I2M')
   when s = 11 and not moved then concat('2S10M1D', len - 12, 'S') when s = 11 then concat('12S1D', len - 16, 'M2I2M') when s = 12 and not moved then concat('2S10M2D', len - 12, 'S') when s = 12 then concat('12S', len - 16, 'M2I2M')
   when s < 12 + len - 16 and not moved then concat('2S10M2D', s - 12, 'M', len - s, 'S') when s < 12 + len - 16 then concat(s, 'S', len - 4 - s, 'M2I2M')
   when s = len - 4 and not moved then concat('2S10M2D', len - 16, 'M4S') when s = len - 4 then concat(len - 4, 'S2I2M')
   when not moved then concat('2S10M2D', len - 16, 'M2I', s - (len - 4), 'M', len - 2 - s, 'S') else concat(s + 2, 'S', len - 2 - s, 'M') end cigar,
  case when p >= {_SIZE} or p + span <= {_SIZE} or unmapped then md when s <= 4 and not moved then cast(s as varchar(9)) when s <= 4 then concat(case when s < 4 then cast(4 - s as varchar(9)) else '' end, 'A5^GT', len - 14)
   when s < 10 and not moved then concat('4A', case when s = 5 then '' else cast(s - 5 as varchar(9)) end) when s < 10 then concat(10 - s, '^GT', len - 14) when s = 10 and not moved then '4A5' when s = 10 then concat('^GT', len - 14)
   when s = 11 and not moved then '4A5^G' when s = 11 then concat('^T', len - 14) when s = 12 and not moved then '4A5^GT' when s = 12 then cast(len - 14 as varchar(9))
   when not moved then concat('4A5^GT', s - 12) else cast(len - 2 - s as varchar(9)) end md
  from (select *, {_SIZE} - p s, {_WRAP[0]} cg, {_WRAP[1]} md, len - 2 span from (select qname, len, flag & 4 <> 0 unmapped, case when k % 3 = 0 then {_SIZE} - 1 - (k % 40) else pos end p from reads where ref_id <> 4294967295) q) x,
   unnest(case when p < {_SIZE} and p + span > {_SIZE} and not unmapped then [false, true] else [false] end) u(moved)""")
def wrap_to(spark, sf):
    """Reads with clips, a deletion and an insertion, many of which hang over the end of a circle."""
    r = X.reads(spark, sf).where(F.col("ref_id") != 4294967295).withColumn("pos", F.expr(f"case when k % 3 = 0 then {_SIZE} - 1 - (k % 40) else pos end")).withColumn("cigar", F.expr(_WRAP[0]))
    circles = spark.createDataFrame([(i, f"chr{i}", _SIZE) for i in range(3)], "ref_id bigint, name string, size bigint")
    return molecules.wrapped(_tagged(r, MD=_WRAP[1]), circles).select("qname", "moved", F.col("pos").cast("bigint").alias("pos"), "cigar", _text("MD").alias("md"))


# --- alignments

_MIXED = "concat('2S5M', cast(1 + k % 2 as varchar(9)), 'D4M', cast(1 + k % 3 as varchar(9)), 'I', cast(len - 12 - k % 3 as varchar(9)), 'M')"
_MIXED_MD = "concat('1C3^', case when k % 2 = 0 then 'A' else 'AT' end, cast(len - 8 - k % 3 as varchar(9)))"
_PAIRS = "concat('--', substr(seq, 3, 1), 'C', substr(seq, 5, 3), substr(seq, 8, 4), repeat('-', cast(1 + k % 3 as int)), substr(seq, cast(13 + k % 3 as int)))"


@_on_reads(f"select qname, case when k % 7 = 0 then null else {_PAIRS} end ref, case when k % 7 = 0 then null else seq end read from reads")
def aln_from_md(spark, sf):
    """Every seventh MD is one base short, and so tells no alignment."""
    r = X.reads(spark, sf).withColumn("md", F.expr(f"case when k % 7 = 0 then concat('1C3^A', cast(len as varchar(9))) else {_MIXED_MD} end"))
    r = r.withColumn("f", U.fuse(F.expr(_MIXED), F.col("md"))).withColumn("a", U.aligned(F.col("f"), F.col("seq")))
    return r.select("qname", "a.ref", "a.read")


@_on_reads(f"select qname, {_PAIRS} ref, seq read from reads")
def aln_from_ref(spark, sf):
    ref = F.expr("concat(substr(seq, 3, 1), 'C', substr(seq, 5, 3), substr('GG', 1, cast(1 + k % 2 as int)), substr(seq, 8, 4), substr(seq, cast(13 + k % 3 as int)))")
    return X.reads(spark, sf).withColumn("a", U.aligned_to(F.col("seq"), F.expr(_MIXED), ref)).select("qname", "a.ref", "a.read")


@_on_reads(f"""select ref_id, site, ins, cast(del as bigint) del, count(*) n, cast(sum(mapq) as bigint) q from (
   select ref_id, pos + 4 site, '' ins, 1 + k % 2 del, mapq from u union all select ref_id, pos + 9 + k % 2, substr(seq, 12, cast(1 + k % 3 as int)), 0, mapq from u
   union all select ref_id, pos + i, '', 0, mapq from u, unnest(range(0, 4)) r(i) union all select ref_id, pos + 6 + k % 2 + i, '', 0, mapq from u, unnest(range(0, 3)) r(i)
   union all select ref_id, pos + 10 + k % 2 + i, '', 0, mapq from u, unnest(range(0, len - 13 - k % 3)) r(i)) x group by 1, 2, 3, 4""".replace("from u", "from (select * from reads where flag & 4 = 0 and ref_id <> 4294967295) u"))
def pileup_indels(spark, sf):
    return pileup.indel_piles(X.reads(spark, sf).withColumn("cigar", F.expr(_MIXED)), ["ref_id"])


# --- damage

_ENDS = "case k % 4 when 0 then concat('C', substr(seq, 2)) when 1 then concat(substr(seq, 1, cast(len - 1 as int)), 'C') when 2 then concat('C', substr(seq, 2, cast(len - 2 as int)), 'C') else seq end"
_ENDS_MD = "case k % 4 when 0 then concat('0C', len - 1) when 1 then concat(len - 1, 'C0') when 2 then concat('0C', len - 2, 'C0') else cast(len as varchar(9)) end"
_WIDTH = 10


@_on_reads(f"""select "end", cast(offs as int) offs, class, x, y, count(*) c from (
  select *, case when "end" = 5 then i else -i - 1 end offs, unnest([case when i < n then 'all' end, case when i < n and d5 then 'd5' end, case when i < n and d3 then 'd3' end, case when i < n and d5 and d3 then 'dd' end,
    case when "end" = 5 and (x = 'C' and nx = 'G' and i < n or x = 'G' and px = 'C' and i >= 1) or "end" = 3 and (x = 'G' and px = 'C' and i < n or x = 'C' and nx = 'G' and i >= 1) then 'cpg' end]) class from (
   select *, rf[z] x, rd[z] y, case when z > 1 then rf[z - 1] end px, rf[z + 1] nx from (
    select *, case when "end" = 5 then i + 1 else len - i end z from (
     select *, case when kind = 'complete' then least(len // 2, {_WIDTH}) else {_WIDTH} end n, rf[1] = 'C' and rd[1] = 'T' d5, rf[len] = 'C' and rd[len] = 'T' d3 from (
      select len, kind, case when back then translate(reverse(rf), 'ACGT', 'TGCA') else rf end rf, case when back then translate(reverse(seq), 'ACGT', 'TGCA') else seq end rd from (
       select len, seq, {_ENDS} rf, flag & 16 <> 0 back, case when f & 65 = 65 then 'leading' when f & 129 = 129 then 'trailing' when f & 192 <> 0 or coalesce(ff, 0) & 3 <> 0 then 'complete' else 'leading' end kind
       from (select *, case when k % 3 = 0 then xor(flag, 192) else flag end f from reads) r) a) b) c,
      unnest([5, 3]) v("end"), unnest(range(0, {_WIDTH})) w(i) where i <= n and case when "end" = 5 then kind <> 'trailing' else kind <> 'leading' end) d) e) g where class is not null group by all""")
def damage_classes(spark, sf):
    r = X.reads(spark, sf).withColumn("kind", T.fragment_type(F.expr("case when k % 3 = 0 then flag ^ 192L else flag end"), F.col("ff")))
    r = r.withColumn("f", U.fuse(F.col("cigar"), F.expr(_ENDS_MD))).withColumn("a", U.aligned(F.col("f"), F.col("seq")))
    return molecules.damage_classes(r.select("flag", "kind", "a.ref", "a.read", F.col("len").alias("n")), _WIDTH)


_ODDS = "(({0} * 37 + {1} * 11) % 60 - 40) / 10.0"


@_query(f"""with a as (select l_orderkey * 10 + l_linenumber k, cast(l_partkey % 45 as int) i, 45 + l_suppkey % 20 n, l_linenumber % 2 = 0 rev from lineitem),
 b as (select *, case when 2 * i < n then i else n - i - 1 end d, case when 2 * i < n then 5 else 3 end e from a),
 c as (select *, case when d < 12 then {_ODDS.format('d', 'e')} else -3.0 end x, case when d < 12 then {_ODDS.format('d', '(e + 1)')} else -4.0 end y from b)
 select k, round(1 / (1 + exp(-case when rev then y else x end)), 9) ct, round(1 / (1 + exp(-case when rev then x else y end)), 9) ga, round(2 - 1 / (1 + exp(-case when rev then y else x end)), 9) cc, round(1 / (1 + exp(-case when rev then y else x end)) + 0.5, 9) other from c""")
def damage_matrix_emp(spark, sf):
    """Rates by position; of the other strand's matrix the one for G to A, after half is added to it."""
    a = X.table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber k", "cast(l_partkey % 45 as int) i", "45 + l_suppkey % 20 n", "l_linenumber % 2 = 0 rev")
    odds = lambda e: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda d: F.struct(((d * 37 + e * 11) % 60 - 40).cast("double").__truediv__(10.0).alias("a"), (((d * 37 + (e + 1) * 11) % 60 - 40) / 10.0).alias("b")))
    p, q = M.empirical_rates(F.col("i"), F.col("n"), F.col("rev"), odds(5), odds(3), (-3.0, -4.0))
    m = a.select("k", M.substitution_matrix(p, q).alias("m"))
    whole = M.at_matrix(M.scalar_matrix(F.lit(1.0)), "C", "C") + M.at_matrix(F.col("m"), "C", "C")
    other = M.at_matrix(M.nudged_matrix(M.complement_matrix(F.col("m")), "G", "A", F.lit(0.5)), "G", "A")
    return m.select("k", F.round(M.at_matrix(F.col("m"), "C", "T"), 9).alias("ct"), F.round(M.at_matrix(F.col("m"), "G", "A"), 9).alias("ga"), F.round(whole, 9).alias("cc"), F.round(other, 9).alias("other"))
