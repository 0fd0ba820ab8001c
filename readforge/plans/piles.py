"""Queries on piles by strand, quality, offset and reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import molecules as M
from ..operators import piles
from . import fixtures as X
from .queries import _on_reads

_D, _N = "cast(1 + k % 2 as int)", "cast(1 + k % 3 as int)"
#: Reads with clips, a deletion (of every fifth a gap) and an insertion.
_CIGAR = "concat('2S5M', cast(1 + k % 2 as varchar(9)), case when k % 5 = 0 then 'N' else 'D' end, '4M', cast(1 + k % 3 as varchar(9)), 'I', cast(len - 12 - k % 3 as varchar(9)), 'M')"
#: One differing base; every eleventh read has no MD text.
_MD = "case when k % 11 = 0 then null when k % 5 = 0 then concat('1C', cast(len - 5 - k % 3 as varchar(9))) else concat('1C3^', case when k % 2 = 0 then 'A' else 'AT' end, cast(len - 8 - k % 3 as varchar(9))) end"
#: Every fourth read has a BQ text, three letters short; every sixth an unknown base; every thirteenth no qualities.
_BQ = "case when k % 4 = 1 then {0} end"
_SEQ = "case when k % 6 = 0 then concat(substr(seq, 1, 2), 'N', substr(seq, 4)) else seq end"

_PARTS = f"""parts as (
  select ref_id, rg, site, back reversed, base, q[i + 1] q, case when 2 * i > len then i - len else i end "offset", ref, mapq, "on", del, ins,
    case when ins = '' then [] else q[12:11 + n] end ins_q, case when ins = '' then [] else list_transform(range(11, 11 + n), lambda j: case when 2 * j > len then j - len else j end) end ins_offset from (
   select *, pos + i - 2 + case when i >= 7 then d else 0 end - case when i >= 11 then n else 0 end site, case when s[i + 1] = 'N' then 'A' else s[i + 1] end base,
     case when k % 11 = 0 then 'N' when i = 3 then 'C' else s[i + 1] end ref, not (i = len - 1 or i = 6 and k % 5 = 0) "on",
     case when i <> 6 or k % 5 = 0 then '' when k % 11 = 0 then repeat('N', d) else substr('AT', 1, d) end del, case when i = 10 then substr(s, 12, n) else '' end ins from (
    select *, list_transform(range(0, len), lambda j: case when s[j + 1] = 'N' then 0 else least(mapq, case when k % 13 = 0 then 30 else qual[j + 1] end + case when k % 4 = 1 and j < len - 3 then (j * 5 + k) % 7 else 0 end) end) q from (
     select *, flag & 16 <> 0 back, {_D} d, {_N} n, {_SEQ} s from reads where flag & 4 = 0 and ref_id <> 4294967295) a) b, unnest(range(0, len)) r(i) where i >= 2 and not (i >= 11 and i < 11 + n)) c)"""


def _on_parts(select: str):
    return _on_reads(f"select * from (with {_PARTS} {select}) parts")


def _parts(spark, sf):
    bq = "array_join(transform(sequence(0L, len - 4), j -> char(64 + (j * 5 + k) % 7)), '')"
    r = X.reads(spark, sf).selectExpr("ref_id", "rg", "pos", "mapq", "flag", f"{_CIGAR} cigar", f"{_MD} md", f"{_BQ.format(bq)} bq", f"{_SEQ} seq", "case when k % 13 = 0 then transform(qual, q -> 255L) else qual end qual")
    return piles.decompose(r, ["ref_id", "rg"], F.col("md"), F.col("bq"))


@_on_parts("""select ref_id, rg, site, reversed, base, q, "offset", ref, count(*) n from parts group by all""")
def pileup_bases(spark, sf):
    return piles.bases(_parts(spark, sf), ["ref_id", "rg"])


@_on_parts("""select ref_id, rg, site, reversed, mapq, del, ins, ins_q, ins_offset, count(*) n from parts where "on" group by all""")
def pileup_changes(spark, sf):
    return piles.changes(_parts(spark, sf), ["ref_id", "rg"])


@_on_parts("""select ref_id, site, count(*) depth, count(*) filter (mapq = 0) mapq0, cast(sum(mapq) as bigint) sum_mapq, cast(sum(mapq * mapq) as bigint) sum_mapq2, count(*) filter ("on") on_depth, count(*) filter ("on" and mapq = 0) on_mapq0,
  cast(coalesce(sum(mapq) filter ("on"), 0) as bigint) on_sum_mapq, cast(coalesce(sum(mapq * mapq) filter ("on"), 0) as bigint) on_sum_mapq2 from parts group by all""")
def pileup_statistics(spark, sf):
    return piles.statistics(_parts(spark, sf), ["ref_id"])


#: Rates of C to T by offset from the front and of G to A by offset from the back, as of double-stranded libraries.
_CT, _GA = "case when \"offset\" >= 0 then 0.4 * pow(0.7, \"offset\") else 0.01 end", "case when \"offset\" < 0 then 0.4 * pow(0.7, -\"offset\" - 1) else 0.01 end"
_LIKELY = """case base when 'A' then 1 - e when 'C' then e / 3 when 'G' then e / 3 else e / 3 end a,
  (1 - ct) * case when base = 'C' then 1 - e else e / 3 end + ct * case when base = 'T' then 1 - e else e / 3 end c, (1 - ga) * case when base = 'G' then 1 - e else e / 3 end + ga * case when base = 'A' then 1 - e else e / 3 end g, case when base = 'T' then 1 - e else e / 3 end t"""


@_on_parts(f"""select ref_id, site, count(*) n, round(sum(ln(a)), 6) a, round(sum(ln(c)), 6) c, round(sum(ln(g)), 6) g, round(sum(ln(t)), 6) t from (
  select *, {_LIKELY} from (select *, pow(10, -q / 10.0) e, {_CT} ct, {_GA} ga from parts where q > 0) x) y group by all""")
def pileup_likelihoods(spark, sf):
    """Log likelihoods of each base at each site, with damage by offset; bases without quality say nothing.  Double-stranded
    damage looks alike on both strands, so reversed reads have the same rates."""
    p = piles.bases(_parts(spark, sf).where("q > 0"), ["ref_id"])
    ct, ga = [F.expr(x.replace('"', "`")) for x in (_CT, _GA)]
    p = p.withColumn("l", piles.likelihoods(F.col("base"), F.col("q"), M.substitution_matrix(ct, ga)))
    sums = [F.round(F.sum(F.col("n") * F.log(F.get("l", F.lit(i)))), 6).alias(c) for i, c in enumerate("acgt")]
    return p.groupBy("ref_id", "site").agg(F.sum("n").alias("n"), *sums)
