"""Queries on mates, molecule lengths, edit alignment, and CIGAR fused with MD."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import fused as U
from ..operators import mates as P
from . import fixtures as X
from .queries import _on_reads, _query

# A mate for two of three paired reads; what stays: unpaired reads of good quality, pairs with a sum of qualities, lone mates that pass themselves.
_MATES = "case when k % 3 <> 0 then true else false end"


@_on_reads(f"""select r.qname, r.flag, r.mapq from reads r where r.flag & 1 = 0 and r.mapq >= 20
  union all select qname, flag, mapq from reads where flag & 1 = 1 and case when {_MATES} then mapq + (mapq * 3 + k) % 61 >= 40 else mapq >= 30 end
  union all select qname, flag - 64 + 128, (mapq * 3 + k) % 61 from reads where flag & 1 = 1 and {_MATES} and mapq + (mapq * 3 + k) % 61 >= 40""")
def pair_filter(spark, sf):
    r = X.reads(spark, sf).select("k", "qname", "flag", "mapq")
    second = r.where(f"flag & 1 = 1 and {_MATES}").select("k", "qname", (F.col("flag") - 64 + 128).alias("flag"), ((F.col("mapq") * 3 + F.col("k")) % 61).alias("mapq"))
    quality = lambda c: F.col(f"{c}.mapq")
    pair = F.when(F.col("second").isNull(), quality("first") >= 30).when(F.col("first").isNull(), quality("second") >= 30).otherwise(quality("first") + quality("second") >= 40)
    return P.pair_filter(r.unionByName(second), quality("single") >= 20, pair, ["k"]).select("qname", "flag", "mapq")


# Molecules of 5 to 74 bases read from both ends by mates of unequal lengths, adapters behind short ones, a few errors.
_BASE = "substr('ACGT', cast(({}) % 4 as int) + 1, 1)"
_MOLECULES = """select c_custkey k, cast(5 + c_custkey * 13 % 70 as int) ins, 40 n1, cast(34 + c_custkey % 8 as int) n2 from {}"""
_INSERT = _BASE.format("k * 7 + i * i * 31 + i * k + i {div} 3")
_ONE = "substr(concat(m, '{0}', 'CCATGCATTAGCGGATTACAACCATGCATTAGCGGATTACA'), 1, {1})"
_MATES_SQL = f"""with a as ({_MOLECULES.format("customer")}), b as (select *, array_to_string(list_transform(range(0, ins), lambda i: {_INSERT.format(div="//")}), '') m from a),
  c as (select k, n1, n2, {_ONE.format(P.FORWARD[0], "n1")} r1, m, translate(reverse(m), 'ACGT', 'TGCA') w from b),
  d as (select k, n1, n2, case when k % 4 = 0 then concat(substr(r1, 1, 9), 'N', substr(r1, 11)) else r1 end r1, {_ONE.format(P.REVERSE[0], "n2").replace("(m,", "(w,")} r2,
    list_transform(range(0, n1), lambda i: (k * 5 + i * 3) % 41) q1, list_transform(range(0, n2), lambda i: (k * 3 + i * 5) % 41) q2 from c)
"""


def _mates(spark, sf):
    a = spark.sql(_MOLECULES.format("{c}"), c=X.table(spark, sf, "customer"))
    b = a.withColumn("m", F.expr(f"array_join(transform(sequence(0L, ins - 1L), i -> {_INSERT.format(div='div')}), '')"))
    c = b.withColumn("r1", F.expr(_ONE.format(P.FORWARD[0], "n1"))).withColumn("m", F.expr("translate(reverse(m), 'ACGT', 'TGCA')")).withColumn("r2", F.expr(_ONE.format(P.REVERSE[0], "n2")))
    return c.selectExpr("k", "n1", "n2", "case when k % 4 = 0 then concat(substr(r1, 1, 9), 'N', substr(r1, 11)) else r1 end r1", "r2", "transform(sequence(0L, n1 - 1L), i -> (k * 5 + i * 3) % 41) q1", "transform(sequence(0L, n2 - 1L), i -> (k * 3 + i * 5) % 41) q2")


def _adapter_sql(seq: str, qual: str, n: str, ads: list[str]) -> str:
    one = "coalesce(list_sum(list_transform(range(1, least({n} - l, 20) + 1), lambda i: case when {seq}[l + i] = '{ad}'[i] then 0 else 5 + least({qual}[l + i], 25) end)), 0) + 6 * greatest(0, {n} - 20 - l)"
    return "least(" + ", ".join(one.format(n=n, seq=seq, qual=qual, ad=ad) for ad in ads) + ")"


def _score_sql(second: bool) -> str:
    both = f""" + {_adapter_sql('r2', 'q2', 'n2', P.REVERSE)} + coalesce(list_sum(list_transform(range(greatest(0, l - n2) + 1, least(n1, l) + 1),
      lambda p: case when r1[p] = translate(r2[l - p + 1], 'ACGT', 'TGCA') then 0 else 5 + least(q1[p], q2[l - p + 1]) end)), 0)"""
    return f"6 * l + {_adapter_sql('r1', 'q1', 'n1', P.FORWARD)}" + (both if second else "")


def _best_sql(second: bool) -> str:
    n2 = "n2" if second else "0"
    return f"""e as (select k, n1, {n2} n2, 6 * (n1 + {n2}) plain, cast({_score_sql(second)} as bigint) s, l from d, unnest(range(0, n1 + {n2})) u(l)),
  f as (select k, n1, n2, plain, min(s) low, arg_min(l, (s, l)) place, list_sort(list(s))[2] after from e group by 1, 2, 3, 4),
  g as (select k, n1, n2, case when low < plain then place else -1 end size, case when low < plain then least(after, plain) - low else low - plain end ym, case when low < plain then plain - low else 0 end yn from f)"""


@_query(_MATES_SQL + ", " + _best_sql(True) + """select k, cast(size as bigint) size, cast(ym as bigint) ym, cast(yn as bigint) yn, case when ym < 20 or size < 0 then 'mates' when size = 0 and ym >= 60 then 'none' when ym >= 60 or size < n1 - 20 or size < n2 - 20 then 'merged' else 'all' end fate from g""")
def merge_best_insert(spark, sf):
    found = _mates(spark, sf).withColumn("s", P.insert_size(F.col("r1"), F.col("q1"), F.col("r2"), F.col("q2")))
    return found.select("k", "s.*", P.merge_decision(F.col("s.size"), F.col("s.ym"), F.col("n1"), F.col("n2"), 20, 60).alias("fate"))


@_query(_MATES_SQL + ", " + _best_sql(False) + """select k, cast(size as bigint) size, cast(ym as bigint) ym, cast(yn as bigint) yn, case when ym < 20 or size < 0 then 'mates' when size = 0 and ym >= 60 then 'none' when ym >= 60 then 'merged' else 'all' end fate from g""")
def trim_best_insert(spark, sf):
    found = _mates(spark, sf).withColumn("s", P.insert_size(F.col("r1"), F.col("q1"), F.lit(""), F.array().cast("array<bigint>")))
    return found.select("k", "s.*", P.merge_decision(F.col("s.size"), F.col("s.ym"), F.col("n1"), F.lit(0), 20, 60).alias("fate"))


@_query("""select k, case when levenshtein(a, b) < 9 then levenshtein(a, b) end distance from (select o_orderkey k, concat('GATTACA', cast(translate(cast(o_orderkey * 7919 as varchar(20)), '0123456789', 'ACGTACGTAC') as varchar(20)), 'TTGACC') a,
  concat('GATACA', cast(translate(cast(o_orderkey * 7919 + o_custkey as varchar(20)), '0123456789', 'ACGTACGTAC') as varchar(20)), 'TTGGACC') b from orders) s""")
def edit_alignment(spark, sf):
    o = X.table(spark, sf, "orders")
    text = lambda x: F.translate(x.cast("string"), "0123456789", "ACGTACGTAC")
    a, b = F.concat(F.lit("GATTACA"), text(o.o_orderkey * 7919), F.lit("TTGACC")), F.concat(F.lit("GATACA"), text(o.o_orderkey * 7919 + o.o_custkey), F.lit("TTGGACC"))
    return o.select(F.col("o_orderkey").alias("k"), A.aligned(a, b, 9).alias("r")).select("k", F.col("r.distance").cast("bigint").alias("distance"))


# A deletion in the middle, a mismatch before it, an empty deletion between numbers in odd reads; every seventh MD is one short.
_FUSED = "concat('2S5M2D', len - 9, 'M2I') cg", "concat('2A2^GT', case when k % 2 = 0 then '0C' else '1^' end, len - 10 - case when k % 7 = 0 then 1 else 0 end) m"


@_on_reads("select qname, cg cigar, case when k % 7 = 0 then null when k % 2 = 0 then m else concat('2A2^GT', cast(len - 9 as varchar(9))) end md from (select *, concat('2S5M2D', cast(len - 9 as varchar(9)), 'M2I') cg, concat('2A2^GT0C', cast(len - 10 as varchar(9))) m from reads) r")
def ecig_roundtrip(spark, sf):
    r = X.reads(spark, sf).selectExpr("*", *_FUSED)
    f = r.withColumn("f", U.fuse(F.col("cg"), F.col("m")))
    return f.select("qname", U.cigar_of(F.col("f")).alias("cigar"), U.md_of(F.col("f")).alias("md"))


@_on_reads("""select qname, case when seq[5] = 'T' then case when k % 2 = 0 then cast(len as varchar(9)) else concat('2C', cast(len - 3 as varchar(9))) end
    else concat(case when k % 2 = 0 then '4' else '2C1' end, seq[5], cast(len - 5 as varchar(9))) end md from reads""")
def md_rebuild(spark, sf):
    # the reference has C at the third place; the consensus has it in every second read, and T at the fifth in all
    r = X.reads(spark, sf).withColumn("md", F.expr("concat('2C', len - 3)"))
    new = F.expr("concat(substr(seq, 1, 2), case when k % 2 = 0 then 'C' else 'N' end, substr(seq, 4, 1), 'T', substr(seq, 6))")
    return r.select("qname", U.rebuilt_md(F.col("cigar"), F.col("md"), F.col("seq"), new).alias("md"))
