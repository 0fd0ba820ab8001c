"""Registered queries on names, coordinates, adapters, the reference sequence and damage, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import molecules as M
from ..functions import reads as R
from ..operators import genome, pileup, streams
from . import fixtures as X
from .queries import BY, ORDER, _on_reads, _on_stream, _query

ADAPTER = "AGATCGGAAGAGCACACGTC"
LENGTH = 6000


@_on_reads("""select qname, flag_ & ~641 | (case m when '1' then 65 when '2' then 129 else 0 end) | (case when k % 9 = 0 then 512 else 0 end) flag, case when k % 4 <> 0 then substr(seq, 1, 6) else null end xi
  from (select *, flag as flag_, cast(1 + k % 2 as varchar) m from reads) r""")
def fastq_cassava(spark, sf):
    r = X.reads(spark, sf).withColumn("d", F.expr("concat(cast(1 + k % 2 as string), ':', if(k % 9 = 0, 'Y', 'N'), ':0:', if(k % 4 = 0, 'x', substr(seq, 1, 6)), ' rest')"))
    c = M.cassava(F.col("d"), F.col("flag"))
    return r.select("qname", c["flag"].cast("bigint").alias("flag"), c["xi"].alias("xi"))


_WARTS = "select o_orderkey k, concat(case o_orderkey % 8 when 0 then 'F_' when 1 then 'R_' when 2 then 'M_' when 3 then 'T_' when 4 then 'C_' when 5 then 'C_F_' when 6 then 'M_C_' else '' end, 'r', cast(o_orderkey as varchar(20)), case o_custkey % 5 when 0 then '/1' when 1 then '/2' else '' end, case o_custkey % 3 when 0 then '#ACG' when 1 then '#ACG,TT' else '' end) n from orders"


@_query(f"""with a as ({_WARTS}), b as (select k, string_split(n, '#')[1] n, string_split(n, '#')[2] t from a), c as (select *, starts_with(n, 'C_') e from b),
  d as (select *, case when e then substr(n, 3) else n end m from c), f as (select *, case when regexp_matches(m, '^[FRMT]_') then m[1] when ends_with(m, '/1') then '1' when ends_with(m, '/2') then '2' else '' end kind from d),
  g as (select *, case when kind in ('F','R','M','T') then substr(m, 3) else m end i from f)
  select k, case when kind in ('F','R','M','T') then regexp_replace(i, '^C_', '') when kind in ('1', '2') then m[:-3] else i end as name, cast(case when kind in ('F','1') then 65 when kind in ('R','2') then 129 else 0 end as int) flag,
    cast(case kind when 'M' then 2 when 'T' then 1 end as int) ff, cast(case when e or (kind in ('F','R','M','T') and starts_with(i, 'C_')) then -1 end as int) xp, string_split(t, ',')[1] xi, string_split(t, ',')[2] xj from g""")
def name_warts(spark, sf):
    n = spark.sql(_WARTS.replace("from orders", "from {o}"), o=X.table(spark, sf, "orders"))
    return n.select("k", M.plain_name(F.col("n")).alias("p")).select("k", "p.*")


@_query("""with r as (select o_orderkey k, cast(o_custkey % 90 as bigint) s1, cast(10 + o_orderkey % 30 as bigint) n1, cast(case when o_orderkey % 2 = 0 then -1000 - o_custkey else o_custkey end as bigint) s2, cast(80 as bigint) n2 from orders),
  x as (select *, case when s2 < 0 then -s2 - n2 else s2 end + least(s1, n2) a, case when s1 <= n2 then least(n1, n2 - s1) else 0 end n from r)
  select k, case when s2 < 0 then -a - n else a end "start", n length, -s2 - n2 reversed_start, ((s2 % 977) + 977) % 977 wrapped from x""")
def range_algebra(spark, sf):
    o = X.table(spark, sf, "orders")
    s1, n1 = (o.o_custkey % 90).cast("bigint"), (10 + o.o_orderkey % 30).cast("bigint")
    s2, n2 = F.when(o.o_orderkey % 2 == 0, -1000 - o.o_custkey).otherwise(o.o_custkey).cast("bigint"), F.lit(80).cast("bigint")
    start, n = M.inside_range(s1, n1, s2, n2)
    return o.select(F.col("o_orderkey").alias("k"), start.alias("start"), n.cast("bigint").alias("length"), M.reverse_range(s2, n2).alias("reversed_start"), F.pmod(s2, F.lit(977)).cast("bigint").alias("wrapped"))


_XA = "case k % 4 when 0 then concat('chr1,+', cast(pos % 1000 + 1 as varchar(9)), ',24M,0;') when 1 then concat('chr1,-', cast(pos + 1 as varchar(9)), ',24M,0') when 2 then 'chr2,+5,24M,0;' else 'chr1,+1,24M,0;chr1,+2,24M,0;' end"


@_on_reads("select qname, pos % 1000 pos, pos >= 1000 moved, case when (k % 4 = 0 and flag & 16 = 0) or (k % 4 = 1 and flag & 16 <> 0) then 37 else mapq end mapq from reads where ref_id <> 4294967295")
def circular_normalize(spark, sf):
    r = X.reads(spark, sf).where(R.valid_ref(F.col("ref_id"))).withColumn("xa", F.expr(_XA))
    size = F.lit(1000).cast("bigint")
    same = M.other_hit_is_same(F.col("xa"), F.lit("chr1"), size, F.col("pos"), R.has_flag(F.col("flag"), "reversed"))
    return r.select("qname", F.pmod("pos", size).alias("pos"), (F.col("pos") >= size).alias("moved"), F.when(same, F.lit(37).cast("bigint")).otherwise(F.col("mapq")).alias("mapq"))


@_on_reads("""select qname, array_to_string(list_transform(b, lambda x: case when x = 0 then 'N' else substr('ACGT', cast(x % 4 + 1 as int), 1) end), '') bases,
  list_transform(b, lambda x: x // 4) quals from (select qname, list_transform(range(0, 16), lambda i: (k * 17 + i * 23) % 256) b from reads) r""")
def bcl_decode(spark, sf):
    r = X.reads(spark, sf).selectExpr("qname", "transform(sequence(0L, 15L), i -> (k * 17 + i * 23) % 256) b")
    return r.select("qname", F.array_join(F.transform("b", M.bcl_base), "").alias("bases"), F.transform("b", M.bcl_quality).alias("quals"))


@_on_reads(f"""select qname, coalesce((select cast(sum(case when seq[l + i] = '{ADAPTER}'[i] then 0 else 5 + least(qual[l + i], 25) end) as bigint) from unnest(range(1, least(len - l, 20) + 1)) u(i)), 0) score
  from (select *, k % 40 l from reads) r""")
def adapter_score(spark, sf):
    r = X.reads(spark, sf)
    return r.select("qname", M.adapter_score((r.k % 40).cast("int"), r.seq, r.qual, ADAPTER).alias("score"))


@_on_reads("""select qname, coalesce((select cast(sum(case when seq[f + i] = translate(seq2, 'ACGT', 'TGCA')[e - i + 1] then 0 else 5 + least(qual[f + i], qual[e - i + 1]) end) as bigint) from unnest(range(1, least(len, l) - f + 1)) u(i)), 0) score
  from (select *, greatest(0, l - n2) f, least(l, n2) e from (select *, reverse(seq) seq2, len n2, k % 96 l from reads) q) r""")
def overlap_score(spark, sf):
    r = X.reads(spark, sf).withColumn("seq2", F.reverse("seq"))
    return r.select("qname", M.overlap_score((r.k % 96).cast("int"), F.col("seq"), F.col("qual"), F.col("seq2"), F.col("qual")).alias("score"))


@_on_reads("select qname, list_min(qual) least, cast(list_position(qual, list_min(qual)) - 1 as bigint) place, list_sort(qual)[2] runner_up from reads")
def two_mins(spark, sf):
    low = F.array_sort(F.transform("qual", lambda q, i: F.struct(q.alias("q"), i.alias("i"))))
    return X.reads(spark, sf).select("qname", low.alias("t")).select("qname", F.col("t")[0]["q"].alias("least"), F.col("t")[0]["i"].cast("bigint").alias("place"), F.col("t")[1]["q"].alias("runner_up"))


@_query("""with i as (select distinct cast(24 + c_custkey % 40 as bigint) l, c_custkey % 2 = 1 r from customer), x as (select l, r, cast(i as bigint) i from i, unnest(range(0, l)) u(i)),
  y as (select *, pow(0.3, case when r then l - i else 1 + i end) a, pow(0.2, case when r then 1 + i else l - i end) b from x), z as (select *, 0.4 * (a + b - a * b) + 0.01 * (1 - (a + b - a * b)) s from y)
  select l, r, i, round(case when r then 0 else s end + pow(0.25, 1 + i) * 0.1 + (1 - pow(0.25, 1 + i)) * 0.02, 9) p, round(case when r then s else 0 end + pow(0.25, l - i) * 0.1 + (1 - pow(0.25, l - i)) * 0.02, 9) q from z""")
def damage_matrix_univ(spark, sf):
    c = X.table(spark, sf, "customer").select((24 + F.col("c_custkey") % 40).cast("bigint").alias("l"), (F.col("c_custkey") % 2 == 1).alias("r")).distinct()
    c = c.select("l", "r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("l") - 1)).alias("i"))
    p, q = M.damage_rates(c.i, c.l, c.r, (0.4, 0.01, 0.3, 0.2), (0.1, 0.02, 0.25))
    return c.select("l", "r", "i", F.round(p, 9).alias("p"), F.round(q, 9).alias("q"))


@_query("""with n as (select distinct cast(1 + c_custkey % 150 as bigint) len from customer), t as (select len, cast(k as bigint) k, sum(exp(-len * 0.02) * pow(len * 0.02, k) / factorial(cast(k as int))) over (partition by len order by k) s from n, unnest(range(0, 15)) u(k))
  select len, min(k) most from t where 1 - s < 0.04 group by len""")
def bwa_maxdiff(spark, sf):
    n = X.table(spark, sf, "customer").select((1 + F.col("c_custkey") % 150).cast("bigint").alias("len")).distinct()
    return n.select("len", M.most_differences(F.col("len"), 0.04).alias("most"))


@_query("select o_orderkey, format('{:,}', cast(o_orderkey * 7919 as bigint)) t from orders")
def num_format(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", F.format_number(F.col("o_orderkey") * 7919, 0).alias("t"))


@_query("""with a as (select o_orderkey, cast(o_orderkey * o_custkey % 1000000007 * case when o_orderkey % 2 = 0 then -1 else 1 end as bigint) v from orders),
 b as (select *, abs(v) * 10.0 * power(0.001, n) y, n, ['', 'k', 'M', 'G'][n + 1] u from a, unnest([0, 1, 2, 3]) t(n)), c as (select *, row_number() over (partition by o_orderkey order by n) w, cast(round_even(y, 0) as bigint) r from b where y < 10000)
 select o_orderkey, case when v < 0 then '-' else '' end || case when y < 100 then cast(r // 10 as varchar(9)) || case when r % 10 = 0 then u else case when u = '' then '.' else u end || cast(r % 10 as varchar(9)) end
  when y < 1000 then cast(r // 10 as varchar(9)) || u else cast(r // 100 * 10 as varchar(9)) || u end t from c where w = 1""")
def num_short(spark, sf):
    """Numbers in two significant digits or so."""
    v = F.expr("cast(o_orderkey * o_custkey % 1000000007 * case when o_orderkey % 2 = 0 then -1 else 1 end as bigint)")
    return X.table(spark, sf, "orders").select("o_orderkey", M.short_number(v).alias("t"))


@_on_reads("select qname, pos + 7 shifted, len + 5 extended from reads")
def range_moves(spark, sf):
    pos, n = F.col("pos"), F.col("len")
    return X.reads(spark, sf).select("qname", M.shift_range(pos, n, F.lit(7))[0].alias("shifted"), M.extend_range(pos, n, F.lit(5))[1].alias("extended"))


@_on_reads("select qname, (flag & 15) | ((mapq & 15) << 4) packed, ((flag & 15) | ((mapq & 15) << 4)) & 15 low, ((flag & 15) | ((mapq & 15) << 4)) >> 4 high from reads")
def npair_pack(spark, sf):
    r = X.reads(spark, sf).withColumn("packed", F.expr("(flag & 15) | shiftleft(mapq & 15, 4)"))
    return r.select("qname", "packed", F.expr("packed & 15").alias("low"), F.expr("shiftright(packed, 4)").alias("high"))


@_query("select w, count(*) n from part, unnest(regexp_extract_all(p_name, '[^\\x20\\x09-\\x0D]+')) u(w) group by w")
def lines_words(spark, sf):
    return X.table(spark, sf, "part").select(F.explode(F.regexp_extract_all("p_name", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@_on_stream("""select user_id, cast(coalesce(min(case when value >= lim then rn end) - 1, count(*)) as bigint) n from (select user_id, value, row_number() over (partition by user_id order by t, event_id) rn, 60 lim from stream) x where rn <= 8 group by user_id""")
def common_prefix(spark, sf):
    low = X.stream(spark, sf).withColumn("low", F.coalesce(F.col("value") < 60, F.lit(True)))
    return streams.common_prefix(low, [True] * 8, ORDER, BY, "low")


def _genome(spark):
    """The reference by rule, in chunks."""
    base = "substr('ACGT', cast((p * p * 31 + p * 51 + ref_id * 7 + p div 8) % 4 as int) + 1, 1)"
    chunks = spark.range(3).withColumnRenamed("id", "ref_id").selectExpr("ref_id", f"explode(sequence(0L, {LENGTH - 1} div {genome.CHUNK})) chunk")
    return chunks.selectExpr("ref_id", "chunk", f"array_join(transform(sequence(chunk * {genome.CHUNK}, least(chunk * {genome.CHUNK} + {genome.CHUNK}, {LENGTH}) - 1), p -> {base}), '') seq")


_REF = "substr('ACGT', cast((p * p * 31 + p * 51 + ref_id * 7 + p // 8) % 4 as int) + 1, 1)"


@_query(f"""with {X.REGIONS_SQL}, r as (select ref_id, "start" + 1300 "start", "end" + 1300 "end" from regions)
  select ref_id, "start", "end", array_to_string(list_transform(range("start", "end"), lambda p: case when p < {LENGTH} then {_REF} else 'N' end), '') bases from r""")
def genome_fetch(spark, sf):
    r = X.regions(spark, sf).select("ref_id", (F.col("start") + 1300).alias("start"), (F.col("end") + 1300).alias("end"))
    return genome.fetch(r, _genome(spark), []).select("ref_id", "start", "end", "bases")


@_on_reads(f"""select qname, case when back then -pos - len else pos end "start", case when back then -pos else pos + len end "end",
  case when back then translate(reverse(b), 'ACGT', 'TGCA') else b end bases from (select qname, pos, len, flag & 16 <> 0 back, array_to_string(list_transform(range(pos, pos + len), lambda p: case when p < {LENGTH} then {_REF} else 'N' end), '') b from reads where ref_id <> 4294967295) x""")
def genome_fetch_stranded(spark, sf):
    """The reference under each read in the direction of its molecule; positions on the other strand are negative."""
    back = R.has_flag(F.col("flag"), "reversed")
    r = X.reads(spark, sf).where(R.valid_ref(F.col("ref_id")))
    r = r.select("qname", "ref_id", F.when(back, -F.col("pos") - F.col("len")).otherwise(F.col("pos")).alias("start"), F.when(back, -F.col("pos")).otherwise(F.col("pos") + F.col("len")).alias("end"))
    return genome.fetch_stranded(r, _genome(spark), ["qname"]).select("qname", "start", "end", "bases")


@_on_reads(f"""select case when 2 * j <= len then j else j - len end offs, case when rev then translate(ref_base, 'ACGT', 'TGCA') else ref_base end ref_base, case when rev then translate(base, 'ACGT', 'TGCA') else base end base, count(*) c
  from (select *, {_REF} ref_base, case when rev then len - 1 - i else i end j from (select ref_id, len, i, flag & 16 <> 0 rev, pos + i p, seq[i + 1] base from reads, unnest(range(0, len)) u(i) where flag & 4 = 0 and ref_id <> 4294967295) x) y group by 1, 2, 3""")
def damage_substitutions(spark, sf):
    b = pileup.walk(X.reads(spark, sf), ["ref_id", "flag"]).withColumn("rev", R.has_flag(F.col("flag"), "reversed"))
    b = b.withColumn("offs", R.damage_position(F.when(F.col("rev"), F.col("read_len") - 1 - F.col("i")).otherwise(F.col("i")), F.col("read_len")))
    c = genome.substitutions(b, _genome(spark), ["offs", "rev"])
    turn = lambda x: F.when(F.col("rev"), F.translate(x, "ACGT", "TGCA")).otherwise(F.col(x)).alias(x)
    return genome.merged_counts([c.select("offs", turn("ref_base"), turn("base"), "c")], ["offs", "ref_base", "base"])
