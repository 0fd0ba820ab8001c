"""Registered queries over the tables of a folder, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import reads as R
from ..operators import intervals, pileup, streams
from . import fixtures as X

_queries: dict = {}
_sql: dict[str, str] = {}
ORDER, BY = ["t", "event_id"], ["user_id"]


def _query(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def _on_reads(select: str):
    return _query(X.SQL + select)


def _on_stream(select: str, more: str = ""):
    return _query(f"with {X.STREAM_SQL}{more} {select}")


# --- flags, fields and qualities


@_on_reads("select qname, " + ", ".join(f"flag & {v} <> 0 as {k}" for k, v in R.FLAGS.items()) + " from reads")
def flag_bits(spark, sf):
    return X.reads(spark, sf).select("qname", *[R.has_flag(F.col("flag"), k).alias(k) for k in R.FLAGS])


@_on_reads("select qname, " + ", ".join(f"coalesce(ff, 0) & {v} <> 0 as {k}" for k, v in R.EXT_FLAGS.items()) + " from reads")
def ext_flags(spark, sf):
    return X.reads(spark, sf).select("qname", *[R.has_ext_flag(F.col("ff"), k).alias(k) for k in R.EXT_FLAGS])


_CIG = "concat(cast(1 + k % 5 as string), 'S', cast(len - 9 as string), 'M2D', cast(1 + k % 3 as string), 'I3N4M')"


@_on_reads("select qname, len as plain, len - 9 + 2 + 3 + 4 as mixed from reads")
def aligned_length(spark, sf):
    r = X.reads(spark, sf).withColumn("mix", F.expr(_CIG))
    return r.select("qname", R.aligned_length(F.col("cigar")).alias("plain"), R.aligned_length(F.col("mix")).alias("mixed"))


_BIN = "case " + " ".join(f"when p >> {b} = e >> {b} then {o} + (p >> {b})" for b, o in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))) + " else 0 end"


@_query(f"with s as (select o_orderkey, o_orderkey * 7919 % 90000000 p, o_orderkey * 7919 % 90000000 + o_custkey * 37 e from orders) select o_orderkey, cast({_BIN} as bigint) bin from s")
def distinct_bin(spark, sf):
    o = X.table(spark, sf, "orders")
    pos = o.o_orderkey * 7919 % 90000000
    return o.select("o_orderkey", R.distinct_bin(pos, (o.o_custkey * 37 + 1).cast("bigint")).alias("bin"))


@_on_reads("select r.qname, coalesce(f.name, '*') ref_name, coalesce(f.length, 0) ref_length from reads r left join (values (0, 'chr1', 6000), (1, 'chr2', 6000), (2, 'chrX', 6000)) f(id, name, length) on r.ref_id = f.id")
def ref_lookup(spark, sf):
    refs = spark.createDataFrame([(0, "chr1", 6000), (1, "chr2", 6000), (2, "chrX", 6000)], "ref_id bigint, name string, length int")
    return X.reads(spark, sf).join(F.broadcast(refs), "ref_id", "left").select("qname", F.coalesce("name", F.lit("*")).alias("ref_name"), F.coalesce("length", F.lit(0)).alias("ref_length"))


@_on_reads("select qname, list_transform(range(1, len + 1), lambda i: cast(case when strpos('-ACMGRSVTWYHKDBN', seq[i]) > 0 then strpos('-ACMGRSVTWYHKDBN', seq[i]) - 1 else 15 end as int)) codes from reads")
def nuc_codes(spark, sf):
    return X.reads(spark, sf).select("qname", F.transform(F.split("seq", ""), R.base_code).alias("codes"))


@_on_reads("select qname, reverse(translate(seq, 'ACMGRSVTWYHKDBN', 'TGKCYSBAWRDMHVN')) rc from reads")
def revcomp(spark, sf):
    return X.reads(spark, sf).select("qname", R.reverse_complement(F.col("seq")).alias("rc"))


@_on_reads("select qname, mapq, round(pow(10, -mapq / 10.0), 9) p, cast(round_even(-10 * log10(pow(10, -mapq / 10.0)), 0) as bigint) q from reads")
def phred_roundtrip(spark, sf):
    r = X.reads(spark, sf)
    return r.select("qname", "mapq", F.round(R.error_rate(r.mapq), 9).alias("p"), R.phred(R.error_rate(r.mapq)).alias("q"))


_COUNTS = "select *, " + ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) n{b}" for b in "ACGT") + " from reads"


@_on_reads(f"select qname, greatest(nA, nC, nG, nT) <= floor(0.4 * (nA + nC + nG + nT)) passes from ({_COUNTS}) c")
def complexity_simple(spark, sf):
    return X.reads(spark, sf).select("qname", R.simple_complexity(F.col("seq"), 0.4).alias("passes"))


@_on_reads("select qname, round(" + " + ".join(f"case when n{b} > 0 then n{b} * log2(length(seq) / n{b}) else 0 end" for b in "ACGT") + f", 6) h from ({_COUNTS}) c")
def complexity_entropy(spark, sf):
    return X.reads(spark, sf).select("qname", F.round(R.entropy(F.col("seq")), 6).alias("h"))


@_on_reads("select qname, cast(list_sum(qual) as bigint) total, list_sum(qual) >= 30 * len(qual) passes from reads")
def qual_average(spark, sf):
    q = F.col("qual")
    return X.reads(spark, sf).select("qname", R.quality_sum(q).alias("total"), R.quality_average(q, 30).alias("passes"))


@_on_reads("select qname, len(list_filter(qual, lambda x: x < 23)) <= 4 passes from reads")
def qual_minimum(spark, sf):
    return X.reads(spark, sf).select("qname", R.quality_minimum(F.col("qual"), 4, 23).alias("passes"))


@_on_reads("select qname, list_transform(qual, lambda x: cast(round_even(-10 * log10(pow(10, -(x + 8 - 31) / 10.0) / (1 + pow(10, -(x + 8 - 31) / 10.0))), 0) as bigint)) q from reads")
def qual_illumina_old(spark, sf):
    return X.reads(spark, sf).select("qname", F.transform("qual", lambda x: R.old_illumina_quality(x + 8)).alias("q"))


@_on_reads("select qname, list_transform(qual, lambda x: ((x - 31) % 256 + 256) % 256) q from reads")
def qual_illumina_new(spark, sf):
    return X.reads(spark, sf).select("qname", F.transform("qual", R.new_illumina_quality).alias("q"))


_ODD = "select qname, (flag & 1) | (case when k % 3 = 0 then 128 when k % 3 = 1 then 192 else 0 end) | (case when k % 7 = 0 then 2048 else 0 end) f, ff from reads"


@_on_reads(f"""select qname, cast(case when f & 1 = 0 and f & 192 <> 0 then f & 59199 & 65343 else f & 59391 end as bigint) flag,
  cast(coalesce(ff, 0) | case when f & 1 = 0 and f & 192 = 192 then 2 when f & 1 = 0 and f & 192 = 128 then 1 else 0 end as bigint) ff from ({_ODD}) o""")
def flag_abuse_fix(spark, sf):
    r = spark.sql(_ODD.replace("from reads", "from {r}"), r=X.reads(spark, sf))
    return r.select("qname", R.repaired_flag(r.f.cast("bigint")).alias("flag"), R.repaired_ff(r.f.cast("bigint"), r.ff).cast("bigint").alias("ff"))


@_on_reads("""select qname, cast(case when c and o & 12 <> 0 then (o | 8) & 65533 when c then (o | 8) & 65533 when o & 12 <> 0 then o & 65533 else o end as bigint) flag from
  (select qname, flag | 2 o, (flag & 1 <> 0 and flag & 4 = 0 and (flag & 16 <> 0) = (flag & 32 <> 0) and ref_id = mate_ref_id and pos = mate_pos - 100) c from reads) x""")
def bwa_flag_fix(spark, sf):
    r = X.reads(spark, sf)
    return r.select("qname", R.mate_fixed_flag(r.flag.bitwiseOR(F.lit(2)), r.ref_id, r.pos, r.mate_ref_id, r.mate_pos - 100).alias("flag"))


@_on_reads("select qname, len(list_filter(range(1, len(qual) + 1), lambda i: list_max(qual[len(qual) - i + 1 : len(qual)]) < 30)) cut from reads")
def trim_low_quality(spark, sf):
    return X.reads(spark, sf).select("qname", R.trailing_below(F.col("qual"), 30).cast("bigint").alias("cut"))


_NAMES = "concat('s', cast({n} % 7 as varchar(9)), '_', cast({n} * 7919 % 100003 as varchar(20)), case when {n} % 3 = 0 then '00' else '' end, cast({n} as varchar(20)))"


@_query(f"select {_NAMES.format(n='c_custkey')} as name, row_number() over (order by c_custkey % 7, cast(split_part({_NAMES.format(n='c_custkey')}, '_', 2) as hugeint)) rn from customer")
def name_natural_order(spark, sf):
    """Names with two runs of digits, some with zeros before them, numbered without a single task."""
    n = X.table(spark, sf, "customer").select(F.expr(_NAMES.format(n="c_custkey")).alias("name")).withColumn("_key", R.name_key(F.col("name")))
    return streams.number(n, ["_key", "name"], []).select("name", "rn")


@_on_reads("""select concat_ws(chr(9), qname, cast(flag as varchar), case when ref_id = 4294967295 then '*' else 'ref' || cast(ref_id as varchar) end, cast(pos + 1 as varchar), cast(mapq as varchar), cigar,
  case when mate_ref_id = 4294967295 then '*' when mate_ref_id = ref_id then '=' else 'ref' || cast(mate_ref_id as varchar) end, cast(mate_pos + 1 as varchar), '0', seq,
  array_to_string(list_transform(qual, lambda x: chr(cast(x + 33 as int))), '')) line from reads""")
def sam_encode(spark, sf):
    from ..sources.sam import encode

    return encode(X.reads(spark, sf))


@_on_reads("select qname, flag, ref_id, pos, mapq, mate_ref_id, mate_pos, len * 3 - 70 isize, seq, qual, rg, xp from reads")
def sam_roundtrip(spark, sf):
    from ..functions import tags as T
    from ..sources.sam import decode, encode

    tags = F.array(T.tag("RG", "Z", F.col("rg")), T.tag("XP", "i", F.col("xp")))
    back = decode(encode(X.reads(spark, sf).withColumn("isize", F.expr("len * 3 - 70")).withColumn("tags", tags)))
    return back.select("qname", "flag", "ref_id", "pos", "mapq", "mate_ref_id", "mate_pos", "isize", "seq", "qual", T.as_string(F.col("tags"), "RG").alias("rg"), T.as_int(F.col("tags"), "XP").alias("xp"))


# --- intervals


@_query(f"""with {X.REGIONS_SQL}, m as (select *, max("end") over (partition by ref_id order by "start", "end" rows between unbounded preceding and 1 preceding) b from regions),
 g as (select *, sum(case when b is null or "start" > b then 1 else 0 end) over (partition by ref_id order by "start", "end") g from m)
 select ref_id, min("start") "start", max("end") "end" from g group by ref_id, g""")
def regions_union(spark, sf):
    return intervals.union(X.regions(spark, sf))


@_query(X.SQL.rstrip() + f', {X.REGIONS_SQL} select qname from reads r where exists (select 1 from regions g where g.ref_id = r.ref_id and r.pos < g."end" and g."start" < r.pos + r.len)')
def region_semijoin(spark, sf):
    r = X.reads(spark, sf).select("qname", "ref_id", "pos", F.col("len").alias("aligned"))
    return intervals.semi_join(r, X.regions(spark, sf)).select("qname")


@_query(f'with {X.REGIONS_SQL} select ref_id, "start", cast(b as bigint) bin from regions, unnest(range("start" >> 8, (("end" - 1) >> 8) + 1)) u(b)')
def region_bins(spark, sf):
    return intervals.with_bins(X.regions(spark, sf), "start", "end", 8).select("ref_id", "start", F.col("_bin").alias("bin"))


@_on_reads("select qname, pos from reads where ref_id = 1")
def ref_scan(spark, sf):
    return X.reads(spark, sf).where("ref_id = 1").select("qname", "pos")


@_on_reads("select qname from reads where ref_id = 4294967295")
def unaligned_scan(spark, sf):
    return X.reads(spark, sf).where(~R.valid_ref(F.col("ref_id"))).select("qname")


# --- pileup, consensus, duplicates

_BASES = "select ref_id, pos + i site, flag, mapq, i, substr(seq, cast(i + 1 as int), 1) base, least(qual[i + 1], mapq) q, length(seq) n from reads, unnest(range(0, len)) u(i) where flag & 4 = 0 and flag & 1024 = 0 and ref_id <> 4294967295"


@_on_reads(f"select ref_id, site, count(*) depth, cast(sum(case when mapq = 0 then 1 else 0 end) as bigint) mapq0, cast(sum(mapq) as bigint) sum_mapq, cast(sum(mapq * mapq) as bigint) sum_mapq2 from ({_BASES}) b group by ref_id, site")
def pileup_depth(spark, sf):
    return pileup.call_stats(pileup.walk(X.reads(spark, sf), ["ref_id"], bases=False), ["ref_id", "site"])


@_on_reads(f"select ref_id, site, flag & 16 <> 0 rev, count(*) depth, cast(sum(case when mapq = 0 then 1 else 0 end) as bigint) mapq0, cast(sum(mapq) as bigint) sum_mapq, cast(sum(mapq * mapq) as bigint) sum_mapq2 from ({_BASES}) b group by 1, 2, 3")
def pileup_strand(spark, sf):
    r = X.reads(spark, sf).withColumn("rev", R.has_flag(F.col("flag"), "reversed"))
    return pileup.call_stats(pileup.walk(r, ["ref_id", "rev"], bases=False), ["ref_id", "site", "rev"])


@_on_reads(f"""select ref_id, site, case when d > 3 then base else 'N' end base, cast(case when d > 3 then d else 0 end as bigint) q from (
  select *, least(s - coalesce(lead(s) over (partition by ref_id, site order by s desc, base), 0), 60) d, row_number() over (partition by ref_id, site order by s desc, base) k
  from (select ref_id, site, base, sum(q) s from ({_BASES}) b group by 1, 2, 3) x) y where k = 1""")
def consensus_base(spark, sf):
    return pileup.consensus(pileup.walk(X.reads(spark, sf), ["ref_id"]), ["ref_id", "site"])


@_on_reads(f"select case when 2 * j <= n then j else j - n end offs, case when flag & 16 <> 0 then translate(base, 'ACGT', 'TGCA') else base end base, count(*) c from (select *, case when flag & 16 <> 0 then n - 1 - i else i end j from ({_BASES}) a) b group by 1, 2")
def damage_composition(spark, sf):
    b = pileup.molecule_way(pileup.walk(X.reads(spark, sf), ["flag"]))
    return b.groupBy(R.damage_position(b.i, b.read_len).alias("offs"), "base").agg(F.count("*").alias("c"))


_CLASS = "case when flag & 1 = 0 and coalesce(ff, 0) & 3 <> 0 then 'merged' when flag & 1 = 0 then 'single' when flag & 12 = 0 then 'pair' when flag & 4 <> 0 then 'half_unaligned' else 'half_aligned' end"


@_on_reads(f"select rg, {_CLASS} class, count(*) n from reads group by 1, 2")
def dedup_classes(spark, sf):
    return X.reads(spark, sf).groupBy("rg", pileup.duplicate_class().alias("class")).agg(F.count("*").alias("n"))


@_on_reads(f"""select rg, ref_id, pos, case when class = 'half_aligned' then 'single' else class end class, flag & 16 <> 0 rev, class = 'pair' and flag & 64 <> 0 "first", case when class = 'pair' then mate_pos when class = 'merged' then len end far,
  case when class = 'half_unaligned' then qname end own, min(qname) qname, count(*) cluster, cast(case when count(*) = 1 then min(xp) when min(coalesce(xp, 1)) = -1 then -1 else sum(coalesce(xp, 1)) end as bigint) xp, arg_min(seq, qname) seq
  from (select *, {_CLASS} class from (select * replace (case when k % 10 = 0 then flag | 4 else flag end as flag, case when k % 3 = 0 then null else xp end as xp) from reads) q) r where ref_id <> 4294967295 group by 1, 2, 3, 4, 5, 6, 7, 8""")
def dedup_cheap(spark, sf):
    r = X.reads(spark, sf).where(R.valid_ref(F.col("ref_id"))).withColumn("flag", F.expr("case when k % 10 = 0 then flag | 4L else flag end")).withColumn("xp", F.expr("case when k % 3 = 0 then null else xp end"))
    return pileup.cheap_collapse(r.select("*", *pileup.duplicate_key()), ["rg", "ref_id", "pos", "class", "rev", "first", "far", "own"])


@_on_reads("select ref_id, pos, rgv from (select ref_id, pos, cast(mapq % 3 as int) rgv, row_number() over (partition by ref_id, pos order by count(*) desc, cast(mapq % 3 as int) desc) k from reads group by 1, 2, cast(mapq % 3 as int)) x where k = 1")
def majority_tag(spark, sf):
    return pileup.majority(X.reads(spark, sf).withColumn("rgv", (F.col("mapq") % 3).cast("int")), ["ref_id", "pos"], "rgv")


@_on_reads("select ref_id, pos, cast(round_even(sqrt(avg(mapq * mapq)), 0) as bigint) rms from reads group by 1, 2")
def rmsq_mapq(spark, sf):
    return X.reads(spark, sf).groupBy("ref_id", "pos").agg(F.bround(F.sqrt(F.avg(F.col("mapq") * F.col("mapq"))), 0).cast("bigint").alias("rms"))


# --- numbers


@_query("""with c as (select l_returnflag, l_linestatus, cast(count(*) as double) n, cast(sum(case when l_quantity > 25 then 1 else 0 end) as double) x from lineitem group by 1, 2)
 select l_returnflag, l_linestatus, round((x / n + 3.8414588206941254 / (2 * n) - 1.959963984540054 * sqrt((x / n * (1 - x / n) + 3.8414588206941254 / (4 * n)) / n)) / (1 + 3.8414588206941254 / n), 6) low, round(x / n, 6) p from c""")
def wilson_ci(spark, sf):
    c = X.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").cast("double").alias("n"), F.sum((F.col("l_quantity") > 25).cast("double")).alias("x"))
    low, p, _ = N.wilson(F.col("x"), F.col("n"), N.normal_quantile(0.975))
    return c.select("l_returnflag", "l_linestatus", F.round(low, 6).alias("low"), F.round(p, 6).alias("p"))


@_query("select event_id, round(case when -value / 10 - 0.01 > -0.6931471805599453 then ln(1 - exp(-value / 10 - 0.01)) else ln(1 - exp(-value / 10 - 0.01)) end, 6) + 0.0 m, round(ln(1 + exp(value / 50)), 6) p, round(greatest(value / 50, 1) + ln(1 + exp(-abs(value / 50 - 1))), 6) s from events where value >= 0")
def log_helpers(spark, sf):
    e = X.table(spark, sf, "events").where("value >= 0")
    v = F.col("value")
    return e.select("event_id", (F.round(N.log1mexp(-v / 10 - 0.01), 6) + 0.0).alias("m"), F.round(N.log1pexp(v / 50), 6).alias("p"), F.round(N.log_add(v / 50, F.lit(1.0)), 6).alias("s"))


@_query("select n_nationkey, n_regionkey, cast(factorial(n_nationkey % 12 + 4) / (factorial(n_regionkey) * factorial(n_nationkey % 12 + 4 - n_regionkey)) as bigint) c from nation")
def choose(spark, sf):
    n = X.table(spark, sf, "nation")
    return n.select("n_nationkey", "n_regionkey", N.choose(n.n_nationkey % 12 + 4, n.n_regionkey).cast("bigint").alias("c"))


@_query("""with recursive c as (select o_custkey % 50 g, cast(count(*) as double) t, cast(count(distinct o_custkey // 50) as double) s from orders group by 1),
 z as (select g, t, s, 0 i, ln(10 * t / s) z from c union all select g, t, s, i + 1, z - (exp(z) - 1 - t / s * z) / (exp(z) - t / s) from z where i < 60)
 select g, round(case when s > 0 and t > s then s * exp(z) / z end, 3) m from z where i = 60""")
def library_complexity(spark, sf):
    c = X.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("g")).agg(F.count("*").cast("double").alias("t"), F.countDistinct(F.floor(F.col("o_custkey") / 50)).cast("double").alias("s"))
    return c.select("g", F.round(N.library_complexity(F.col("t"), F.col("s")), 3).alias("m"))


# --- ordered streams


@_on_stream("select event_id from stream order by t, event_id limit 25")
def take_n(spark, sf):
    return streams.take(X.stream(spark, sf), ORDER, 25).select("event_id")


@_on_stream("select event_id from stream order by t, event_id offset 40")
def drop_n(spark, sf):
    return streams.drop(X.stream(spark, sf), ORDER, 40).select("event_id")


_STOP = ", w as (select *, min(case when value < 80 then 1 else 0 end) over (partition by user_id order by t, event_id) ok from stream)"


@_on_stream("select event_id from w where ok = 1", _STOP)
def take_while(spark, sf):
    return streams.take_while(X.stream(spark, sf), ORDER, F.col("value") < 80, BY).select("event_id")


@_on_stream("select event_id from w where ok = 0", _STOP)
def drop_while(spark, sf):
    return streams.drop_while(X.stream(spark, sf), ORDER, F.col("value") < 80, BY).select("event_id")


@_on_stream("select user_id, arg_min(event_id, (t, event_id)) first_value, arg_max(event_id, (t, event_id)) last_value, count(*) n from stream group by user_id")
def head_last(spark, sf):
    return streams.first_last(X.stream(spark, sf), ORDER, BY, "event_id")


@_on_stream("select count(*) n from stream")
def stream_length(spark, sf):
    return X.stream(spark, sf).agg(F.count("*").alias("n"))


@_on_stream("""select user_id, win, count(*) n, round(sum(value), 4) total from (select user_id, value, row_number() over (partition by user_id order by t, event_id) - 1 p from stream) x,
  unnest(range(cast(greatest(0, ceil((p - 5 + 1) / 3)) as bigint), cast(floor(p / 3) as bigint) + 1)) u(win) group by 1, 2""")
def roll_window(spark, sf):
    return streams.roll(X.stream(spark, sf), ORDER, BY, 5, 3, "value").withColumn("total", F.round("total", 4)).withColumn("win", F.col("win").cast("bigint"))


@_on_stream("""select user_id, grp, min(event_type) event_type, count(*) n from (select *, cast(sum(c) over (partition by user_id order by t, event_id) as bigint) grp from
  (select *, case when lag(event_type) over (partition by user_id order by t, event_id) is distinct from event_type then 1 else 0 end c from stream) x) y group by 1, 2""")
def group_consecutive(spark, sf):
    s = X.stream(spark, sf)
    return streams.group_consecutive(s, ORDER, BY, streams.changed("event_type", ORDER, BY)).groupBy("user_id", "grp").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@_on_stream("""select user_id, grp, count(*) n, min(t) t0 from (select *, cast(sum(c) over (partition by user_id order by t, event_id) as bigint) grp from
  (select *, case when t - lag(t) over (partition by user_id order by t, event_id) <= 3600000000 then 0 else 1 end c from stream) x) y group by 1, 2""")
def group_by_gap(spark, sf):
    s = X.stream(spark, sf)
    return streams.group_consecutive(s, ORDER, BY, streams.gap(F.col("t"), ORDER, BY, 3_600_000_000)).groupBy("user_id", "grp").agg(F.count("*").alias("n"), F.min("t").alias("t0"))


_HALF = ", a as (select user_id, event_id a, row_number() over (partition by user_id order by t, event_id) rn from stream where value < 50), b as (select user_id, event_id b, row_number() over (partition by user_id order by t, event_id) rn from stream where value >= 50)"


def _halves(spark, sf):
    s = X.stream(spark, sf)
    return s.where("value < 50").select("user_id", "t", "event_id", F.col("event_id").alias("a")), s.where("value >= 50").select("user_id", "t", "event_id", F.col("event_id").alias("b"))


@_on_stream("select user_id, cast(rn as int) rn, a, b from a join b using (user_id, rn)", _HALF)
def zip_inner(spark, sf):
    a, b = _halves(spark, sf)
    return streams.zip_streams(a, b.withColumnsRenamed({"t": "t2", "event_id": "e2"}), ORDER, ["t2", "e2"], BY, "inner").select("user_id", "rn", "a", "b")


@_on_stream("select user_id, cast(rn as int) rn, a, b from a full join b using (user_id, rn)", _HALF)
def zip_outer(spark, sf):
    a, b = _halves(spark, sf)
    return streams.zip_streams(a, b.withColumnsRenamed({"t": "t2", "event_id": "e2"}), ORDER, ["t2", "e2"], BY, "full").select("user_id", "rn", "a", "b")


@_on_stream("select event_id, src, row_number() over (order by t, src desc, event_id) rn from (select event_id, t, case when value < 50 then 0 else 1 end src from stream where value is not null) x")
def merge_sorted(spark, sf):
    s = X.stream(spark, sf)
    return streams.merge_ordered([s.where("value < 50"), s.where("value >= 50")], [F.col("t")], ["event_id"]).select("event_id", "src", "rn")


_THREE = "select qname, ref_id, pos, mapq, cast(k % 3 as int) src from reads"


def _three(spark, sf):
    r = X.reads(spark, sf)
    return [r.where(F.col("k") % 3 == i).select("qname", "ref_id", "pos", "mapq") for i in range(3)]


@_on_reads(f"select qname, src, row_number() over (order by ref_id, pos, src desc, qname) rn from ({_THREE}) x")
def merge_coordinates(spark, sf):
    return streams.merge_ordered(_three(spark, sf), streams.by_coordinate(), ["qname"]).select("qname", "src", "rn")


@_on_reads(f"select qname, src, row_number() over (order by cast(substr(qname, 2) as bigint)) rn from ({_THREE}) x")
def merge_names(spark, sf):
    return streams.merge_ordered(_three(spark, sf), streams.by_name(), ["pos"]).select("qname", "src", "rn")


@_on_reads(f"""select ref_id, pos, n, m, src, row_number() over (order by ref_id, pos, i, src desc) rn from (select ref_id, pos, i, count(*) n, cast(sum(mapq) as bigint) m, min(src) src from
  (select *, row_number() over (partition by src, ref_id, pos order by qname) i from ({_THREE}) x) y group by 1, 2, 3) z""")
def merge_combine(spark, sf):
    """The n-th records of three inputs at one place become one, with the sum of their qualities."""
    made = {"ref_id": F.first("ref_id"), "pos": F.first("pos"), "n": F.count("*"), "m": F.sum("mapq")}
    return streams.merge_ordered(_three(spark, sf), streams.by_coordinate(), ["qname"], made).select("ref_id", "pos", "n", "m", "src", "rn")


@_on_stream("select a.rn, a, b from (select event_id a, row_number() over (order by t, event_id) rn from stream where value < 50) a full join (select event_id b, row_number() over (order by t, event_id) rn from stream where value >= 50) b on a.rn = b.rn")
def zip_whole(spark, sf):
    """Two streams side by side by their numbers in the whole, without keys."""
    a, b = _halves(spark, sf)
    return streams.zip_streams(a.drop("user_id"), b.drop("user_id").withColumnsRenamed({"t": "t2", "event_id": "e2"}), ORDER, ["t2", "e2"], [], "full").select("rn", "a", "b")


_SWITCH = "case when value is null or value between 30 and 60 then 'keep' when value < 30 then 'off' when value < 80 then 'turn' else 'on' end"


@_on_stream("select event_id, i, state from y, unnest(range(case when sym = 'keep' and state = 0 then 0 when sym = 'turn' then 2 else 1 end)) u(i)", f""", s as (select *, {_SWITCH} sym from stream),
  w as (select *, max(case when sym in ('on', 'off') then rn end) over (order by rn) since from (select *, row_number() over (order by t, event_id) rn from s) a),
  x as (select w.*, (coalesce(b.sym, 'off') = 'on')::int + (select count(*) from w v where v.sym = 'turn' and v.rn > coalesce(w.since, 0) and v.rn <= w.rn) turns from w left join w b on b.rn = w.since),
  y as (select event_id, sym, cast(turns % 2 as bigint) state from x)""")
def conv_stream(spark, sf):
    """A switch that values set, turn or keep, in the order of the whole stream; each row tells its state none, one or two times."""
    s = X.stream(spark, sf).withColumn("sym", F.expr(_SWITCH)).select("t", "event_id", "sym")

    def step(state, row):
        state = {"on": 1, "off": 0, "turn": 1 - state}.get(row.sym, state)
        n = 2 if row.sym == "turn" else 0 if row.sym == "keep" and not state else 1
        return state, [(row.event_id, i, state) for i in range(n)]

    return streams.convert(s, ORDER, 2, 0, step, "event_id bigint, i bigint, state bigint")


@_on_stream("select event_type, count(*) n, round(sum(value), 3) s, round(min(value), 6) lo, round(max(value), 6) hi from stream group by 1")
def multi_aggregate(spark, sf):
    return X.stream(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("s"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"))


@_on_stream("select user_id, count(*) n, round(sum(value), 4) s from w where ok = 1 group by 1", _STOP)
def prefix_aggregate(spark, sf):
    return streams.take_while(X.stream(spark, sf), ORDER, F.col("value") < 80, BY).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"))


@_query("select c_custkey, w from customer, unnest(string_split(c_name, '#')) u(w)")
def flat_map(spark, sf):
    return X.table(spark, sf, "customer").select("c_custkey", F.explode(F.split("c_name", "#")).alias("w"))


@_on_reads("select qname, cast(mapq - 10 as bigint) m from reads where mapq >= 10")
def map_maybe(spark, sf):
    return X.reads(spark, sf).select("qname", F.when(F.col("mapq") >= 10, F.col("mapq") - 10).alias("m")).where(F.col("m").isNotNull())


@_query("select c_custkey k, c_name as name from customer union all select s_suppkey, s_name from supplier")
def concat_inputs(spark, sf):
    return X.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).unionByName(X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


from . import alignments, duplicates, files, molecules, pairs, piles, records, small  # noqa: E402, F401  register their queries here
