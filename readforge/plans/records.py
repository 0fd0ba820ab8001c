"""Queries on whole records: files, tags, quality marks, MD text, merged mates, damage statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import reads as R
from ..functions import sequences as S
from ..functions import tags as T
from ..operators import genome, pileup, streams
from ..operators.tables import scratch
from ..sources import bam, fastq
from . import fixtures as X
from .queries import BY, ORDER, _on_reads, _on_stream, _query

REFS = [("chr1", 6000), ("chr2", 6000), ("chrX", 6000)]


@_on_reads("select qname, flag, ref_id, pos, mapq, cigar, mate_ref_id, mate_pos, len * 3 - 70 isize, seq, qual, ff, rg, xp from reads")
def bam_roundtrip(spark, sf):
    bam.register(spark)
    path = scratch(spark, "bam")
    r = X.reads(spark, sf)
    tags = F.array(T.tag("FF", "i", F.col("ff")), T.tag("RG", "Z", F.col("rg")), T.tag("XP", "i", F.col("xp"))).alias("tags")
    i = lambda c: F.col(c).cast("int").alias(c)
    r = r.select("qname", i("flag"), "ref_id", i("pos"), i("mapq"), "cigar", "mate_ref_id", i("mate_pos"), (F.col("len") * 3 - 70).cast("int").alias("isize"), "seq", F.col("qual").cast("array<int>").alias("qual"), tags)
    r.write.format("bam").option("header", bam.refs_header(REFS)).mode("append").save(path)
    back = spark.read.format("bam").load(path)
    b = lambda c: F.col(c).cast("bigint").alias(c)
    return back.select("qname", b("flag"), "ref_id", b("pos"), b("mapq"), "cigar", "mate_ref_id", b("mate_pos"), b("isize"), "seq", F.col("qual").cast("array<bigint>").alias("qual"), T.as_int(F.col("tags"), "FF").alias("ff"), T.as_string(F.col("tags"), "RG").alias("rg"), T.as_int(F.col("tags"), "XP").alias("xp"))


@_on_reads("select qname, case when k % 5 = 0 then '' else seq end seq, case when k % 5 = 0 then [] when k % 3 = 0 then [] else qual end qual, case when k % 2 = 0 then 'about ' || rg else '' end description from reads")
def fastq_parse(spark, sf):
    """Records written in both formats, in lines of 10, with a line of qualities that may begin with a mark."""
    r = X.reads(spark, sf)
    seq = F.when(F.col("k") % 5 == 0, "").otherwise(F.col("seq"))
    qual = F.array_join(F.transform("qual", lambda q: F.char((q + 33).cast("bigint"))), "")
    wrap = lambda t: F.regexp_replace(t, "(.{10})", "$1\n")
    head = F.concat("qname", F.when(F.col("k") % 2 == 0, F.concat(F.lit(" about "), "rg")).otherwise(""))
    fasta = (F.col("k") % 5 == 0) | (F.col("k") % 3 == 0)
    lines = r.select(F.when(fasta, F.concat(F.lit(">"), head, F.lit("\n"), wrap(seq))).otherwise(F.concat(F.lit("@"), head, F.lit("\n"), wrap(seq), F.lit("\n+\n"), qual)).alias("value"))
    path = scratch(spark, "fastq")
    lines.write.text(path)
    return fastq.read(spark, path).select("qname", "seq", "qual", "description")


# --- tags, flags and marks

_ZQ = "case when k % 13 = 0 then 'Q' when k % 17 = 0 then 'CQ' else '' end"


def _tagged(spark, sf):
    zq = F.when(F.col("k") % 13 == 0, "Q").when(F.col("k") % 17 == 0, "CQ").otherwise("")
    return X.reads(spark, sf).withColumn("tags", F.array(T.tag("ZQ", "Z", zq), T.tag("XP", "i", F.col("xp")), T.tag("XP", "i", F.col("ff")), T.tag("RG", "Z", F.col("rg"))))


@_on_reads(f"""select qname, xp first_xp, 7 absent, 0 wrong_type, rg, ff after_delete, xp + 1 adjusted, cast(case when k % 2 = 0 then 5 else 4 end as bigint) n_tags,
  case when strpos({_ZQ}, 'C') > 0 then {_ZQ} else 'C' || {_ZQ} end zq from reads""")
def ext_access(spark, sf):
    t, xp = F.col("tags"), lambda v: T.tag("XP", "i", v)
    less = F.when(F.col("k") % 2 == 0, T.insert(t, xp(F.lit(1)))).otherwise(T.update(t, "RG", T.tag("RG", "Z", F.lit("x"))))
    return _tagged(spark, sf).select(
        "qname", T.as_int(t, "XP").alias("first_xp"), T.as_int(t, "NM", 7).cast("int").alias("absent"), T.as_int(t, "RG").cast("int").alias("wrong_type"), T.as_string(t, "RG").alias("rg"),
        T.as_int(T.update(t, "XP", xp(F.col("ff"))), "XP").alias("after_delete"), T.as_int(T.adjust(t, "XP", lambda v: (v.cast("bigint") + 1).cast("string")), "XP").alias("adjusted"), F.size(less).cast("bigint").alias("n_tags"), T.as_string(T.mark_quality(t, "C"), "ZQ").alias("zq"),
    )


_SIMPLE = "greatest(" + ", ".join(f"len - length(replace(seq, '{b}', ''))" for b in "ACGT") + ") <= floor(0.4 * len)"


@_on_reads(f"""select qname, case when s and v then flag else flag | 512 end flag, case when s then z1 when strpos(z1, 'C') > 0 then z1 else 'C' || z1 end zq
  from (select *, case when v then z when strpos(z, 'Q') > 0 then z else 'Q' || z end z1 from (select qname, flag, {_SIMPLE} s, list_sum(qual) >= 30 * len v, {_ZQ} z from reads) x) y""")
def qc_marks(spark, sf):
    r = _tagged(spark, sf)
    flag, tags = T.filtered(F.col("flag"), F.col("tags"), R.quality_average(F.col("qual"), 30), "Q")
    r = r.select("qname", "seq", flag.alias("flag"), tags.alias("tags"))
    flag, tags = T.filtered(F.col("flag"), F.col("tags"), R.simple_complexity(F.col("seq"), 0.4), "C")
    return r.select("qname", flag.alias("flag"), T.as_string(tags, "ZQ").alias("zq"))


@_on_reads("""select qname, case when g & 1 = 0 then g & ~192 else g end flag, n_q || n_c zq, case when has_ff then ff | new when k % 7 = 0 then 8 | new when new <> 0 then new end ff, not has_ff and k % 7 = 0 xf_gone
  from (select *, f & ~6144 g, case when f & 2048 <> 0 then 'Q' else '' end n_q, case when f & 4096 <> 0 then 'C' else '' end n_c, case when f & 193 = 192 then 2 when f & 193 = 128 then 1 else 0 end new, k % 3 = 0 has_ff
    from (select *, flag | (case when k % 4 = 0 then 2048 else 0 end) | (case when k % 6 = 0 then 4096 else 0 end) | (case when k % 10 = 1 then 192 when k % 10 = 2 then 128 else 0 end) f from reads) x) y""")
def flag_abuse_tags(spark, sf):
    k = F.col("k")
    r = X.reads(spark, sf).withColumn("flag", F.expr("flag | case when k % 4 = 0 then 2048 else 0 end | case when k % 6 = 0 then 4096 else 0 end | case when k % 10 = 1 then 192 when k % 10 = 2 then 128 else 0 end"))
    xf = F.when(k % 7 == 0, T.tag("XF", "i", F.lit(8))).otherwise(T.tag("XF", "A", F.lit("q")))
    tags = F.when(k % 3 == 0, F.array(T.tag("FF", "i", F.col("ff")), xf)).otherwise(F.array(xf))
    flag, out = T.repaired_flags(F.col("flag"), F.col("tags"))
    r = r.withColumn("tags", tags).select("qname", flag.alias("flag"), out.alias("t"))
    has = lambda key: F.exists("t", lambda t: t["key"] == key)
    return r.select("qname", "flag", T.as_string(F.col("t"), "ZQ").alias("zq"), F.when(has("FF"), T.as_int(F.col("t"), "FF")).alias("ff"), (~has("XF")).alias("xf_gone"))


@_on_reads("select qname, case when f & 65 = 65 then 'leading' when f & 129 = 129 then 'trailing' when f & 192 <> 0 or coalesce(ff, 0) & 3 <> 0 then 'complete' else 'leading' end kind, case when f & 65 = 65 then 'leading' when f & 129 = 129 then 'trailing' else 'complete' end old from (select *, case when k % 3 = 0 then xor(flag, 192) else flag end f from reads) r")
def frag_type(spark, sf):
    r = X.reads(spark, sf).withColumn("f", F.expr("case when k % 3 = 0 then flag ^ 192L else flag end"))
    return r.select("qname", T.fragment_type(F.col("f"), F.col("ff")).alias("kind"), T.fragment_type(F.col("f"), F.col("ff"), True).alias("old"))


@_query("""select c_custkey, c in ('A', 'C', 'G', 'T') proper, c in ('A', 'C', 'G', 'T', 'N') or strpos('MRSVWYHKDB', c) > 0 base, c = '-' gap
  from (select c_custkey, substr('-ACMGRSVTWYHKDBN', cast(c_custkey % 16 + 1 as int), 1) c from customer) x""")
def base_predicates(spark, sf):
    c = X.table(spark, sf, "customer").select("c_custkey", F.substring(F.lit(R.CODES), (F.col("c_custkey") % 16 + 1).cast("int"), F.lit(1)).alias("c"))
    return c.select("c_custkey", R.is_proper_base(F.col("c")).alias("proper"), R.is_base(F.col("c")).alias("base"), R.is_gap(F.col("c")).alias("gap"))


# --- MD, CIGAR, merged mates


_MD = "concat(cast(k % 9 as {s}), 'A', cast(k % 4 as {s}), '^GC', cast(k % 3 as {s}), 'T', cast(len as {s}), case when k % 2 = 0 then '^A' else '' end)"


@_on_reads("""select qname, cast(case when k % 2 = 0 then 8 else 7 end as bigint) ops, k % 9 + k % 4 + k % 3 + len matches, cast(case when k % 2 = 0 then 3 else 2 end as bigint) deleted,
  concat(case when k % 9 > 0 then cast(k % 9 as varchar) else '' end, 'A', case when k % 4 > 0 then cast(k % 4 as varchar) else '' end, '^GC', cast(k % 3 as varchar), 'T', cast(len as varchar), case when k % 2 = 0 then '^A' else '' end) text from reads""")
def md_parse(spark, sf):
    r = X.reads(spark, sf).select("qname", S.md_ops(F.expr(_MD.format(s="string"))).alias("o"))
    total = lambda kind, v: F.aggregate(F.filter("o", lambda x: x["kind"] == kind), F.lit(0).cast("bigint"), lambda a, x: a + v(x))
    return r.select("qname", F.size("o").cast("bigint").alias("ops"), total("num", lambda x: x["n"]).alias("matches"), total("del", lambda x: F.length(x["bases"])).alias("deleted"), S.md_text(F.col("o")).alias("text"))


@_on_reads("""select qname, case when n = 0 then concat(3, 'S', len - 9, 'M2D4I2M') when n <= 2 then concat(3, 'S', len - 9, 'M2D4I', 2 - n, 'M') when n < 6 then concat(3, 'S', len - 9, 'M2D', 6 - n, 'S') else concat(3, 'S', len - 9 - (n - 6), 'M') end back,
  case when n = 0 then concat(3, 'S', len - 9, 'M2D4I2M') when n < 3 then concat(3 - n, 'S', len - 9, 'M2D4I2M') else concat(len - 9 - (n - 3), 'M2D4I2M') end front, greatest(n - 3, 0) shift
  from (select *, k % 9 n from reads) r where n <> 2 and n <> 6 or true""".replace("when n <= 2 then concat(3, 'S', len - 9, 'M2D4I', 2 - n, 'M')", "when n < 2 then concat(3, 'S', len - 9, 'M2D4I', 2 - n, 'M') when n = 2 then concat(3, 'S', len - 9, 'M2D4S')").replace(" where n <> 2 and n <> 6 or true", ""))
def trim_cigar(spark, sf):
    r = X.reads(spark, sf).withColumn("n", F.col("k") % 9).withColumn("c", F.expr("concat('3S', len - 9, 'M2D4I2M')"))
    back, _ = S.trimmed_cigar(F.col("c"), F.col("n"), True)
    front, shift = S.trimmed_cigar(F.col("c"), F.col("n"), False)
    return r.select("qname", back.alias("back"), front.alias("front"), shift.alias("shift"))


_PAIR = "(select qname, seq, qual, len, reverse(translate(seq, 'ACGT', 'TGCA')) seq2, list_transform(qual, lambda q: 61 - q) qual2, len + k % 30 l from reads)"


@_on_reads(f"""select qname, array_to_string(list_transform(range(0, l), lambda p: case when p < len and l - 1 - p < len then case when seq[p + 1] = c[l - p] or qual[p + 1] > qual2[l - p] then seq[p + 1] else c[l - p] end when p < len then seq[p + 1] else seq2[l - p] end), '') seq,
  list_transform(range(0, l), lambda p: case when p < len and l - 1 - p < len then case when seq[p + 1] = c[l - p] then least(qual[p + 1] + qual2[l - p], 50) else abs(qual[p + 1] - qual2[l - p]) end when p < len then qual[p + 1] else qual2[l - p] end) qual from (select *, translate(seq2, 'ACGT', 'TGCA') c from {_PAIR} a) b""".replace("range(0, l)", "list_filter(range(0, l), lambda p: p < len or l - 1 - p < len)"))
def merge_consensus(spark, sf):
    r = X.reads(spark, sf).selectExpr("qname", "seq", "qual", "reverse(translate(seq, 'ACGT', 'TGCA')) seq2", "transform(qual, q -> 61 - q) qual2", "cast(len + k % 30 as int) l")
    r = r.select("qname", S.merged(F.col("l"), F.col("seq"), F.col("qual"), F.col("seq2"), F.col("qual2"), 50).alias("m"))
    return r.select("qname", F.array_join("m.base", "").alias("seq"), F.col("m.q").alias("qual"))


@_on_reads("select ref_id, pos, array_to_string(list_sort(list(distinct hit)), ';') xa from (select ref_id, pos, unnest([concat('chr1,+', k % 5), concat('chr2,-', k % 3)]) hit from reads) x group by 1, 2")
def xa_union(spark, sf):
    r = X.reads(spark, sf).withColumn("xa", F.expr("concat('chr1,+', k % 5, ';chr2,-', k % 3)"))
    return pileup.hits_union(r, ["ref_id", "pos"], "xa")


# --- numbers


@_query("select event_id, round(ln(exp(a) + exp(b)), 9) s, round(a + b, 9) p, round(3 * a, 9) cube, round(ln(exp(a) + exp(b) + exp(a + b)), 9) three from (select event_id, -abs(coalesce(value, 0)) / 100 - 0.5 a, -(event_id % 7 + 1) / 10.0 b from events) x")
def log_prob_sum(spark, sf):
    e = X.table(spark, sf, "events").select("event_id", (-F.abs(F.coalesce("value", F.lit(0.0))) / 100 - 0.5).alias("a"), (-(F.col("event_id") % 7 + 1) / 10.0).alias("b"))
    a, b = F.col("a"), F.col("b")
    return e.select("event_id", F.round(N.log_add(a, b), 9).alias("s"), F.round(a + b, 9).alias("p"), F.round(3 * a, 9).alias("cube"), F.round(N.log_sum(F.array(a, b, a + b)), 9).alias("three"))


def _horner(c, x):
    out = repr(c[0])
    for v in c[1:]:
        out = f"({out} * {x} + {v!r})"
    return out


_TAIL = "{c} / {d}".format(c=_horner(N._C, "t"), d=_horner(N._D, "t"))
_INNER = "{a} * q / {b}".format(a=_horner(N._A, "(q * q)"), b=_horner(N._B, "(q * q)"))


@_query(f"""select c_custkey, round(case when p < 0.02425 then {_TAIL} when p < 0.97575 then {_INNER} else -({_TAIL}) end, 9) z
  from (select c_custkey, p, p - 0.5 q, sqrt(-2 * ln(case when p > 0.5 then 1 - p else p end)) t from (select c_custkey, (c_custkey % 997 + 0.5) / 998 p from customer) x) y""")
def inv_norm_cdf(spark, sf):
    p = (F.col("c_custkey") % 997 + F.lit(0.5)) / 998
    return X.table(spark, sf, "customer").select("c_custkey", F.round(N.inverse_normal(p), 9).alias("z"))


# --- order and sets


@_on_reads("select qname, cast(row_number() over (partition by ref_id, pos order by len, qname) as bigint) place from reads")
def nice_sort(spark, sf):
    return pileup.number_in_group(X.reads(spark, sf), ["ref_id", "pos"], [F.length("seq"), "qname"]).select("qname", F.col("rn").cast("bigint").alias("place"))


@_on_reads("select cast(count(*) as bigint) n from (select ref_id, pos, lag(ref_id) over (order by k) r, lag(pos) over (order by k) p from reads) x where r > ref_id or r = ref_id and p > pos")
def check_sort(spark, sf):
    return streams.descents(X.reads(spark, sf), ["k"], ["ref_id", "pos"])


@_on_stream("select user_id, round(list_reduce(list(coalesce(value, 0) order by t, event_id), lambda a, x: a * 0.5 + x), 6) f from stream group by user_id")
def ordered_fold(spark, sf):
    s = X.stream(spark, sf).withColumn("v", F.coalesce("value", F.lit(0.0)))
    return streams.fold(s, BY, ORDER, "v", F.lit(0.0), lambda a, x: a * 0.5 + x).select("user_id", F.round("folded", 6).alias("f"))


@_query("select c_nationkey k from customer where c_custkey % 2 = 0 except select s_nationkey from supplier where s_suppkey % 3 = 0")
def header_difference(spark, sf):
    c = X.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("k"))
    return c.distinct().join(X.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("k")), "k", "left_anti")


@_query("select o_orderkey, o_orderkey % 256 b0, (o_orderkey // 256) % 256 b1, o_orderkey % 65536 le16, (o_orderkey % 256) * 256 + (o_orderkey // 256) % 256 be16, o_orderkey % 16777216 le24 from orders")
def endian_ints(spark, sf):
    """Numbers of two and three bytes, least or most significant first, from binary values."""
    o = X.table(spark, sf, "orders").withColumn("b", F.unhex(F.lpad(F.hex(F.col("o_orderkey").cast("bigint")), 16, "0")))
    big = lambda at, n: F.conv(F.hex(F.substring("b", at, n)), 16, 10).cast("bigint")
    return o.select("o_orderkey", big(8, 1).alias("b0"), big(7, 1).alias("b1"), big(7, 2).alias("le16"), (big(8, 1) * 256 + big(7, 1)).alias("be16"), big(6, 3).alias("le24"))


# --- bytes, numbers and several outputs


@_query("""select o_orderkey, o_orderkey * 65537 be8, (o_orderkey * 65537) % 4294967296 be4, ((o_orderkey * 65537) % 256) * 256 + (o_orderkey * 65537) // 256 % 256 le2,
  case when (o_orderkey * 65537) % 65536 >= 32768 then (o_orderkey * 65537) % 65536 - 65536 else (o_orderkey * 65537) % 65536 end s2, cast(null as bigint) beyond from orders""")
def endian_read(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", F.unhex(F.lpad(F.hex(F.col("o_orderkey") * 65537), 16, "0")).alias("b"))
    at = lambda *a, **k: N.integer(F.col("b"), *a, **k)
    return o.select("o_orderkey", at(0, 8, little=False).cast("bigint").alias("be8"), at(4, 4, little=False).alias("be4"), at(6, 2).alias("le2"), at(6, 2, little=False, signed=True).alias("s2"), at(6, 4).alias("beyond"))


@_query("select c_custkey, c_name || case when c_custkey % 3 = 0 then 'é ü' when c_custkey % 3 = 1 then 'é ü' else '' end text, cast(length(c_name) + case when c_custkey % 3 < 2 then 5 else 0 end as bigint) bytes from customer")
def bytes_decoded(spark, sf):
    """Bytes of names in UTF-8 or Latin-1, and how many bytes the text has in UTF-8."""
    c = X.table(spark, sf, "customer")
    tail = F.when(F.col("c_custkey") % 3 == 0, F.unhex(F.lit("E920FC"))).when(F.col("c_custkey") % 3 == 1, S.encoded(F.lit("é ü"))).otherwise(F.unhex(F.lit("")))
    return c.select("c_custkey", S.decoded(F.concat(S.encoded(F.col("c_name")), tail)).alias("text")).select("*", F.octet_length(S.encoded(F.col("text"))).cast("bigint").alias("bytes"))


@_on_reads("select qname, case k % 5 when 1 then 'A' when 2 then '2C' || cast(len - 3 as varchar(9)) else null end md from reads")
def md_tag(spark, sf):
    """MD as a letter or text; absent or of a type that says nothing in the rest."""
    md = lambda k, typ, v: F.when(F.col("k") % 5 == k, F.array(T.tag("MD", typ, v)))
    tags = F.coalesce(md(0, "i", F.col("len")), md(1, "A", F.lit("A")), md(2, "Z", F.expr("concat('2C', len - 3)")), md(3, "f", F.lit("1.5")), F.array().cast(T.KIND))
    return X.reads(spark, sf).select("qname", T.md_text(tags).alias("md"))


@_on_stream("select 'low' sink, count(*) n, cast(sum(event_id) as bigint) s from stream where value < 50 union all select 'odd', count(*), sum(event_id) from stream where event_id % 2 = 1 union all select 'high', count(*), sum(event_id) from stream where value >= 80")
def tee_sinks(spark, sf):
    """Three outputs of one pass over the stream; rows go to several of them or none."""
    out = streams.tee(X.stream(spark, sf), {"low": F.col("value") < 50, "odd": F.col("event_id") % 2 == 1, "high": F.col("value") >= 80})
    parts = [df.agg(F.count("*").alias("n"), F.sum("event_id").alias("s")).select(F.lit(n).alias("sink"), "n", "s") for n, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- damage


_COUNTS_SQL = "select cast(c_nationkey % 2 as int) side, substr('ACGT', cast(c_custkey % 4 + 1 as int), 1) x, substr('ACGT', cast(c_custkey // 4 % 4 + 1 as int), 1) y, count(*) c from customer group by 1, 2, 3"


@_query(f"""with n as ({_COUNTS_SQL}), g as (select a.x, b.y from (values ('A'), ('C'), ('G'), ('T')) a(x), (values ('A'), ('C'), ('G'), ('T')) b(y)),
  v as (select g.x, g.y, coalesce(n.c, 0) + coalesce(m.c, 0) c from g left join n on n.side = 0 and n.x = g.x and n.y = g.y left join n m on m.side = 1 and m.x = translate(g.x, 'ACGT', 'TGCA') and m.y = translate(g.y, 'ACGT', 'TGCA'))
  select x, y, round((c + 1) / (sum(c) over (partition by x) + 4.0), 9) rate from v""")
def freeze_mats(spark, sf):
    c = X.table(spark, sf, "customer").selectExpr("cast(c_nationkey % 2 as int) side", "substr('ACGT', cast(c_custkey % 4 + 1 as int), 1) x", "substr('ACGT', cast(c_custkey div 4 % 4 + 1 as int), 1) y").groupBy("side", "x", "y").agg(F.count("*").alias("c"))
    return genome.frozen_rates(c.where("side = 0").drop("side"), c.where("side = 1").drop("side")).withColumn("rate", F.round("rate", 9))


@_on_reads("select case when 2 * j <= len then j else j - len end offs, case when back then translate(seq[i + 1], 'ACGT', 'TGCA') else seq[i + 1] end base, count(*) c from (select *, flag & 16 <> 0 back, case when flag & 16 <> 0 then len - 1 - i else i end j from reads, unnest(range(0, len)) u(i) where flag & 4 = 0 and ref_id <> 4294967295) x group by 1, 2")
def dmgstats_merge(spark, sf):
    """Statistics of two halves of the reads, added; reversed reads in the direction of their molecules."""
    b = pileup.molecule_way(pileup.walk(X.reads(spark, sf).withColumn("half", F.col("k") % 2), ["half", "flag"]))
    one = lambda h: b.where(F.col("half") == h).groupBy(R.damage_position(b.i, b.read_len).alias("offs"), "base").agg(F.count("*").alias("c"))
    return genome.merged_counts([one(0), one(1)], ["offs", "base"])


@_on_reads(f"""select offs, case when back then translate(ref_base, 'ACGT', 'TGCA') else ref_base end ref_base, case when back then translate(base, 'ACGT', 'TGCA') else base end base, cpg, count(*) c
  from (select back, case when 2 * j <= len then j else j - len end offs, base, {{ref}} ref_base, {{ref}} = 'C' and {{next}} = 'G' or {{ref}} = 'G' and {{before}} = 'C' cpg
  from (select ref_id, len, flag & 16 <> 0 back, case when flag & 16 <> 0 then len - 1 - i else i end j, pos + i p, seq[i + 1] base from reads, unnest(range(0, len)) u(i) where flag & 4 = 0 and ref_id <> 4294967295) x) y group by 1, 2, 3, 4""".format(
    **{k: f"substr('ACGT', cast((({p}) * ({p}) * 31 + ({p}) * 51 + ref_id * 7 + ({p}) // 8) % 4 as int) + 1, 1)" for k, p in (("ref", "p"), ("next", "p + 1"))}, before="case when p > 0 then substr('ACGT', cast(((p - 1) * (p - 1) * 31 + (p - 1) * 51 + ref_id * 7 + (p - 1) // 8) % 4 as int) + 1, 1) else 'N' end"))
def damage_cpg(spark, sf):
    """Substitutions at CpG sites and elsewhere, in the direction of the molecules."""
    from .molecules import _genome

    b = pileup.walk(X.reads(spark, sf).withColumn("back", R.has_flag(F.col("flag"), "reversed")), ["ref_id", "back"])
    b = b.withColumn("offs", R.damage_position(F.when(F.col("back"), b.read_len - 1 - b.i).otherwise(b.i), b.read_len))
    c = genome.substitutions(b, _genome(spark), ["offs", "back"], cpg=True)
    turn = lambda x: F.when(F.col("back"), F.translate(x, "ACGT", "TGCA")).otherwise(F.col(x)).alias(x)
    return genome.merged_counts([c.select("offs", turn("ref_base"), turn("base"), "cpg", "c")], ["offs", "ref_base", "base", "cpg"])


@_query(f"""with {X.REGIONS_SQL}, r as (select distinct ref_id, "start" + 25 a, "start" + 125 b from regions), h as (select ref_id, "start" s, "end" e from regions where "start" % 2 = 0), o as (select ref_id, "start" s, "end" e from regions where "start" % 2 = 1),
  g as (select r.*, p, substr('ACGT', cast((p * p * 31 + p * 51 + ref_id * 7 + p // 8) % 4 as int) + 1, 1) c, exists(select 1 from h where h.ref_id = r.ref_id and p >= s and p < e) n, exists(select 1 from o where o.ref_id = r.ref_id and p >= s and p < e) m from r, unnest(range(a, b)) u(p))
  select ref_id, a "start", b "end", string_agg(case when n then 'N' else c end, '' order by p) "hard", string_agg(case when m then lower(c) else c end, '' order by p) soft, string_agg(case when n then case when m then 'n' else 'N' end when m then lower(c) else c end, '' order by p) "both", string_agg(c, '' order by p) plain from g group by 1, 2, 3""")
def mask_overlay(spark, sf):
    from .molecules import _genome

    g = X.regions(spark, sf)
    r = g.select("ref_id", (F.col("start") + 25).alias("start"), (F.col("start") + 125).alias("end")).distinct()
    plain = genome.fetch(r, _genome(spark), []).select("ref_id", "start", "end", F.col("bases").alias("plain"))
    return genome.masked(plain, g.where("start % 2 = 0"), g.where("start % 2 = 1"))
