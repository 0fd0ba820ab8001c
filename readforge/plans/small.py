"""Queries on instrument bytes, trimming by a condition, and letters and logarithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import molecules as M
from ..functions import numeric as N
from ..functions import reads as R
from ..operators import molecules
from . import alignments
from . import fixtures as X
from .queries import _on_reads, _query

_CYCLES, _CLUSTERS = 17, 6


@_query(f"""select tile, cluster, array_to_string(list_transform(d, lambda b: case when b = 0 then 'N' else 'ACGT'[b % 4 + 1] end), '') bases, array_to_string(list_transform(list_reverse(d), lambda b: case when b = 0 then 'N' else 'TGCA'[b % 4 + 1] end), '') back,
  list_transform(d, lambda b: case when b = 0 then 15 else 1 << (b % 4) end) codes, array_to_string(list_transform(d, lambda b: case when b = 0 then 'F' else '1248'[b % 4 + 1] end), '') || '0' packed,
  list_transform(d, lambda b: b // 4) quals, array_to_string(list_transform(d, lambda b: chr(33 + b // 4)), '') text, array_to_string(list_transform(list_reverse(d), lambda b: chr(33 + b // 4)), '') text_back
  from (select p_partkey tile, cast(c as int) cluster, list_transform(range(2, {_CYCLES}), lambda i: cast((p_partkey * 17 + c * 31 + i * 23) % 256 as int)) d from part, unnest(range(0, {_CLUSTERS})) u(c)) x""")
def bcl_emitters(spark, sf):
    """A byte for each cluster in a row for each cycle; cycles from the second on."""
    p = X.table(spark, sf, "part").selectExpr("p_partkey tile", f"explode(sequence(0L, {_CYCLES - 1}L)) cycle")
    cycles = p.selectExpr("tile", "cycle", f"unhex(array_join(transform(sequence(0L, {_CLUSTERS - 1}L), c -> lpad(hex((tile * 17 + c * 31 + cycle * 23) % 256), 2, '0')), '')) data")
    d = F.col("data")
    out = molecules.bcl_clusters(cycles.where("cycle >= 2"), ["tile"])
    return out.select("tile", "cluster", M.bcl_bases(d).alias("bases"), M.bcl_bases(d, back=True).alias("back"), M.bcl_codes(d).alias("codes"), F.hex(M.bcl_packed(d)).alias("packed"), M.bcl_qualities(d).alias("quals"), M.bcl_quality_text(d).alias("text"), M.bcl_quality_text(d, back=True).alias("text_back"))


_MEAN = 29


@_on_reads(f"""select qname, case when back then pos + n else pos end pos, case when back then substr(seq, cast(n as int) + 1) else substr(seq, 1, cast(len - n as int)) end seq, case when back then qual[n + 1:] else qual[1:len - n] end qual, case when n = len then '' else cast(len - n as varchar(9)) end md from (
  select *, coalesce(list_min(list_filter(range(1, len + 1), lambda j: list_sum(e[1:j]) >= {_MEAN} * j)) - 1, len) n from (select *, flag & 16 <> 0 back, case when flag & 16 <> 0 then qual else list_reverse(qual) end e from reads) x) y""")
def trim_3_while(spark, sf):
    """While the mean quality of what goes is under a bound."""
    low = lambda s, q: F.aggregate(q, F.lit(0).cast("bigint"), lambda a, x: a + x) < _MEAN * F.length(s)
    return molecules.trim_3_while(alignments._tagged(X.reads(spark, sf), MD="cast(len as string)"), low).select("qname", F.col("pos").cast("bigint").alias("pos"), "seq", "qual", alignments._text("MD").alias("md"))


@_query("""select event_id, round(case when c <= 0 then b when c >= 1 then a else ln(c * exp(a) + (1 - c) * exp(b)) end, 9) mix, case when a = b then null else round(ln(exp(greatest(a, b)) - exp(least(a, b))), 6) end less
  from (select event_id, -(event_id % 13 + 1) / 10.0 a, -(event_id % 7 + 1) / 10.0 b, (event_id % 11 - 2) / 6.0 c from events) x""")
def log_mix(spark, sf):
    e = X.table(spark, sf, "events").select("event_id", (-(F.col("event_id") % 13 + 1) / 10.0).alias("a"), (-(F.col("event_id") % 7 + 1) / 10.0).alias("b"), ((F.col("event_id") % 11 - 2) / 6.0).alias("c"))
    a, b = F.col("a"), F.col("b")
    less = N.log_subtract(F.greatest(a, b), F.least(a, b))
    return e.select("event_id", F.round(N.log_mix(F.col("c"), a, b), 9).alias("mix"), F.when(a != b, F.round(less, 6)).alias("less"))


@_query("""select doc_id, list_transform(t, lambda x: case when strpos('ACGT', upper(x)) > 0 then strpos('ACGT', upper(x)) - 1 else 0 end) two, list_transform(t, lambda x: case when strpos('ACGT', upper(x)) > 0 then 1 << cast(strpos('ACGT', upper(x)) - 1 as int) else 1 end) wide,
  list_transform(t, lambda x: case when x = '.' then 0 when upper(x) = 'U' then 8 when strpos('-ACMGRSVTWYHKDBN', upper(x)) > 0 then strpos('-ACMGRSVTWYHKDBN', upper(x)) - 1 else 15 end) four
  from (select doc_id, list_filter(string_split(coalesce(text, ''), ''), lambda x: x <> '' and ascii(x) < 128) t from documents) d""")
def letter_codes(spark, sf):
    """Codes of all letters of the documents' texts that ASCII has."""
    d = X.table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda x: (x != "") & (F.ascii(x) < 128)))).alias("t"))
    return d.select("doc_id", F.transform("t", R.two_bit_code).alias("two"), F.transform("t", lambda x: R.wide_code(R.two_bit_code(x))).alias("wide"), F.transform("t", R.base_code).alias("four"))
