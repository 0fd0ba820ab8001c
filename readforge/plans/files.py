"""Queries on files that Spark writes from the tables: indexed BAM."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions import tags as T
from ..operators import pileup
from ..operators.tables import scratch
from ..sources import bam, index, sam, twobit
from ..sources import reads as any_reads
from ..streaming import statistics
from . import fixtures as X
from .queries import _query

#: Reads and regions spread over so many times the positions, so that they fall into many bins.
SPREAD = 40
_READS = X.SQL.rstrip() + f", wide as (select qname, flag, ref_id, case when pos < 0 then pos else pos * {SPREAD} end pos, len from reads)"
_REGIONS = X.REGIONS_SQL.replace("regions as", "near as") + f', regions as (select ref_id, "start" * {SPREAD} "start", "end" * {SPREAD} "end" from near)'


def sorted_bam(spark, sf) -> str:
    """The path of BAM files, each sorted by place; records of one reference may stand in several."""
    bam.register(spark)
    path = scratch(spark, "sorted-bam")
    i = lambda c: F.col(c).cast("int").alias(c)
    # short rows are dealt out and sorted, and bases made once: the sample of a range runs what is before it a second time
    h = X.heads(spark, sf).repartitionByRange("ref_id", "pos", "qname").sortWithinPartitions("ref_id", "pos", "qname")
    r = X.with_bases(h).withColumn("pos", F.when(F.col("pos") < 0, F.col("pos")).otherwise(F.col("pos") * SPREAD))
    tags = F.array(T.tag("RG", "Z", F.col("rg"))).alias("tags")
    r = r.select("qname", i("flag"), "ref_id", i("pos"), i("mapq"), "cigar", "mate_ref_id", i("mate_pos"), F.lit(0).alias("isize"), "seq", F.col("qual").cast("array<int>").alias("qual"), tags)
    r.write.format("bam").option("header", bam.refs_header([(f"chr{k}", 6000 * SPREAD) for k in range(3)], "coordinate")).mode("append").save(path)
    return path


def _data_paths(rows):
    return rows.withColumn("path", F.regexp_replace("path", r"\.bai$", ""))


@_query(_READS + f', {_REGIONS} select qname, pos from wide r where exists (select 1 from regions g where g.ref_id = r.ref_id and r.pos < g."end" and g."start" < r.pos + r.len)')
def bam_region_scan(spark, sf):
    path = sorted_bam(spark, sf)
    index.write(index.build(spark, path)).collect()
    g = X.regions(spark, sf).select("ref_id", (F.col("start") * SPREAD).alias("start"), (F.col("end") * SPREAD).alias("end"))
    return index.scan(spark, _data_paths(index.read(spark, f"{path}/*.bai")), g).select("qname", F.col("pos").cast("bigint").alias("pos"))


@_query(_READS + """, b as (select ref_id, pos, pos + len - 1 e from wide where ref_id <> 4294967295)
  select distinct ref_id, case when pos >> 14 = e >> 14 then 4681 + (pos >> 14) when pos >> 17 = e >> 17 then 585 + (pos >> 17) when pos >> 20 = e >> 20 then 73 + (pos >> 20) else 9 + (pos >> 23) end bin, cast(null as bigint) "window" from b
  union all select ref_id, null, w from (select ref_id, max(e >> 14) m from b group by 1) x, unnest(range(m + 1)) u(w)""")
def bai_read(spark, sf):
    path = sorted_bam(spark, sf)
    index.write(index.build(spark, path, 4096)).collect()
    return index.read(spark, f"{path}/*.bai").select("ref_id", "bin", "window").distinct()


@_query(_READS + " select qname, flag, pos from wide where ref_id = 1 and pos >= 40000 and pos < 90000")
def bam_pushed_filter(spark, sf):
    """Filters on reference and position reach the source, which asks the index beside each file."""
    path = sorted_bam(spark, sf)
    index.write(index.build(spark, path)).collect()
    found = spark.read.format("bam").option("split", 1 << 16).load(path).where("ref_id = 1 and pos >= 40000 and pos < 90000")
    return found.select("qname", F.col("flag").cast("bigint").alias("flag"), F.col("pos").cast("bigint").alias("pos"))


@_query(_READS + " select flag & 16 <> 0 rev, count(*) n, cast(sum(pos) as bigint) s from wide group by 1")
def bam_split_scan(spark, sf):
    """Each file in stretches of 4 KB: records are found wherever they begin."""
    found = spark.read.format("bam").option("split", 4096).load(sorted_bam(spark, sf))
    return found.groupBy(R.has_flag(F.col("flag"), "reversed").alias("rev")).agg(F.count("*").alias("n"), F.sum("pos").alias("s"))


# --- files of any kind

_WHOLE = "qname, flag, ref_id, pos, mapq, cigar, mate_ref_id, mate_pos, len * 3 - 70 isize, seq, qual, rg, case when k % 4 = 0 then null else xp end xp"


@_query(X.SQL + f"select {_WHOLE} from reads")
def reads_roundtrip(spark, sf):
    """Half of the reads in BAM, half in SAM text with the references in another order, read back from one folder."""
    bam.register(spark)
    path = scratch(spark, "reads")
    r = X.reads(spark, sf)
    i = lambda c: F.col(c).cast("int").alias(c)
    tags = F.array(T.tag("RG", "Z", F.col("rg")), T.tag("XP", "i", F.expr("case when k % 4 = 0 then null else xp end")))
    r = r.select("k", "qname", i("flag"), "ref_id", i("pos"), i("mapq"), "cigar", "mate_ref_id", i("mate_pos"), F.expr("cast(len * 3 - 70 as int)").alias("isize"), "seq", F.col("qual").cast("array<int>").alias("qual"), F.filter(tags, lambda t: t["value"].isNotNull()).alias("tags"))
    names = ["chr1", "chr2", "chrX"]
    r.where("k % 2 = 0").drop("k").write.format("bam").option("header", bam.refs_header([(n, 6000) for n in names])).mode("append").save(f"{path}/a")
    refs = spark.createDataFrame(list(enumerate(names)), "ref_id bigint, name string")
    sam.write(r.where("k % 2 = 1").drop("k"), f"{path}/b", bam.refs_header([(n, 6000) for n in reversed(names)]), refs)
    back = any_reads.read(spark, f"{path}/a\n{path}/b")
    b = lambda c: F.col(c).cast("bigint").alias(c)
    xp = F.when(F.exists("tags", lambda t: t["key"] == "XP"), T.as_int(F.col("tags"), "XP")).alias("xp")
    return back.select("qname", b("flag"), "ref_id", b("pos"), b("mapq"), "cigar", "mate_ref_id", b("mate_pos"), b("isize"), "seq", F.col("qual").cast("array<bigint>").alias("qual"), T.as_string(F.col("tags"), "RG").alias("rg"), xp)


@_query(X.SQL + """select 'chr1' as name, 6000 as length, 0 number, count(*) n from reads where ref_id = 0 union all select 'chr2', 6000, 1, count(*) from reads where ref_id = 1 union all select 'chrX', 6000, 2, count(*) from reads where ref_id = 2""")
def header_roundtrip(spark, sf):
    """References by the header of the files that were written, with how many records stand on each."""
    bam.register(spark)
    path = scratch(spark, "headed")
    meta = bam.with_program(bam.parse_header(bam.refs_header([(n, 6000) for n in ("chr1", "chr2", "chrX")])), "readforge", "header_roundtrip", "1")
    sam.write(X.reads(spark, sf).where("ref_id <> 4294967295"), path, bam.show_header(meta), spark.createDataFrame([(0, "chr1"), (1, "chr2"), (2, "chrX")], "ref_id bigint, name string"))
    refs = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(any_reads.references(spark, path))], "ref_id bigint, name string, length int")
    return any_reads.read(spark, path).join(refs, "ref_id").groupBy("name", "length", F.col("ref_id").cast("int").alias("number")).agg(F.count("*").alias("n"))


# --- windows of a genome

_SIZES = "select n_nationkey k, cast(900 + n_nationkey * 40 as bigint) size from nation"


@_query(f"with s as ({_SIZES}) select count(*) * 20 n, count(*) * 20 windows, 0 touching, 0 outside, true strands from s")
def random_genome_windows(spark, sf):
    """Windows of 60 bases drawn from sequences of the nations' sizes; every supplier makes 30 bases unknown."""
    sizes = [r["size"] for r in spark.sql(_SIZES.replace("from nation", "from {n}"), n=X.table(spark, sf, "nation")).orderBy("k").collect()]  # a row for each nation
    unknown = X.table(spark, sf, "supplier").selectExpr("s_nationkey ref_id", "cast(s_suppkey * 37 % 800 as bigint) start").withColumn("end", F.col("start") + 30)
    w = twobit.windows(spark, sizes, 20 * len(sizes), 60, 7, unknown)
    met = w.join(unknown.select("ref_id", F.col("start").alias("s"), F.col("end").alias("e")), "ref_id").where("s < end and e > start").agg(F.count("*").alias("touching"))
    size = F.element_at(F.array(*[F.lit(x) for x in sizes]), F.col("ref_id").cast("int") + 1)
    told = w.agg(F.count("*").alias("n"), F.countDistinct("window").alias("windows"), F.sum(((F.col("start") < 0) | (F.col("end") > size)).cast("int")).alias("outside"), (F.countDistinct("reversed") == 2).alias("strands"))
    one = F.broadcast(met.withColumn("_k", F.lit(1)))  # one row
    return told.withColumn("_k", F.lit(1)).join(one, "_k").select("n", "windows", F.col("touching").cast("int").alias("touching"), F.col("outside").cast("int").alias("outside"), "strands")


# --- files that arrive


@_query(X.SQL + """select ref_id, site, count(*) depth, cast(sum(mapq) as bigint) mapq from (select ref_id, pos + i site, mapq from reads, unnest(range(0, len)) u(i) where flag & 4 = 0 and flag & 1024 = 0 and ref_id <> 4294967295) x group by 1, 2""")
def stream_depth(spark, sf):
    """Depths of reads whose SAM files arrive two by two, added up batch by batch."""
    lines, out = scratch(spark, "arriving"), scratch(spark, "depths")
    sam.encode(X.reads(spark, sf).repartition(6, "qname")).write.text(lines)
    sums = {"depth": F.count("*"), "mapq": F.sum("mapq")}
    query = statistics.accumulate(statistics.sam_stream(spark, lines, 2), out, ["ref_id", "site"], sums, lambda b: pileup.walk(b, ["ref_id"], bases=False), once=True)
    query.awaitTermination()
    return statistics.totals(spark, out, ["ref_id", "site"], list(sums))
