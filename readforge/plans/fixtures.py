"""Read records derived from the tables of a folder, alike in Spark and in standard SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = """select o_orderkey k, cast(o_custkey as bigint) ck,
  cast(case when o_orderkey % 97 = 0 then 4294967295 else o_custkey % 3 end as bigint) ref_id,
  cast(case when o_orderkey % 97 = 0 then -1 else (o_custkey*37) % 5000 end as bigint) pos,
  cast(24 + (o_custkey % 4)*8 as bigint) len,
  cast((o_orderkey*7) % 61 as bigint) mapq,
  cast((case when o_custkey % 5 = 0 then 1 + 64 else 0 end) + (case when o_orderkey % 97 = 0 then 4 else 0 end)
     + (case when o_custkey % 2 = 1 then 16 else 0 end) + (case when o_orderkey % 50 = 0 then 512 else 0 end) as bigint) flag,
  cast(case when o_custkey % 5 = 0 then o_custkey % 3 else 4294967295 end as bigint) mate_ref_id,
  cast(case when o_custkey % 5 = 0 then (o_custkey*37) % 5000 + 100 else -1 end as bigint) mate_pos,
  cast(case when o_custkey % 7 = 0 then 2 when o_custkey % 11 = 0 then 1 else 0 end as bigint) ff,
  cast(case when o_orderkey % 211 = 0 then -1 else 1 end as bigint) xp,
  concat('rg', cast(o_custkey % 2 as varchar(9))) rg,
  concat('r', cast(o_orderkey as varchar(20))) qname
 from orders"""
BASE = "substr('ACGT', cast(((((pos+i)*(pos+i)*31 + (pos+i)*51 + (ref_id)*7 + ((pos+i) {div} 8)) % 4 + case when (k*13 + i*7) % 29 = 0 then 1 else 0 end) % 4) as int)+1, 1)"
SQL = f"""with h as ({HEAD}), reads as (select *,
  array_to_string(list_transform(range(0, len), lambda i: {BASE.format(div="//")}), '') seq,
  list_transform(range(0, len), lambda i: 20 + (k*5 + i*3) % 21) qual, concat(cast(len as varchar(9)), 'M') cigar from h)
"""
REGIONS_SQL = "regions as (select cast(n_regionkey % 3 as bigint) ref_id, cast((n_nationkey*211) % 4800 as bigint) \"start\", cast((n_nationkey*211) % 4800 + 50 + (n_nationkey % 4)*60 as bigint) \"end\" from nation)"
STREAM_SQL = "stream as (select event_id, user_id, event_type, value, epoch_us(ts) t from events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read for each order, without what stands in its sequence; orders of a customer stand at one place, and so are duplicates."""
    return spark.sql(HEAD.replace("from orders", "from {o}"), o=table(spark, sf_dir, "orders"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reads; orders are dealt over all cores, as a table of few files would not be."""
    return with_bases(heads(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism))


def with_bases(h: DataFrame) -> DataFrame:
    """Heads with bases, qualities and operations, by a generator, which the optimizer does not copy into each place that uses them."""
    seq = f"array_join(transform(sequence(0L, len-1), i -> {BASE.format(div='div')}), '')"
    made = h.selectExpr("*", f"explode(array(struct({seq} as seq, transform(sequence(0L, len-1), i -> 20 + (k*5 + i*3) % 21) as qual))) as _x")
    return made.select("*", "_x.seq", "_x.qual", F.concat(F.col("len").cast("string"), F.lit("M")).alias("cigar")).drop("_x")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    start = (F.col("n_nationkey").cast("bigint") * 211) % 4800
    return n.select((F.col("n_regionkey") % 3).cast("bigint").alias("ref_id"), start.alias("start"), (start + 50 + (F.col("n_nationkey") % 4) * 60).alias("end"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
