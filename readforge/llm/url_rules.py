"""URL filters as a sort-merge range join, in DataFrame operations only.

A host is written with its labels reversed ("www.example.com" → "com.example.www."), so a rule's host and all its
subdomains are one interval of keys, and intervals nest or are disjoint.  Rules and urls are sorted together; a sweep
keeps the stack of rules still open, one slot for each depth of labels, and each url looks up its longest open rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, shuffle_partitions


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_u, instr(_u, '://') + 3)"))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each followed by a dot; a key starts with another just when its host is that host or below it."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of urls: page_id, host, path, rule, verdict.

    rules has host, path, verdict.  A rule fits its host and all subdomains if the url's path starts with the rule's;
    the longest (host and path together, then host) wins; without one the rule is null and the verdict `default`.
    Null urls and urls without `://` have empty host and path and no rule.  Rules that are null in any column or have
    no host are passed over; repeated rules count once.  Repeated urls give repeated rows.  Rows are dealt by top label
    and a salt, with the rules copied to each salt of their label, so no host, however frequent, lies in one task.
    """
    n = shuffle_partitions(urls.sparkSession)
    base = urls.select(F.col(key).alias("_id"), F.col(url).alias("_u"))
    host, path = url_parts(F.col("_u"))
    base = base.select("_id", host.alias("host"), path.alias("path"), (F.rand(7) * n).cast("int").alias("_salt"))
    base = base.withColumn("_key", host_key(F.col("host")))
    own = rules.select(lower_ascii(F.col("host")).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v"))
    own = own.where("h <> '' and p is not null and v is not null").withColumn("_key", host_key(F.col("h")))
    own = own.groupBy("_key").agg(F.collect_set(F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("hn"), "p", F.concat("h", "p").alias("rule"), "v")).alias("_rules"))
    own = own.withColumn("_depth", F.size(F.split("_key", r"\.")) - 1)
    depths = [r[0] for r in own.select("_depth").distinct().collect()]  # a host has at most 127 labels
    opened = own.select(F.lit(None).cast(base.schema["_id"].dataType).alias("_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_salt"), "_key", "_depth", "_rules", F.lit(0).alias("_kind"))
    swept = base.withColumn("_depth", F.lit(None).cast("int")).withColumn("_rules", F.lit(None).cast(own.schema["_rules"].dataType)).withColumn("_kind", F.lit(1))
    swept = swept.unionByName(opened).withColumn("_top", F.split("_key", r"\.")[0])
    w = Window.partitionBy("_top", "_salt").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slot = F.struct("_key", "_rules")
    swept = swept.withColumns({f"_s{d}": F.last(F.when(F.col("_depth") == d, slot), ignorenulls=True).over(w) for d in depths})
    stack = F.array(*[F.col(f"_s{d}") for d in depths]) if depths else F.array().cast("array<struct<_key:string,_rules:array<struct<n:int,hn:int,p:string,rule:string,v:string>>>>")
    swept = swept.where("_kind = 1").withColumn("_stack", stack)
    live = F.filter("_stack", lambda s: s.isNotNull() & F.col("_key").startswith(s["_key"]))
    fits = F.filter(F.flatten(F.transform(live, lambda s: s["_rules"])), lambda r: F.col("path").startswith(r["p"]))
    best = F.array_max(fits)
    return swept.select("_id", "host", "path", best.alias("_best")).select(F.col("_id").alias("page_id"), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.v", F.lit(default)).alias("verdict"))
