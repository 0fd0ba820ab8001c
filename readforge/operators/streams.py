"""Ordered-stream algebra on DataFrames.  The order is always a column, as shuffles keep none.

Operators that look at all earlier rows are windows over `by`; without keys in `by` such a window is one task, so large
streams are given keys (a file, a reference, a user), or the two-pass forms below, which only order within ranges.  A global
number is such a form: it is what `number` gives without keys.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType, _parse_datatype_string

from ..functions import reads as R
from .tables import scratch, written


def _window(order: list[str], by: list[str]):
    return Window.partitionBy(*[F.col(c) for c in by]).orderBy(*order)


def take(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def drop(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """All rows but the first n; no task gets more than its range of them."""
    return numbered(df, order, "_n").where(F.col("_n") > n).drop("_n")


def _first_failure(df: DataFrame, order: list[str], by: list[str], keep: Column) -> DataFrame:
    """The order key of the first row of each stream that fails: an aggregate, so no stream lies in one task."""
    failed = df.where(~F.coalesce(keep, F.lit(False)))
    at = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])).alias("_stop")
    return failed.groupBy(*by).agg(at)


def take_while(df: DataFrame, order: list[str], keep: Column, by: list[str]) -> DataFrame:
    """Rows of each stream before its first failure."""
    here = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    return df.join(_first_failure(df, order, by, keep), by, "left").where(F.col("_stop").isNull() | (here < F.col("_stop"))).drop("_stop")


def drop_while(df: DataFrame, order: list[str], keep: Column, by: list[str]) -> DataFrame:
    """Rows of each stream from its first failure on."""
    here = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    return df.join(_first_failure(df, order, by, keep), by).where(here >= F.col("_stop")).drop("_stop")


def first_last(df: DataFrame, order: list[str], by: list[str], value: str) -> DataFrame:
    key = F.struct(*order)
    return df.groupBy(*by).agg(F.min_by(value, key).alias("first_value"), F.max_by(value, key).alias("last_value"), F.count("*").alias("n"))


def numbered(df: DataFrame, order: list, name: str = "rn") -> DataFrame:
    """df with each row's number, from 1, in the order of all rows.

    Two passes: rows are sorted by ranges and written, with their places in their range; the rows of each range are counted,
    and the sum of the ranges before (one number for each) is added.  Rows that tie are numbered as they were written.
    """
    at = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r["_p"]: r["count"] for r in at.groupBy(part.alias("_p")).count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offsets = F.array(*[F.lit(v) for v in before]).cast("array<bigint>")
    return at.withColumn(name, F.get(offsets, part.cast("int")) + place + 1).drop("_at")


def number(df: DataFrame, order: list[str], by: list[str], name: str = "rn") -> DataFrame:
    """df with each row's number in its stream; without `by`, in the whole, by ranges."""
    if not by:
        return numbered(df, order, name)
    return df.withColumn(name, F.row_number().over(_window(order, by)))


def common_prefix(df: DataFrame, literal: list, order: list[str], by: list[str], value: str) -> DataFrame:
    """Length of the common prefix of each stream and the literal; nulls equal nulls.  Only the shorter of both bounds it."""
    places = df.sparkSession.createDataFrame([(i, x, True) for i, x in enumerate(literal, 1)], StructType([StructField("rn", IntegerType()), StructField("_want", df.schema[value].dataType), StructField("_in", BooleanType())]))
    at = number(df, order, by).join(F.broadcast(places), "rn", "left")
    other = F.col("_in").isNull() | ~F.col(value).eqNullSafe(F.col("_want"))
    return at.groupBy(*by).agg(F.coalesce(F.min(F.when(other, F.col("rn"))) - 1, F.count("*")).cast("bigint").alias("n"))


def roll(df: DataFrame, order: list[str], by: list[str], width: int, step: int, value: str) -> DataFrame:
    """Windows of `width` rows, each `step` rows after the one before; the last ones may be shorter."""
    at = number(df, order, by).withColumn("_n", F.col("rn") - 1)
    at = at.withColumn("win", F.explode(F.expr(f"sequence(cast(greatest(0, ceil((_n - {width} + 1) / {step})) as bigint), cast(floor(_n / {step}) as bigint))")))
    return at.groupBy(*by, "win").agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def group_consecutive(df: DataFrame, order: list[str], by: list[str], starts: Column) -> DataFrame:
    """Adds `grp`: a number that grows by one at each row where `starts` holds."""
    return df.withColumn("grp", F.sum(F.coalesce(starts, F.lit(True)).cast("bigint")).over(_window(order, by).rowsBetween(Window.unboundedPreceding, 0)))


def changed(value: str, order: list[str], by: list[str]) -> Column:
    return ~F.lag(value).over(_window(order, by)).eqNullSafe(F.col(value)) | (F.row_number().over(_window(order, by)) == 1)


def gap(value: Column, order: list[str], by: list[str], most: int) -> Column:
    return F.coalesce(value - F.lag(value).over(_window(order, by)) > most, F.lit(True))


def zip_streams(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], by: list[str], how: str) -> DataFrame:
    """Row n of a beside row n of b; `how` is inner (stops with the shorter) or full (goes on with the longer)."""
    return number(a, order_a, by).join(number(b, order_b, by), [*by, "rn"], how)


def merge_sorted(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Union in order of key; where keys tie, rows of b come first.  Adds `src` (0 for a, 1 for b)."""
    return a.withColumn("src", F.lit(0)).unionByName(b.withColumn("src", F.lit(1))).orderBy(*key, F.desc("src"))


def by_coordinate() -> list[Column]:
    """Order of records by place; those at no reference come last."""
    return [F.pmod(F.col("ref_id").cast("bigint"), F.lit(1 << 32)), F.col("pos")]


def by_name() -> list[Column]:
    """Natural order of names."""
    return [R.name_key(F.col("qname"))]


def merge_ordered(inputs: list[DataFrame], key: list[Column], order: list[str], combine: dict[str, Column] | None = None) -> DataFrame:
    """Any number of sorted inputs as one, with `src` (the place of the input in the list) and `rn` (the place of the row).

    Rows are dealt by ranges of the key that a sample of all inputs gives, sorted in each range and numbered over all.  Where
    keys tie, later inputs come first, and rows of one input in `order`.  With `combine` the n-th rows that have one key in
    several inputs become one: its other columns are the given aggregates (over `src` and the columns; `src` is the least),
    and rows alone keep what the aggregate makes of one.
    """
    key = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    names = [f"_k{i}" for i in range(len(key))]
    every = None
    for i, df in enumerate(inputs):
        one = df.select("*", *key, F.lit(i).alias("src"))
        every = one if every is None else every.unionByName(one)
    last = [F.desc("src"), *order]
    if combine is not None:
        place = F.row_number().over(Window.partitionBy("src", *names).orderBy(*order))
        each = every.withColumn("_i", place).groupBy(*names, "_i").agg(F.min("src").alias("src"), *[v.alias(c) for c, v in combine.items()])
        every, last = each, [F.col("_i"), F.desc("src")]
    return numbered(every, [*names, *last]).drop(*names, "_i")


def fold(df: DataFrame, by: list[str], order: list[str], value: str, start: Column, step) -> DataFrame:
    """`folded`: step(so far, value) over the rows of each group in order.  A fold that is not associative needs all of a
    group in one row; sums, counts and extremes should be aggregates instead."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_r"))
    return rows.select(*by, F.aggregate(F.transform("_r", lambda r: r["_v"]), start, step).alias("folded"))


def descents(df: DataFrame, order: list[str], key: list[str]) -> DataFrame:
    """`n`: how often the key goes down from one row to the next, 0 for a sorted stream.

    Rows are range-partitioned by the order; each partition counts its own descents and tells its first and last key, so
    only one small row for each partition meets the others.
    """
    parts = df.select(*order, F.struct(*key).alias("_k")).repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(*order)
    at = parts.withColumn("_down", F.coalesce(F.lag("_k").over(w) > F.col("_k"), F.lit(False)))
    ends = at.groupBy("_p").agg(F.sum(F.col("_down").cast("bigint")).alias("n"), F.min_by("_k", F.struct(*order)).alias("first"), F.max_by("_k", F.struct(*order)).alias("last"))
    ends = ends.withColumn("n", F.col("n") + F.coalesce(F.lag("last").over(Window.orderBy("_p")) > F.col("first"), F.lit(False)).cast("bigint"))
    return ends.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))


def convert(df: DataFrame, order: list[str], states: int, start: int, step: Callable[[int, tuple], tuple[int, list[tuple]]], schema: str, block: int = 1 << 20) -> DataFrame:
    """Rows of `schema` that a machine with a few states makes of the rows of df in order.

    step(state, row) gives the next state, a number below `states`, and the rows to put out, none or several.  The stream is
    cut into blocks; for each block every state is followed to where it leads (states that meet go on as one), these maps are
    composed over the blocks, one small row each, and a second pass starts each block in its true state.  So no block waits
    for another, and how the rows are partitioned makes no difference.
    """
    at = numbered(df, order, "_n").withColumn("_block", F.floor((F.col("_n") - 1) / block))
    names = df.columns

    def rows_of(group: pd.DataFrame):
        return group.sort_values("_n")[names].itertuples(index=False)

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        now = list(range(states))
        for row in rows_of(group):
            known = {s: step(s, row)[0] for s in set(now)}
            now = [known[s] for s in now]
        return pd.DataFrame({"block": [group["_block"].iloc[0]], "to": [now]})

    begin, state = [], start
    for r in sorted(at.groupBy("_block").applyInPandas(follow, "block long, to array<int>").collect()):
        begin.append(state)
        state = r["to"][state]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        now, out = begin[int(group["_block"].iloc[0])], []
        for row in rows_of(group):
            now, made = step(now, row)
            out += made
        return pd.DataFrame(out, columns=fields)

    fields = [f.name for f in _parse_datatype_string(schema).fields]
    return at.groupBy("_block").applyInPandas(run, schema)


def tee(df: DataFrame, sinks: dict[str, Column]) -> dict[str, DataFrame]:
    """Several outputs of one pass: for each name the rows for which its condition holds.

    The input is read once: rows are written with the names of their sinks, in a folder for each, and every output reads its
    own folder.  A row may go to several sinks or none; nulls in a condition are no.
    """
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in sinks.items()]))
    path = scratch(df.sparkSession, "tee")
    df.withColumn("_sink", F.explode(names)).write.partitionBy("_sink").parquet(path)
    wide = df.schema.add("_sink", "string")
    return {n: df.sparkSession.read.schema(wide).parquet(path).where(F.col("_sink") == n).drop("_sink") for n in sinks}
