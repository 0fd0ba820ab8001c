"""Mates of a pair: bringing them together, filtering them together, and finding how long their molecule was."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reads as R

#: Adapters as they appear in the first and in the second mate.
FORWARD = ["AGATCGGAAGAGCGGTTCAG", "AGATCGGAAGAGCACACGTC", "AGATCGGAAGAGCTCGTATG"]
REVERSE = ["AGATCGGAAGAGCGTCGTGT", "GGAAGAGCGTCGTGTAGGGA"]
#: Fixed values of the score: of a base that nothing explains, least of a mismatch, and most that a quality adds to one.
PLAIN, MISMATCH, MOST = 6, 5, 25
#: Merged molecules that leave more than so many bases of a mate are trusted without the mates.
SPARE = 20


def paired(reads: DataFrame, order: list[str]) -> DataFrame:
    """(single, first, second): each read in one column as a struct; unpaired reads as `single`, the others by their name.

    A mate whose partner is absent, or that has no name, stands alone in its column.  Names that come several times are
    paired in `order`.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in reads.columns])
    is_pair, second = R.has_flag(F.col("flag"), "paired"), R.has_flag(F.col("flag"), "second_mate")
    marked = reads.select(row.alias("row"), F.col("qname").alias("_name"), second.alias("_second"), is_pair.alias("_pair"))
    w = Window.partitionBy("_name", "_second").orderBy(*[F.col(f"row.`{c}`") for c in order])
    both = marked.where("_pair and _name is not null").withColumn("_n", F.row_number().over(w))
    mates = both.groupBy("_name", "_n").agg(F.first(F.when(~F.col("_second"), F.col("row")), ignorenulls=True).alias("first"), F.first(F.when(F.col("_second"), F.col("row")), ignorenulls=True).alias("second"))
    none = lambda: F.lit(None).cast(marked.schema["row"].dataType)
    alone = marked.where("not coalesce(_pair, false)").select(F.col("row").alias("single"), none().alias("first"), none().alias("second"))
    nameless = marked.where("_pair and _name is null").select(none().alias("single"), F.when(~F.col("_second"), F.col("row")).alias("first"), F.when(F.col("_second"), F.col("row")).alias("second"))
    return alone.unionByName(nameless).unionByName(mates.select(none().alias("single"), "first", "second"))


def pair_filter(reads: DataFrame, single: Column, pair: Column, order: list[str]) -> DataFrame:
    """Reads that stay: unpaired ones where `single` holds, and both mates of a pair where `pair` holds.

    The conditions are on the structs `single`, `first` and `second`; of a lone mate the other struct is null.
    """
    kept = paired(reads, order).where(F.when(F.col("single").isNotNull(), single).otherwise(pair))
    return kept.select(F.explode(F.filter(F.array("single", "first", "second"), lambda x: x.isNotNull())).alias("row")).select("row.*")


def _codes(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)


_TURN = np.frombuffer(bytes(range(256)).translate(bytes.maketrans(R.BASES.encode(), R.COMPLEMENTS.encode())), np.uint8)


def _adapter_scores(seq: np.ndarray, qual: np.ndarray, adapters: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """For each molecule size, the score of the best adapter behind it and of what follows that."""
    if not adapters:
        return np.zeros(len(sizes), np.int64)
    best = None
    for ad in adapters:
        at = sizes[:, None] + np.arange(len(ad))
        inside = at < len(seq)
        at = np.where(inside, at, 0)
        worse = inside & (seq[at] != ad) if len(seq) else inside
        cost = (worse * (MISMATCH + np.minimum(qual, MOST))[at]).sum(axis=1) if len(seq) else np.zeros(len(sizes), np.int64)
        cost = cost + PLAIN * np.maximum(len(seq) - len(ad) - sizes, 0)
        best = cost if best is None else np.minimum(best, cost)
    return best


def _best(seq1, qual1, seq2, qual2, forward: list[np.ndarray], reverse: list[np.ndarray]) -> tuple[int, int, int]:
    one, two = _codes(seq1 or ""), _codes(seq2 or "")
    q1, q2 = (np.asarray(q if q is not None else [], np.int64) for q in (qual1, qual2))
    if len(one) != len(q1) or len(two) != len(q2):
        raise ValueError("bases and qualities of a read differ in number")
    n1, n2 = len(one), len(two)
    plain, sizes = PLAIN * (n1 + n2), np.arange(n1 + n2)
    if not len(sizes):
        return -1, 0, 0
    score = PLAIN * sizes + _adapter_scores(one, q1, forward, sizes)
    if n2:
        score = score + _adapter_scores(two, q2, reverse, sizes)
    if n1 and n2:
        at = np.arange(n1)
        back = sizes[:, None] - 1 - at
        inside = (back >= 0) & (back < n2)
        back = np.where(inside, back, 0)
        score = score + ((inside & (one != _TURN[two][back])) * (MISMATCH + np.minimum(q1, q2[back]))).sum(axis=1)
    least = int(score.argmin())
    if score[least] >= plain:
        return -1, int(score[least]) - plain, 0
    low = int(score[least])
    return least, int(min(plain, np.delete(score, least).min(initial=plain))) - low, plain - low


def insert_size(seq1: Column, qual1: Column, seq2: Column, qual2: Column, forward: list[str] = FORWARD, reverse: list[str] = REVERSE) -> Column:
    """Struct (size, ym, yn): the likeliest length of the molecule that both mates were read from, by what its score is
    better than that of the next length (ym) and than that of mates that do not overlap (yn).

    size is -1 where no length is better than no overlap.  A single read that may run into an adapter has an empty second
    mate.  Null reads are empty; bases and qualities of different numbers are an error.
    """
    ads = [_codes(a) for a in forward], [_codes(a) for a in reverse]

    @F.pandas_udf("size bigint, ym bigint, yn bigint")
    def best(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_best(*x, *ads) for x in zip(a, b, c, d)], columns=["size", "ym", "yn"])

    return best(seq1, qual1, seq2, qual2)


def merge_decision(size: Column, ym: Column, n1: Column, n2: Column, low: int, high: int, pair: Column | None = None) -> Column:
    """What becomes of a pair: none, mates, merged, or all (merged and mates, as alternatives); n2 is 0 for a single read.

    `pair` tells pairs from single reads where a second mate may be empty.
    """
    single = n2 == 0 if pair is None else ~pair
    short = ~single & ((size < n1 - SPARE) | (size < n2 - SPARE))
    rest = F.when((size == 0) & (ym >= high), "none").when((ym >= high) | short, "merged").otherwise("all")
    return F.when((n1 == 0) & (n2 == 0), "none").when((ym < low) | (size < 0), "mates").otherwise(rest)
