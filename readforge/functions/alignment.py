"""Alignment of two strings of bases by edits; ambiguity codes match where they share a base."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bases of each ambiguity code, as bits of A, C, G, T.
CODES = {"A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7, "T": 8, "U": 8, "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15}
#: Where gaps cost nothing: nowhere, behind the second string, behind the first.
MODES = ("global", "has_prefix", "is_prefix")


def _align(a: str, b: str, most: int, mode: str) -> tuple[int | None, str, str]:
    """Furthest places reached on each diagonal (place in a less place in b) with 0, 1, 2 ... edits, then the way back."""
    x, y = ([CODES.get(c, 0) for c in s.upper()] for s in (a, b))
    n, m = len(x), len(y)
    rounds: list[dict[int, int]] = []
    for d in range(max(most, 0)):
        last, now = rounds[-1] if rounds else {}, {}
        for k in range(-d, d + 1):
            # i: bases of a used; an edit takes one of a, one of b, or one of each
            i = 0 if not rounds and k == 0 else max(last.get(k, -2) + 1, last.get(k - 1, -2) + 1, last.get(k + 1, -1))
            i = min(i, n, m + k)
            if i < 0 or i < k:
                continue
            while i < n and i - k < m and x[i] & y[i - k]:
                i += 1
            now[k] = i
        rounds.append(now)
        ends = [(k, i) for k, i in now.items() if (i == n or mode == "has_prefix") and (i - k == m or mode == "is_prefix")]
        if ends:
            return d, *_way_back(a, b, rounds, *ends[0])
    return None, "", ""


def _way_back(a: str, b: str, rounds: list[dict[int, int]], k: int, i: int) -> tuple[str, str]:
    one, two = [a[i:]], [b[i - k :]]
    tail = max(len(one[0]), len(two[0]))
    one, two = [one[0].ljust(tail, "-")], [two[0].ljust(tail, "-")]
    for d in range(len(rounds) - 1, 0, -1):
        last = rounds[d - 1]
        start, before, step = max((last.get(k, -2) + 1, k, 0), (last.get(k - 1, -2) + 1, k - 1, 1), (last.get(k + 1, -1), k + 1, -1))
        start = min(start, i)
        one.append(a[start:i])
        two.append(b[start - k : i - k])
        i = start - (step >= 0)
        one.append("-" if step < 0 else a[i])
        two.append("-" if step > 0 else b[start - k - 1])
        k = before
    one.append(a[:i])
    two.append(b[:i])
    return "".join(reversed(one)), "".join(reversed(two))


def aligned(a: Column, b: Column, most: int, mode: str = "global") -> Column:
    """Struct (distance, a, b): gaps and mismatches, and both strings with dashes for gaps; distance is null, and the
    strings are empty, where it would not be less than `most` or a string is null.

    has_prefix: the second string is a prefix of the first; is_prefix: the other way round.  Work grows with the length
    times the distance.  X and letters that are no code match nothing.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")

    @F.pandas_udf("distance int, a string, b string")
    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = [(None, "", "") if s is None or t is None else _align(s, t, most, mode) for s, t in zip(left, right)]
        return pd.DataFrame(rows, columns=["distance", "a", "b"]).astype({"distance": "Int32"})

    return run(a, b)


def blocks(texts: Column, width: int) -> Column:
    """Aligned strings in lines of `width`, one below the other, each block with a line of stars where all agree and an
    empty line; texts is an array of strings of one length."""
    size = F.coalesce(F.array_max(F.transform(texts, F.length)), F.lit(0))
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))

    def block(at):
        parts = F.transform(texts, lambda t: F.substring(t, at + 1, F.lit(width)))
        places = F.sequence(F.lit(1), F.least(size - at, F.lit(width)))
        star = lambda p: F.when(F.size(F.array_distinct(F.filter(F.transform(parts, lambda t: F.substring(t, p, F.lit(1))), lambda c: c != ""))) <= 1, "*").otherwise(" ")
        return F.concat(parts, F.array(F.array_join(F.transform(places, star), ""), F.lit("")))

    return F.flatten(F.transform(starts, block))
