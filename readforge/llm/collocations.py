"""Phrase collocation mining by pivot partitioning.

Texts become blocks of word numbers with the dictionary of each block (`blocks`).  Words are counted per language and
numbered by falling frequency, and each block gets the numbers of its own words by a join, so no vocabulary is
broadcast.  At each word the text around it is rewritten to a fragment: the word is the fragment's pivot, up to three
words on each side follow, and the fragment ends at a rarer word (on the left also at the pivot itself, so that an
n-gram belongs to the leftmost of its rarest words).  Equal fragments of a block are merged, fragments are routed to
buckets by their pivot, and each bucket mines the n-grams that hold a pivot by itself.  A pivot with more fragments than
a share of a bucket is split, and what its buckets find is added up.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions
from .hashing import mix, prefix, spans

LONGEST, SUPPORT, LISTED = 4, 30, 2000
OVERLAP = 80
#: Bytes of text in a block, fragments in a bucket, and the fragments beyond which a pivot is split.
BLOCK_BYTES, BUCKET, SPLIT = 2_000_000, 500_000, 125_000
#: Numbers of words: none (the end of a piece), and a word that is too rare for any phrase.
GAP, RARE = -1, -2
_REACH = LONGEST - 1
_GAPS = np.zeros(256, np.uint8)
_GAPS[[0x20, 0x09]] = 1
_GAPS[[*b".,;:!?\n\x0b\x0c\r"]] = 2


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _cuts(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Stretches of about `size` bytes that end where pieces end; one that no piece ends in is longer."""
    ends = np.flatnonzero(_GAPS[data] == 2) + 1
    at = 0
    while at < len(data):
        i = int(np.searchsorted(ends, at + size))
        to = int(ends[i]) if i < len(ends) else len(data)
        yield data[at:to]
        at = to


def _same(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> bool:
    """Whether each data[start:end] equals data[other:other_end], byte by byte."""
    n = end - start
    if not np.array_equal(n, other_end - other):
        return False
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return bool(np.array_equal(data[np.repeat(start, n) + inner], data[np.repeat(other, n) + inner]))


def _number_words(data: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word numbers in order with GAP between pieces, the words by number, and their counts.  data is already lower-case."""
    kind = _GAPS[data]
    edge = np.diff(np.concatenate([[True], kind > 0, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.int32), [], np.zeros(0, np.int64)
    _, first, number, count = np.unique(spans(prefix(data), start, end), return_index=True, return_inverse=True, return_counts=True)
    if not _same(data, start, end, start[first][number], end[first][number]):  # two words share a hash: number the texts themselves
        texts = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist())]
        _, first, number, count = np.unique(np.array(texts, object), return_index=True, return_inverse=True, return_counts=True)
    words = [data[a:b].tobytes().decode() for a, b in zip(start[first].tolist(), end[first].tolist())]
    breaks = np.cumsum(kind == 2)
    new = np.flatnonzero(np.diff(breaks[start])) + 1
    return np.insert(number.astype(np.int32), new, GAP), words, count


def blocks(docs: DataFrame, lang: str, text: str, size: int) -> DataFrame:
    """(lang, block, ids, words, counts): the texts of one language in blocks; ids are packed numbers into words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[bytes]] = {}
        sizes: Counter = Counter()

        def flush(name: str) -> pd.DataFrame:
            data = np.frombuffer(b"\n".join(held.pop(name)), np.uint8)
            sizes.pop(name)
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
            rows = []
            for own in _cuts(data, size):
                ids, words, counts = _number_words(own)
                if words:
                    rows.append({"lang": name, "ids": _pack(ids), "words": words, "counts": counts})
            return pd.DataFrame(rows, columns=["lang", "ids", "words", "counts"])

        for batch in batches:
            for name, t in zip(batch["lang"], batch["text"]):
                held.setdefault(name, []).append(t.encode())
                sizes[name] += len(held[name][-1]) + 1
                if sizes[name] >= size:
                    yield flush(name)
                if sizes.total() >= 4 * size:
                    yield flush(max(sizes, key=sizes.get))
        for name in list(held):
            yield flush(name)

    side = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = side.mapInPandas(run, "lang string, ids binary, words array<string>, counts array<bigint>")
    return rows.withColumn("block", F.monotonically_increasing_id())


def vocabulary(found: DataFrame, support: int) -> DataFrame:
    """(lang, word, f, id) of the words with that many occurrences; a smaller id is at least as frequent.  Ids are dense."""
    words = found.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    ordered = words.where(F.col("f") >= support).orderBy(F.desc("f"), "word", "lang").withColumn("at", F.monotonically_increasing_id())
    ordered = materialize(ordered, "collocation-words")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["count"] for r in ordered.groupBy(part.alias("p")).count().collect()}  # one row for each partition
    before = np.cumsum([0, *[sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)]]).tolist()
    offsets = F.array(*[F.lit(v).cast("long") for v in before])
    return ordered.select("lang", "word", "f", (F.get(offsets, part.cast("int")) + place).alias("id"))


def _windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fragment of a run of ids: the pivot, the words to the left (nearest first) and to the right, GAP beyond its ends.

    A smaller id is more frequent.  Left of the pivot only smaller ids stand, right of it also the pivot's own.
    """
    padded = np.concatenate([np.full(_REACH, GAP, ids.dtype), ids, np.full(_REACH, GAP, ids.dtype)])
    n = len(ids)
    left, right = np.full((_REACH, n), GAP, ids.dtype), np.full((_REACH, n), GAP, ids.dtype)
    go_left, go_right = ids >= 0, ids >= 0
    for j in range(_REACH):
        x, y = padded[_REACH - 1 - j : _REACH - 1 - j + n], padded[_REACH + 1 + j : _REACH + 1 + j + n]
        go_left, go_right = go_left & (x >= 0) & (x < ids), go_right & (y >= 0) & (y <= ids)
        left[j, go_left], right[j, go_right] = x[go_left], y[go_right]
    some = (left[0] >= 0) | (right[0] >= 0)
    return ids[some], left[:, some], right[:, some]


def _tallied(columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal columns of a matrix: the place of the first, each one's class, and the summed counts of a class."""
    key = np.zeros(columns.shape[1], np.uint64)
    for row in columns:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64) + np.uint64(1))
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    if not all(np.array_equal(row[first][group], row) for row in columns):  # two fragments share a hash
        _, first, group = np.unique(columns, axis=1, return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, group, counts)
    return first, group, total


def fragments(found: DataFrame, words: DataFrame, buckets: int, split: int) -> DataFrame:
    """(bucket, rows): packed fragments with their counts, routed by pivot; equal ones of a block are merged."""
    # Each block meets the ids of its own words: `at` is a word's number in the block.
    own = found.select("block", "lang", F.posexplode("words").alias("at", "word"))
    own = own.join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("at", "id", "f")).alias("known"))
    rows = found.select("block", "ids", F.size("words").alias("n")).join(own, "block")
    rows = rows.select("ids", "n", F.transform("known", lambda k: k["at"]).alias("at"), F.transform("known", lambda k: k["id"]).alias("id"), F.transform("known", lambda k: k["f"]).alias("f"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, n, at, name, f in chain.from_iterable(zip(b["ids"], b["n"], b["at"], b["id"], b["f"]) for b in batches):
            table = np.full(n + 1, RARE, np.int32 if max(name) < 1 << 31 else np.int64)
            table[np.array(at)] = name
            table[-1] = GAP
            pivot, left, right = _windows(table[_unpack(ids, np.int32)])
            if not len(pivot):
                continue
            every = np.vstack([pivot[None], left, right])
            del left, right
            first, _, count = _tallied(every, np.ones(len(pivot), np.int64))
            every = every[:, first].astype(np.int64)
            order = np.argsort(every[0], kind="stable")
            every, count = every[:, order], count[order]
            known = np.argsort(np.array(name))
            f_of = np.array(f)[known][np.searchsorted(np.array(name)[known], every[0])]
            shares = (f_of - 1) // split + 1
            salt = np.where(shares > 1, mix(every[1:].astype(np.uint64).sum(axis=0) * np.uint64(0x9E3779B97F4A7C15)) % shares.astype(np.uint64), np.uint64(0))
            bucket = (mix(every[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
            whole = shares == 1
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                i = order[a:b]
                out.append((int(bucket[i[0]]), _pack(np.vstack([every[:, i], count[i], whole[i]]).astype(np.int64))))
            yield pd.DataFrame(out, columns=["bucket", "rows"])

    return rows.mapInPandas(run, "bucket long, rows binary")


def _mine(every: np.ndarray, support: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n-grams as columns, counts, whole): those that hold the pivot of a fragment, of 2 to LONGEST words.

    An n-gram has a words left of the pivot and b right of it; it can only be frequent where those with one word less
    are.  Counts of pivots that are not whole here are parts, so these are all given.
    """
    pivot, left, right, count, whole = every[0], every[1 : 1 + _REACH], every[1 + _REACH : 1 + 2 * _REACH], every[-2], every[-1] > 0
    alive = {(0, 0): np.ones(len(pivot), bool)}
    for length in range(2, LONGEST + 1):
        for a in range(length):
            b = length - 1 - a
            some = np.ones(len(pivot), bool)
            if a:
                some &= alive[a - 1, b] & (left[a - 1] >= 0)
            if b:
                some &= alive[a, b - 1] & (right[b - 1] >= 0)
            at = np.flatnonzero(some)
            grams = np.vstack([left[:a, at][::-1], pivot[None, at], right[:b, at]])
            if len(at):
                first, group, total = _tallied(grams, count[at])
                keep = (total >= support) | ~whole[at][first]
                some[at] = keep[group]
                yield grams[:, first[keep]], total[keep], whole[at][first[keep]]
            alive[a, b] = some


def mined(packed: DataFrame, support: int) -> DataFrame:
    """(ids, f): every n-gram of two words or more that occurs at least `support` times."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        every = np.concatenate([_unpack(x, np.int64).reshape(2 * _REACH + 3, -1) for x in group["rows"]], axis=1)
        first, _, total = _tallied(np.vstack([every[: 2 * _REACH + 1], every[-1:]]), every[-2])
        every = every[:, first]
        every[-2] = total
        out = [pd.DataFrame({"ids": pd.Series(list(g.T), dtype=object), "f": n, "whole": w}) for g, n, w in _mine(every, support)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"ids": pd.Series([], dtype=object), "f": np.zeros(0, np.int64), "whole": np.zeros(0, bool)})

    found = packed.groupBy("bucket").applyInPandas(run, "ids array<long>, f long, whole boolean")
    return found.groupBy("ids").agg(F.sum("f").alias("f")).where(F.col("f") >= support)


def _best(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows of each language by score, a and phrase, with their rank; found in shares first, so no task sorts a language."""
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(rows.sparkSession)))
    few = rows.withColumn("_share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*by))).where(F.col("rank") <= limit)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= limit).drop("_share")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", support: int = SUPPORT, listed: int = LISTED, overlap: int = OVERLAP,
    block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET, split: int = SPLIT,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `listed` best phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and LF to CR, and pieces into words at spaces and tabs.
    A phrase has 2 to 4 words of one piece and a >= support occurrences (overlapping ones count).  Its score is the least
    over its cuts of floor(2000000 a / (l + r)), l and r being the occurrences of the two sides; at a tie the first cut
    counts.  A phrase goes if a longer candidate that holds it has `overlap` percent of its occurrences or more.

    A null text is empty, a null lang is `und`; each row counts, repeated ones too; an empty table gives no rows.  Texts
    are cut into blocks where pieces end, so long ones do not need more memory (a single piece is never cut).  Every
    count is exact: hashes only group, and groups are compared as bytes.  Columns but lang and text are not read.
    """
    found = materialize(blocks(docs, lang, text, block_bytes), "collocation-blocks")
    totals = found.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    words = materialize(vocabulary(found, support), "collocation-ids")
    size = words.agg(F.sum("f")).first()[0] or 0
    packed = fragments(found, words, max(1, math.ceil(size / bucket)), split)
    grams = materialize(mined(packed, support), "collocation-grams")

    counts = grams.union(words.select(F.array("id").alias("ids"), "f"))
    cut = grams.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("x"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("y"))
    cut = cut.join(counts.select(F.col("ids").alias("x"), F.col("f").alias("l")), "x").join(counts.select(F.col("ids").alias("y"), F.col("f").alias("r")), "y")
    score = F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    least = cut.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))

    inner = grams.where(F.size("ids") > 2).select("ids", "f", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("w"))
    inner = inner.select("ids", "f", "w", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("w") + 1)).alias("at"))
    inner = inner.groupBy(F.slice("ids", F.col("at"), F.col("w")).alias("ids")).agg(F.max("f").alias("longer"))
    over = F.expr(f"cast(longer as decimal(19,0)) * 100 >= cast(a as decimal(19,0)) * {overlap}")
    kept = least.join(inner, "ids", "left").where(~F.coalesce(over, F.lit(False))).select("ids", "a", "m.*")

    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word", "lang"), "id")
    spelled = spelled.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"), F.min("lang").alias("lang"))
    best = _best(kept.join(spelled, "ids").select("lang", "phrase", "a", "l", "r", "score"), listed)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
