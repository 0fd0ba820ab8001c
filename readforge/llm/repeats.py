"""Exact repeats: removes each byte covered by a string of `length` bytes that also starts anywhere else.

Every window of `length` bytes has an anchor, its leftmost least gram of GRAM bytes; equal windows have equal anchors at
equal places.  A run is the windows that follow each other and share an anchor.  Equal runs, told by one hash, repeat as
a whole; only for runs that share an anchor gram but differ somewhere are the hashes of single windows compared, in
buckets of a fixed size.  So the corpus is matched without a suffix array: a column-wise construction would need as many
rounds over the corpus as the longest text has bytes.

Texts meet their runs and their spans by two shuffles, compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_task, materialize, row_key, shuffle_partitions, unzipped, zipped
from .hashing import batches_of, mix, prefix, spans

LENGTH, GRAM = 400, 160
#: For a stage that cuts passages of about fifty words and more: fifty short words have some 250 bytes.
PASSAGE, PASSAGE_GRAM = 250, 100
#: Window hashes that a task sends together, those of a bucket (a task holds one bucket at a time, whole), and most tasks.
FLUSH_WINDOWS, BUCKET_WINDOWS, MOST_TASKS = 250_000, 500_000, 20_000
#: Longer texts are taken in overlapping parts of so many bytes, so that an anchor's place fits the low bits.
PART = 1 << 22
_LOW = np.uint64((1 << 24) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, from block-wise running minima."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: bytes, length: int, gram: int) -> list[np.ndarray]:
    """first window, number of windows, gram hash and hash of the whole stretch, for each run of windows of a text."""
    out = []
    for at in range(0, max(len(data) - length + 1, 0), PART - length + 1):
        part = np.frombuffer(data, np.uint8, offset=at, count=min(PART, len(data) - at))
        sums = prefix(part)
        n = len(part) - gram + 1
        grams = spans(sums, np.arange(n), np.arange(gram, gram + n))
        low = sliding_min((grams & ~_LOW) | np.arange(n, dtype=np.uint64), length - gram + 1)
        start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        count = np.diff(np.append(start, len(low)))
        anchor = (low[start] & _LOW).astype(np.int64)
        stretch = spans(sums, start, start + count + length - 1)
        # the stretch and the place of its anchor together tell a run
        whole = stretch ^ spans(sums, anchor, anchor + gram) * np.uint64(3) ^ (anchor - start).astype(np.uint64) << np.uint64(32) ^ count.astype(np.uint64)
        out.append(np.stack([start + at, count, grams[anchor].view(np.int64), whole.view(np.int64)], axis=1))
    return out


def repeated(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """_key, spans ([from, to, from, to ...], sorted, disjoint, of repeated bytes) of each row key of docs (_key, _t) that has any."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, texts = batch["_key"].to_numpy(), batch["_t"].tolist()
            for i, j in batches_of(texts):
                found = [(np.full(len(r), keys[k]), r) for k in range(i, j) for r in runs_of(texts[k], length, gram)]
                if found:
                    r = np.concatenate([x for _, x in found])
                    yield pd.DataFrame({"_key": np.concatenate([k for k, _ in found]), "start": r[:, 0], "count": r[:, 1], "gram": r[:, 2], "whole": r[:, 3]})

    runs = docs.select("_key", F.col("_t").cast("binary")).mapInPandas(find, "_key bigint, start bigint, count bigint, gram bigint, whole bigint")
    # written, so that the join below reads it from a shuffle of its own and a gram of very many runs is split
    grams = materialize(runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "repeat-grams")
    runs = materialize(runs.join(grams, "gram"), "repeat-runs")
    classes = runs.groupBy("gram", "whole").agg(F.count("*").alias("times"), F.min(F.struct("_key", "start", "count")).alias("one"))
    kinds = classes.groupBy("gram").agg(F.count("*").alias("kinds"))
    classes = materialize(classes.join(kinds, "gram").select("whole", "times", "kinds", "one.*"), "repeat-classes")
    # runs that differ though their anchors are equal: compare their windows, one example of each
    asked = classes.where("kinds > 1").groupBy("_key").agg(F.collect_list(F.struct("start", "count", "whole")).alias("asked"))
    partial = _hits(zipped(docs).join(asked, "_key"), length, int(classes.where("kinds > 1").agg(F.sum("count")).first()[0] or 0))
    known = classes.select("whole", (F.col("times") > 1).alias("full")).join(partial, "whole", "left").where("full or hits is not null")
    out = runs.select("_key", "start", "count", "whole").join(known, "whole").select("_key", F.struct("start", "count", "full", "hits").alias("r"))
    out = out.groupBy("_key").agg(F.collect_set("r").alias("runs")).select("_key", *[F.col(f"runs.{c}").alias(c) for c in ("start", "count", "full", "hits")])
    return out.mapInPandas(lambda b: _merge(b, length), "_key bigint, spans array<bigint>")


def repeated_in(docs: DataFrame, found: DataFrame, length: int, gram: int) -> DataFrame:
    """`repeated`, sought only in found: what `repeated` tells of the same docs for shorter strings.

    A string that starts twice has all its parts twice, so each of its places lies within one span of found.  Those spans
    are matched as texts of their own, mostly a small part of the corpus.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, z, spans_ in zip(batch["_key"].tolist(), batch["_z"], batch["spans"]):
                long = [(a, b) for a, b in zip(spans_[::2].tolist(), spans_[1::2].tolist()) if b - a >= length]
                if long:
                    data = next(unzipped([z]))
                    rows.extend((key, a, data[a:b]) for a, b in long)
            yield pd.DataFrame(rows, columns=["_of", "at", "_t"])

    pieces = zipped(docs).join(found, "_key").mapInPandas(cut, "_of bigint, at bigint, _t binary")
    pieces = materialize(pieces.withColumn("_key", row_key(F.col("_of"), F.col("at"))), "repeat-pieces")
    places = pieces.select("_key", "_of", "at").distinct()
    moved = repeated(pieces.select("_key", "_t"), length, gram).join(places, "_key").select("_of", "at", F.transform("spans", lambda x: x + F.col("at")).alias("own"))
    whole = moved.groupBy("_of").agg(F.array_sort(F.collect_list(F.struct("at", "own"))).alias("all"))
    return whole.select(F.col("_of").alias("_key"), F.flatten("all.own").alias("spans"))


def twice(prints: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted and without repeats: hashes, runs, places, and whether the hash stands more than once."""
    order = np.lexsort((at, of, prints))
    prints, of, at = prints[order], of[order], at[order]
    new = np.concatenate([[True], (prints[1:] != prints[:-1]) | (of[1:] != of[:-1]) | (at[1:] != at[:-1])])[: len(prints)]
    if not new.all():
        prints, of, at = prints[new], of[new], at[new]
    edge = np.concatenate([[True], prints[1:] != prints[:-1], [True]])
    # alone is what differs from both neighbours
    return prints, of, at, ~(edge[:-1] & edge[1:])[: len(prints)]


def by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one bucket after another, also where batches part them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for bucket, part in batch.groupby("bucket"):
            if held and held[0]["bucket"].iloc[0] != bucket:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _hits(texts: DataFrame, length: int, windows: int) -> DataFrame:
    """whole, hits: the windows (sorted places in the run, two bytes each) that also start elsewhere.

    texts has _key, _z and asked, the runs to compare.  A task sends each window hash once for each flush, and decides
    itself on those that it holds twice, so a window that very many runs share does not gather in its bucket.
    """
    spark = texts.sparkSession
    buckets = max(shuffle_partitions(spark), -(-windows // BUCKET_WINDOWS))

    def dealt(key: np.ndarray, *columns: np.ndarray) -> list[tuple]:
        """A row for each bucket that the hashes of key fall in: its number and the bytes of each column."""
        to = ((mix(key.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, columns = to[order], [c[order] for c in columns]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() if len(to) else []
        return [(int(to[i]), *[c[i:j].tobytes() for c in columns]) for i, j in zip(first, [*first[1:], len(to)])]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n, turn = [], 0, 0

        def flush() -> pd.DataFrame:
            prints, of, at, many = twice(*(np.concatenate(x) for x in zip(*found)))
            hit = dealt(of[many], of[many], at[many])
            one = np.concatenate([[True], prints[1:] != prints[:-1]])
            rows = dealt(prints[one], prints[one], of[one], at[one])
            # what is settled already goes along with any bucket
            rows.extend(((turn + k) % buckets, b"", *x[1:]) for k, x in enumerate(hit))
            return pd.DataFrame(rows, columns=["bucket", "prints", "of", "at"])

        for batch in batches:
            seen = set()
            for key, text, asked in zip(batch["_key"], unzipped(batch["_z"]), batch["asked"]):
                if key in seen:
                    continue
                seen.add(key)
                sums = prefix(np.frombuffer(text, np.uint8))
                for r in asked:
                    for k in range(0, r["count"], 1 << 16):  # a run is at most length - gram + 1 windows long, unless parameters say otherwise
                        at = np.arange(k, min(r["count"], k + (1 << 16)))
                        found.append((spans(sums, at + r["start"], at + r["start"] + length).view(np.int64), np.full(len(at), r["whole"], np.int64), at.astype(np.uint16)))
                        n += len(at)
                if n >= FLUSH_WINDOWS:
                    yield flush()
                    found, n, turn = [], 0, turn + 1
        if found:
            yield flush()

    joined = lambda column, kind: np.frombuffer(b"".join(column), kind)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in by_bucket(batches):
            done = rows["prints"].map(len) == 0
            known, open_ = rows[done], rows[~done]
            _, of, at, many = twice(joined(open_["prints"], np.int64), joined(open_["of"], np.int64), joined(open_["at"], np.uint16))
            of, at = np.concatenate([joined(known["of"], np.int64), of[many]]), np.concatenate([joined(known["at"], np.uint16), at[many]])
            yield pd.DataFrame(dealt(of, of, at), columns=["bucket", "of", "at"])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in by_bucket(batches):
            of, at = joined(rows["of"], np.int64), joined(rows["at"], np.uint16)
            order = np.lexsort((at, of))
            of, at = of[order], at[order]
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1])])[: len(of)]
            of, at = of[new], at[new]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist()
            yield pd.DataFrame([(int(of[i]), at[i:j].tobytes()) for i, j in zip(first, [*first[1:], len(of)])], columns=["whole", "hits"])

    packed = by_task(texts.mapInPandas(pack, "bucket bigint, prints binary, of binary, at binary"), buckets, MOST_TASKS)
    return by_task(packed.mapInPandas(meet, "bucket bigint, of binary, at binary"), buckets, MOST_TASKS).mapInPandas(gather, "whole bigint, hits binary")


def _merge(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Repeated windows of a document, as runs → the bytes they cover, as disjoint spans."""
    for batch in batches:
        out = []
        for runs in zip(batch["start"], batch["count"], batch["full"], batch["hits"]):
            spans_ = []
            for start, count, full, hits in zip(runs[0].tolist(), runs[1].tolist(), *runs[2:]):
                if full:
                    spans_.append((start, start + count - 1 + length))
                else:
                    at = np.frombuffer(hits, np.uint16).astype(np.int64) + start
                    cut = np.flatnonzero(np.diff(at) > length)
                    spans_.extend(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + length).tolist()))
            spans_.sort()
            joined = []
            for a, b in spans_:
                if joined and a <= joined[-1]:
                    joined[-1] = max(joined[-1], b)
                else:
                    joined += [a, b]
            out.append(joined)
        yield pd.DataFrame({"_key": batch["_key"], "spans": out})


def _kept(data: bytes, found) -> bytes:
    if found is None:
        return data
    edges = [0, *found, len(data)]
    return b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, outputs: tuple[str, ...] = ("spans", "kept"), passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans and, as asked for by `outputs`: spans (from, to),
    kept (binary), kept_sha256 (lowercase hex), text (kept as text, without characters that are cut in two), key,
    n_in_passages (bytes that strings of `passage` bytes cover which start twice), without_passages (text without those).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same document or another;
    texts are UTF-8, judged as they came in, and matches never cross documents.  Null texts are empty; texts shorter than
    `length` lose nothing; a row that is repeated loses all that windows cover, in each copy.  An empty table gives an
    empty result.  Other columns are not read.  Windows are compared by 64-bit hashes.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    side = docs.select(F.col(doc_id).cast("string").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"), row_key(F.col(doc_id), F.col(text)).alias("_key"))
    texts = side.select("_key", "_t")
    if any(o in outputs for o in ("n_in_passages", "without_passages")):
        if passage > length:
            raise ValueError("passages must not be longer than the strings that are removed")
        passages = materialize(repeated(texts, passage, passage_gram), "repeat-passages")
        spans_ = passages.select("_key", F.col("spans").alias("passages")).join(repeated_in(texts, passages, length, gram), "_key", "left")
    else:
        spans_ = repeated(texts, length, gram).withColumn("passages", F.lit(None).cast("array<bigint>"))
    spans_ = materialize(spans_, "repeat-spans")
    kinds = {"spans": "array<struct<from:bigint,to:bigint>>", "kept": "binary", "kept_sha256": "string", "text": "string", "key": "bigint", "n_in_passages": "bigint", "without_passages": "string"}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data, found, passages, key in zip(unzipped(batch["_z"]), batch["spans"], batch["passages"], batch["_key"]):
                kept = _kept(data, found)
                made = {"kept": kept, "key": key}
                if "spans" in outputs:
                    made["spans"] = [] if found is None else [{"from": a, "to": b} for a, b in zip(found[::2], found[1::2])]
                if "kept_sha256" in outputs:
                    made["kept_sha256"] = hashlib.sha256(kept).hexdigest()
                if "text" in outputs:
                    made["text"] = kept.decode("utf-8", "ignore")
                if "n_in_passages" in outputs:
                    made["n_in_passages"] = 0 if passages is None else int(sum(passages[1::2]) - sum(passages[::2]))
                if "without_passages" in outputs:
                    made["without_passages"] = _kept(data, passages).decode("utf-8", "ignore")
                rows.append((len(data), len(data) - len(kept), 0 if found is None else len(found) // 2, *[made[k] for k in outputs]))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", *outputs])
            out.insert(0, "doc_id", batch["_id"].to_numpy())
            yield out

    schema = ", ".join(["doc_id string", "n_bytes bigint", "n_removed bigint", "n_spans bigint", *[f"{k} {kinds[k]}" for k in outputs]])
    return zipped(side).join(spans_, "_key", "left").mapInPandas(cut, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def without_repeats(docs: DataFrame, length: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """docs, all columns and rows, with the repeated bytes removed from text and n_chars, where there is one, counted anew.

    Bytes of a character that is cut in two are dropped.  Null texts stay null and keep their n_chars; empty texts and
    those shorter than `length` stay as they are; of repeated rows each loses what repeats; an empty table stays empty.
    """
    # the row travels in one column, so its names meet none of these
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    spans_ = materialize(repeated(keyed.select("_key", F.coalesce(F.col("row.text"), F.lit("")).alias("_t")), length, gram), "repeat-spans")

    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or f is None else _kept(t.encode("utf-8", "surrogatepass"), f).decode("utf-8", "ignore") for t, f in zip(text, found)], dtype=object)

    out = keyed.join(spans_, "_key", "left").select("row", cut("row.text", "spans").alias("_text"))
    n_chars = lambda kind: F.when(F.col("_text").isNotNull(), F.length("_text").cast(kind)).otherwise(F.col("row.n_chars"))
    new = {"text": lambda f: F.col("_text"), "n_chars": lambda f: n_chars(f.dataType)}
    return out.select(*[new.get(f.name, lambda f: F.col(f"row.`{f.name}`"))(f).alias(f.name) for f in docs.schema.fields])
