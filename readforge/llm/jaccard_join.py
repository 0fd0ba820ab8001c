"""N-gram Jaccard join by parity sketches.

A set of shingle hashes is cut into pieces by hash; a piece's sketch is the XOR of its hashes, so a token that only one of
two sets has changes one piece at most.  Sets with Jaccard 0.8 or more differ in at most (a + b) / 9 tokens, so in their
size band at most `apart` of the pieces differ.  Put in one global order, rarest first, the first `apart` + 1 pieces of
both therefore hold a common one: only those are joined.  There are about twice as many pieces as `apart`, so a passage
that many texts share makes no candidates unless it fills about half of a text.

Sets that share such a piece are a run.  Links are first sought from one leader of each run.  Where a run's members then
still lie in different components, they are compared in blocks by sketches of parity bits, whose Hamming distance is a
lower bound of the symmetric difference; only the few pairs that it allows leave the task, and the whole sets decide.  So
a group of copies costs one comparison for each member and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, bounded, by_task, materialize, row_name, shuffle_partitions, small_enough, unzipped, zipped
from .components import components
from .hashing import batches_of, mix, word_shingles

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Pieces for each one that may differ; parity bits for each token.
PIECES, BITS = 2, 4
#: Members of a block; ids that are broadcast (8 bytes each).
BLOCK, BROADCAST_ROWS = 1024, 300_000
#: Keys of a task that are written out together, keys of a bucket, and most tasks that buckets are dealt to.
FLUSH_KEYS, BUCKET_KEYS, MOST_TASKS = 500_000, 1_000_000, 20_000
#: Sets that are numbered together, in 16 bits.
FLUSH_SETS = 1 << 16
#: Sets that a task remembers, so as to send each once.
SEEN_SETS = 500_000
#: Marks the band of a set of which two keys fall together.
ODD = 128


def most_apart(a, b):
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def _bands(top: int) -> list[int]:
    """Lower ends of the size bands: each at least 5/4 of the one before, so linked sets lie in one band or two neighbours."""
    low = [1]
    while low[-1] <= top:
        low.append(max(low[-1] + 1, -(-low[-1] * 100 // PERCENT)))
    return low


BANDS = np.array(_bands(1 << 40))


def band_of(n) -> np.ndarray:
    """The size band of sets of n tokens."""
    return np.searchsorted(BANDS, n, side="right") - 1


def scheme(band, parity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """band, most pieces that differ, and number of pieces, in that of a set's two bands which is odd or even.

    A set lies in its own band and, as the larger of a pair, in the band below; one of the two is odd and one is even.
    """
    band = np.where(band & 1 == parity, band, band - 1)
    most = BANDS[band + 1] - 1
    apart = most_apart(most, most * 100 // PERCENT)
    return band, apart, PIECES * apart + 1 + apart // 32


def piece_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set, one for each piece in each of its bands; the lowest bit tells which band it is."""
    own, out, mixed = band_of(len(hashes)), [], mix(hashes)
    for parity in (0, 1):
        band, _, m = (int(x) for x in scheme(own, parity))
        if band < 0:
            continue
        piece = ((hashes >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        value = np.zeros(m, np.uint64)
        np.bitwise_xor.at(value, piece.astype(np.int64), mixed)
        key = mix(value ^ mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32)))
        out.append(key >> np.uint64(1) << np.uint64(1) | np.uint64(parity))
    return np.concatenate(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the hashes in about BITS times as many bits as there are hashes, a power of two from 64 up, in 64-bit words."""
    bits = max(64, 1 << round(float(np.log2(len(hashes) * BITS))))
    flips = np.bincount((mix(hashes ^ np.uint64(0x5BD1E995)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _folded(sketches: list[np.ndarray], words: int) -> np.ndarray:
    """Sketches as rows, each folded by XOR to so many words; the fold is the sketch of so many bits.  Shorter ones are zero."""
    out = np.zeros((len(sketches), words), np.uint64)  # bits of signed numbers are counted without their sign
    for i, x in enumerate(sketches):
        while len(x) > words:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        if len(x) == words:
            out[i] = x.view(np.uint64)
    return out


def flips(a: Column, b: Column) -> Column:
    """Bits in which sketches of sets differ of which none has twice the size of the other; the longer is folded to the shorter."""

    def folded(s: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(s) > half, F.zip_with(F.slice(s, 1, half), F.slice(s, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(s)

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def _set_id(hashes: np.ndarray) -> int:
    total = int(np.bitwise_xor.reduce(mix(hashes))) + 3 * int(hashes.sum()) + len(hashes)
    return int(mix(np.array([total & (1 << 64) - 1], np.uint64)).view(np.int64)[0])


def _sets(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    # bytes: text would be held twice more, decoded and encoded again
    texts = batch["_t"].tolist()
    for i, j in batches_of(texts):
        yield from enumerate(word_shingles(texts[i:j], SHINGLE), i)


def _profiles(docs: DataFrame) -> DataFrame:
    """_key, _id, n, set (an id of the shingle set; null if empty) and sketch of each row."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(len(h), _set_id(h) if len(h) else None, sketch(h) if len(h) else None) for _, h in _sets(batch)]
            # as objects: a column of numbers and nulls would become floats and lose digits
            out = pd.DataFrame(rows, columns=["n", "set", "sketch"], dtype=object)
            out["_key"], out["_id"] = batch["_key"].to_numpy(), batch["_id"].to_numpy()
            yield out

    side = docs.withColumn("_id", F.col("_id").cast("string"))
    return side.mapInPandas(run, "n bigint, set bigint, sketch array<bigint>, _key string, _id string").withColumn("_id", F.col("_id").cast(kind))


def _grouped_rows(batches: Iterator[pd.DataFrame], col: str) -> Iterator[tuple[int, pd.DataFrame]]:
    """Neighbouring rows with one value of col, also where batches part them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        v = batch[col].to_numpy()
        at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])).tolist() if len(v) else []
        for i, j in zip(at, [*at[1:], len(v)]):
            part = batch.iloc[i:j]
            if held and held[0][col].iloc[0] != part[col].iloc[0]:
                yield int(held[0][col].iloc[0]), pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield int(held[0][col].iloc[0]), pd.concat(held, ignore_index=True)


def steps(numbers: np.ndarray) -> bytes:
    """Numbers from 0 to 65,535 that never fall, as the step to each from the one before: a byte each, or two where one is larger."""
    step = np.diff(numbers, prepend=0)
    return step.astype(np.uint8 if step.max() < 256 else np.uint16).tobytes()


def numbers_of(step: bytes, n: int) -> np.ndarray:
    """The n numbers of `steps`."""
    return np.cumsum(np.frombuffer(step, np.uint8 if len(step) == n else np.uint16), dtype=np.int64)


def _whole(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def in_several(key: np.ndarray, sets: np.ndarray, bands: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, set, band and number of sets of each key that several sets have, once for each of its sets.

    sets and bands stand once for `times` keys.  Only the order of the whole bucket is held in full; what a key alone has
    goes before sets are spelled out for each key.
    """
    of = np.repeat(np.arange(len(sets), dtype=np.uint32), times)
    order = np.argsort(key, kind="stable")
    key, of = key[order], of[order]
    del order
    edge = np.concatenate([[True], key[1:] != key[:-1], [True]])
    some = ~(edge[:-1] & edge[1:])[: len(key)]
    key, of = key[some], of[some]
    own, band = sets[of], bands[of]
    order = np.lexsort((own, key))
    key, own, band = key[order], own[order], band[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])[: len(key)]
    key, own, band = key[new], own[new], band[new]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    many = np.diff(np.append(at, len(key)))
    many = np.repeat(many.astype(np.int32), many)
    return key[many > 1], own[many > 1], band[many > 1], many[many > 1]


def _once(docs: DataFrame, rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, bool]:
    """_t of one row of docs (_key, _t) for each set, and whether some stand more than once: those of whole rows that are repeated."""
    copied = bounded(sets.where("copies > 1").select("set", F.col("_key").alias("_first")), BROADCAST_ROWS)
    at = F.xxhash64("_key").alias("_at")
    found = rows.select("set", "_key").join(copied, "set").groupBy(at, (F.col("_key") == F.col("_first")).alias("first")).agg(F.count("*").alias("n"))
    found = materialize(found, "jaccard-copies")
    more = found.where("not first").select("_at")
    if small_enough(more, BROADCAST_ROWS):
        one = docs.select(at, "_t").join(F.broadcast(more), "_at", "left_anti")
    else:

        @F.pandas_udf("binary")
        def unpack(z: pd.Series) -> pd.Series:
            return pd.Series(list(unzipped(z)), dtype=object)

        one = zipped(docs.select(at, "_t")).join(more, "_at", "left_anti").select(unpack("_z").alias("_t"))
    return one.select("_t"), found.where("first and n > 1").limit(1).count() > 0


def _index(docs: DataFrame, keys: int, again: bool = False) -> DataFrame:
    """(run, set) for the rarest keys of each set, of those that it shares with another; `keys` is about their number in all.

    docs has one row for each set, or, as `again` tells, more for some.  A task cuts its sets into flushes of at most
    FLUSH_KEYS keys, and numbers the sets of each.  It sends the keys of each bucket together (4 bytes a key, and its set's
    number as a step of mostly one byte, however many buckets there are); a bucket counts the sets of its keys and sends
    what is shared back, to where the flush's ids and bands are, once for each set, and its keys are put in order.
    Buckets are of a fixed size and are taken one after the other from sorted partitions.
    """
    spark = docs.sparkSession
    buckets = max(shuffle_partitions(spark), -(-keys // BUCKET_KEYS))
    room = np.uint64(buckets)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, sets, bands, counts, seen, turn = [], [], [], [], set(), 0

        def flush() -> pd.DataFrame:
            key, own = np.concatenate(found), np.repeat(np.arange(len(sets)), counts)
            ids, band = np.array(sets, np.int64), np.array(bands, np.uint8)
            # named by its task and what it holds: if a task runs again over other rows, nothing is taken for what it was before
            place = np.array([TaskContext.get().partitionId(), turn], np.uint64)
            name = _set_id(mix(np.concatenate([place, ids.view(np.uint64)]) + np.arange(len(ids) + 2, dtype=np.uint64))) & (1 << 63) - 1
            to = ((key >> np.uint64(32)) * room >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            key, own, to = key[order].astype(np.uint32), own[order], to[order]
            at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist()
            rows = [(int(to[i]), name, key[i:j].tobytes(), steps(own[i:j]), b"", b"") for i, j in zip(at, [*at[1:], len(to)])]
            rows.append((name % buckets, name, b"", b"", ids.tobytes(), band.tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "flush", "keys", "steps", "sets", "bands"])

        total = 0
        for batch in batches:
            for _, h in _sets(batch):
                if not len(h) or (one := _set_id(h)) in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(one)
                key = piece_keys(h)
                place = (key >> np.uint64(32)) * room >> np.uint64(32) << np.uint64(32) | key & np.uint64(0xFFFFFFFF)
                # where two keys fall together, their number is not what the band says
                bands.append(int(band_of(len(h))) | (0 if len(np.unique(place)) == len(key) else ODD))
                found.append(key)
                sets.append(one)
                counts.append(len(key))
                total += len(key)
                if total >= FLUSH_KEYS or len(sets) >= FLUSH_SETS:
                    yield flush()
                    found, sets, bands, counts, total, turn = [], [], [], [], 0, turn + 1
        if found:
            yield flush()

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["bucket", "of", "keys", "many", "steps", "sets", "bands"]
        for bucket, rows in _grouped_rows(batches, "bucket"):
            listed = rows["sets"].map(len) > 0
            yield pd.DataFrame([(f, -1, b"", b"", b"", s, b) for f, s, b in zip(rows["flush"][listed], rows["sets"][listed], rows["bands"][listed])], columns=columns)
            rows = rows[~listed]
            if not len(rows):
                continue
            flushes, sets, times = rows["flush"].to_numpy(), [], []
            for i, (step, k) in enumerate(zip(rows["steps"], rows["keys"])):
                own = numbers_of(step, len(k) // 4)
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                sets.append(own[first] | i << 16)
                times.append(np.diff(np.append(first, len(own))))
            sets = np.concatenate(sets)
            key, own, _, many = in_several(_whole(rows["keys"], np.uint32), sets, np.zeros(len(sets), np.uint8), np.concatenate(times))
            del rows
            order = np.lexsort((key, own))
            key, own, many = key[order], own[order], many[order]
            of = own >> 16
            at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist() if len(of) else []
            out = [(int(flushes[of[i]]), bucket, key[i:j].tobytes(), many[i:j].tobytes(), steps(own[i:j] & 0xFFFF), b"", b"") for i, j in zip(at, [*at[1:], len(of)])]
            yield pd.DataFrame(out, columns=columns)

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for flush, rows in _grouped_rows(batches, "bucket"):
            listed = rows["of"] < 0
            if listed.sum() != 1:
                raise ValueError(f"flush {flush} has {listed.sum()} lists of sets: a task ran again over other rows")
            ids, bands = (np.frombuffer(rows[c][listed].iloc[0], kind) for c, kind in (("sets", np.int64), ("bands", np.uint8)))
            rows = rows[~listed]
            if not len(rows):
                continue
            many, low = _whole(rows["many"], np.int32), _whole(rows["keys"], np.uint32).astype(np.int64)
            own = np.concatenate([numbers_of(step, len(k) // 4) for step, k in zip(rows["steps"], rows["keys"])])
            key = np.repeat(rows["of"].to_numpy(np.int64), [len(x) // 4 for x in rows["keys"]]) << 32 | low
            parity = low & 1
            order = np.lexsort((key, many, parity, own))
            key, own, parity = key[order], own[order], parity[order]
            at = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (parity[1:] != parity[:-1])]))
            size = np.diff(np.append(at, len(key)))
            band = bands[own[at]].astype(np.int64)
            _, apart, m = scheme(band & ~ODD, parity[at])
            # the keys that no other set has come first; what is left of apart + 1 goes to the rarest of the others
            quota = np.where(band & ODD != 0, size, apart + 1 - (m - size))
            keep = np.arange(len(key)) - np.repeat(at, size) < np.repeat(quota, size)
            yield pd.DataFrame({"run": key[keep], "set": ids[own[keep]]})

    packed = by_task(docs.mapInPandas(pack, "bucket bigint, flush bigint, keys binary, steps binary, sets binary, bands binary"), buckets, MOST_TASKS)
    some = by_task(packed.mapInPandas(shared, "bucket bigint, of bigint, keys binary, many binary, steps binary, sets binary, bands binary"), buckets, MOST_TASKS)
    found = some.mapInPandas(rarest, "run bigint, set bigint")
    return materialize(found.distinct() if again else found, "jaccard-index")


def _near(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Those pairs (a, b) of set ids whose sizes and sketches allow a link."""
    side = profiles.select("set", "n", "sketch")
    both = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    both = both.where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    return materialize(both.where((100 + PERCENT) * flips(F.col("sa"), F.col("sb")) <= (100 - PERCENT) * (F.col("na") + F.col("nb"))).select("a", "b"), "jaccard-pairs")


def _linked(near: DataFrame, profiles: DataFrame, docs: DataFrame, again: bool) -> DataFrame:
    """Those pairs (a, b) of set ids whose whole sets are linked.  `again` tells whether whole rows of docs are repeated."""
    few = small_enough(near, BROADCAST_ROWS // 2)
    need = near.select(F.explode(F.array("a", "b")).alias("set"))
    keys = profiles.join(F.broadcast(need) if few else need.distinct(), "set", "left_semi").select("_key", "set")
    texts = docs.join(F.broadcast(keys) if few else bounded(keys, BROADCAST_ROWS), "_key").select("set", "_t")
    if again:
        texts = texts.dropDuplicates(["set"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets, texts = batch["set"].to_numpy(), batch["_t"].tolist()
            for i, j in batches_of(texts):
                yield pd.DataFrame({"set": sets[i:j], "h": [h.view(np.int64) for h in word_shingles(texts[i:j], SHINGLE)]})

    sets = materialize(texts.mapInPandas(whole, "set bigint, h array<bigint>"), "jaccard-sets")
    full = (F.broadcast(near) if few else near).join(sets.toDF("b", "hb"), "b").join(sets.toDF("a", "ha"), "a")
    both = full.select("a", "b", (F.size("ha") + F.size("hb")).alias("n"), F.size(F.array_intersect("ha", "hb")).alias("both"))
    return materialize(both.where(f"100 * both >= {PERCENT} * (n - both)").select("a", "b"), "jaccard-links")


def _stars(index: DataFrame) -> DataFrame:
    """Pairs of each run's leader (the least by a hash, another for each run) with its other members."""
    first = index.groupBy("run").agg(F.min_by("set", F.xxhash64("set", "run")).alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    return index.join(first, "run").where("set <> leader").select(F.least("set", "leader").alias("a"), F.greatest("set", "leader").alias("b")).distinct()


def _labels(links: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, c) for each set id: its component, itself where it has no link."""
    found = bounded(components(links, BROADCAST_ROWS).toDF("set", "c"), BROADCAST_ROWS)
    return materialize(sets.join(found, "set", "left").select("set", F.coalesce("c", "set").alias("c")), "jaccard-labels")


def _across(index: DataFrame, labels: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pairs (a, b) of a run in different components whose sizes and sketches allow a link, found block against block.

    Of runs with the same members one is taken.
    """
    rows = index.join(bounded(labels, BROADCAST_ROWS), "set")
    runs = rows.groupBy("run").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("set")).alias("sign"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("sign2")).where("lo <> hi")
    runs = runs.groupBy("sign", "sign2", "k").agg(F.min("run").alias("run")).select("run", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    rows = materialize(rows.join(runs, "run"), "jaccard-mixed").join(profiles.select("set", "n", "sketch"), "set")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("run", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set", "c", "n", "sketch")

    def pairs_of(part: pd.DataFrame) -> set[tuple[int, int]]:
        ids, comp, n, sketches = part["set"].to_numpy(), part["c"].to_numpy(), part["n"].to_numpy(), part["sketch"].tolist()
        words = np.array([len(s) for s in sketches])
        bits = {k: _folded(sketches, k) for k in np.unique(words).tolist()}
        found = set()
        for x in range(len(ids) - 1):
            rest = x + 1 + np.flatnonzero((comp[x + 1 :] != comp[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= PERCENT * np.maximum(n[x + 1 :], n[x])))
            for k, own in bits.items():
                if len(rest) and words[x] >= k:
                    rest = rest[(words[rest] < k) | (np.bitwise_count(own[rest] ^ own[x]).sum(axis=1) <= most_apart(n[rest], n[x]))]
            if len(rest):
                found.update(zip(np.minimum(ids[x], ids[rest]).tolist(), np.maximum(ids[x], ids[rest]).tolist()))
        return found

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # three numbers name a pair of blocks; rows come sorted by them
        named = (b.assign(_at=pd.util.hash_pandas_object(b[["run", "i", "j"]], index=False).to_numpy().view(np.int64)) for b in batches)
        found: set[tuple[int, int]] = set()
        for _, part in _grouped_rows(named, "_at"):
            found |= pairs_of(part)
            if len(found) >= FLUSH_KEYS // 20:
                yield pd.DataFrame(list(found), columns=["a", "b"], dtype=np.int64)
                found = set()
        yield pd.DataFrame(list(found), columns=["a", "b"], dtype=np.int64)

    keys = ["run", "i", "j"]
    return materialize(rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a bigint, b bigint").distinct(), "jaccard-pairs")


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, key (of the row's id and text).

    Documents with 100 * intersection >= 80 * union of their five-word shingles are linked; component_id is the smallest
    doc_id reachable by links.  Null, empty and blank texts have no shingles and no links, and are alone; fewer than five
    words are one shingle.  Rows with equal sets are one class.  Null ids come last: a component of null ids only has
    none.  Repeated rows give repeated results; other columns are not read.  Sets are of 64-bit hashes.
    """
    return _grouped(docs, doc_id, text).drop("class")


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The columns of `similar` and class: an id of the component, null for rows without shingles."""
    side = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t"), row_name(F.col(doc_id), F.col(text)).alias("_key"))
    rows = materialize(_profiles(side.select("_id", "_key", "_t")), "jaccard-profiles")
    sets = rows.where("set is not null").groupBy("set").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("_key").alias("_key"), F.min("_id").alias("low"), F.count("*").alias("copies"))
    profiles = materialize(sets, "jaccard-classes")
    once, again = _once(side.select("_key", "_t"), rows, profiles)
    index = _index(once, int(profiles.agg(F.sum("n")).first()[0] or 0), again)
    links = _linked(_near(_stars(index), profiles), profiles, side, again)
    labels = _labels(links, profiles.select("set"))
    more = _linked(_across(index, labels, profiles), profiles, side, again)
    if more.limit(1).count():
        # the components found so far are stars already
        stars = labels.where("set <> c").select(F.col("set").alias("a"), F.col("c").alias("b"))
        labels = _labels(stars.union(more.select("a", "b")), profiles.select("set"))
    named = profiles.select("set", "low").join(bounded(labels, BROADCAST_ROWS), "set")
    least = named.groupBy("c").agg(F.min("low").alias("component_id"))
    of = named.join(least, "c").select("set", "component_id", F.col("c").alias("class"))
    out = rows.select("_id", "_key", "n", "set").join(of, "set", "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("set").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("_key").alias("key"), "class")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of similar documents, with all its columns: that with the smallest doc_id.

    Rows without an id come last.  Of rows with one id and text the first by its JSON form stays.  Null, empty and blank
    texts are alike only to rows with the same id and text.  An empty table stays empty.
    """
    found = _grouped(docs, "doc_id", "text")
    # by component, not by doc_id, which different texts may share; rows without shingles are alone
    alone = F.when(F.col("class").isNull(), F.col("key")).alias("alone")
    first = found.groupBy("class", alone).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("_key"))
    kept = as_rows(docs).join(first.select("_key"), "_key", "left_semi")
    return kept.groupBy("_key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
