"""Exact nearest neighbours over balanced posting lists.

Vectors lie in lists, one for each centroid; a vector near the border of several clusters is in each of their lists.
A query walks a graph of the centroids, held in memory, towards its nearest ones and reads the lists whose distance is
within a ratio of the nearest.  Its k-th distance there is a bound: by the triangle inequality a list whose vectors lie between two distances from its centroid can be left out if none of them can
be as near as that, and all other lists are read too, so no neighbour is missed.  Lists longer than a bound are split by
a salt, so copies of one vector, however many, spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: Rows that centroids are fitted on, most centroids, rows a centroid, copies of a border vector, rows a split list.
SAMPLE_ROWS, MOST_CENTROIDS, LIST_ROWS, COPIES, SPLIT_ROWS = 20_000, 2_048, 200, 3, 2_000
#: A vector joins a list whose centroid is at most so many times as far as its nearest one; a query first searches such lists.
BORDER_RATIO, SEARCH_RATIO, SEARCH_LISTS = 1.10, 1.5, 96
#: Nearest centroids and most neighbours of a centroid in the graph, and centroids from which a walk starts.
DEGREE, WIDTH, ENTRIES = 16, 64, 32
#: Rows of a shard of lists, queries of a block and distances held at once when the lists within the bound are read.
SHARD_ROWS, BLOCK_QUERIES, HELD = 20_000, 20_000, 2_000_000
SEED = 11


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Balanced k-means of a bounded sample: a point's distance to a cluster is raised by the cluster's surplus of points."""
    rng = np.random.default_rng(SEED)
    k = max(1, min(k, len(sample)))
    cent = sample[rng.choice(len(sample), k, replace=False)].astype(np.float64)
    penalty = np.zeros(k)
    for _ in range(rounds):
        d = ((sample**2).sum(1)[:, None] - 2 * sample @ cent.T + (cent**2).sum(1)[None]) + penalty
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(cent)
        np.add.at(sums, own, sample)
        cent = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], cent)
        penalty += 0.02 * max(float(np.median(d.min(1))), 0.0) * (n * k / len(sample) - 1)
        penalty -= penalty.min()
    return cent


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a from those of b, with an error of at most `_slack`."""
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None], 0))


def centroid_graph(cent: np.ndarray) -> np.ndarray:
    """At most WIDTH neighbours of each centroid: two on a ring through all, so that none is out of reach, its nearest ones,
    and of those that have it among theirs first the ones that fewest others have.  Rows are filled up with the centroid."""
    k = len(cent)
    d = _distances(cent, cent)
    np.fill_diagonal(d, np.inf)
    near = np.zeros((k, k), bool)
    if n := min(DEGREE, k - 1):
        near[np.arange(k)[:, None], np.argpartition(d, n - 1, axis=1)[:, :n]] = True
    rank = np.where(near, -1.0, np.where(near.T, near.sum(0), np.inf))
    ring = np.random.default_rng(SEED).permutation(k)
    rank[ring, np.roll(ring, 1)] = rank[ring, np.roll(ring, -1)] = -2
    np.fill_diagonal(rank, np.inf)
    order = np.argsort(rank, axis=1, kind="stable")[:, :WIDTH]
    return np.where(np.isfinite(np.take_along_axis(rank, order, 1)), order, np.arange(k)[:, None])


def graph_search(q: np.ndarray, cent: np.ndarray, links: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, distances), nearest first, that best-first walks over the graph find for each row of q.

    All rows walk at once: each round goes on from the nearest centroid of a row's beam from which it has not yet gone on.
    At most `beam` are held; places beyond those found have an infinite distance.
    """
    one, rows = np.arange(len(q)), np.arange(len(q))[:, None]
    start = np.unique(np.linspace(0, len(cent) - 1, ENTRIES).astype(int))
    ids, far = np.tile(start, (len(q), 1)), np.sqrt(((cent[start] - q[:, None]) ** 2).sum(2))
    open_, seen = np.ones(ids.shape, bool), np.zeros((len(q), len(cent)), bool)
    seen[:, start] = True
    while True:
        wait = np.where(open_, far, np.inf)
        pick = wait.argmin(1)
        live = np.isfinite(wait[one, pick])
        if not live.any():
            break
        open_[one, pick] = False
        to = links[ids[one, pick]]
        fresh = live[:, None] & ~seen[rows, to]
        seen[rows, to] |= fresh
        i, j = np.nonzero(fresh)
        d = np.full(to.shape, np.inf)
        d[i, j] = np.sqrt(((cent[to[i, j]] - q[i]) ** 2).sum(1))
        ids, far, open_ = np.hstack([ids, to]), np.hstack([far, d]), np.hstack([open_, fresh])
        if ids.shape[1] > beam:
            best = np.argpartition(far, beam - 1, axis=1)[:, :beam]
            ids, far, open_ = (np.take_along_axis(x, best, 1) for x in (ids, far, open_))
    order = np.argsort(far, axis=1, kind="stable")[:, :beam]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


def _slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1e-6 * (np.sqrt((a**2).sum(1)) + np.sqrt((b**2).sum(1).max(initial=0)))


def _reach(q: np.ndarray, most: np.ndarray, cent: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a vector between `low` and `high` from a centroid can be as near as `most` to a query; not finite counts as yes."""
    d, limit = _distances(q, cent), most + 2 * _slack(q, cent)
    return ~((d - high > limit[:, None]) | (low - d > limit[:, None]))


def _least(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least distances, one for each id; ties go to the smaller id."""
    n = min(k, len(d))
    while n:
        own = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
        own = own[np.lexsort((ids[own], d[own]))]
        own = own[np.sort(np.unique(ids[own], return_index=True)[1])]
        if len(own) >= k or n == len(d):
            return own[:k]
        n = min(2 * n, len(d))
    return np.zeros(0, int)


def usable(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(_id, _v): rows whose vector is not null or zero and has no null or non-finite component."""
    ok = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    side = vectors.select(F.col(key).alias("_id"), F.col(vec).cast("array<double>").alias("_v"))
    return side.where(F.col("_v").isNotNull() & F.coalesce(ok, F.lit(False)) & F.exists("_v", lambda x: x != 0))


def search(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", every: int = 100, k: int = 10, exact: bool = True) -> DataFrame:
    """The k nearest other rows of each query row: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Queries are the rows whose key is divisible by `every`; every usable row is in the index.  The result is exact;
    without `exact` only the lists within the ratio are read, and neighbours in others are missed.  Ties go to the smaller key.  Null, zero and non-finite vectors and null keys take no part; vectors whose length differs from
    the query's are not its candidates.  Repeated rows count once; a query with fewer candidates has fewer rows; an empty
    table has none.  Centroids are fitted on at most SAMPLE_ROWS rows, which bears on the time only.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    # one width at a time would need a pass for each; the lists of one width hold all rows of that width
    rows = usable(vectors, key, vec).where("_id is not null").dropDuplicates(["_id", "_v"]).withColumn("_dim", F.size("_v")).withColumn("_query", F.col("_id") % every == 0)
    rows = materialize(rows, "ann-vectors")
    widths = rows.groupBy("_dim").agg(F.count("*").alias("count"), F.sum(F.col("_query").cast("bigint")).alias("asked")).orderBy(F.desc("count"), "_dim").collect()
    graphs = {}
    for r in widths:
        share = min(1.0, 1.1 * SAMPLE_ROWS / r["count"])
        own = rows.where(F.col("_dim") == r["_dim"])
        own = own if share >= 1 else own.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
        sample = np.array([x["_v"] for x in own.select("_v").limit(SAMPLE_ROWS).collect()])
        graphs[r["_dim"]] = fit_centroids(sample, min(MOST_CENTROIDS, -(-r["count"] // LIST_ROWS)))
    cents = spark.sparkContext.broadcast(graphs)
    links = spark.sparkContext.broadcast({dim: centroid_graph(c) for dim, c in graphs.items()})

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, all_of in batch.groupby("_dim"):
                cent = cents.value[dim]
                for begin in range(0, len(all_of), 1024):
                    part = all_of.iloc[begin : begin + 1024]
                    ids, vecs = part["_id"].to_numpy(), part["_v"].to_numpy()
                    v = np.vstack(vecs)
                    dist = _distances(v, cent)
                    n = min(COPIES, len(cent))
                    near = np.argpartition(dist, n - 1, axis=1)[:, :n]
                    far = np.sqrt(((v[:, None] - cent[near]) ** 2).sum(2))
                    order = np.argsort(far, axis=1)
                    near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
                    home = far <= BORDER_RATIO * far[:, :1] + 1e-12
                    home[:, 0] = True
                    i, j = np.nonzero(home)
                    yield pd.DataFrame({"_id": ids[i], "_v": vecs[i], "_list": near[i, j], "_role": 0, "_first": j == 0, "_far": far[i, j], "_dim": dim})
                own = all_of[all_of["_query"]]
                for begin in range(0, len(own), 1024):
                    part = own.iloc[begin : begin + 1024]
                    lists_of, far = graph_search(np.vstack(part["_v"].to_numpy()), cent, links.value[dim], SEARCH_LISTS)
                    for i, v, near, d in zip(part["_id"], part["_v"], lists_of, far):
                        near, d = (near[np.isfinite(d)], d[np.isfinite(d)]) if np.isfinite(d[0]) else (near[:1], d[:1])
                        wide = near[d <= SEARCH_RATIO * d[0] + 1e-12]
                        if len(wide) < min(16, len(near)):  # a query that lies on a centroid still reads its surroundings
                            wide = near[:16]
                        yield pd.DataFrame({"_id": i, "_v": [v] * len(wide), "_list": wide, "_role": 1, "_first": False, "_far": 0.0, "_dim": dim})

    at = rows.select("_id", "_v", "_query", "_dim").mapInPandas(placed, f"_id {kind}, _v array<double>, _list int, _role int, _first boolean, _far double, _dim int")
    at = materialize(at, "ann-lists")
    own = F.when(F.col("_first"), F.col("_far"))
    sizes = at.where("_role = 0").groupBy("_dim", "_list").agg(F.ceil(F.count("*") / SPLIT_ROWS).cast("int").alias("_parts"), F.min(own).alias("low"), F.max(own).alias("high"))
    sizes = materialize(sizes, "ann-sizes")  # one row for each centroid: at most MOST_CENTROIDS a width
    at = at.join(F.broadcast(sizes.select("_dim", "_list", "_parts")), ["_dim", "_list"])
    base = at.where("_role = 0").withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    asked = at.where("_role = 1").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    keys = ["_dim", "_list", "_part"]
    asked = asked.select(*[F.col(c).alias(c) for c in (*keys, "_id", "_v")])

    def nearest(batch: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        ids = batch["_id"].to_numpy()
        mat = np.vstack(batch["_v"].to_numpy()) if len(batch) else np.zeros((0, 0))
        out = []
        if len(ids):
            for i, v in zip(other["_id"], other["_v"]):
                rest = np.flatnonzero(ids != i)
                d = np.sqrt(((mat[rest] - v) ** 2).sum(axis=1))
                out.extend((i, ids[rest[j]], float(d[j])) for j in _least(ids[rest], d, k))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    w = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def best(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    result = f"query_id {kind}, vec_id {kind}, score double"
    found = base.select(*keys, "_id", "_v").groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(nearest, result)
    if not exact:
        return best(found)
    found = materialize(best(found), "ann-first")

    # the k-th distance so far bounds what is left; without k candidates nothing does
    bounds = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("_most"))
    left = rows.where("_query").join(bounds.withColumnRenamed("query_id", "_id"), "_id", "left").select("_id", "_v", "_dim", F.coalesce("_most", F.lit(float("inf"))).alias("_most"))
    shards = max(shuffle_partitions(spark), -(-sum(r["count"] for r in widths) // SHARD_ROWS))
    blocks = max([1, *[-(-r["asked"] // BLOCK_QUERIES) for r in widths]])
    lists = {r["_dim"]: [] for r in widths}
    for r in sizes.where("low is not null").orderBy("_list").collect():
        lists[r["_dim"]].append((r["_list"], r["_parts"], r["low"], r["high"]))
    ranges = spark.sparkContext.broadcast({d: [np.array(c) for c in zip(*x)] for d, x in lists.items()})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query once for each shard that holds a list within its bound."""
        for batch in batches:
            for dim, all_of in batch.groupby("_dim"):
                at, parts, low, high = ranges.value[dim]
                for begin in range(0, len(all_of), 1024):
                    part = all_of.iloc[begin : begin + 1024]
                    reach = _reach(np.vstack(part["_v"].to_numpy()), part["_most"].to_numpy(), cents.value[dim][at], low, high)
                    to = np.zeros((len(part), shards), bool)
                    for c in range(len(at)):
                        to[np.ix_(reach[:, c], np.unique((at[c] + np.arange(parts[c])) % shards))] = True
                    i, shard = np.nonzero(to)
                    yield part.iloc[i].assign(_shard=shard)

    def rest_of(batch: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(batch) and len(other):
            dim = batch["_dim"].iloc[0]
            at, _, low, high = ranges.value[dim]
            ids, mat = batch["_id"].to_numpy(), np.vstack(batch["_v"].to_numpy())
            asking, vecs, most = other["_id"].to_numpy(), np.vstack(other["_v"].to_numpy()), other["_most"].to_numpy()
            for c, own in batch.groupby("_list").indices.items():
                x, place = mat[own], np.searchsorted(at, [c])
                for begin in range(0, len(vecs), step := max(1, HELD // len(own))):
                    q = vecs[begin : begin + step]
                    ask = np.flatnonzero(_reach(q, most[begin : begin + step], cents.value[dim][[c]], low[place], high[place])[:, 0])
                    q = q[ask]
                    near = ~(_distances(q, x) > (most[begin + ask] + 2 * _slack(q, x))[:, None])
                    for i in np.flatnonzero(near.any(1)):
                        one = asking[begin + ask[i]]
                        js = own[near[i]]
                        js = js[ids[js] != one]
                        d = np.sqrt(((mat[js] - q[i]) ** 2).sum(axis=1))
                        out.extend((one, ids[js[j]], float(d[j])) for j in _least(ids[js], d, k))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["_dim", "_shard", "_block"]
    left = left.mapInPandas(spread, f"_id {kind}, _v array<double>, _dim int, _most double, _shard int").withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    base = base.where("_first").withColumn("_shard", ((F.col("_list") + F.col("_part")) % shards).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    base = base.select(*[F.col(c).alias(c) for c in (*keys, "_list", "_id", "_v")])
    more = base.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInPandas(rest_of, result)
    return best(found.select("query_id", "vec_id", "score").unionByName(more))
