"""Embedding whitening: singular vectors of the centred rows by MLlib, the total variance from exact deviations.

Entries become whole numbers, so sums and deviations are exact whatever the order of adding.  The rows, centred by the
exact means, form a distributed row matrix; its singular values, squared and divided by n, are the eigenvalues of the
covariance.  Only tables of the width of a vector (sums, singular vectors) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size or more have no whole number of 64 bits; singular values below this share of the first are noise.
LARGEST, NOISE = 1.4e17, 1e-7


def _square(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def whole(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that take part, x being floor(64 c) + 1000000 for each entry c, and the width."""
    fit = F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = vectors.where(F.coalesce(fit, F.lit(False)) & (F.size(vector) > 0))
    widest = rows.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = widest[0]["width"] if widest else 0
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT))
    return rows.where(F.size(vector) == width).select(F.col(vec_id).alias("vec_id"), x.cast("array<bigint>").alias("x")), width


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension, exact: partial sums of a task are added as whole numbers of 38 digits."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for b in batches:
            x = _square(b.column("x"))
            wide = len(x) and float(np.abs(x).max()) * len(x) >= 2.0**62
            own = (x.astype(object) if wide else x).sum(axis=0)
            n, sums = n + len(x), [a + int(v) for a, v in zip(sums, own)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(v) for v in [n, *sums]], pa.string())], ["at", "v"])

    total = rows.select("x").mapInArrow(partial, "at int, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {r["at"]: int(r["v"]) for r in total.collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as 64-bit numbers where these hold it, else as Python's."""
    if n * (int(np.abs(x).max()) if x.size else 0) + max(map(abs, sums)) < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _exact_squares(y: np.ndarray) -> list[int]:
    small = y.dtype != object and y.size and int(np.abs(y).max()) ** 2 * y.shape[1] < 2**62
    return [int(v) for v in ((y if small else y.astype(object)) ** 2).sum(axis=1)]


class Components:
    """Unit eigenvectors (columns) of the covariance with their eigenvalues, and the exact total variance times n**3."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, total: int):
        self.n, self.sums, self.vectors, self.values, self.total = n, sums, vectors, values, total
        self.explained = [float(v) * n**3 / total for v in values] if total else []

    def project(self, x: np.ndarray) -> np.ndarray:
        return (_scaled(x, self.n, self.sums) / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Components | None:
    """The components of rows of `whole`, by falling eigenvalue; None without rows."""
    n, sums = exact_sums(rows, width) if width else (0, [])
    if not n:
        return None

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(_exact_squares(_scaled(_square(b.column("x")), n, sums))) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([str(total)], pa.string())], ["v"])

    total = int(rows.select("x").mapInArrow(squares, "v string").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).first()["v"] or 0)
    if not total:
        return Components(n, sums, np.zeros((width, 0)), np.zeros(0), 0)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = (_scaled(_square(b.column("x")), n, sums) / n).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, c.size + 1, width, np.int32), c.ravel())], ["c"])

    centred = rows.select("x").mapInArrow(centre, "c array<double>").select(array_to_vector("c").alias("c"))
    # All components are asked for: MLlib then decomposes the Gram matrix whole instead of iterating to a tolerance.
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "c"), n, width).computeSVD(width, computeU=False, rCond=NOISE)
    values = svd.s.toArray()[:components] ** 2 / n
    vectors = svd.V.toArray()[:, : len(values)]
    return Components(n, sums, vectors, values, total)


def identity_error(rows: DataFrame, model: Components) -> float:
    """The largest absolute entry of the covariance (divisor n, centred first) of the whitened rows minus the identity."""
    k = len(model.values)

    def gathered(f, size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for b in batches:
                out += f(model.project(_square(b.column("x")))).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(out)], ["at", "v"])

        out = np.zeros(size)
        for r in rows.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        return out / model.n

    mean = gathered(lambda w: w.sum(axis=0), k)
    cov = gathered(lambda w: (w - mean).T @ (w - mean), k * k).reshape(k, k)
    return float(np.abs(cov - np.eye(k)).max()) if k else 0.0


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries take no part, nor do those with an entry of
    1.4e17 or more, which has no 64-bit whole number.  All vectors must have one length; of several the most common one
    counts (the longer at a tie) and the rest take no part.  Repeated rows and ids count each time; ids may be null.
    Directions without variance have no component, so there are fewer rows where vectors span less than `components`
    dimensions, and none for an empty table, one vector, or equal ones.  deviation is a whole number of up to 38 digits.
    Other columns are not read.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows, width = whole(vectors, vec_id, vector)
    rows = materialize(rows, "whitening-rows")
    model = fit(rows, width, components)
    error = identity_error(rows, model) if model else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist(), np.int64).reshape(len(b), -1)
            yield pd.DataFrame({"vec_id": b["vec_id"], "d": [str(v) for v in _exact_squares(_scaled(x, model.n, model.sums))], "w": list(model.project(x))})

    side = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x")
    if not model or not len(model.values):
        side, run = side.limit(0), lambda batches: iter(())
    out = side.mapInPandas(run, "vec_id string, d string, w array<double>")
    explained = F.array(*[F.lit(v) for v in (model.explained if model else [])]).cast("array<double>")
    return out.select(F.col("vec_id").cast(kind).alias("vec_id"), "d", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"),
        F.col("d").cast("decimal(38,0)").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
