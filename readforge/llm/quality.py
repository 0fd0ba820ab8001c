"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian whose covariance is shrunk towards the pooled diagonal; its Cholesky factor is computed once
and kept.  A score is the logistic of the difference of log densities, which are Mahalanobis distances plus constants.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_rows, materialize, row_name

SHRINKAGE, RIDGE = 0.15, 0.05
THRESHOLD = 0.7
FEATURES = ["words", "word_len", "distinct", "symbols", "upper", "digits", "odd", "short", "lines_same", "lines_end", "pairs_same", "commas", "line_len"]
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(48, 58)]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 3
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and not _CLASS[b]]] = 4
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")


def statistics(text: str) -> list[float]:
    """The features of one whole text; all finite, also for an empty one."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, size = max(len(words), 1), max(len(text), 1)
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=5)
    pairs = len(set(zip(words, words[1:])))
    root = lambda x: (x / size) ** 0.5
    return [
        np.log1p(len(words)),
        np.log(sum(map(len, words)) / n + 1),
        np.log(max(len(set(words)), 1)) / np.log(n + 1),
        root(kinds[3] + kinds[4]),
        root(len(_UPPER.findall(text))),
        root(kinds[1]),
        root(kinds[4]),
        sum(len(w) <= 3 for w in words) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(len(lines), 1),
        1 - pairs / max(len(words) - 1, 1) if len(words) > 1 else 0.0,
        root(kinds[3]),
        np.log1p(len(words) / max(len(lines), 1)),
    ]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """`_id`, `_key` and `_f` (the statistics) for each row of docs (`_id` and the text column)."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"].to_numpy(), "_key": batch["_key"], "_f": [statistics(t) for t in batch["_t"]]})

    side = docs.select(F.col("_id").cast("string").alias("_id"), row_name(F.col("_id"), F.col(text)).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return side.mapInPandas(run, "_id string, _key string, _f array<double>").withColumn("_id", F.col("_id").cast(kind))


class Model:
    """Two Gaussians with their priors; `score` maps a matrix of statistics to probabilities of label 1."""

    def __init__(self, counts: dict[int, float], sums: dict[int, np.ndarray], outer: dict[int, np.ndarray]):
        total = sum(counts.values())
        self.constant = None if total and len(counts) == 2 and min(counts.values()) > 1 else (counts.get(1, 0) / total if total else 0.5)
        if self.constant is not None:
            return
        mean = sum(sums.values()) / total
        self.mean = mean
        self.scale = np.sqrt(np.maximum(np.diag(sum(outer.values())) / total - mean**2, 1e-8))
        self.parts = []
        within = {}
        for k in (0, 1):
            m = sums[k] / counts[k]
            within[k] = (outer[k] / counts[k] - np.outer(m, m)) / np.outer(self.scale, self.scale)
        pooled = sum(within[k] * counts[k] for k in (0, 1)) / total
        for k in (0, 1):
            cov = (1 - SHRINKAGE) * within[k] + SHRINKAGE * np.diag(np.diag(pooled)) + RIDGE * np.eye(len(mean))
            chol = np.linalg.cholesky(cov)
            self.parts.append(((sums[k] / counts[k] - mean) / self.scale, np.linalg.inv(chol), np.log(np.diag(chol)).sum(), np.log(counts[k] / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.mean) / self.scale
        logs = [prior - half - 0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1) for m, inv, half, prior in self.parts]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(labelled: DataFrame) -> Model:
    """Fit to rows of `_f` and `label` (0 or 1): moments are summed over all of them by Spark; only the sums reach the driver."""
    d = len(FEATURES)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = np.array(batch["_f"].tolist()).reshape(-1, d), batch["label"].to_numpy()
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pd.DataFrame({"label": np.repeat([0, 1], sums.shape[1]), "at": np.tile(np.arange(sums.shape[1]), 2), "v": sums.ravel()})

    rows = labelled.select("_f", "label").mapInPandas(moments, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    table = np.zeros((2, 1 + d + d * d))
    for r in rows:
        table[r["label"], r["at"]] = r["v"]
    have = [k for k in (0, 1) if table[k, 0]]
    return Model({k: table[k, 0] for k in have}, {k: table[k, 1 : 1 + d] for k in have}, {k: table[k, 1 + d :].reshape(d, d) for k in have})


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, key (of the row's id and text).

    labels has doc_id and quality (0 or 1; other values and nulls are passed over); rows of the held-out fold are never
    learnt from.  Null texts score as empty ones.  Repeated rows and labels count each time.  Without labels of both
    classes every score is the share of label 1, or 0.5.  Statistics are of whole texts; other columns are not read.
    """
    side = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    found = materialize(features(side, "_text"), "quality-features")
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    model = fit(found.join(known.where(~held_out(F.col("_id"))), "_id"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = model.score(np.array(batch["_f"].tolist()).reshape(-1, len(FEATURES)))
            yield pd.DataFrame({"doc_id": batch["_id"].to_numpy(), "held_out": batch["_held"], "score": score, "predicted": (score >= threshold).astype(np.int32), "key": batch["_key"]})

    return found.withColumn("_held", held_out(F.col("_id"))).withColumn("_id", F.col("_id").cast("string")).mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int, key string").withColumn("doc_id", F.col("doc_id").cast(kind))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns, whatever those are called.

    Null texts are judged as empty ones; of repeated rows all stay or all go; an empty table stays empty.
    """
    bad = classify(docs, labels).where("predicted = 0").select(F.col("key").alias("_key")).distinct()
    return as_rows(docs).join(bad, "_key", "left_anti").select("row.*")
