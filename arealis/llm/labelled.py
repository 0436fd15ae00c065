"""Labelled texts, all of them or a bounded sample, and what both classifiers do with their scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm.common import crc_held_out, held_out, map_batches


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """``(doc_id, label)`` of ids that are not held out; an id with several labels counts as 1 if any is."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out("doc_id"))
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str) -> tuple[DataFrame, float]:
    """``(doc_id, label, text)`` of every labelled document that is not held out, and the share of label 1.

    Null labels are left out; of an id with several texts the smallest is learned from.
    """
    known = known_labels(labels, column)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null").where(~held_out("doc_id"))
    found = texts.join(known, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    share = known.agg(F.avg("label")).first()[0]
    return found, 0.5 if share is None else share


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows_a_class: int, max_chars: int, all_chars: int = 32_000_000) -> tuple[pd.DataFrame, float]:
    """``(text, label)`` of at most ``rows_a_class`` documents of each class, on the driver, and the share of label 1.

    Rows whose ``doc_id`` is held out, and null labels, are never taken. An id with
    several labels counts as 1 if any is; of an id with several texts the smallest is
    learned from. The documents are those whose id hashes lowest, so the sample is the same
    in every run. Texts of more than ``max_chars`` characters are not learned from, nor
    what exceeds ``all_chars`` together, so the driver's bytes are bounded. The id list is
    at most two times ``rows_a_class`` rows and is broadcast.
    """
    known = known_labels(labels, column)
    picks = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_a_class) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= max_chars)
    found = texts.join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    so_far = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most two times rows_a_class rows
    found = found.withColumn("so_far", so_far).where(F.col("so_far") <= all_chars).toPandas()
    found = found.sort_values("doc_id", ignore_index=True)
    share = known.agg(F.avg("label")).first()[0]
    return found[["text", "label"]], 0.5 if share is None else share


def prior_shift(labels: np.ndarray | float, share: float | None) -> float:
    """What an intercept learned on ``labels`` (or on rows of which they are the part of label 1) lacks if label 1 has ``share`` of all rows."""
    here = float(np.mean(labels)) if np.size(labels) else 0.0
    if share is None or not 0 < share < 1 or not 0 < here < 1:
        return 0.0
    return float(np.log(share / (1 - share)) - np.log(here / (1 - here)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights and intercept (last) by Newton steps; constant labels give an intercept only."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[-1] = 0.0 if len(y) == 0 else np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return w
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge), x.T @ (p - y) / len(y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_logistic_rows(rows: DataFrame, features: int, l2: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, float]:
    """``fit_logistic`` for ``(label, x)`` in Spark, and the part of label 1: each Newton step is one sum over partitions."""
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    w, size = np.zeros(features + 1), features + 1
    if not n or ones in (0, n):
        w[-1] = np.log((ones + 1) / (n - ones + 1)) if n else 0.0
        return w, ones / n if n else 0.0
    ridge = np.full(size, l2)
    ridge[-1] = 1e-9
    names = [f"s{i}" for i in range(size * size + size)]

    def sums(w: np.ndarray):
        def of(b: pa.RecordBatch) -> pa.RecordBatch:
            x = np.column_stack([b.column("x").flatten().to_numpy().reshape(b.num_rows, features), np.ones(b.num_rows)])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            found = np.concatenate([((x * (p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (p - b.column("label").to_numpy())])
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in found], names=names)

        return of

    for _ in range(rounds):
        found = np.array(map_batches(rows, sums(w), ", ".join(f"{c} double" for c in names)).agg(*(F.sum(c) for c in names)).first()) / n
        step = np.linalg.solve(found[: size * size].reshape(size, size) + np.diag(ridge), found[size * size :] + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w, ones / n


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; ``score`` maps a list of texts to probabilities."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column("doc_id").to_pylist()
        p = np.asarray(score([x or "" for x in b.column("text").to_pylist()]), dtype=float)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([crc_held_out(i) for i in ids]), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")
