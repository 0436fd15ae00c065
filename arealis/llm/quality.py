"""Text quality from a convolutional network over bytes, in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from arealis.llm.common import documents, table
from arealis.llm.labelled import fit_logistic, labelled_sample, prior_shift, scored, sigmoid

#: Chunks are two steps long and start at every step, so neighbours overlap by half.
STEP = 256


@dataclass
class ByteNet:
    """Filters over ``width`` bytes; each chunk keeps the maximum of each filter.

    The mean and the maximum over all chunks, rectified, are combined into one
    probability. ``taps[k, b]`` is what byte ``b`` at place ``k`` adds to each filter.
    """

    taps: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    prior: float

    @classmethod
    def random(cls, filters: int = 24, width: int = 6, seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        taps = rng.normal(0, 0.3, (width, 256, filters)).astype(np.float32)
        return cls(taps, np.zeros(filters, np.float32), rng.normal(0, 0.1, 2 * filters).astype(np.float32), 0.0)

    def pooled(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The maximum of each filter in each step of ``text``, and the position where it is."""
        b = np.frombuffer(text.ljust(len(self.taps), b"\0"), dtype=np.uint8)
        n = len(b) - len(self.taps) + 1
        steps = -(-n // STEP)
        best = np.empty((steps, len(self.bias)), np.float32)
        at = np.empty((steps, len(self.bias)), np.int64)
        for lo in range(0, steps, 64):  # a bounded part of a long text at a time
            start, stop = lo * STEP, min(n, (lo + 64) * STEP)
            seen = self.taps[0][b[start:stop]]
            for k in range(1, len(self.taps)):
                seen += self.taps[k][b[start + k : stop + k]]
            for s in range(start, stop, STEP):
                part = seen[s - start : s - start + STEP]
                a = part.argmax(0)
                at[s // STEP] = a + s
                best[s // STEP] = part[a, np.arange(part.shape[1])]
        return best, at

    def features(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk maxima and, for each, which of the chunk's two steps has it."""
        if len(best) == 1:
            return best, np.zeros_like(best, dtype=np.int64)
        second = best[1:] > best[:-1]
        return np.where(second, best[1:], best[:-1]), second.astype(np.int64)

    def logit(self, text: bytes) -> float:
        chunks, _ = self.features(self.pooled(text)[0])
        x = np.maximum(chunks + self.bias, 0)
        return float(np.concatenate([x.mean(0), x.max(0)]) @ self.out + self.prior)

    def fit(self, texts: list[bytes], labels: np.ndarray, rounds: int = 5, batch: int = 16, rate: float = 0.01, seed: int = 1) -> ByteNet:
        """Adam on the log loss; gradients go to the winning position of each pooled filter."""
        rng, f = np.random.default_rng(seed), len(self.bias)
        params = [self.taps, self.bias, self.out, np.array([self.prior], np.float32)]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        turn, width, cols = 0, len(self.taps), np.arange(f)
        for r in range(rounds):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                grads = [np.zeros_like(p) for p in params]
                for i in order[lo : lo + batch]:
                    text = texts[i].ljust(width, b"\0")
                    best, at = self.pooled(text)
                    chunks, second = self.features(best)
                    x = np.maximum(chunks + self.bias, 0)
                    h = np.concatenate([x.mean(0), x.max(0)])
                    err = (sigmoid(h @ self.out + params[3][0]) - labels[i]) / batch
                    grads[2] += err * h
                    grads[3] += err
                    dx = np.broadcast_to(err * self.out[:f] / len(x), x.shape).copy()
                    dx[x.argmax(0), cols] += err * self.out[f:]
                    dx[x <= 0] = 0
                    grads[1] += dx.sum(0)
                    where = at[np.arange(len(x))[:, None] + second, cols]
                    b = np.frombuffer(text, dtype=np.uint8)
                    for k in range(width):
                        np.add.at(grads[0][k], (b[where + k], cols), dx)
                turn += 1
                step = rate * min(1.0, 2 * (1 - turn * batch / (rounds * len(order) + batch)))
                for p, g, a, c in zip(params, grads, m, v):
                    g += 1e-5 * p
                    a += 0.1 * (g - a)
                    c += 0.01 * (g * g - c)
                    p -= step * (a / (1 - 0.9**turn)) / (np.sqrt(c / (1 - 0.99**turn)) + 1e-7)
                self.prior = float(params[3][0])
        return self


def train(sample: pd.DataFrame, share: float | None = None, spark: SparkSession | None = None, folds: int = 3) -> ByteNet:
    """The network of a labelled sample, its output put on the scale of texts it has not seen.

    A network separates what it learned from nearly without error, so its own sums say
    little about how sure it may be. Networks of all but one fold each score that fold;
    a logistic fit on these scores gives slope and intercept, moved to where ``share`` of
    all rows have label 1. With ``spark`` the networks are fitted in tasks.
    """
    labels = sample["label"].to_numpy()
    if not len(labels) or labels.min() == labels.max():
        net = ByteNet.random()
        net.out[:] = 0
        net.prior = 0.0 if not len(labels) else float(np.log((labels.sum() + 1) / ((1 - labels).sum() + 1)))
        return net
    texts = [t.encode() for t in sample["text"]]
    # rows are in the order of their ids: folds by a fixed shuffle, each with its part of both labels
    part = np.empty(len(labels), dtype=int)
    for y in (0, 1):
        at = np.random.default_rng(5).permutation(np.flatnonzero(labels == y))
        part[at] = np.arange(len(at)) % folds
    learn = lambda k: _fold(texts, labels, part, k)
    if spark is None:
        found = [learn(k) for k in range(folds + 1)]
    else:
        held = spark.sparkContext.broadcast((texts, labels, part))

        def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column("id").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(_fold(*held.value, k))])], names=["k", "fit"])

        rows = spark.range(0, folds + 1, 1, folds + 1).mapInArrow(fits, "k long, fit binary").collect()
        found = [pickle.loads(r.fit) for r in sorted(rows, key=lambda r: r.k)]
    net, unseen = found[folds][0], np.zeros(len(labels))
    for k in range(folds):
        unseen[part == k] = found[k][1]
    slope, cut = fit_logistic(unseen[:, None], labels)
    net.out *= np.float32(slope)
    net.prior = float(net.prior * slope + cut) + prior_shift(labels, share)
    return net


def _fold(texts: list[bytes], labels: np.ndarray, part: np.ndarray, k: int) -> tuple[ByteNet, np.ndarray]:
    """A network of all texts outside fold ``k``, and what it makes of those inside."""
    net = ByteNet.random().fit([t for t, p in zip(texts, part) if p != k], labels[part != k])
    return net, np.array([net.logit(t) for t, p in zip(texts, part) if p == k])


def score_texts(net: ByteNet, texts: list[str]) -> np.ndarray:
    return sigmoid(np.array([net.logit(t.encode()) for t in texts]))


def quality(docs: DataFrame, labels: DataFrame, rows_a_class: int = 2000, learn_chars: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    A score is the probability of label 1 if ``threshold`` of all rows had it, so a text
    that speaks for neither label scores just that, whatever label is the commoner one:
    what is predicted errs about as often on either label.

    The network learns from at most ``rows_a_class`` labelled documents of each class
    with at most ``learn_chars`` characters (documented bounds), and scores whole texts
    of any length. Nulls and edges: a null text is the empty text, which is padded with
    zero bytes; a null ``doc_id`` is not held out; repeated rows get the same score;
    without labels of both classes every score is the same; an empty table gives an
    empty result; other columns are ignored.
    """
    sample, _ = labelled_sample(docs, labels, "quality", rows_a_class, learn_chars)
    net = docs.sparkSession.sparkContext.broadcast(train(sample, threshold, docs.sparkSession))
    return scored(docs, lambda texts: score_texts(net.value, texts), threshold)


def op1(spark, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
