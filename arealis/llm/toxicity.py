"""Toxicity from two Kneser-Ney word models that share their backoff."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from arealis.llm.common import deleted, documents, map_batches, table, written
from arealis.llm.labelled import fit_logistic, fit_logistic_rows, labelled_rows, prior_shift, scored, sigmoid
from arealis.llm.word_counts import FOLDS, bands, model_counts, model_tables, one_of_near_copies, some_at_once, word_counts, words

#: Letters of the beginnings that rare forms of a word back off to, the shortest first.
STEMS = (4, 6)
#: What is taken from a word's document counts, and from those of a pair.
DISCOUNT, PAIR_DISCOUNT = 3.0, 8.0
#: Words of the passages that are compared besides the whole text; they start at every half of a length.
PASSAGES = (1, 2, 4, 8, 16)


@dataclass
class KneserNey:
    """Word models of order two for two classes.

    A word is a beginning of four letters, then of six, then the whole form, then the form
    after the word before it. On every level a class keeps ``max(count - discount, 0)`` of
    its document counts (an expression counts once in each document) and gives the rest
    to the level below, the same share in both classes, so that what neither has seen
    tells nothing. In a beginning, forms are shared out by the continuation counts of
    both classes together; a rare form thus has the evidence of its beginning. A context
    after which one class has nothing left is left to the words by both. For each class
    ``P(. | previous word)`` sums to one over the known words and one unknown word for
    each beginning, one for all other beginnings included.
    """

    index: dict[str, int]
    stem_ratio: list[dict[str, float]]  # for each length: log ratio of a beginning, toxic to ordinary
    word_p: np.ndarray  # P of each known word without context, ordinary and toxic
    pairs: np.ndarray  # sorted previous * size + word
    pair_kept: np.ndarray  # discounted share of each pair in its context, by class
    spare: np.ndarray  # weight of the word level after each word; 1 where the context is left out
    weights: np.ndarray | None = None
    unknown: np.ndarray = field(init=False)  # ratio of each beginning, and of none

    def __post_init__(self):
        self.unknown = np.exp([0.0, *(x for r in self.stem_ratio for x in r.values())])
        starts = np.cumsum([1, *map(len, self.stem_ratio)]).tolist()
        self._beginnings = [(n, dict(zip(r, range(at, at + len(r))))) for n, r, at in zip(STEMS, self.stem_ratio, starts)][::-1]

    def numbers(self, text: list[str]) -> np.ndarray:
        """Places of words in ``index``; of unknown ones ``-1`` less the place of their longest known beginning in ``unknown``."""
        get = self.index.get
        w = np.array([get(x, -1) for x in text], dtype=np.int64)
        for k in np.flatnonzero(w < 0).tolist():
            x = text[k]
            w[k] = -1 - next((r[x[:n]] for n, r in self._beginnings if x[:n] in r), 0)
        return w

    @classmethod
    def fit(cls, texts: list[np.ndarray], labels: np.ndarray, names: list[str], discount: float = DISCOUNT, pair_discount: float = PAIR_DISCOUNT) -> KneserNey:
        """``texts`` are numbers of words in ``names``; words that no text has stay unknown. ``of_tables`` makes the same model of counts by Spark."""
        used = np.unique(np.concatenate([*texts, np.zeros(0, np.int64)])).astype(np.int64)
        look = np.zeros(len(names), dtype=np.int64)
        look[used] = np.arange(len(used))
        vocabulary, size = [names[i] for i in used], max(len(used), 1)
        index = {w: i for i, w in enumerate(vocabulary)}
        counts, keys = np.zeros((2, len(used))), ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        for t, y in zip(texts, labels):
            t = look[t]
            counts[y, np.unique(t)] += 1
            keys[y].append(np.unique(t[:-1] * size + t[1:]))
        flat = [np.concatenate(k) for k in keys]
        pairs, inverse = np.unique(np.concatenate(flat), return_inverse=True)
        shared = np.bincount(pairs % size, minlength=len(used))[: len(used)] + 1.0  # different words before each word, in both classes
        # from the shortest beginnings to whole forms; a level is a distribution over its items for each class
        below, ratios, names = None, [], [[w[:n] for w in vocabulary] for n in STEMS] + [vocabulary]
        for items in names:
            known = {x: i for i, x in enumerate(dict.fromkeys(items))}
            at = np.array([known[x] for x in items], dtype=np.int64)
            here = np.stack([np.bincount(at, c, len(known)) for c in counts])
            mass = np.bincount(at, shared, len(known))
            if below is None:
                base = np.tile(mass / (mass.sum() + 1), (2, 1))
            else:  # each parent's probability, shared out among its items and one unknown item
                up = np.zeros(len(known), dtype=np.int64)
                up[at] = parent
                base = below[:, up] * mass / (np.bincount(up, mass, below.shape[1]) + 1)[up]
            kept = np.maximum(here - discount, 0)
            if kept.sum(1).all():
                spare = 1 - (kept.sum(1) / here.sum(1)).mean()
                below = (1 - spare) * kept / kept.sum(1, keepdims=True) + spare * base
            else:
                below = base
            parent = at
            if items is not vocabulary:
                ratios.append(dict(zip(known, (np.log(below[1]) - np.log(below[0])).tolist())))
        # pairs: discounted counts within each context
        of = np.r_[np.zeros(len(flat[0]), int), np.ones(len(flat[1]), int)]
        n = np.stack([np.bincount(inverse[of == c], minlength=len(pairs)) for c in (0, 1)]).astype(float)
        v = pairs // size
        kept = np.maximum(n - pair_discount, 0)
        seen, left = (np.stack([np.bincount(v, x[c], size) for c in (0, 1)]) for x in (n, kept))
        both = (left > 0).all(0)
        spare = np.where(both, 1 - (left / np.maximum(seen, 1)).mean(0), 1.0)
        use = both[v] & (kept > 0).any(0)
        share = (1 - spare[v[use]]) * kept[:, use] / left[:, v[use]]
        return cls(index, ratios, below, pairs[use], share, spare)

    @classmethod
    def of_tables(cls, tables: dict, discount: float = DISCOUNT, pair_discount: float = PAIR_DISCOUNT) -> KneserNey:
        """The model of ``model_tables``. It knows the words that a class has above the discount only.

        Both classes give any other word the same part of its beginning, which is how
        unknown words are treated; pairs with such a word are below their discount too.
        """
        below, ratios, up, up_mass = None, [], {}, np.zeros(0)
        for level, size in zip(tables["levels"], (*STEMS, None)):
            if below is None:
                base = np.tile(level["mass"] / (level["all_mass"] + 1), (2, 1))
            else:
                at = np.array([up[x[: STEMS[len(ratios) - 1]]] for x in level["names"]], dtype=np.int64)
                base = below[:, at] * level["mass"] / (up_mass[at] + 1)
            kept = np.maximum(level["here"] - discount, 0)
            below = base
            if level["all_kept"].all():
                spare = 1 - (level["all_kept"] / level["all_here"]).mean()
                below = (1 - spare) * kept / level["all_kept"][:, None] + spare * base
            up, up_mass = {x: i for i, x in enumerate(level["names"])}, level["mass"]
            if size is not None:
                ratios.append(dict(zip(up, (np.log(below[1]) - np.log(below[0])).tolist())))
        size, (first, second, n) = max(len(up), 1), tables["pairs"]
        often = np.flatnonzero((n > pair_discount).any(0))
        names = pa.array(up, pa.string())
        v, w = (pc.index_in(c.take(pa.array(often)), value_set=names).to_numpy().astype(np.int64) for c in (first, second))
        kept = np.maximum(n[:, often] - pair_discount, 0)
        left = np.stack([np.bincount(v, k, size) for k in kept])
        both = (left > 0).all(0)
        seen = tables["seen"] if len(up) else np.zeros((2, 1))
        spare = np.where(both, 1 - (left / np.maximum(seen, 1)).mean(0), 1.0)
        use = np.flatnonzero(both[v])
        use = use[np.argsort(v[use] * size + w[use])]
        share = (1 - spare[v[use]]) * kept[:, use] / left[:, v[use]]
        return cls(up, ratios, below, v[use] * size + w[use], share, spare)

    def probabilities(self, text: list[str]) -> np.ndarray:
        """P of each word after the one before it, in both classes; unknown words have the ratio of their beginning."""
        return self._probabilities(self.numbers(text), np.arange(len(text)) == 0)

    def _probabilities(self, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``probabilities`` of numbers of words; ``first`` marks those that begin a text."""
        known, size = w >= 0, max(len(self.index), 1)
        p = np.ones((2, len(w)))
        p[:, known] = self.word_p[:, w[known]]
        p[1, ~known] = self.unknown[-1 - w[~known]]
        if len(self.pairs):
            after = np.flatnonzero(known[:-1] & known[1:] & ~first[1:])
            v = w[after]
            key = v * size + w[after + 1]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            p[:, after + 1] = np.where(self.pairs[at] == key, self.pair_kept[:, at], 0.0) + self.spare[v] * p[:, after + 1]
        return p

    def _features(self, texts: list[np.ndarray]) -> np.ndarray:
        """``features`` of texts as numbers of words, all at once."""
        x = np.zeros((len(texts), 1 + len(PASSAGES)))
        size = np.array([len(t) for t in texts], dtype=np.int64)
        some = np.flatnonzero(size)
        if not len(some):
            return x
        size, w = size[some], np.concatenate(texts)
        at = np.cumsum(size) - size
        first = np.zeros(len(w), dtype=bool)
        first[at] = True
        p = self._probabilities(w, first)
        ratio = np.log(p[1]) - np.log(p[0])
        base = at + np.arange(len(at))
        r = np.zeros(len(w) + len(at))  # sums from the start of each text, which has its 0 at base
        for i, b, n in zip(at.tolist(), base.tolist(), size.tolist()):
            np.cumsum(ratio[i : i + n], out=r[b + 1 : b + 1 + n])
        x[some, 0] = r[base + size] / size
        for k, n in enumerate(PASSAGES, 1):
            step = max(n // 2, 1)
            starts = -(-np.maximum(size - n // 2, 1) // step)
            of = np.cumsum(starts) - starts
            low = (np.arange(starts.sum()) - np.repeat(of, starts)) * step
            b = np.repeat(base, starts)
            x[some, k] = np.maximum.reduceat(r[b + np.minimum(low + n, np.repeat(size, starts))] - r[b + low], of) / n
        return x

    def features(self, text: list[str]) -> tuple[float, ...]:
        """Length-normalised log-likelihood of the text, toxic less ordinary, and that of its most toxic passage of each length."""
        return tuple(self._features([self.numbers(text)])[0].tolist())

    def features_of(self, texts: list[str]) -> np.ndarray:
        """``features`` of the words of each text."""
        found = [self._features([self.numbers(t) for t in some]) for some in some_at_once(texts)]
        return np.concatenate([np.zeros((0, 1 + len(PASSAGES))), *found])


def _one_of_each(texts: list[np.ndarray]) -> list[int]:
    """Indexes of texts that share no band of MinHash values with an earlier one, as ``one_of_near_copies`` has them."""
    seen: set[int] = set()
    kept = []
    for i, t in enumerate(texts):
        marks = set(bands(t))
        if not marks & seen:
            kept.append(i)
        seen |= marks
    return kept


def numbered(texts: Iterable[str]) -> tuple[list[np.ndarray], list[str]]:
    """The words of each text as numbers, and the words."""
    index: dict[str, int] = {}
    return [np.array([index.setdefault(w, len(index)) for w in words(t)], dtype=np.int64) for t in texts], list(index)


def unseen_features(texts: list[np.ndarray], labels: np.ndarray, names: list[str], folds: int, **settings: float) -> np.ndarray:
    """Features of each text by models of the texts in the other folds."""
    part = np.arange(len(texts)) % folds
    x = np.zeros((len(texts), 1 + len(PASSAGES)))
    for k in range(folds):
        model = KneserNey.fit([t for t, p in zip(texts, part) if p != k], labels[part != k], names, **settings)
        for i in np.flatnonzero(part == k):
            x[i] = model.features([names[w] for w in texts[i]])
    return x


def train(sample: pd.DataFrame, share: float | None = None, folds: int = 3) -> KneserNey:
    """The models of labelled texts in memory, to choose settings by; what turns their ratios into a probability is learned on texts that a part model has not seen.

    Copies and near copies within the sample would pass chance words off as evidence, so
    one of each is learned from. ``share`` is the part of toxic rows among all labelled
    ones, which a sample drawn by class doesn't show. ``learned`` does the same in
    Spark, over all rows.
    """
    texts, names = numbered(sample["text"])
    kept = _one_of_each(texts)
    texts, labels = [texts[i] for i in kept], sample["label"].to_numpy()[kept]
    x = unseen_features(texts, labels, names, folds)
    model = KneserNey.fit(texts, labels, names)
    model.weights = fit_logistic(x, labels)
    model.weights[-1] += prior_shift(labels, share)
    return model


def cross_validated_loss(sample: pd.DataFrame, share: float, folds: int = 5, **settings: float) -> float:
    """Log loss of texts that neither models nor logistic weights have seen, classes weighted to ``share``.

    By it the settings were chosen, on learning rows alone: discounts among 1, 2, 3 and 5
    and (for pairs) 2, 4, 8 and 16 first, then ``PASSAGES``, then ``STEMS``.
    """
    texts, names = numbered(sample["text"])
    kept = _one_of_each(texts)
    texts, labels = [texts[i] for i in kept], sample["label"].to_numpy()[kept]
    x, part, loss = unseen_features(texts, labels, names, folds, **settings), np.arange(len(texts)) % folds, 0.0
    of = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    for k in range(folds):
        w = fit_logistic(x[part != k], labels[part != k])
        w[-1] += prior_shift(labels[part != k], share)
        p = sigmoid(np.column_stack([x[part == k], np.ones((part == k).sum())]) @ w)
        loss -= (of[part == k] * np.log(np.where(labels[part == k] == 1, p, 1 - p))).sum()
    return float(loss / len(texts))


def score_texts(model: KneserNey, texts: list[str]) -> np.ndarray:
    return sigmoid(np.column_stack([model.features_of(texts), np.ones(len(texts))]) @ model.weights)


_built: dict[str, KneserNey] = {}


def _model_of(counts: dict, m: int = FOLDS) -> KneserNey:
    """The model without fold ``m``, or of all rows, made once in a worker."""
    key = f"{counts['key']}-{m}"
    if key not in _built:
        if len(_built) >= FOLDS:
            _built.clear()
        _built[key] = KneserNey.of_tables(model_tables(counts, m, DISCOUNT))
    model = _built[key]
    model.weights = counts.get("weights")
    return model


def _features_of(counts: dict, b: pa.RecordBatch) -> pa.RecordBatch:
    texts, folds, x = b.column("text").to_pylist(), b.column("fold").to_numpy(), np.zeros((b.num_rows, 1 + len(PASSAGES)))
    for m in range(FOLDS):
        mine = np.flatnonzero(folds == m)
        if len(mine):
            x[mine] = _model_of(counts, m).features_of([texts[i] for i in mine])
    return pa.RecordBatch.from_arrays([b.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def learned(docs: DataFrame, labels: DataFrame) -> dict:
    """What ``_model_of`` makes the model of, learned from every labelled document that is not held out.

    Of near copies the smallest id is learned from. Words and pairs are counted by label
    and fold; the logistic weights come from sums over partitions of the features that
    models without a text's fold give it. The driver gets the words and pairs that a class
    has more often than the discounts, and sums; models are made of them in tasks.
    """
    texts, share = labelled_rows(docs, labels, "toxic")
    kept = one_of_near_copies(texts)
    counts = word_counts(kept, PAIR_DISCOUNT)
    found = model_counts(counts, STEMS, DISCOUNT)
    held = docs.sparkSession.sparkContext.broadcast(found)
    x = written(map_batches(kept, lambda b: _features_of(held.value, b), "label int, x array<double>"), "toxicity-features")
    held.destroy()
    weights, toxic = fit_logistic_rows(x, 1 + len(PASSAGES))
    weights[-1] += prior_shift(toxic, share)
    deleted(kept, counts, x)
    return found | {"weights": weights}


def toxicity_model(docs: DataFrame, labels: DataFrame) -> KneserNey:
    """The model that ``toxicity`` scores with."""
    return _model_of(learned(docs, labels))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    The models learn from all labelled documents that are not held out, whole texts (see
    ``learned``); whole texts are scored. Nulls and edges: a null text is the empty text and gets the
    score of no evidence; a null ``doc_id`` is not held out; repeated rows get the same
    score; without labels of both classes every score is the same; an empty table gives
    an empty result; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))
    return scored(docs, lambda texts: score_texts(_model_of(held.value), texts), 0.5)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose toxicity is below ``threshold``, all columns."""
    held = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))

    def keep(b: pa.RecordBatch) -> pa.RecordBatch:
        p = score_texts(_model_of(held.value), [x or "" for x in b.column("text").to_pylist()])
        return b.filter(pa.array(p < threshold))

    return map_batches(docs, keep, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
