"""Word and pair counts of labelled texts, and models of words from them, over every learning row.

Counts are kept by label and fold, so the models of all rows and those that leave out one
fold come from one table.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.common import deleted, map_batches, shuffles_dropped, written

_WORD = re.compile(r"\w+")
FOLDS = 3
#: MinHash values of a text, and how many of them two texts share in a row to be near copies.
HASHES, BAND = 6, 2
#: Words and pairs that a counting task holds before it hands them on.
HELD_KEYS, HELD_WORDS = 4_000_000, 400_000
#: Pairs are counted in as many passes, by second word, so that the shuffle on disk stays well below the input.
PASSES = 2
_TURNS = np.random.default_rng(3).integers(1, 1 << 62, (HASHES, 4), dtype=np.uint64) | np.uint64(1)
_CELLS = range(2 * FOLDS)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("_", " "))


def some_at_once(texts: Iterable[str], most: int = 1 << 16) -> Iterator[list[list[str]]]:
    """The words of texts, for as many at once as have about ``most`` words together, one text at least."""
    found, held = [], 0
    for t in texts:
        found.append(words(t))
        held += len(found[-1])
        if held >= most:
            yield found
            found, held = [], 0
    if found:
        yield found


def bands_of(texts: list[np.ndarray]) -> list[list[int]]:
    """For each text digests of each ``BAND`` MinHash values of three-word shingles; numbers stand for words."""
    size = np.array([max(len(t), 3) for t in texts], dtype=np.int64)
    at = np.cumsum(size) - size
    flat = np.zeros(size.sum() + 2, dtype=np.int64)
    for i, t in zip(at.tolist(), texts):
        flat[i : i + len(t)] = t
    t = flat.astype(np.uint64) + np.uint64(1)
    own = np.column_stack([at, at + size - 2]).ravel()  # shingles that begin in one text and end in the next lie between
    low = np.stack([np.minimum.reduceat((t[:-2] * a + t[1:-1] * b + t[2:] * c) * d >> np.uint64(20), own)[::2] for a, b, c, d in _TURNS], axis=1)
    digest = lambda k, x: int.from_bytes(hashlib.blake2b(bytes([k]) + x[k : k + BAND].tobytes(), digest_size=8).digest(), "little", signed=True)
    return [[digest(k, x) for k in range(0, HASHES, BAND)] for x in low]


def bands(numbers: np.ndarray) -> list[int]:
    """``bands_of`` one text."""
    return bands_of([numbers])[0]


def _with_bands(b: pa.RecordBatch) -> pa.RecordBatch:
    found = []
    for texts in some_at_once(b.column("text").to_pylist()):
        found += bands_of([np.array([zlib.crc32(w.encode()) for w in t], dtype=np.int64) for t in texts])
    return b.append_column("bands", pa.array(found, pa.list_(pa.int64())))


def one_of_near_copies(texts: DataFrame) -> DataFrame:
    """``(doc_id, label, fold, text)``, written: texts of ``(doc_id, label, text)`` that share no band with a smaller ``doc_id``."""
    found = written(map_batches(texts, _with_bands, "doc_id long, label int, text string, bands array<long>"), "learning-texts")
    shuffles_dropped(texts.sparkSession)
    first = found.select("doc_id", F.explode("bands").alias("band")).groupBy("band").agg(F.min("doc_id").alias("doc_id"))
    first = first.groupBy("doc_id").count().where(F.col("count") == HASHES // BAND).select("doc_id")
    kept = found.join(first, "doc_id").select("doc_id", "label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    kept = written(kept, "one-of-each")
    deleted(found)
    shuffles_dropped(texts.sparkSession)
    return kept


class _Numbers(dict):
    """Numbers of words as they come; modulo ``PASSES`` a number tells the pass of its word."""

    def __missing__(self, word: str) -> int:
        n = self[word] = (len(self) + 1) * PASSES + zlib.crc32(word.encode()) % PASSES
        return n


def _distinct(x: np.ndarray) -> np.ndarray:
    """``np.unique`` with less to do for short arrays."""
    x = np.sort(x)
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _counted(turn: int):
    """``(v, w, cell, n)``: documents of a cell that have ``w`` after ``v``; those with ``w`` where ``v`` is null.

    Only words ``w`` of one pass count. A cell is ``label * FOLDS + fold``; in the cells beyond
    ``_CELLS`` ``n`` is how many different pairs of the pass the documents have whose first word is ``w``.
    """

    def all_of(index: _Numbers, keys: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names = pa.array([None, *index], pa.string())
        for cell, found in enumerate(keys):
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                for lo in range(0, len(key), 50_000):
                    k = key[lo : lo + 50_000]
                    columns = [names.take(pa.array((k >> 32) // PASSES)), names.take(pa.array((k & 0xFFFFFFFF) // PASSES)), pa.array(np.full(len(k), cell, np.int32)), pa.array(n[lo : lo + 50_000])]
                    yield pa.RecordBatch.from_arrays(columns, names=["v", "w", "cell", "n"])
                found.clear()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = _Numbers(), 0
        keys: list[list[np.ndarray]] = [[] for _ in range(2 * len(_CELLS))]
        for b in batches:
            for text, label, fold in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), b.column("fold").to_pylist()):
                t, cell = np.array([index[w] for w in words(text)], dtype=np.int64), label * FOLDS + fold
                mine = t % PASSES == turn
                pairs = _distinct((t[:-1] << 32 | t[1:])[mine[1:]])
                keys[cell] += [_distinct(t[mine]), pairs]
                keys[cell + len(_CELLS)].append(pairs >> 32)
                held += 3 * len(pairs)
                if held > HELD_KEYS or len(index) > HELD_WORDS:
                    yield from all_of(index, keys)
                    index, held = _Numbers(), 0
        yield from all_of(index, keys)

    return run


def word_counts(texts: DataFrame, pair_discount: float) -> DataFrame:
    """``(v, w, n0.., s0.., f0..)``, written: one row for each word (``v`` null), and for each pair above the discount.

    ``n`` are documents by cell, ``s`` different pairs in them that begin with the word,
    ``f`` different words before it in all folds but one, and in all folds.
    """
    n, s, f = ([f"{k}{i}" for i in range(size)] for k, size in (("n", len(_CELLS)), ("s", len(_CELLS)), ("f", FOLDS + 1)))
    none = lambda names: [F.lit(0).cast("long").alias(c) for c in names]
    present = [F.when(sum(F.col(n[i]) for i in _CELLS if i % FOLDS != m) > 0, 1).otherwise(0).cast("long").alias(f[m]) for m in range(FOLDS + 1)]
    word = F.struct(F.lit(None).cast("string").alias("v"), "w", *n, *s, *none(f))
    before = F.struct(F.lit(None).cast("string").alias("v"), "w", *none(n), *none(s), *present)
    pair = F.struct("v", "w", *n, *none(s), *none(f))
    often = (sum(F.col(c) for c in n[:FOLDS]) > pair_discount) | (sum(F.col(c) for c in n[FOLDS:]) > pair_discount)
    parts = []
    for turn in range(PASSES):
        found = texts.select("text", "label", "fold").mapInArrow(_counted(turn), "v string, w string, cell int, n long").repartition("v", "w")
        cells = found.groupBy("v", "w").agg(*(F.sum(F.when(F.col("cell") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(n + s)))
        rows = cells.select(F.explode(F.when(F.col("v").isNull(), F.array(word)).when(often, F.array(before, pair)).otherwise(F.array(before))).alias("r")).select("r.*")
        parts.append(written(rows.groupBy("v", "w").agg(*(F.sum(c).alias(c) for c in n + s + f)), "word-counts"))
        shuffles_dropped(texts.sparkSession)
    out = reduce(DataFrame.unionByName, parts).groupBy("v", "w").agg(*(F.sum(c).alias(c) for c in n + s + f))
    out = written(out, "word-counts")
    deleted(*parts)
    return out


def _by_model(of: str, label: int, m: int) -> F.Column:
    """The sum of a label's cells over all folds but ``m``."""
    return sum(F.col(f"{of}{label * FOLDS + f}") for f in range(FOLDS) if f != m)


def model_counts(counts: DataFrame, stems: tuple[int, ...], discount: float) -> dict:
    """What ``model_tables`` makes models of, as Arrow tables: items that a class has in more than ``discount`` documents, and sums over all.

    ``levels`` are beginnings of each length, and whole forms. Items below the discount
    give their class nothing of its own, so they stay in Spark.
    """
    models = range(FOLDS + 1)
    n = [f"n{y}_{m}" for y in (0, 1) for m in models]
    f = [f"f{m}" for m in models]
    of = lambda k: [_by_model(k, y, m).alias(f"{k}{y}_{m}") for y in (0, 1) for m in models]
    all_words = counts.where("v is null").select("w", *of("n"), *of("s"), *f)
    for m in models:  # one for the unknown word before it
        all_words = all_words.withColumn(f"f{m}", F.when(F.col(f"n0_{m}") + F.col(f"n1_{m}") > 0, F.col(f"f{m}") + 1).otherwise(0))
    out: dict = {"key": uuid.uuid4().hex, "levels": []}
    for size in (*stems, None):
        level = all_words if size is None else all_words.groupBy(F.substring("w", 1, size).alias("w")).agg(*(F.sum(c).alias(c) for c in n + f))
        sums = level.agg(*(F.sum(c).alias(c) for c in n + f), *(F.sum(F.greatest(F.col(c) - discount, F.lit(0))).alias(f"k_{c}") for c in n)).first().asDict()
        items = level.where(F.greatest(*(F.col(f"n{y}_{FOLDS}") for y in (0, 1))) > discount).orderBy("w")
        out["levels"].append((items.withColumns({c: F.col(c).cast("int") for c in n + f}).toArrow(), sums))
    out["pairs"] = counts.where("v is not null").select("v", "w", *(c.cast("int").alias(k) for c, k in zip(of("n"), n))).toArrow()
    return out


def model_tables(found: dict, m: int, discount: float) -> dict:
    """What the model without fold ``m`` is made of; for ``m = FOLDS``, the model of all rows.

    ``levels`` has names, documents by class and mass of the items, and the sums over all
    items of documents, of documents above the discount, and of mass. ``seen`` belongs to
    the last level.
    """
    both = lambda t, k: np.stack([t.column(f"{k}{y}_{m}").to_numpy() for y in (0, 1)]).astype(float)
    out: dict = {"levels": []}
    for items, sums in found["levels"]:
        here = both(items, "n")
        used = np.flatnonzero((here > discount).any(0))
        out["levels"].append(
            {
                "names": items.column("w").take(pa.array(used)).to_pylist(),
                "here": here[:, used],
                "mass": items.column(f"f{m}").to_numpy()[used].astype(float),
                "all_here": np.array([float(sums[f"n{y}_{m}"] or 0) for y in (0, 1)]),
                "all_kept": np.array([float(sums[f"k_n{y}_{m}"] or 0) for y in (0, 1)]),
                "all_mass": float(sums[f"f{m}"] or 0),
            }
        )
    out["seen"] = both(items, "s")[:, used]
    out["pairs"] = (found["pairs"].column("v"), found["pairs"].column("w"), both(found["pairs"], "n"))
    return out
