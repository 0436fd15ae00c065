"""Importance resampling towards a target distribution, counted line by line."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arealis.llm.common import documents, map_batches, table, written
from arealis.llm.conversation_trie import CRC_TABLE_SQL, crc_sql

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_UPPER))


class Buckets:
    """The bucket of each run of one to ``n`` words: CRC-32 of its bytes modulo ``size``."""

    def __init__(self, n: int, size: int, remembered: int = 200_000):
        self.n, self.size, self.remembered, self.known = n, size, remembered, {}

    def of(self, run: str) -> int:
        b = self.known.get(run)
        if b is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            b = self.known[run] = zlib.crc32(run.encode()) % self.size
        return b

    def within(self, line: list[str]) -> list[int]:
        """Of all runs inside a line."""
        return [self.of(" ".join(line[i : i + k]) if k > 1 else line[i]) for k in range(1, self.n + 1) for i in range(len(line) - k + 1)]

    def across(self, lines: list[list[str]]) -> list[int]:
        """Of all runs that begin in one line and end in a later one."""
        flat = [w for line in lines for w in line]
        line_of = [k for k, line in enumerate(lines) for _ in line]
        ends = {i for i in range(1, len(flat)) if line_of[i] != line_of[i - 1]}  # places before which a line begins
        starts = sorted({i for e in ends for i in range(max(0, e - self.n + 1), e)})
        return [self.of(" ".join(flat[i : i + k])) for i in starts for k in range(2, self.n + 1) if i + k <= len(flat) and line_of[i] != line_of[i + k - 1]]


_LINE = "line binary, occurrences long, n_words long, buckets array<int>"


def line_features(texts: DataFrame, n: int, size: int) -> DataFrame:
    """``(line, occurrences, n_words, buckets)``: each distinct line of ``texts(text)`` once, by digest."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("s")).groupBy("s").agg(F.count("*").alias("occurrences"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(n, size)
        for b in batches:
            found = [words(s) for s in b.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("line"), b.column("occurrences"), pa.array([len(w) for w in found], pa.int64()), pa.array([buckets.within(w) for w in found], pa.list_(pa.int32()))], names=["line", "occurrences", "n_words", "buckets"])

    return written(lines.select(line_digest("s").alias("line"), "occurrences", "s").mapInArrow(run, _LINE), "lines")


def line_digest(column: str):
    return F.unhex(F.sha2(F.col(column).cast("binary"), 256))


def cross_features(texts: DataFrame, n: int, size: int) -> DataFrame:
    """``(…, buckets)``: for each row of ``texts`` with a line feed its runs over line ends; none for ``n`` of 1."""
    kept = [c for c in texts.columns if c != "text"]
    schema = ", ".join([*(f"{c} {t}" for c, t in texts.dtypes if c != "text"), "buckets array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(n, size)
        for b in batches:
            found = [buckets.across([words(s) for s in t.split("\n")]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, pa.list_(pa.int32()))], names=[*kept, "buckets"])

    return texts.where(F.contains("text", F.lit("\n"))).mapInArrow(run, schema)


def bucket_counts(lines: DataFrame, across: DataFrame | None, size: int) -> np.ndarray:
    """How often each bucket's features occur: distinct lines times their occurrences, and runs over line ends. ``size`` numbers reach the driver."""
    each = lines.select(F.explode("buckets").alias("b"), F.col("occurrences").alias("k"))
    if across is not None:
        each = each.unionByName(across.select(F.explode("buckets").alias("b"), F.lit(1).cast("long").alias("k")))
    out = np.zeros(size, dtype=np.int64)
    for r in each.groupBy("b").agg(F.sum("k").alias("k")).collect():
        out[r.b] = r.k
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + size) / ((s + 1)(T + size))))`` of each bucket."""
    size, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_s + size) / (float(s + 1) * float(all_t + size)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def _sums(buckets: pa.Array, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each list its length and the sum of its gains."""
    ends = np.asarray(buckets.offsets)
    run = np.r_[0, np.cumsum(gains[np.asarray(buckets.values)])] if len(buckets.values) else np.zeros(1, np.int64)
    return np.diff(ends).astype(np.int64), run[ends[1:]] - run[ends[:-1]]


def importance(docs: DataFrame, target: DataFrame, n: int = 1, size: int = 10_000) -> DataFrame:
    """``(doc_id, sha, copies, n_words, n_features, weight)``: how much likelier a text is under ``target`` than under ``docs``.

    Features are all runs of one to ``n`` words, hashed into ``size`` buckets. Line feeds
    cut texts into lines; what a line holds is counted once for all its occurrences, and
    so is its weight; runs that cross line ends are added for each document. Lines are
    told apart by SHA-256. Rows of the same ``doc_id`` and text are one row with their
    number as ``copies``.
    """
    clean = lambda df, *cols: df.select(*cols, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = clean(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("sha", line_digest("text")).select("doc_id", "sha", "text")
    lines = line_features(clean(docs), n, size)
    wanted = clean(target)
    across = written(cross_features(rows, n, size), "across") if n > 1 else None
    source = bucket_counts(lines, across, size)
    gains = bucket_gains(source, bucket_counts(line_features(wanted, n, size), cross_features(wanted, n, size) if n > 1 else None, size))

    def weigh(b: pa.RecordBatch) -> pa.RecordBatch:
        k, w = _sums(b.column("buckets"), gains)
        return pa.RecordBatch.from_arrays([b.column("line"), b.column("n_words"), pa.array(k), pa.array(w)], names=["line", "n_words", "n_features", "weight"])

    def weigh_rows(b: pa.RecordBatch) -> pa.RecordBatch:
        k, w = _sums(b.column("buckets"), gains)
        none = pa.array(np.zeros(len(k), np.int64))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sha"), none, none, pa.array(k), pa.array(w)], names=["doc_id", "sha", "first", "n_words", "n_features", "weight"])

    weights = map_batches(lines, weigh, "line binary, n_words long, n_features long, weight long")
    held = rows.select("doc_id", "sha", F.posexplode(F.split("text", "\n")).alias("i", "s")).groupBy("doc_id", "sha", line_digest("s").alias("line")).agg(F.count("*").alias("k"), F.sum((F.col("i") == 0).cast("long")).alias("first"))
    each = held.join(weights, "line").select("doc_id", "sha", "first", *((F.col(c) * F.col("k")).alias(c) for c in ("n_words", "n_features", "weight")))
    if across is not None:
        each = each.unionByName(map_batches(across, weigh_rows, "doc_id long, sha binary, first long, n_words long, n_features long, weight long"))
    sums = each.groupBy("doc_id", "sha").agg(F.sum("first").alias("copies"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    return sums.select("doc_id", "sha", "copies", *(F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")))


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, size: int = 10_000, seed: int = 2024, min_words: int = 20, percent: int = 10) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row: a draw without replacement by Gumbel top-k.

    A score is the weight plus ``floor(-1000 ln(-ln u))``, where ``u`` comes from
    SHA-256 of the seed and ``doc_id``. Of the documents with ``min_words`` words or more
    ``percent`` in a hundred, rounded down, with the highest scores are drawn and ranked
    from 1, ties to the smaller ``doc_id``; others have no rank. Ranks are counted
    within ranges of scores and shifted by the ranges before (a row for each range).

    Nulls and edges: a null or empty text has no features and weight 0; a null
    ``doc_id`` is drawn as an empty id and comes first in ties; rows of the same id tie
    by text; equal rows get consecutive ranks; an empty target is flat; an empty table
    gives an empty result; other columns are ignored.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = written(importance(docs, target, n, size).withColumn("score", F.col("weight") + noise), "scores")
    fit = rows.where(F.col("n_words") >= min_words)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("sha")]
    ranged = written(fit.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("part").agg(F.sum("copies").alias("n"))
    run = Window.orderBy("part")  # a row for each range
    parts = parts.select("part", (F.sum("n").over(run) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    first = F.sum("copies").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    ranked = ranged.withColumn("first", first).join(F.broadcast(parts), "part").withColumn("drawn", F.floor(F.col("all") * percent / 100)).withColumn("first", F.col("first") + F.col("before"))
    columns = ("doc_id", "n_features", "weight", "score", "copies")
    none = F.lit(None).cast("long")
    both = ranked.select(*columns, "first", "drawn").unionByName(rows.where(F.col("n_words") < min_words).select(*columns, none.alias("first"), none.alias("drawn")))
    each = both.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rank = F.col("first") + F.col("k")
    return each.select("doc_id", "n_features", "weight", "score", F.when(rank <= F.col("drawn"), rank).alias("rank"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH {CRC_TABLE_SQL.strip()},
d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
dw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS_SQL}) AS word FROM benchmark) GROUP BY word),
known AS (SELECT word, {crc_sql("word", "crc.t")} % 10000 AS b FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT b, sum(n) AS s FROM dw JOIN known USING (word) GROUP BY b),
t AS (SELECT b, sum(n) AS t FROM bw JOIN known USING (word) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE)
        / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)),
x AS (SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN known USING (word) JOIN g USING (b) GROUP BY doc_id),
y AS (SELECT d.doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN x USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (doc_id)
"""
