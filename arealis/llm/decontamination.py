"""Documents that contain items of a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm.common import documents, table, written
from arealis.llm.native_text import lower_ascii, shingles, spaced_words

#: An index of at most so many rows is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000


def _shingled(df: DataFrame, key: str) -> DataFrame:
    words = df.select(F.col(key).cast("long").alias(key), spaced_words(lower_ascii(F.col("text").cast("string"))).alias("words"))
    # explode_outer below: explode would let the optimizer test the arrays' sizes before
    # it has them, and so split each text again for every shingle
    return words.select(key, shingles(F.col("words")).alias("shingles"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_index(benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``(item_id, shingle, n, need, sketch)`` of the items.

    ``need`` is the least number of an item's ``n`` shingles that a match has. The
    sketch is the item's bottom MinHash values, as many as its size asks for: a document
    that lacks all of them has at most ``need - 1`` shingles of the item, so looking up
    the sketch alone loses no match.
    """
    rows = _shingled(benchmark, "item_id").select("item_id", F.explode_outer("shingles").alias("shingle")).where("shingle is not null").distinct()
    by = Window.partitionBy("item_id")
    rows = rows.withColumn("n", F.count("*").over(by)).withColumn("need", F.ceil(F.col("n") * F.lit(threshold)).cast("long"))
    place = F.row_number().over(by.orderBy(F.xxhash64("shingle"), "shingle"))
    return rows.withColumn("sketch", place <= F.col("n") - F.col("need") + 1)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_common, containment)`` for each item a document contains.

    An item is contained if at least ``threshold`` of its distinct five-word shingles
    stand in the document, whatever the document's length. Documents that meet an
    item's sketch and have enough shingles are candidates; these alone are read again
    and compared with the items shingle by shingle.

    Nulls and edges: null and empty texts contain nothing and are contained nowhere; an
    item of fewer than five words is one shingle, found only in a document that is as
    short; rows that share a ``doc_id`` (null is one, too) or an ``item_id`` are taken
    together; empty tables give an empty result; other columns are ignored.
    """
    index = written(item_index(benchmark, threshold), "items")
    seen = _shingled(docs, "doc_id")
    sketch = _small(index.where("sketch").select("item_id", "shingle", "need"))
    near = seen.select("doc_id", F.explode_outer("shingles").alias("shingle")).join(sketch, "shingle")
    candidates = written(near.select("doc_id").distinct(), "candidates").withColumnRenamed("doc_id", "candidate")
    again = docs.join(candidates, F.col("doc_id").cast("long").eqNullSafe(F.col("candidate")), "left_semi")
    pairs = _shingled(again, "doc_id").select("doc_id", F.explode_outer(F.array_distinct("shingles")).alias("shingle")).distinct().join(_small(index.select("item_id", "shingle", "n", "need")), "shingle")
    found = pairs.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_common"), F.max("n").alias("n_shingles"), F.max("need").alias("need"))
    return found.where("n_common >= need").select("doc_id", "item_id", "n_shingles", "n_common", (F.col("n_common") / F.col("n_shingles")).alias("containment"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns."""
    bad = written(contaminated(docs, benchmark, threshold).select("doc_id").distinct(), "contaminated").withColumnRenamed("doc_id", "bad_id")
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("bad_id")), "left_anti")


def op7(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


SHINGLES_SQL = r"""
CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"""
WORDS_SQL = r"""
list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest({SHINGLES_SQL}) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest({SHINGLES_SQL}) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_common, n_common / n_shingles AS containment
FROM c JOIN n USING (item_id) WHERE 4 * n_common >= 3 * n_shingles
"""
