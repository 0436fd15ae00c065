"""Lines that many documents share, kept in one of them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.common import SPACE, documents, map_batches, written

#: Ids that are null sort below every other id.
NO_ID = -(2**63)


def split_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def line_key(line: str) -> bytes:
    """White space stripped at both ends, A-Z lower-cased, as UTF-8."""
    return line.strip(SPACE).encode().lower()


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the row key ``_doc, _body``: rows with the same id and text are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_body": F.xxhash64(text), "_text": text})


def _line_rows(min_chars: int):
    def rows(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out: dict[tuple[bytes, int, int], list[int]] = {}
        for doc, body, text in zip(*(b.column(c).to_pylist() for c in ("_doc", "_body", "_text"))):
            for at, line in enumerate(split_lines(text)):
                if len(line) >= min_chars and len(line.strip(SPACE)) >= min_chars:
                    out.setdefault((xxhash.xxh3_128_digest(line_key(line)), doc, body), []).append(at)
        if not out:
            return None
        keys = np.frombuffer(b"".join(k[0] for k in out), dtype="<i8").reshape(-1, 2)
        arrays = [keys[:, 0], keys[:, 1], [k[1] for k in out], [k[2] for k in out], list(out.values())]
        types = [pa.int64()] * 4 + [pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types)], names=["h1", "h2", "doc", "body", "at"])

    return rows


_DECIDED = "h1 long, h2 long, doc long, body long, at array<int>, drop boolean, part_docs long"


def _stream(min_docs: int):
    """Decide the rows of a sorted partition while they pass; returns rows to drop and open ones.

    A key's first row has its largest document, and its rows wait only until
    ``min_docs`` documents have been seen. The partition's first key may have begun in
    an earlier partition and its last key may go on in a later one: their undecided
    rows leave with ``drop`` null, and a row with the largest document and the number
    of documents (``part_docs``) tells this partition's share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, docs, top, last, wait = None, True, 0, None, None, []
        for b in batches:
            h1, h2, doc = (b.column(c).to_numpy() for c in ("h1", "h2", "doc"))
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if b.num_rows else []
            if not b.num_rows:
                continue
            length = np.diff(np.r_[starts, len(h1)])
            look = (length > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)
            rows = np.flatnonzero(np.repeat(look, length))  # a key seen once, inside the batch, has one document
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.take(pa.array(rows)).columns)):
                if row[:2] != key:
                    if key is not None and first:
                        out.append((*key, top, None, None, None, docs))
                    first = key is None
                    key, docs, top, last, wait = row[:2], 0, row[2], None, []
                if row[2] != last:
                    docs, last = docs + 1, row[2]
                if first:
                    out.append((*row, None, None))
                elif docs < min_docs:
                    wait.append(row)
                else:
                    out += [(*r, True, None) for r in (*wait, row) if r[2] != top]
                    wait = []
            if out:
                yield _batch(out)
        if key is not None:
            yield _batch([*((*r, None, None) for r in wait), (*key, top, None, None, None, docs)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.bool_(), pa.int64()]
    names = ["h1", "h2", "doc", "body", "at", "drop", "part_docs"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The lines to drop: ``(doc, body, at)`` with the positions of one key in one document.

    A line's key has at least ``min_chars`` code points and stands in at least
    ``min_docs`` (2 or more) documents; its lines stay only in the largest ``doc_id``
    that has it. Keys become 128-bit hashes, one row for each key and document. Rows
    are dealt by range over hash *and* document, so a line that a third of all
    documents share is spread over many partitions, each of which streams its rows.
    What the partitions say about the keys at their ends is at most two rows each, and
    so small enough to broadcast.
    """
    if min_docs < 2:
        raise ValueError("min_docs is 2 at least")
    rows = map_batches(keyed(docs).select("_doc", "_body", "_text"), _line_rows(min_chars), "h1 long, h2 long, doc long, body long, at array<int>")
    by = ["h1", "h2", F.desc("doc")]
    seen = written(rows.repartitionByRange(*by).sortWithinPartitions(*by, "body").mapInArrow(_stream(min_docs), _DECIDED), "line-rows")
    ends = seen.where("part_docs is not null").groupBy("h1", "h2").agg(F.sum("part_docs").alias("docs"), F.max("doc").alias("top")).where(F.col("docs") >= min_docs)
    open_rows = seen.where("part_docs is null and drop is null").join(F.broadcast(ends), ["h1", "h2"]).where("doc != top")
    return seen.where("drop").select("doc", "body", "at").unionByName(open_rows.select("doc", "body", "at"))


def _bitmap(dropped: pd.Series) -> pd.Series:
    """zlib-packed bits, 1 for a line that stays; lines past the last bit stay."""

    def one(at) -> bytes:
        keep = np.ones(max(at) // 8 * 8 + 8, dtype=bool)  # whole bytes: no bit is padding
        keep[np.asarray(at)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return dropped.map(one)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``(doc, body, bitmap)`` for each document that loses lines; others have no row."""
    lines = shared_lines(docs, min_chars, min_docs)
    return lines.groupBy("doc", "body").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")).select("doc", "body", F.pandas_udf(_bitmap, "binary")("at").alias("bitmap"))


def kept_lines(text: str, bitmap: bytes | None) -> list[str]:
    lines = text.split("\n")
    if bitmap is None:
        return lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))
    return [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]]


def _with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    maps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc").alias("_doc"), F.col("body").alias("_body"), F.col("bitmap").alias("_bitmap"))
    return keyed(docs).join(maps, ["_doc", "_body"], "left")


def _kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(kept_lines(t, b)) for t, b in zip(text, bitmap)])


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the shared lines taken out of ``text``; all other columns as they were.

    Nulls and edges: a null text is one empty line and stays null; a null ``doc_id`` is
    below every other id; rows with the same id and text are one document, rows with
    the same id and other text count once; a document may become empty; an empty table
    gives an empty result; columns with names of other tables pass through.
    """
    names = [f"`{c}`" for c in docs.columns]
    new = F.when(F.col("_bitmap").isNull(), F.col("text")).otherwise(F.pandas_udf(_kept_text, "string")("_text", "_bitmap"))
    return _with_bitmaps(docs, min_chars, min_docs).select(*(new.alias("text") if c == "`text`" else c for c in names))


def _digest(b: pa.RecordBatch) -> pa.RecordBatch:
    lines, dropped, sha = [], [], []
    for text, bitmap in zip(b.column("_text").to_pylist(), b.column("_bitmap").to_pylist()):
        kept = kept_lines(text, bitmap)
        lines.append(text.count("\n") + 1)
        dropped.append(lines[-1] - len(kept))
        sha.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op3(spark, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in five documents or more go but for the last; keys are compared as 128-bit hashes."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(_with_bitmaps(docs, 40, 5).select("doc_id", "_text", "_bitmap"), _digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, hot.k IS NOT NULL AND doc_id <> top AS dropped FROM keyed LEFT JOIN hot USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
