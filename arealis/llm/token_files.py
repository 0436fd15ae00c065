"""Token ids in files of canonical, length-limited Huffman codes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arealis.llm.common import documents, written
from arealis.llm.tokens import default_vocabulary, encoder
from arealis.sources.shared import shared_dir

#: Bits of the longest code, and tokens between two bit-offset checkpoints.
LIMIT, STRIDE = 20, 512
#: Tokens of a block, about; blocks are decoded without each other.
BLOCK = 1 << 19


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 where a count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    w = counts[order].astype(np.float64)
    leaf, levels = np.arange(len(w)), []
    items, is_leaf = w, np.ones(len(w), bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([w, pairs])
        at = np.argsort(merged, kind="stable")
        items, is_leaf = merged[at], at < len(w)
    levels.append(is_leaf)
    take, depth = 2 * len(w) - 2, np.zeros(len(w), dtype=np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        depth[leaf < n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes, code, last = np.zeros(len(lengths), dtype=np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[lengths[order] > 0]:
        code <<= int(lengths[s]) - last
        codes[s], last = code, int(lengths[s])
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each ``limit`` bits ahead: symbol << 5 | length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    entry = (order.astype(np.uint32) << np.uint32(5)) | lengths[order].astype(np.uint32)
    table = np.repeat(entry, 1 << (limit - lengths[order].astype(np.int64)))
    return np.concatenate([table, np.zeros((1 << limit) - len(table), dtype=np.uint32)])


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids``, and the bit offset of every ``STRIDE``-th of them."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    start = end - n
    word, room = start >> 6, 64 - (start & 63)
    code, n = codes[ids], n.astype(np.uint64)
    over = np.maximum(n.astype(np.int64) - room, 0).astype(np.uint64)
    head = (code >> over) << (room.astype(np.uint64) - (n - over))
    words = np.zeros((int(end[-1]) + 63 >> 6) + 2, dtype=np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[first]] = np.add.reduceat(head, first)
    tail = np.flatnonzero(over)
    words[word[tail] + 1] |= code[tail] << (np.uint64(64) - over[tail])  # one code at most crosses into a word
    return words[: (int(end[-1]) + 63) >> 6].astype(">u8").tobytes(), start[::STRIDE]


def unpack_bits(stream: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The ``n`` ids of a block; all checkpoints are followed side by side."""
    words = np.concatenate([np.frombuffer(stream, dtype=">u8").astype(np.uint64), np.zeros(2, dtype=np.uint64)])
    at = checkpoints.astype(np.int64)
    out = np.zeros((len(at), STRIDE), dtype=np.uint32)
    shift = np.uint64(64 - limit)
    for k in range(min(STRIDE, n)):
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        ahead = (words[word] << bit) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - bit))
        hit = table[(ahead >> shift).astype(np.int64)]
        out[:, k] = hit >> np.uint32(5)
        at = np.minimum(at + (hit & np.uint32(31)), len(words) * 64 - 129)
    return out.ravel()[:n]


_IDS = "shard int, block int, ord long, doc_id long, n_tokens long, ids binary"
_BLOCKS = "shard int, block int, doc_ids array<long>, n_tokens array<long>, checkpoints binary, stream binary"


def _ids(parts: list[bytes], tokens: int) -> np.ndarray:
    """Ids kept in two bytes each, or in four where the vocabulary needs them."""
    joined = b"".join(parts)
    return np.frombuffer(joined, dtype="<u4" if len(joined) == 4 * tokens else "<u2")


def _id_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of each document with the end id, in the order of the partition, and their block."""
        shard, ord_, before, words = TaskContext.get().partitionId(), 0, 0, encoder(path, narrow=True)
        end = np.array([end_id], dtype="<u2" if words.narrow else "<u4").tobytes()
        for b in batches:
            docs, texts = b.column("doc_id"), [x or "" for x in b.column("text").to_pylist()]
            for lo in range(0, len(texts), 500):
                ids = [x + end for x in words.encode(texts[lo : lo + 500])]
                n, counts = len(ids), [len(x) // len(end) for x in ids]
                blocks = ((before + np.cumsum([0, *counts[:-1]])) // BLOCK).astype(np.int32)
                before += sum(counts)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(blocks), pa.array(range(ord_, ord_ + n), pa.int64()), docs.slice(lo, n), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["shard", "block", "ord", "doc_id", "n_tokens", "ids"])
                ord_ += n

    return run


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for b in batches:
        ids = _ids(b.column("ids").to_pylist(), sum(b.column("n_tokens").to_pylist()))
        if len(ids):
            n = np.bincount(ids, minlength=len(total))
            n[: len(total)] += total
            total = n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])


def _block_rows(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole documents in order, a block of about ``BLOCK`` tokens at a time."""
        codes, key = canonical_codes(lengths), None
        docs: list[tuple[int | None, int, bytes]] = []

        def flush() -> pa.RecordBatch:
            stream, marks = pack_bits(_ids([d[2] for d in docs], sum(d[1] for d in docs)), codes, lengths)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([[d[0] for d in docs]], pa.list_(pa.int64())), pa.array([[d[1] for d in docs]], pa.list_(pa.int64())), pa.array([marks.astype("<i8").tobytes()]), pa.array([stream])], names=["shard", "block", "doc_ids", "n_tokens", "checkpoints", "stream"])

        for b in batches:
            for *this, doc, n, ids in zip(*(b.column(c).to_pylist() for c in ("shard", "block", "doc_id", "n_tokens", "ids"))):
                if docs and this != key:
                    yield flush()
                    docs = []
                key = this
                docs.append((doc, n, ids))
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Encode ``docs`` and write ``path/blocks`` and ``path/codebook``.

    Documents go in ascending ``doc_id`` order (null first, ties by text): range
    partitions become shards, and a shard's documents become blocks whose payload is one
    Huffman bit stream with a checkpoint every ``STRIDE`` tokens. The code comes from the
    counts over all documents; what reaches the driver is one count for each id of the
    vocabulary. Blocks are Parquet rows, so any store that Spark writes will do and a
    retried task replaces its own file.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")]
    ids = written(rows.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(*order).mapInArrow(_id_rows(vocabulary, end_id), _IDS), "token-ids")
    found = ids.select("n_tokens", "ids").mapInArrow(_count_rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found.id.max()) + 1 if len(found) else 1, dtype=np.int64)
    counts[found.id] = found.n
    lengths = code_lengths(counts)
    spark.createDataFrame([(lengths.tobytes(), LIMIT, STRIDE)], "lengths binary, bits int, stride int").coalesce(1).write.parquet(f"{path}/codebook")
    blocks = ids.repartition("shard", "block").sortWithinPartitions("shard", "block", "ord").mapInArrow(_block_rows(lengths), _BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def _decoded(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for b in batches:
            for shard, block, docs, counts, marks, stream, first in zip(*(b.column(c).to_pylist() for c in ("shard", "block", "doc_ids", "n_tokens", "checkpoints", "stream", "first"))):
                ids = unpack_bits(stream, np.frombuffer(marks, dtype="<i8"), sum(counts), table).astype("<u4")
                at = np.r_[0, np.cumsum(counts)]
                parts = [ids[at[k] : at[k + 1]].tobytes() for k in range(len(docs))]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(docs, pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(counts, pa.int64()), pa.array(parts, pa.binary()), pa.array(first + at[:-1], pa.int64())], names=["shard", "block", "place", "doc_id", "at", "n_tokens", "ids", "start"])

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, block, place, doc_id, at, n_tokens, ids, start)``; ``start`` counts the ids of all documents before.

    Blocks are decoded independently of each other. Their first positions come from one
    token total for each block.
    """
    book = spark.read.parquet(f"{path}/codebook").first()
    lengths = np.frombuffer(book.lengths, dtype=np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.select("shard", "block", size.alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()  # one row a shard
    before, shards = 0, []
    for r in totals:
        shards.append((r.shard, before))
        before += r.n
    firsts = spark.createDataFrame(shards, "shard int, shard_at long")
    at = F.coalesce(F.sum(size).over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = blocks.select("shard", "block", "n_tokens").withColumn("block_at", at).drop("n_tokens").join(F.broadcast(firsts), "shard")
    places = places.select("shard", "block", (F.col("block_at") + F.col("shard_at")).alias("first"))
    # positions go to the blocks while these are still packed
    return blocks.join(places, ["shard", "block"]).mapInArrow(_decoded(lengths), "shard int, block int, place int, doc_id long, at long, n_tokens long, ids binary, start long")


def token_digest(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by their crc32."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), path)
    return token_digest(read_token_files(spark, path))
