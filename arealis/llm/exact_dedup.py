"""Exact duplicates found with Patricia tries."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.common import documents, texts_as_bytes, written


class PatriciaTrie:
    """A radix trie over byte strings; each terminal holds the smallest id and the row count.

    ``budget`` bounds the bytes of labels kept in memory. Beyond it the heaviest
    subtree goes to a file of this task, later strings that lead into it follow it
    there, and ``close`` works through such files one after another, so any number of
    strings fits. A node is ``[label, children, terminal, bytes below, file]``.
    """

    def __init__(self, budget: int = 96 << 20):
        self.budget, self.held = budget, 0
        self.root: list = [b"", {}, None, 0, None]

    def insert(self, key: bytes, smallest: int | None, rows: int, tag: int) -> None:
        """Add ``rows`` copies of ``key``; ``tag`` names this row in what ``close`` returns."""
        node, at, path = self.root, 0, [self.root]
        while True:
            if node[4] is not None:
                pickle.dump((key, smallest, rows, [tag]), node[4])
                return
            if at == len(key):
                break
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None, 0, None]
                node[1][key[at]] = child
                self._grow(path, child, len(key) - at)
                node = child
                break
            label = child[0]
            if not key.startswith(label, at):
                n = _common(label, key, at)
                upper = [label[:n], {label[n]: child}, None, child[3], None]
                child[0], child[3] = label[n:], child[3] - n if child[3] >= n else 0
                node[1][key[at]] = upper
                child = upper
            at += len(child[0])
            node = child
            path.append(node)
        old = node[2]
        if old is None:
            node[2] = [smallest, rows, [tag]]
        else:
            if old[0] is None or smallest is not None and smallest < old[0]:
                old[0] = smallest
            old[1] += rows
            old[2].append(tag)
        if self.held > self.budget:
            self._spill()

    def _grow(self, path: list, child: list, n: int) -> None:
        child[3] += n
        for x in path:
            x[3] += n
        self.held += n

    def _spill(self) -> None:
        path, prefix, node = [self.root], b"", self.root
        while node[1]:
            heavy = max((c for c in node[1].values() if c[4] is None), key=lambda c: c[3], default=None)
            if heavy is None:
                return
            node = heavy
            prefix += node[0]
            path.append(node)
            if node[3] <= self.budget // 2:
                break
        file = tempfile.TemporaryFile()  # this task's own; gone with it, and a retry starts over
        for key, terminal in self._terminals(node, prefix):
            pickle.dump((key, *terminal), file)
        freed = node[3]
        node[1], node[2], node[4] = {}, None, file
        for x in path:
            x[3] -= freed
        self.held -= freed

    @staticmethod
    def _terminals(node: list, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        todo = [(node, prefix)]
        while todo:
            node, key = todo.pop()
            if node[2] is not None:
                yield key, node[2]
            todo += [(c, key + c[0]) for c in node[1].values()]

    def close(self) -> Iterator[tuple[bytes, list]]:
        """Each string once: ``(key, [smallest id, rows, tags])``."""
        files, todo = [], [(self.root, b"")]
        while todo:
            node, key = todo.pop()
            if node[2] is not None:
                yield key, node[2]
            if node[4] is not None:
                files.append(node[4])
            todo += [(c, key + c[0]) for c in node[1].values()]
        self.root = [b"", {}, None, 0, None]
        self.held = 0
        for file in files:
            file.seek(0)
            again = PatriciaTrie(self.budget)
            while True:
                try:
                    key, smallest, rows, tags = pickle.load(file)
                except EOFError:
                    break
                again.insert(key, smallest, rows, tags[0])
                for tag in tags[1:]:
                    again.insert(key, smallest, 0, tag)
            file.close()
            yield from again.close()


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common start of ``label`` and ``key[at:]``, known to differ or end."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def squeeze(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one blank."""
    out = b" ".join(text.split())
    if not text:
        return out
    if not out:
        return b" "
    return (b" " if text[:1].isspace() else b"") + out + (b" " if text[-1:].isspace() else b"")


_LOCAL = "doc_id long, local long, owner boolean, n_bytes long, text_sha256 string, text binary, smallest long, copies long"


def _local_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse the copies within each record batch; one row of each text carries it on."""
    task, serial = TaskContext.get().partitionId(), count()
    schema = pa.schema([("doc_id", pa.int64()), ("local", pa.int64()), ("owner", pa.bool_()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("text", pa.binary()), ("smallest", pa.int64()), ("copies", pa.int64())])
    for b in batches:
        ids = b.column("doc_id").cast(pa.int64()).to_pylist()
        trie = PatriciaTrie()
        for i, text in enumerate(map(squeeze, texts_as_bytes(b.column("text")))):
            trie.insert(text, ids[i], 1, i)
        rows: list[tuple] = []
        for key, (smallest, copies, tags) in trie.close():
            local, sha = (task << 36) + next(serial), hashlib.sha256(key).hexdigest()
            for k, i in enumerate(tags):
                rows.append((ids[i], local, not k, len(key), sha) + ((key, smallest, copies) if not k else (None, None, None)))
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _owner_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie()
    for b in batches:
        for local, text, smallest, copies in zip(*(b.column(c).to_pylist() for c in ("local", "text", "smallest", "copies"))):
            trie.insert(text, smallest, copies, local)
    found: list[tuple[int, int | None, int]] = []
    names = ["local", "keep_id", "group_size"]
    for _, (smallest, copies, tags) in trie.close():
        found += [(t, smallest, copies) for t in tags]
        if len(found) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)
            found = []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """The row that stays for every row of ``docs``, by whole text with white space squeezed.

    Copies inside a record batch collapse first, so a text that fills a third of all
    rows reaches its owner as one row per batch. Owners are dealt out by length and
    content hash, and hold the full strings in Patricia tries, so equality is decided
    on the bytes. Results go back to the rows by the key of their local copy, of which
    none is hot.

    Nulls and edges: a null text is the empty text; a null ``doc_id`` counts in
    ``group_size`` and stays only where its group has no other id; rows that repeat the
    smallest id are all kept; an empty table gives an empty result; other columns are ignored.
    """
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_local_tries, _LOCAL), "exact-local")
    owners = rows.where("owner").select("local", "text", "smallest", "copies", "n_bytes", F.xxhash64("text").alias("h"))
    owners = owners.repartition("n_bytes", "h").select("local", "text", "smallest", "copies").mapInArrow(_owner_tries, "local long, keep_id long, group_size long")
    return (
        rows.select("doc_id", "local", "text_sha256", "n_bytes")
        .join(owners, "local")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes")
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256, CAST(octet_length(encode(norm)) AS BIGINT) AS n_bytes
FROM t
"""
