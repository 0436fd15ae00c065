"""Documents packed into sequences of fixed length, with a certified count of sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.common import documents, map_batches, written
from arealis.llm.tokens import default_vocabulary, encoder

#: Pieces that one task packs, about.
PIECES_A_TASK = 20_000


def lower_bound(sizes: np.ndarray, room: int) -> int:
    """No packing of ``sizes`` has fewer bins: the best of two families of dual-feasible functions.

    The first family counts sizes over ``room - t`` as full and drops those under ``t``,
    for every ``t`` up to half the room; the second rounds ``(k + 1) * size / room`` down
    (Fekete and Schepers 2001). ``t = 0`` is the plain sum.
    """
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=room + 1)
    total, number = np.cumsum(n * np.arange(room + 1)), np.cumsum(n)
    t = np.arange(0, room // 2 + 1)
    low = np.where(t > 0, total[t - 1], 0)
    full = number[-1] - number[room - t]
    best = int((-(-(total[room - t] - low + full * room) // room)).max())
    sizes_k, count_k = np.flatnonzero(n), n[np.flatnonzero(n)]
    for k in range(1, 40):
        exact = (k + 1) * sizes_k % room == 0
        scaled = np.where(exact, k * sizes_k, (k + 1) * sizes_k // room * room)  # times room * k
        best = max(best, int(-(-int((scaled * count_k).sum()) // (room * k))))
    return best


def best_fit(sizes: np.ndarray, room: int) -> np.ndarray:
    """The bin of each size: largest first, into the fullest bin that still takes it."""
    bins = np.empty(len(sizes), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    free, used = 0, 0  # bit r of free: some bin has r places left
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                free &= ~(1 << left)
        else:
            left, b, used = room, used, used + 1
        bins[i] = b
        if left > size:
            open_bins[left - size].append(b)
            free |= 1 << (left - size)
    return bins


def _piece_rows(path: str, end_id: int, room: int):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        end, out = np.array([end_id], dtype="<u4").tobytes(), []
        texts = [x or "" for x in b.column("text").to_pylist()]
        for doc, ids in zip(b.column("doc_id").to_pylist(), encoder(path).encode(texts)):
            ids += end
            for k in range(0, len(ids), 4 * room):
                piece = ids[k : k + 4 * room]
                out.append((doc, k // (4 * room), k // 4, len(piece) // 4, zlib.crc32(piece)))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, room: int = 4096, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """The ids of each document with the end id, cut only where longer than ``room``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, _piece_rows(vocabulary or default_vocabulary(), end_id, room), "doc_id long, piece long, start long, length long, ids_crc32 long")


_PACKED = "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long, final boolean, emptiest boolean"


def _pack(room: int, round_: int, last: bool, wide: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pack one partition; what it gives to the exchange has ``final`` false."""
        frames = [p for p in parts if len(p)]
        if not frames:
            return
        p = pd.concat(frames, ignore_index=True).sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], ignore_index=True)
        sizes = p["length"].to_numpy()
        bins = best_fit(sizes, room)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        gap = len(fill) - lower_bound(sizes, room)
        give = min(len(fill), 1 + 16 * gap * wide)  # the emptiest bin always, more where the bound is not met
        given = np.zeros(len(fill), dtype=bool)
        order = np.argsort(fill, kind="stable")
        given[order[:give]] = not last
        given[fill == room] = False
        p["sequence_id"] = (round_ << 56) + (TaskContext.get().partitionId() << 32) + bins
        p["offset"] = p.groupby("sequence_id")["length"].cumsum() - p["length"]
        p["final"], p["emptiest"] = ~given[bins], bins == order[0]
        yield p

    return run


def best_fit_sequences(pieces: DataFrame, room: int = 4096) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, in as few sequences as can be had.

    Each partition (about ``PIECES_A_TASK`` pieces, dealt by hash) is packed best-fit
    decreasing and compared with its dual-feasible lower bound. A partition that meets
    the bound gives only its emptiest bin to the exchange, one that does not gives
    sixteen more for each bin over the bound. The exchange is dealt to as many partitions
    as its pieces ask for and packed again, until one partition can take it. A round that
    saves no sequence is not used: the bins before it are final where they are, and only
    the emptiest of each partition go on.

    Edges: pieces may repeat and ids may be null; every row gets a place; a row's
    ``length`` is 1 to ``room``; no pieces give an empty result.
    """
    pieces = written(pieces, "pieces")
    n = pieces.count()
    tasks, round_, done, rest, wide = -(-n // PIECES_A_TASK) or 1, 0, [], pieces, True
    held, given = None, 0  # what the round before gave, and in how many sequences
    first = F.count_if(F.col("offset") == 0)
    while True:
        packed = rest.repartition(tasks, F.xxhash64(F.lit(round_), "doc_id", "piece", "start")).mapInPandas(_pack(room, round_, tasks == 1, wide), _PACKED)
        packed = written(packed, f"packed-{round_}")
        used, left, passed = packed.agg(first, F.count_if(~F.col("final")), F.count_if((F.col("offset") == 0) & ~F.col("final"))).first()
        if held is not None and used >= given:  # nothing saved
            if not wide:
                done.append(held)
                break
            done.append(held.where("not emptiest"))
            packed, wide = held.where("emptiest"), False
            passed, left = packed.agg(first, F.count("*")).first()
        else:
            done.append(packed.where("final"))
            packed = packed.where("not final")
        if not left:
            break
        held, given, rest, round_ = packed, passed, packed.select(pieces.columns), round_ + 1
        tasks = -(-left // PIECES_A_TASK) if wide else min(-(-left // PIECES_A_TASK), max(1, tasks // 2))
    return reduce(DataFrame.unionByName, done).drop("final", "emptiest")


def op8(spark, sf_dir: str) -> DataFrame:
    return best_fit_sequences(token_pieces(documents(spark, sf_dir)))
