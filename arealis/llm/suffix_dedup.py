"""Passages that repeat anywhere in a collection, removed with suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.llm.common import documents, map_batches, texts_as_bytes, written

#: Bytes that an anchor is taken from; it is one of the last steps of a doubling.
ANCHOR = 128
#: Bytes of pieces in one suffix array.
SHARD = 4 << 20
#: Bytes of pieces under one anchor that one task takes; an anchor with more is dealt to several.
SALT = 1 << 20
#: Places of an anchor in its windows that share one context.
BLOCK = 16
_U = np.uint64


def anchor_width(length: int) -> int:
    """Bytes of an anchor: the largest power of two within two fifths of ``length``, ``ANCHOR`` at most."""
    if length < 32:
        raise ValueError("repeats shorter than 32 bytes are not offered")
    return min(ANCHOR, 1 << (2 * length // 5).bit_length() - 1)


def _rolling(b: np.ndarray, width: int = ANCHOR) -> np.ndarray:
    """A 64-bit hash of every ``width`` bytes (a power of two), by doubling."""
    h = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)[b]
    step, c = 1, 0x9E3779B97F4A7C15
    while step < width:
        h = h[:-step] * _U(c) + (h[step:] ^ (h[step:] >> _U(29)))
        step, c = 2 * step, c * 0xD1B54A32D192ED03 % (1 << 64)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def anchors(texts: list[bytes], length: int, part: int = 1 << 26) -> tuple[np.ndarray, ...]:
    """For every ``length`` bytes of a text the place with the least hash; runs of starts with one place.

    Returns text number, first start, number of starts and hash. The place depends on
    the bytes of the window alone, so equal windows have equal hashes. Texts of more than
    ``part`` bytes go through in parts that overlap by a window; a run may end between two.
    """
    parts = [(i, lo, t[lo : lo + part + length - 1]) for i, t in enumerate(texts) for lo in range(0, max(len(t) - length + 1, 1), part)]
    out, lo = [], 0
    while lo < len(parts):
        hi, size = lo, 0
        while hi < len(parts) and (hi == lo or size + len(parts[hi][2]) <= 2 * part):
            size += len(parts[hi][2])
            hi += 1
        text, first, starts, h = _anchors([p[2] for p in parts[lo:hi]], length)
        of = np.array([p[:2] for p in parts[lo:hi]], dtype=np.int64)[text]
        out.append((of[:, 0], first + of[:, 1], starts, h))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out)) if out else _anchors([], length)


def _anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(t) for t in texts])
    b = np.frombuffer(b"".join(texts), dtype=np.uint8)
    width = anchor_width(length)
    if len(b) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    h, w = _rolling(b, width), length - width + 1
    low = _U((1 << 28) - 1)
    m, s = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * s <= w:
        m, s = np.minimum(m[:-s], m[s:]), 2 * s
    if s < w:
        m = np.minimum(m[: len(m) - (w - s)], m[w - s :])
    ends = np.cumsum(sizes)
    start = np.arange(len(m))
    text = np.searchsorted(ends, start, side="right")
    place = np.where(start + length <= ends[text], (m & low).astype(np.int64), -1)
    cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    runs = np.diff(np.r_[cut, len(place)])
    good = place[cut] >= 0
    cut, runs = cut[good], runs[good]
    return text[cut], cut - (ends - sizes)[text[cut]], runs, h[place[cut]]


def suffix_array(b: np.ndarray, most: int = 512) -> np.ndarray:
    """Suffixes in order, at least by their first ``most`` bytes (Larsson and Sadakane 1999).

    The first order is by eight bytes. Each round doubles the depth and sorts again only
    the groups that still have several suffixes; a suffix's rank is its group's place.
    """
    n = len(b)
    w = words(b)[:n]
    order = np.argsort(w, kind="stable")
    new = np.r_[True, w[order][1:] != w[order][:-1]]
    depth = 8
    while depth < most:
        first = np.flatnonzero(new)
        group = np.repeat(first, np.diff(np.r_[first, n]))
        rank = np.zeros(n + depth, dtype=np.int64)
        rank[order] = group + 1
        alone = new & np.r_[new[1:], True]
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        mine = order[at]
        key = (rank[mine].astype(np.uint64) << _U(32)) | rank[mine + depth].astype(np.uint64)
        by = np.argsort(key, kind="stable")
        order[at] = mine[by]
        key = key[by]
        new[at] = np.r_[True, key[1:] != key[:-1]]
        depth *= 2
    return order


def words(b: np.ndarray, beyond: int = 1024) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros follow the end, ``beyond`` and some more."""
    x = np.concatenate([b, np.zeros(beyond + 76, dtype=np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << _U(8 * step)) | x[step:]
    return x


def _common(w: np.ndarray, i: np.ndarray, v: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of ``w`` from ``i`` and ``v`` from ``j``, at most about ``most``."""
    out = np.zeros(len(i), dtype=np.int64)
    live = np.arange(len(i))
    for k in range(0, most, 8):
        x = w[i[live] + k] ^ v[j[live] + k]
        same = x == 0
        out[live[same]] += 8
        end = x[~same]
        out[live[~same]] += sum((end < _U(1 << s)).astype(np.int64) for s in range(8, 64, 8))
        live = live[same]
        if not len(live):
            break
    return out


def kasai(w: np.ndarray, before: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each start with its predecessor in suffix order (Kasai et al. 2001).

    ``before[i]`` is that predecessor, -1 for none. Where it is the place after the
    predecessor of ``i - 1``, the value is one less than that of ``i - 1``; only the other
    starts are compared byte by byte.
    """
    j = before[starts]
    follows = np.r_[False, (starts[1:] == starts[:-1] + 1) & (j[1:] == j[:-1] + 1) & (j[:-1] >= 0)]
    head = np.flatnonzero(~follows)
    own = np.where(j[head] >= 0, _common(w, starts[head], w, np.maximum(j[head], 0), most), 0)
    of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(starts)]))
    return own[of] - (starts - starts[head][of])


class Shard:
    """Pieces of up to ``SHARD`` bytes with their suffix array, and which starts repeat."""

    def __init__(self, pieces: list[tuple[bytes, int]], length: int):
        # after each piece a byte that UTF-8 lacks and the piece's number: nothing that crosses it repeats
        joined = b"".join(p + b"\xff" + i.to_bytes(4, "big") for i, (p, _) in enumerate(pieces))
        b = np.frombuffer(joined, dtype=np.uint8)
        self.offset = np.cumsum([0, *(len(p) + 5 for p, _ in pieces)])[:-1]
        most = max(1024, 2 * length + 8)  # a run of starts is shorter than ``length``, so what is left of ``most`` at its end tells
        self.length, self.count, self.w = length, [m for _, m in pieces], words(b, most)
        is_start = np.zeros(len(b), dtype=bool)
        for o, m in zip(self.offset, self.count):
            is_start[o : o + m] = True
        order = suffix_array(b, max(512, length))
        self.order = order[is_start[order]]
        before = np.full(len(b), -1, dtype=np.int64)
        before[self.order[1:]] = self.order[:-1]
        starts = np.flatnonzero(is_start)
        lcp = np.zeros(len(b), dtype=np.int64)
        lcp[starts] = kasai(self.w, before, starts, most)
        self.linked = linked = lcp[self.order] >= length  # with the start before it in order
        self.repeats = np.zeros(len(b), dtype=bool)
        self.repeats[self.order[linked]] = True
        self.repeats[self.order[np.flatnonzero(linked) - 1]] = True

    def merge(self, other: Shard) -> None:
        """Mark what stands in both shards: binary search of this one's starts in the other's order."""
        mine, theirs = self.order, other.order
        low, high = np.zeros(len(mine), dtype=np.int64), np.full(len(mine), len(theirs))
        while (low < high).any():
            mid = np.minimum((low + high) // 2, len(theirs) - 1)
            same = _common(self.w, mine, other.w, theirs[mid], self.length)
            less = (same < self.length) & (other.w[theirs[mid] + same] < self.w[mine + same]) & (low < high)
            low, high = np.where(less, mid + 1, low), np.where(less | (low >= high), high, mid)
        found = np.minimum(low, len(theirs) - 1)
        hit = _common(self.w, mine, other.w, theirs[found], self.length) >= self.length
        self.repeats[mine[hit]] = True
        other.repeats[theirs[found[hit]]] = True

    def classes(self) -> Iterator[tuple[int, int, bool]]:
        """Piece and start of every different window, the first in order, and whether no other start here equals it."""
        at = self.order[~self.linked]
        piece = np.searchsorted(self.offset, at, side="right") - 1
        return zip(piece.tolist(), (at - self.offset[piece]).tolist(), (~self.repeats[at]).tolist())

    def runs(self, k: int) -> list[int]:
        """Starts of piece ``k`` that repeat: first and end of each run."""
        x = np.r_[False, self.repeats[self.offset[k] : self.offset[k] + self.count[k]], False]
        return np.flatnonzero(x[1:] != x[:-1]).tolist()


def merged_shards(pieces: list[tuple[bytes, int]], length: int, shard: int = SHARD) -> list[Shard]:
    """Shards of the pieces in their order; pieces of more than ``shard`` bytes are split, and the shards merged pairwise."""
    parts, size = [[]], 0
    for p in pieces:
        if size > shard:
            parts.append([])
            size = 0
        parts[-1].append(p)
        size += len(p[0]) + 5
    shards = [Shard(p, length) for p in parts if p]
    for k, s in enumerate(shards):
        for other in shards[:k]:
            s.merge(other)
    return shards


def repeated_runs(pieces: list[tuple[bytes, int]], length: int, shard: int = SHARD) -> list[list[int]]:
    """Runs for each piece."""
    return [s.runs(k) for s in merged_shards(pieces, length, shard) for k in range(len(s.count))]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a 128-bit key of their text; equal texts are one class."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(7), "text")})


def _anchor_rows(length: int):
    def rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        d1, d2, texts = b.column("d1").to_numpy(), b.column("d2").to_numpy(), texts_as_bytes(b.column("text"))
        fresh, lo = {}, 0
        for i, k in enumerate(zip(d1.tolist(), d2.tolist())):
            fresh.setdefault(k, i)
        chosen = sorted(fresh.values())
        while lo < len(chosen):
            hi, size = lo, 0
            while hi < len(chosen) and (hi == lo or size + len(texts[chosen[hi]]) <= 1 << 21):
                size += len(texts[chosen[hi]])
                hi += 1
            at = np.array(chosen[lo:hi])
            text, first, starts, h = anchors([texts[i] for i in at], length)
            at = at[text]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d1[at]), pa.array(d2[at]), pa.array(first.astype(np.int32)), pa.array(starts.astype(np.int32))], names=["h", "d1", "d2", "first", "starts"])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from rows(b)

    return run


def _several(*key: str) -> Column:
    """Whether a group has rows with different keys."""
    return F.min(F.xxhash64(*key)) != F.max(F.xxhash64(*key))


def _piece_rows(length: int, content: bool):
    names = ["h", "r1", "r2", "d1", "d2", "first", "starts", *(["salts", "piece"] if content else [])]
    types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.binary()] * content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d1, d2, text, found in zip(b.column("d1").to_pylist(), b.column("d2").to_pylist(), texts_as_bytes(b.column("text")), b.column("anchors").to_pylist()):
                for a in found:
                    piece = text[a["first"] : a["first"] + a["starts"] + length - 1]
                    r = np.frombuffer(xxhash.xxh3_128_digest(piece), dtype="<i8").tolist()
                    out.append((a["h"], *r, d1, d2, a["first"], a["starts"], *([a["salts"], piece] if content else [])))
            for lo in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 20_000]), types)], names=names)

    return run


def anchor_place(piece: bytes, starts: int, length: int) -> int:
    """Where in a piece the anchor stands that all its ``starts`` windows picked."""
    width = anchor_width(length)
    h = _rolling(np.frombuffer(piece, dtype=np.uint8), width) & ~_U((1 << 28) - 1)
    return starts - 1 + int(h[starts - 1 : length - width + 1].argmin())


def _context_rows(length: int):
    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        """What all windows of a piece with their anchor at ``BLOCK`` neighbouring places have in common."""
        out = []
        for h, r1, r2, salt, starts, piece in zip(*(b.column(c).to_pylist() for c in ("h", "r1", "r2", "salt", "starts", "piece"))):
            at = anchor_place(piece, starts, length)
            for block in range((at - starts + 1) // BLOCK, at // BLOCK + 1):
                context = piece[at - block * BLOCK : at + length - (block + 1) * BLOCK + 1]
                out.append((h, r1, r2, salt, block, *np.frombuffer(xxhash.xxh3_128_digest(context), dtype="<i8").tolist()))
        types = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["h", "r1", "r2", "salt", "block", "c1", "c2"])

    return rows


def _shared_blocks(distinct: DataFrame, length: int) -> DataFrame:
    """``(h, r1, r2, blocks)``: blocks of a piece whose context another piece of its anchor has.

    Equal windows have their anchor at the same place and so the same context; all other
    windows of a hot anchor need not be named. A context of very many pieces is counted
    by shard first, and goes back to the pieces of one shard at a time.
    """
    context = ["h", "block", "c1", "c2"]
    found = written(map_batches(distinct, _context_rows(length), "h long, r1 long, r2 long, salt long, block int, c1 long, c2 long"), "contexts")
    by_shard = found.groupBy(*context, "salt").agg(F.count("*").alias("n"))
    shared = by_shard.groupBy(*context).agg(F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1").select(*context, F.explode("salts").alias("salt"))
    return found.join(shared, [*context, "salt"]).groupBy("h", "r1", "r2").agg(F.collect_set("block").alias("blocks"))


_MARKS = "h long, r1 long, r2 long, runs array<int>, start array<int>, w1 array<long>, w2 array<long>"


def _shard_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces arrive in the order of their anchors and salts; a shard takes whole ones where it can.

        Of anchors with several salts the different windows of the shard go along by
        their 128-bit digests, with the start where it is not known yet to repeat, else -1;
        windows of blocks whose context no other piece has are left out.
        """
        held: list[tuple] = []
        size, key = 0, None

        def flush() -> pa.RecordBatch:
            shards = merged_shards([(r[6], r[5]) for r in held], length)
            found = [s.runs(k) for s in shards for k in range(len(s.count))]
            rows = [(*r[:3], [0, r[5]] if r[4] else f, [], [], []) for r, f in zip(held, found)]
            places = [anchor_place(r[6], r[5], length) if r[8] else 0 for r in held]
            base = 0
            for s in shards:
                for k, at, alone in s.classes() if any(r[3] > 1 for r in held[base : base + len(s.count)]) else ():
                    r = held[base + k]
                    if r[3] > 1 and r[8] and (places[base + k] - at) // BLOCK in r[8]:
                        w = np.frombuffer(xxhash.xxh3_128_digest(r[6][at : at + length]), dtype="<i8").tolist()
                        for column, x in zip(rows[base + k][4:], (at if alone and not r[4] else -1, *w)):
                            column.append(x)
                base += len(s.count)
            types = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["h", "r1", "r2", "runs", "start", "w1", "w2"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "r1", "r2", "salts", "several", "starts", "piece", "salt", "blocks"))):
                if (row[0], row[7]) != key and size > SHARD // 2:
                    yield flush()
                    held, size = [], 0
                key = row[0], row[7]
                held.append(row)
                size += len(row[6]) + 5
        if held:
            yield flush()

    return run


def _across_shards(marks: DataFrame) -> DataFrame:
    """Runs of the starts whose windows stand in another shard of their anchor as well.

    A shard names each of its different windows once, so a window has at most as many
    rows as its anchor has shards, however many pieces share it.
    """
    windows = marks.where(F.size("w1") > 0).select("h", "r1", "r2", F.inline(F.arrays_zip("start", "w1", "w2")))
    twice = windows.groupBy("h", "w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("h", "w1", "w2")
    starts = windows.where("start >= 0").join(twice, ["h", "w1", "w2"]).groupBy("h", "r1", "r2").agg(F.collect_set("start").alias("s"))
    return starts.select("h", "r1", "r2", F.flatten(F.transform(F.sort_array("s"), lambda x: F.array(x, x + 1))).alias("runs"))


def repeated_spans(docs: DataFrame, length: int = 400) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, texts, spans)``: see ``repeats_removed``; spans are byte ranges of classes of equal texts.

    1. Every window of ``length`` bytes picks an anchor, the least hash inside it
       (winnowing). Windows can be equal only if their anchors are.
    2. Anchors that stand in one place only are dropped. Texts with others are read
       again and cut into pieces: the starts that picked an anchor, and the bytes that
       their windows cover.
    3. Equal pieces collapse, map-side first, so a passage of a third of all documents
       is one piece. Pieces that differ under one anchor go to a suffix array with the
       other pieces of their anchor. Neighbours with ``length`` bytes in common are
       repeats. An anchor with more than ``SALT`` bytes of places has its pieces dealt by
       digest to as many tasks as that asks for; windows that stand in several of its
       shards meet by their digests, if the bytes around the anchor that they share with
       their neighbours stand in another piece at all.
    """
    anchor_width(length)  # raises where the length is too small
    keyed = _keyed(docs)
    found = keyed.select("d1", "d2", "text").where(F.octet_length("text") >= length).mapInArrow(_anchor_rows(length), "h long, d1 long, d2 long, first int, starts int")
    found = written(found, "anchors")
    live = written(found.groupBy("h").agg(_several("d1", "d2", "first").alias("s"), F.ceil(F.sum(F.col("starts").cast("long") + (length - 1)) / SALT).alias("salts")).where("s").select("h", "salts"), "live-anchors")
    kept = found.join(live, "h").groupBy("d1", "d2").agg(F.collect_set(F.struct("h", "first", "starts", "salts")).alias("anchors"))
    kept = written(kept, "text-anchors")
    rows = written(map_batches(keyed, _row_digest, "doc_id long, d1 long, d2 long, n_bytes long, sha256 string"), "rows")
    classes = rows.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("owner"))
    texts = keyed.join(kept, ["d1", "d2"]).join(classes, ["d1", "d2"]).where(F.col("doc_id").eqNullSafe(F.col("owner"))).select("d1", "d2", "text", "anchors", "copies")
    texts = written(texts, "near-texts")
    salt = F.expr("pmod(r1, salts)").alias("salt")

    def distinct_pieces(of: DataFrame) -> DataFrame:
        pieces = of.mapInArrow(_piece_rows(length, True), "h long, r1 long, r2 long, d1 long, d2 long, first int, starts int, salts long, piece binary")
        return pieces.groupBy("h", "r1", "r2").agg(_several("d1", "d2", "first").alias("several"), F.max("starts").alias("starts"), F.max("salts").alias("salts"), F.max("piece").alias("piece")).select("*", salt)

    cuts = texts.select("d1", "d2", "text", "anchors")
    hot = cuts.withColumn("anchors", F.filter("anchors", lambda a: a.salts > 1)).where(F.size("anchors") > 0)
    blocks = _shared_blocks(distinct_pieces(hot), length)
    dealt = distinct_pieces(cuts).join(blocks, ["h", "r1", "r2"], "left").repartition("h", "salt").sortWithinPartitions("h", "salt", "r1", "r2")
    marks = written(dealt.mapInArrow(_shard_rows(length), _MARKS).where("size(runs) > 0 or size(w1) > 0"), "marks")
    marks = marks.where(F.size("runs") > 0).select("h", "r1", "r2", "runs").unionByName(_across_shards(marks))
    places = texts.select("d1", "d2", "text", "anchors").mapInArrow(_piece_rows(length, False), "h long, r1 long, r2 long, d1 long, d2 long, first int, starts int")
    spans = places.join(marks, ["h", "r1", "r2"]).groupBy("d1", "d2").agg(F.collect_set(F.struct("first", "runs")).alias("spans"))
    return rows, texts, written(spans, "spans")


def _row_digest(b: pa.RecordBatch) -> pa.RecordBatch:
    texts = texts_as_bytes(b.column("text"))
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("d1"), b.column("d2"), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], names=["doc_id", "d1", "d2", "n_bytes", "sha256"])


def removed_ranges(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that the repeated starts cover."""
    starts = sorted((s["first"] + s["runs"][k], s["first"] + s["runs"][k + 1] + length - 1) for s in spans for k in range(0, len(s["runs"]), 2))
    out: list[list[int]] = []
    for a, b in starts:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept_rows(length: int):
    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        removed, spans, kept = [], [], []
        for text, found in zip(texts_as_bytes(b.column("text")), b.column("spans").to_pylist()):
            ranges = removed_ranges(found, length)
            removed.append(sum(y - x for x, y in ranges))
            spans.append(len(ranges))
            ends = [0, *(p for r in ranges for p in r), len(text)]
            kept.append(b"".join(text[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2)))
        return pa.RecordBatch.from_arrays([b.column("d1"), b.column("d2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["d1", "d2", "n_removed", "n_spans", "kept"])

    return rows


def repeats_removed(docs: DataFrame, length: int = 400, keep_bytes: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])`` for every row of ``docs``.

    A byte goes if some ``length`` bytes that cover it start in another place as well, in
    the same row or another. ``kept`` has the remaining bytes; it is null where the row
    keeps all of them. ``length`` is 32 at least; suffix arrays are sorted as deep as it is.

    Equal texts, equal pieces under an anchor, and windows that several shards of one hot
    anchor have are told by 128-bit digests; all other repeats by suffix arrays, merged by
    binary search where an anchor's pieces fill several of them in one task.

    Nulls and edges: a null text is empty; texts shorter than ``length`` lose nothing;
    rows with equal texts are copies of each other even if they share a ``doc_id``, which
    may be null; an empty table gives an empty result; other columns are ignored.
    """
    rows, texts, spans = repeated_spans(docs, length)
    cut = map_batches(texts.where("copies = 1").join(spans, ["d1", "d2"]).select("d1", "d2", "text", "spans"), _kept_rows(length), "d1 long, d2 long, n_removed long, n_spans long, kept binary")
    cut = cut.withColumn("cut_sha256", F.sha2("kept", 256))
    if not keep_bytes:
        cut = cut.drop("kept")
    copies = rows.groupBy("d1", "d2").agg(F.count("*").alias("copies"))
    named = written(copies.join(cut, ["d1", "d2"], "left").where("copies > 1 or n_removed is not null"), "cut")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = rows.join(named, ["d1", "d2"], "left")
    cols = [
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
    ]
    if keep_bytes:
        cols.append(F.when(all_gone, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*cols)


def op5(spark, sf_dir: str) -> DataFrame:
    return repeats_removed(documents(spark, sf_dir), keep_bytes=False)
