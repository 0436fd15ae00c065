"""Pseudo p-values of local statistics by conditional permutations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.operators.rank import row_rank
from arealis.sources.shared import cut

_U = np.uint64


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A bijection of ``0 .. n - 1`` chosen by ``key``, at the places ``x``.

    Four Feistel rounds over the next even number of bits; what falls outside goes
    through again until it is inside (cycle walking).
    """
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = _U((1 << half) - 1)
    out = np.array(x, dtype=np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> _U(half), out[todo] & mask
        for r in range(4):
            m = right * _U(0x9E3779B97F4A7C15) + _U((key * 4 + r + 1) * 0xD1B54A32D192ED03 % (1 << 64))
            m = (m ^ (m >> _U(31))) * _U(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((m >> _U(29)) & mask)
        out[todo] = (left << _U(half)) | right
        todo = todo[out[todo] >= _U(n)]
    return out.astype(np.int64)


def drawn_places(n: int, slots: int, runs: range, seed: int) -> np.ndarray:
    """For each run the first ``slots`` places of a permutation of ``n - 1`` others."""
    return np.stack([feistel(np.arange(slots), n - 1, seed * 1_000_003 + r) for r in runs])


def permutation_p(df: DataFrame, W: DataFrame, y: str, statistic: str = "moran", n: int = 999, seed: int = 0, key: str = "id", values: int = 2_000_000) -> DataFrame:
    """``(key, value, p_sim)`` of local Moran's I or Gi* (``moran``, ``gi_star``) by ``n`` conditional permutations.

    A place keeps its own value; its neighbours get values of other places, drawn
    without repeats. In a run all places draw by one keyed bijection of ranks, which
    skips a place's own rank, so the runs need the values of ``n`` times the largest
    number of neighbours ranks only. They are gathered in chunks of ``values`` at most
    and broadcast; each place then goes through all runs of a chunk in one pass. Tables of
    places are joined by merging and never go to the driver. ``p_sim`` is ``(1 + as extreme) / (1 + n)`` on the
    nearer side.

    Places without a value are left out with their weights; places without neighbours
    have a null ``p_sim``; no rows give no rows.
    """
    rows = df.select(F.col(key).alias("id"), F.col(y).cast("double").alias("y")).where("y is not null")
    s = rows.agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("var")).first()
    kind = dict(df.dtypes)[key]
    schema = f"{key} {kind}, value double, p_sim double"
    if s.n < 2:
        return rows.select(F.col("id").alias(key), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("p_sim"))
    z = F.col("y") - s["mean"] if statistic == "moran" else F.col("y")
    ranked = cut(row_rank(rows, "id", [], name="rank").select("id", z.alias("z"), (F.col("rank") - 1).alias("rank")))
    near = W.where("i != j").join(ranked.select(F.col("id").alias("j"), F.col("z").alias("zj")).hint("merge"), "j").groupBy(F.col("i").alias("id")).agg(F.collect_list("w").alias("w"), F.sum(F.col("w") * F.col("zj")).alias("seen"))
    state = cut(ranked.join(near.hint("merge"), "id", "left").select("id", "z", "rank", "w", "seen", F.lit(0).cast("long").alias("high")))
    slots = min(state.agg(F.max(F.size("w"))).first()[0] or 0, s.n - 1)
    step = max(1, values // max(2 * slots, 1))
    for first in range(0, n if slots > 0 else 0, step):
        drawn = drawn_places(s.n, slots, range(first, min(n, first + step)), seed)
        wanted = np.unique(np.r_[drawn.ravel(), drawn.ravel() + 1])
        asked = df.sparkSession.createDataFrame(pa.table({"rank": wanted}))
        found = ranked.join(F.broadcast(asked), "rank").select("rank", "z").toPandas().set_index("rank")["z"]
        at = np.searchsorted(wanted, drawn)
        held = found.reindex(wanted).to_numpy()
        tables = df.sparkSession.sparkContext.broadcast((drawn, held[at], held[np.searchsorted(wanted, drawn + 1)]))

        spread = math.sqrt(s["var"] or 0.0)

        def count(batches: Iterator[pa.RecordBatch], tables=tables, spread=spread) -> Iterator[pa.RecordBatch]:
            places, low, high = tables.value
            for b in batches:
                above = b.column("high").to_pylist()
                for k, (z, rank, w, seen) in enumerate(zip(*(b.column(c).to_pylist() for c in ("z", "rank", "w", "seen")))):
                    if w:
                        m = len(w)
                        sums = np.where(places[:, :m] < rank, low[:, :m], high[:, :m]) @ np.array(w)
                        # Moran's I rises with the neighbours' sum where the own deviation is above 0, and falls where it is below
                        sign = 1.0 if statistic != "moran" else np.sign(z)
                        # equal sums may differ in their last bits by the order of their terms
                        slack = 1e-12 * (abs(seen) + spread * np.abs(w).sum())
                        above[k] += int((sign * sums >= sign * seen - slack).sum())
                yield b.set_column(b.schema.get_field_index("high"), "high", pa.array(above, pa.int64()))

        state = cut(state.mapInArrow(count, state.schema))
    if statistic == "moran":
        value = (s.n - 1) * F.col("z") * F.col("seen") / (s.n * s.var) if s.var else F.lit(None).cast("double")
    else:
        total, size = F.lit(float(s["mean"]) * s.n), F.aggregate("w", F.lit(0.0), lambda a, x: a + x) + 1
        value = (F.col("seen") + F.col("z")) / F.nullif(total, F.lit(0.0)) / size
    p = (F.least(F.col("high"), F.lit(n) - F.col("high")) + 1) / F.lit(1.0 + n)
    return state.select(F.col("id").alias(key), value.alias("value"), F.when(F.col("seen").isNotNull(), p).alias("p_sim")).selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in schema.split(", ")))
