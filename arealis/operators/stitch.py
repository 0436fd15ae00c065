"""Loose segments put together to lines, by list contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.sources.shared import cut

_PART = ("e", "level", "u", "v", "n", "length")


def _parts(segments: DataFrame) -> DataFrame:
    """``(e, level, u, v, n, length, a, b)`` of each segment: ``u`` and ``v`` name the ends where it goes on, null where it stops."""
    key = lambda p: F.xxhash64("level", F.round(F.col(f"{p}.x"), 9) + 0.0, F.round(F.col(f"{p}.y"), 9) + 0.0)
    s = segments.where("a is not null and b is not null").select("level", "a", "b", "length", key("a").alias("u"), key("b").alias("v")).where("u != v")
    s = cut(s.withColumn("e", F.monotonically_increasing_id()))
    ends = s.select("e", F.explode(F.array(F.struct("u", F.lit(0).alias("side")), F.struct(F.col("v").alias("u"), F.lit(1).alias("side")))).alias("p")).select("e", "p.u", "p.side")
    at = ends.groupBy("u").agg(F.count("*").alias("n"), F.min(F.struct("e", "side")).alias("p"), F.max(F.struct("e", "side")).alias("q")).where("n = 2")
    on = at.select("u", F.explode(F.array("p", "q")).alias("p")).groupBy(F.col("p.e").alias("e")).agg(F.max(F.when(F.col("p.side") == 0, F.col("u"))).alias("u"), F.max(F.when(F.col("p.side") == 1, F.col("u"))).alias("v"))
    ends = s.drop("u", "v").join(on.hint("merge"), "e", "left")
    return cut(ends.select("e", "level", "u", "v", F.lit(1).cast("long").alias("n"), "length", "a", "b"))


def _merged(parts: DataFrame, turn: int) -> DataFrame:
    """Pairs of parts that become one at a joint, with ``first`` and ``second``: an independent set of the joints, another each ``turn``.

    A joint is taken if no joint at the other ends of its two parts has a smaller hash, so
    that a part is merged at one end at most; on average that is a third of the joints.
    """
    side = lambda here, far, last: F.struct(F.col(here).alias("j"), F.struct("e", "level", F.col(far).alias("far"), "n", "length", F.lit(last).alias("last")).alias("p"))
    ends = parts.select(F.explode(F.array(side("u", "v", False), side("v", "u", True))).alias("s")).select("s.*").where("j is not null")
    at = ends.groupBy("j").agg(F.min("p").alias("first"), F.max("p").alias("second"))
    h = lambda c: F.xxhash64(c, F.lit(turn))
    smaller = lambda far: F.col(far).isNull() | (F.col(far) == F.col("j")) | (h("j") < h(far)) | ((h("j") == h(far)) & (F.col("j") < F.col(far)))
    return at.where(smaller("first.far") & smaller("second.far") & (F.col("first.e") != F.col("second.e")))


def _contracted(parts: DataFrame, trace: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Whole lines as parts, and with ``trace`` what each round merged, ``(e, into, start, back)``.

    Lines that are whole leave at once and each round takes about a third of the joints
    out of the rest, so all rounds together move a few times the segments.
    """
    whole = lambda p: p.where("(u is null and v is null) or u = v")
    open_ = lambda p: p.where("(u is not null or v is not null) and not (u <=> v)")
    parts = parts.select(*_PART)
    done, active, traces, turn = [whole(parts)], open_(parts), [], 0
    while not active.isEmpty():
        pairs = cut(_merged(active, turn))
        new = pairs.select("first.e", "first.level", F.col("first.far").alias("u"), F.col("second.far").alias("v"), (F.col("first.n") + F.col("second.n")).alias("n"), (F.col("first.length") + F.col("second.length")).alias("length"))
        # the first part ends at the joint and the second one begins there, or they are turned round
        inner = F.explode(F.array(F.struct("first.e", F.lit(0).cast("long").alias("start"), (~F.col("first.last")).alias("back")), F.struct("second.e", F.col("first.n").alias("start"), F.col("second.last").alias("back")))).alias("p")
        gone = pairs.select(F.col("first.e").alias("into"), inner).select("p.e", "into", "p.start", "p.back")
        if trace:
            traces.append(gone)
        rest = active.join(gone.select("e").hint("merge"), "e", "left_anti")
        after = cut(rest.select(*_PART).unionByName(new))
        done.append(whole(after))
        active, turn = open_(after), turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, traces


def stitched(segments: DataFrame) -> DataFrame:
    """``(level, line, pos, a, b, length, closed)``: segments ``(level, a, b, length)`` in the order of their lines.

    Ends that agree to nine places are one; a line runs through ends of two segments
    and stops at others. Segments are merged in rounds and, once lines are whole, the
    rounds are gone through backwards to place each segment in its line. Rounds grow with
    the logarithm of the longest line, and what they move with the number of segments.
    ``pos`` counts from 1, ``b`` of one segment is ``a`` of the next; a ring begins
    anywhere. Segments without length, and null ones, are left out.
    """
    parts = _parts(segments)
    lines, traces = _contracted(parts, True)
    flip = lambda c, p, q: F.when(c, F.col(q)).otherwise(F.col(p))
    placed = cut(lines.select("e", F.col("e").alias("line"), F.lit(0).cast("long").alias("start"), F.lit(False).alias("back"), "n", F.col("u").isNotNull().alias("closed")))
    for gone in reversed(traces):
        size = gone.groupBy("into").agg(F.max("start").alias("cut_at"))
        inner = gone.join(size, "into").withColumn("head", F.col("start") == 0).select(F.col("e").alias("part"), F.col("into").alias("e"), "cut_at", "head", F.col("back").alias("turned"))
        met = placed.join(inner.hint("merge"), "e", "left")
        long_ = F.when(F.col("head"), F.col("cut_at")).otherwise(F.col("n") - F.col("cut_at"))
        first = F.col("head") != F.col("back")  # comes first in the line
        start = F.when(first, F.col("start")).otherwise(F.col("start") + F.col("n") - long_)
        moved = F.col("part").isNotNull()
        placed = cut(met.select(F.coalesce("part", "e").alias("e"), "line", F.when(moved, start).otherwise(F.col("start")).alias("start"), F.when(moved, F.col("back") != F.col("turned")).otherwise(F.col("back")).alias("back"), F.when(moved, long_).otherwise(F.col("n")).alias("n"), "closed"))
    out = parts.drop("n", "u", "v").join(placed.hint("merge"), "e")
    return out.select("level", "line", (F.col("start") + 1).alias("pos"), flip(F.col("back"), "a", "b").alias("a"), flip(F.col("back"), "b", "a").alias("b"), "length", "closed")


def line_lengths(segments: DataFrame) -> DataFrame:
    """``(level, line, closed, segments, length)`` of each stitched line, without placing the segments."""
    lines, _ = _contracted(_parts(segments), False)
    return lines.select("level", F.col("e").alias("line"), F.col("u").isNotNull().alias("closed"), F.col("n").alias("segments"), "length")
