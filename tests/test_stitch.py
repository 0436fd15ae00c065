"""Contour segments put together to lines."""

import math
import random

from arealis.operators import raster, stitch


def test_lines_and_rings(spark):
    rng = random.Random(5)
    point = lambda x, y: {"x": float(x), "y": float(y)}
    walks = [[(0, i) for i in range(40)], [(5 + math.cos(t), 5 + math.sin(t)) for t in (k * math.pi / 12 for k in range(24))] + [(6.0, 5.0)], [(20, 20), (21, 21)], [(30, 0), (31, 0), (30, 1), (30, 0)]]
    segs = [(1.0, p, q) for w in walks for p, q in zip(w, w[1:])]
    segs += [(2.0, p, q) for p, q in zip(walks[0], walks[0][1:])]  # another level in the same place
    segs += [(1.0, (50, 50), (51, 50)), (1.0, (50, 50), (50, 51)), (1.0, (50, 50), (49, 50))]  # three ends meet: three lines
    segs += [(1.0, (60, 60), (60, 60))]
    rng.shuffle(segs)
    rows = [(lv, *(map(lambda p: point(*p), (p, q) if rng.random() < 0.5 else (q, p))), math.hypot(p[0] - q[0], p[1] - q[1])) for lv, p, q in segs]
    df = spark.createDataFrame(rows, "level double, a struct<x:double,y:double>, b struct<x:double,y:double>, length double")
    out = stitch.stitched(df).collect()
    lines = {}
    for r in out:
        lines.setdefault((r.level, r.line), []).append(r)
    found = []
    for (level, _), parts in lines.items():
        parts.sort(key=lambda r: r.pos)
        assert [r.pos for r in parts] == list(range(1, len(parts) + 1))
        near = lambda p, q: math.hypot(p.x - q.x, p.y - q.y) < 1e-9
        assert all(near(p.b, q.a) for p, q in zip(parts, parts[1:])) and parts[0].closed == near(parts[-1].b, parts[0].a)
        found.append((level, len(parts), parts[0].closed))
    assert sorted(found) == sorted([(1.0, 39, False), (1.0, 24, True), (1.0, 1, False), (1.0, 3, True), (2.0, 39, False), (1.0, 1, False), (1.0, 1, False), (1.0, 1, False)])
    assert stitch.line_lengths(df.limit(0)).count() == 0


def test_contours_of_a_hill(spark):
    z = [(r, c, 10.0 - math.hypot(r - 6.3, c - 5.6)) for r in range(13) for c in range(12)]
    segs = raster.contours(spark.createDataFrame(z, "row long, col long, v double"), 2.0).cache()
    lines = stitch.line_lengths(segs).collect()
    assert abs(sum(r.length for r in lines) - sum(r.length for r in segs.collect())) < 1e-9
    rings = {r.level: r.length for r in lines if r.closed}
    assert rings.keys() == {6.0, 8.0} and all(abs(length - 2 * math.pi * (10 - lv)) < 0.6 for lv, length in rings.items())


def test_whole_lines_leave_the_rounds(spark, monkeypatch):
    point = lambda x, y: {"x": float(x), "y": float(y)}
    square = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    segs = [(1.0, point(3 * k + p[0], p[1]), point(3 * k + q[0], q[1]), 1.0) for k in range(300) for p, q in zip(square, square[1:])]
    df = spark.createDataFrame(segs, "level double, a struct<x:double,y:double>, b struct<x:double,y:double>, length double")
    written, real = [], stitch.cut

    def counted(d, *a):
        out = real(d, *a)
        written.append(out.count())
        return out

    monkeypatch.setattr(stitch, "cut", counted)
    got = stitch.line_lengths(df).collect()
    assert len(got) == 300 and all(r.closed and r.segments == 4 and r.length == 4.0 for r in got)
    assert sum(written) < 10 * len(segs)  # rings once went round until the rounds of the longest list were over
