"""Graphs of ``edges(src, dst, length_m, minutes)``: reach, components, nearest facilities."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.functions.columns import utm
from arealis.operators.hulls import convex_hull
from arealis.operators.shapes import dissolved_area
from arealis.operators.spatial import nearest_join
from arealis.sources.shared import cut


def edge_minutes(edges: DataFrame, kmh: float) -> DataFrame:
    return edges.withColumn("minutes", F.col("length_m") / 1000 / kmh * 60)


def snap(points: DataFrame, nodes: DataFrame, key: str, node: str, start: float) -> DataFrame:
    """The nearest node of each point; of equally near ones the lowest."""
    return nearest_join(points, nodes, key, node, start).groupBy(key).agg(F.min(node).alias(node), F.min("d").alias("d"))


def reach(edges: DataFrame, sources: DataFrame, limit: float, cost: str = "minutes") -> DataFrame:
    """``(source, node, cost)`` of the nodes within ``limit`` of each source, by frontier rounds.

    ``sources(source, node)``. One run to the largest limit serves all smaller ones.
    """
    steps = cut(edges.groupBy("src", "dst").agg(F.min(cost).alias("step")))
    best = cut(sources.select("source", "node").distinct().withColumn("cost", F.lit(0.0)))
    front = best
    while True:
        onward = front.join(steps, front.node == steps.src).select("source", F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost")).where(F.col("cost") <= limit)
        onward = onward.groupBy("source", "node").agg(F.min("cost").alias("cost"))
        old = best.withColumnRenamed("cost", "_old")
        front = cut(onward.join(old, ["source", "node"], "left").where("_old is null or cost < _old - 1e-9").select("source", "node", "cost"))
        if front.isEmpty():
            return best
        best = cut(best.unionByName(front).groupBy("source", "node").agg(F.min("cost").alias("cost")))


def isochrones(edges: DataFrame, sources: DataFrame, minutes: list[float]) -> DataFrame:
    """``(source, minutes, nodes)`` for each threshold."""
    r = reach(edges, sources, max(minutes))
    limits = F.explode(F.filter(F.array(*map(F.lit, map(float, minutes))), lambda m: m >= F.col("cost")))
    return r.withColumn("minutes", limits).groupBy("source", "minutes").agg(F.count("*").alias("nodes"))


def isochrone_areas(edges: DataFrame, nodes: DataFrame, sources: DataFrame, minutes: list[float], degrees: bool = False) -> DataFrame:
    """``(source, minutes, nodes, rings, area_km2)``: hulls of the nodes reached, where there are three or more.

    ``nodes(node, x, y)`` are in metres, or in degrees, which are then projected to the
    UTM zone of their middle. Nodes without a place count as reached but shape no hull;
    hulls without an area are left out.
    """
    if degrees:
        mid = nodes.agg(F.avg("x").alias("x")).first().x or 0.0
        x, y = utm(F.col("x"), F.col("y"), F.lit(int((mid + 180) // 6) + 1))
        nodes = nodes.select("node", x.alias("x"), y.alias("y"))
    r = cut(reach(edges, sources, max(minutes)))
    limits = F.explode(F.filter(F.array(*map(F.lit, map(float, minutes))), lambda m: m >= F.col("cost")))
    key = F.to_json(F.struct("source", "minutes"))
    each = cut(r.withColumn("minutes", limits).withColumn("_k", key).select("_k", "source", "minutes", "node"))
    counts = each.groupBy("_k", "source", "minutes").agg(F.count("*").alias("nodes"))
    hulls = convex_hull(each.join(nodes.select("node", "x", "y"), "node"), "_k")
    out = counts.join(hulls, "_k").withColumn("area_km2", g.area(F.col("rings")) / 1e6)
    return out.where("area_km2 > 0").drop("_k")


def dissolved_isochrones(isochrones: DataFrame, size: float) -> DataFrame:
    """``(minutes, facilities, area_km2)``: the union of all hulls of a threshold, in cells of ``size`` metres."""
    n = isochrones.groupBy("minutes").agg(F.count_distinct("source").alias("facilities"))
    return n.join(dissolved_area(isochrones, ["minutes"], size), "minutes").select("minutes", "facilities", (F.col("area") / 1e6).alias("area_km2"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node that is connected, by alternating star rounds."""
    e = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        star = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        e = star.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        e = cut(e.select("e.*").where("u != v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node")))


def _settle(arcs: pa.Table, labels: pa.Table) -> pa.Table:
    """The labels of one block that its new labels and its own arcs improve (label correcting with a heap)."""
    out: dict[object, list[tuple[object, float]]] = {}
    for a, b, step in zip(*(arcs.column(c).to_pylist() for c in ("a", "b", "step"))):
        out.setdefault(a, []).append((b, step))
    rows = list(zip(*(labels.column(c).to_pylist() for c in ("node", "cost", "facility", "new"))))
    best = {n: (cost, (f is not None, f)) for n, cost, f, new in rows if not new}
    moved, heap = {}, [((cost, (f is not None, f)), n) for n, cost, f, new in rows if new]
    heapq.heapify(heap)
    while heap:
        label, n = heapq.heappop(heap)
        if n in best and best[n] <= label:
            continue
        best[n] = moved[n] = label
        for b, step in out.get(n, ()):
            onward = (label[0] + step, label[1])
            if b not in best or onward < best[b]:
                heapq.heappush(heap, (onward, b))
    kinds = labels.schema
    nodes, found = list(moved), list(moved.values())
    block = labels.column("block")[0].as_py() if len(labels) else None
    return pa.table({"block": pa.array([block] * len(nodes), pa.int32()), "node": pa.array(nodes, kinds.field("node").type), "cost": pa.array([x[0] for x in found], pa.float64()), "facility": pa.array([x[1][1] for x in found], kinds.field("facility").type)})


def nearest_facility(edges: DataFrame, origins: DataFrame, facilities: DataFrame, limit: float = float("inf"), cost: str = "minutes", block_nodes: int = 50_000) -> DataFrame:
    """For each origin node the nearest facility by network cost; null where none is reached.

    One relaxation from all facilities at once over reversed edges; ties go to the lower facility.
    Nodes are dealt by ranges into blocks of about ``block_nodes``; a round settles the blocks
    whose labels got better, each in a task, and labels then cross to other blocks. So rounds
    grow with the blocks that a shortest path passes, not with its hops: few where nearby nodes
    have nearby numbers, up to one for each hop where they don't. Edges without a cost lead
    nowhere; costs may be negative, cycles of costs may not.
    """
    steps = edges.where("src is not null and dst is not null").groupBy(F.col("dst").alias("a"), F.col("src").alias("b")).agg(F.min(cost).cast("double").alias("step"))
    steps = cut(steps.where(F.col("step").isNotNull() & ~F.isnan("step")))
    start = facilities.where("node is not null").groupBy("node").agg(F.min("facility").alias("facility"), F.count_if(F.col("facility").isNull()).alias("_none"))
    start = cut(start.select("node", F.lit(0.0).alias("cost"), F.when(F.col("_none") == 0, F.col("facility")).alias("facility")))
    nodes = steps.select(F.col("a").alias("node")).union(steps.select("b")).union(start.select("node")).distinct()
    nodes = cut(nodes)
    dealt = nodes.repartitionByRange(max(1, -(-nodes.count() // block_nodes)), "node").select("node", F.spark_partition_id().alias("block"))
    dealt = cut(dealt).hint("merge")  # files of numbers are small beside their rows
    arcs = steps.join(dealt.select(F.col("node").alias("a"), F.col("block")), "a").join(dealt.select(F.col("node").alias("b"), F.col("block").alias("to")), "b")
    arcs = cut(arcs.select("block", "a", "to", "b", "step"))
    inner, crossing = arcs.where("block = to").drop("to"), cut(arcs.where("block != to"))
    front = cut(start.join(dealt, "node").select("block", "node", "cost", "facility"))
    best = front.limit(0)
    kinds = front.schema
    while not front.isEmpty():
        busy = F.broadcast(front.select("block").distinct())
        known = best.join(busy, "block", "left_semi").withColumn("new", F.lit(False)).unionByName(front.withColumn("new", F.lit(True)))
        pairs = inner.join(busy, "block", "left_semi").groupBy("block").cogroup(known.groupBy("block"))
        moved = cut(pairs.applyInArrow(_settle, kinds))
        s = F.struct("cost", "facility").alias("s")
        best = cut(best.unionByName(moved).groupBy("block", "node").agg(F.min(s).alias("s")).select("block", "node", "s.cost", "s.facility"))
        on = moved.select(F.col("node").alias("a"), "cost", "facility").join(crossing, "a").select(F.col("to").alias("block"), F.col("b").alias("node"), F.struct((F.col("cost") + F.col("step")).alias("cost"), "facility").alias("s"))
        on = on.where(F.col("s.cost") <= limit).groupBy("block", "node").agg(F.min("s").alias("s"))
        old = best.select("node", F.struct("cost", "facility").alias("_o")).hint("merge")
        front = cut(on.join(old, "node", "left").where("_o is null or s < _o").select("block", "node", "s.cost", "s.facility"))
    best = best.where((F.col("cost") <= limit) | (F.col("cost") == 0)).select("node", "cost", "facility").hint("merge")
    return origins.join(best, "node", "left").select(*origins.columns, "facility", "cost")
