"""Water over large rasters: filling by tiles, catchments by doubling, stream orders by tree contraction."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.sources.shared import cut

#: The label of what lies beyond the edges of a raster.
OUTSIDE = 0
_TILE = "tr long, tc long, row array<long>, col array<long>, z array<double>, label array<long>, a array<long>, b array<long>, w array<double>"


def flood(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """Levels of a tile's cells as water leaves it over its rim, the rim place each drains to, and spill levels.

    A priority flood from all cells of the rim (Barnes 2016): each popped cell hands its
    label, and its level if that is higher, to neighbours that have none. Two labels
    that touch spill at the lowest pair of cells. NaN is no cell.
    """
    rows, cols = z.shape
    wide = cols + 2
    level = np.pad(z, 1, constant_values=np.nan).ravel().tolist()
    there = [v == v for v in level]
    label = [0] * len(level)
    rim = np.zeros((rows, cols), dtype=bool)
    rim[[0, -1], :] = rim[:, [0, -1]] = True
    heap = [(level[i], i) for i in np.flatnonzero(np.pad(rim, 1).ravel()).tolist() if there[i]]
    waiting = [False] * len(level)
    for _, i in heap:
        waiting[i] = True
    heapq.heapify(heap)
    spill: dict[tuple[int, int], float] = {}
    names = 0
    while heap:
        v, i = heapq.heappop(heap)
        mine = label[i]
        if not mine:
            names += 1
            mine = label[i] = names
        for j in (i - wide - 1, i - wide, i - wide + 1, i - 1, i + 1, i + wide - 1, i + wide, i + wide + 1):
            if not there[j]:
                continue
            other = label[j]
            if not other:
                label[j] = mine
                if not waiting[j]:
                    level[j] = max(level[j], v)
                    heapq.heappush(heap, (level[j], j))
            elif other != mine:
                pair = (mine, other) if mine < other else (other, mine)
                over = max(v, level[j])
                if over < spill.get(pair, math.inf):
                    spill[pair] = over
    inner = lambda x, kind: np.array(x, dtype=kind).reshape(rows + 2, wide)[1:-1, 1:-1]
    return inner(level, float), inner(label, np.int64), spill


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for tr, tc, cells in zip(b.column("tr").to_pylist(), b.column("tc").to_pylist(), b.column("cells")):
            row, col, v = (cells.values.field(k).to_numpy(zero_copy_only=False) for k in ("row", "col", "v"))
            r, c = row - row.min(), col - col.min()
            z = np.full((r.max() + 1, c.max() + 1), np.nan)
            z[r, c] = v
            level, label, spill = flood(z)
            first = (tr * (1 << 21) + tc) * (1 << 20)
            pairs = np.array(list(spill), dtype=np.int64).reshape(-1, 2) + first
            columns = [row, col, level[r, c], label[r, c] + first, pairs[:, 0], pairs[:, 1], np.array(list(spill.values()), dtype=float)]
            yield pa.RecordBatch.from_arrays([pa.array([tr], pa.int64()), pa.array([tc], pa.int64()), *(pa.array([x]) for x in columns)], names=["tr", "tc", "row", "col", "z", "label", "a", "b", "w"])


def spill_levels(edges: DataFrame) -> DataFrame:
    """``(label, level)``: the lowest height over which each label of ``edges(a, b, w)`` reaches ``OUTSIDE``.

    Boruvka's rounds: each component takes its lowest edge, and components so connected
    become one. Along these edges heights never rise, so a component's water has to rise
    to its own lowest edge and no higher within the round; the level of a label is the
    largest such height until it is outside. The number of components at least halves in
    each round, and their trees are walked by doubling. Labels that never get outside
    have an infinite level.
    """
    up = lambda d: d.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    edges = cut(up(edges))
    labels = cut(edges.select(F.explode(F.array("a", "b")).alias("label")).distinct().where(F.col("label") != OUTSIDE).select("label", F.col("label").alias("comp"), F.lit(float("-inf")).alias("level")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where(F.col("a") != OUTSIDE)
        lowest = cut(both.groupBy("a").agg(F.min(F.struct("w", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.col("b").alias("to"))).alias("m")).select("a", "m.to", "m.w"))
        back = lowest.select(F.col("a").alias("to"), F.col("to").alias("again"))
        root = (F.col("again") == F.col("a")) & (F.col("a") < F.col("to"))  # of two that take each other one is the root
        tree = cut(lowest.join(back, "to", "left").select("a", "w", F.when(root, F.col("a")).otherwise(F.col("to")).alias("to")))
        while True:
            on = tree.select(F.col("a").alias("to"), F.col("to").alias("far"))
            far = cut(tree.join(on, "to", "left").select("a", "w", F.coalesce("far", "to").alias("new"), "to"))
            tree = far.select("a", "w", F.col("new").alias("to"))
            if far.where("new != to").isEmpty():
                break
        to = tree.select(F.col("a").alias("comp"), F.col("to").alias("_to"), F.col("w").alias("_w"))
        labels = cut(labels.join(to, "comp", "left").select("label", F.coalesce("_to", "comp").alias("comp"), F.when(F.col("comp") == OUTSIDE, F.col("level")).otherwise(F.greatest("level", F.coalesce("_w", "level"))).alias("level")))
        name = lambda c: tree.select(F.col("a").alias(c), F.col("to").alias(f"_{c}"))
        edges = cut(up(edges.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "w")))
    return labels.select("label", F.when(F.col("comp") == OUTSIDE, F.col("level")).otherwise(F.lit(float("inf"))).alias("level"))


def fill_depressions(dem: DataFrame, tile: int = 128) -> DataFrame:
    """``(row, col, v)`` with pits raised to their spill level; cells on the raster's edges stay.

    Tiles of ``tile`` by ``tile`` cells are flooded by themselves, each in one task; what
    they drain to and where these spill makes a graph with as many nodes as tiles have
    rim cells at most, also across borders; its levels then raise the cells. The number
    of jobs grows with the logarithm of the number of rim cells, however long a valley is.

    Null cells stay null and no water passes them; cells that no way leads from to an
    edge are infinite; of repeated cells the lowest counts; no rows give no rows.
    """
    cells = dem.groupBy("row", "col").agg(F.min(F.col("v").cast("double")).alias("v")).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "v")
    e = dem.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    at = {"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)}
    tiles = cells.where("v is not null").withColumns(at).groupBy("tr", "tc").agg(F.collect_list(F.struct("row", "col", "v")).alias("cells"))
    done = cut(tiles.mapInArrow(_tiles, _TILE))
    zipped = lambda *c: F.explode(F.arrays_zip(*c)).alias("x")
    flat = done.select("tr", "tc", zipped("row", "col", "z", "label")).select("tr", "tc", "x.*")
    rim = flat.where((F.pmod("row", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("col", F.lit(tile)).isin(0, tile - 1)))
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))).alias("m")
    near = rim.select("tr", "tc", F.col("z").alias("z2"), F.col("label").alias("b"), "row", "col", moves).select(F.col("tr").alias("tr2"), F.col("tc").alias("tc2"), "z2", "b", (F.col("row") + F.col("m.i")).alias("row"), (F.col("col") + F.col("m.j")).alias("col"))
    across = rim.join(near, ["row", "col"]).where("tr != tr2 or tc != tc2").select(F.col("label").alias("a"), "b", F.greatest("z", "z2").alias("w"))
    edge = (F.col("row") == F.col("r0")) | (F.col("row") == F.col("r1")) | (F.col("col") == F.col("c0")) | (F.col("col") == F.col("c1"))
    out = flat.join(F.broadcast(e), edge).select(F.col("label").alias("a"), F.lit(OUTSIDE).cast("long").alias("b"), F.col("z").alias("w"))
    within = done.select(zipped("a", "b", "w")).select("x.*")
    levels = spill_levels(within.unionByName(across).unionByName(out))
    filled = flat.join(levels, "label", "left").select("row", "col", F.greatest("z", F.coalesce("level", F.lit(float("inf")))).alias("v"))
    return filled.unionByName(cells.where("v is null"))


def catchment_of(edges: DataFrame, cells: DataFrame, row: int, col: int) -> DataFrame:
    """``(row, col)`` of all ``cells`` that drain to one cell along ``edges(row, col, to_row, to_col)``, itself included.

    Every cell points to the next one and the outlet nowhere; pointers double until they
    reach the outlet or an end, so a river of ``L`` cells takes ``log2 L`` rounds. Water
    that runs in circles never comes to the outlet. The join is merged, not broadcast.
    """
    at = (F.col("to_row") == row) & (F.col("to_col") == col)
    active = cut(edges.where((F.col("row") != row) | (F.col("col") != col)).select("row", "col", "to_row", "to_col"))
    n, steps = active.count(), 1
    arrived, active = active.where(at), active.where(~at)
    while steps <= n and not active.isEmpty():
        on = arrived.unionByName(active).select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("_r"), F.col("to_col").alias("_c"))
        # what points to an end elsewhere finds no next pointer and is left out
        ahead = cut(active.join(on.hint("merge"), ["to_row", "to_col"]).select("row", "col", F.col("_r").alias("to_row"), F.col("_c").alias("to_col")))
        arrived, active, steps = arrived.unionByName(ahead.where(at)), ahead.where(~at), 2 * steps
    here = cells.where((F.col("row") == row) & (F.col("col") == col)).select("row", "col")
    return here.unionByName(arrived.select("row", "col"))


def strahler(edges: DataFrame) -> DataFrame:
    """``(node, ord)`` of a forest ``edges(src, dst)``: sources 1, one more where two equal maxima meet.

    Tree contraction. Raking takes off the nodes whose inflows are all known.
    Compressing takes out every run of nodes with one unknown inflow: what such a node
    makes of the order that comes in is a table of one number for each possible order
    (at most the logarithm of the number of nodes), tables are composed by doubling, and
    the run's end is tied to what lies below the run. After both at most half of the
    nodes are left, so rounds grow with the square of the logarithm of the number of
    nodes at most. Orders inside the runs follow from the ends, last run first. All joins
    are merged, since packed files make the tables seem small enough to broadcast.

    Null ends and repeated edges don't count; nodes that flow in circles, and what lies
    below them, have no order; a node with two ways out is an error.
    """
    edges = cut(edges.where("src is not null and dst is not null and src != dst").select("src", "dst").distinct())
    if not edges.groupBy("src").count().where("count > 1").isEmpty():
        raise ValueError("a stream leaves a node by one way only")
    kinds = dict(edges.dtypes)["src"]
    nodes = edges.select(F.col("src").alias("node"), F.col("dst").alias("parent")).unionByName(edges.join(edges.select(F.col("src").alias("dst")).hint("merge"), "dst", "left_anti").select(F.col("dst").alias("node")).distinct().withColumn("parent", F.lit(None).cast(kinds)))
    flows = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("open"))
    top = math.floor(math.log2(edges.count() + 2)) + 1
    same = F.array(*(F.lit(x) for x in range(top + 1)))  # the table at x is what an order x becomes; place 0 is unused
    live = cut(nodes.join(flows.hint("merge"), "node", "left").select("node", "parent", F.coalesce("open", F.lit(0)).alias("open"), F.lit(0).alias("m"), F.lit(0).alias("c"), same.alias("way")))
    known, runs, most = live.select("node", F.lit(0).alias("ord")).limit(0), [], live.count()
    while not live.isEmpty():
        # rake
        order = F.when(F.col("c") == 0, 1).when(F.col("c") == 1, F.col("m")).otherwise(F.col("m") + 1)
        leaves = cut(live.where("open = 0").select("node", "parent", order.alias("ord"), F.get("way", order).alias("into")))
        if leaves.isEmpty():
            break
        known = known.unionByName(leaves.select("node", "ord"))
        came = leaves.where("parent is not null").groupBy("parent", "into").agg(F.count("*").alias("n")).groupBy(F.col("parent").alias("node")).agg(F.max(F.struct("into", "n")).alias("x"), F.sum("n").alias("gone"))
        m, x = F.col("m"), F.coalesce(F.col("x.into"), F.lit(0))
        rest = live.where("open > 0").join(came.hint("merge"), "node", "left")
        count = F.when(x > m, F.col("x.n")).when(x == m, F.col("c") + F.coalesce("x.n", F.lit(0))).otherwise(F.col("c"))
        live = cut(rest.select("node", "parent", (F.col("open") - F.coalesce("gone", F.lit(0))).alias("open"), F.greatest(m, x).alias("m"), count.cast("int").alias("c"), "way"))
        # compress: a node with one unknown inflow makes ``make`` of what that inflow's ``way`` lets in
        made = F.transform(same, lambda v: F.least(F.lit(top), F.when(F.col("c") == 0, v).when(F.col("c") >= 2, F.greatest(v, F.col("m") + 1)).when(v < F.col("m"), F.col("m")).when(v == F.col("m"), v + 1).otherwise(v)))
        single = live.where("open = 1").select("node", made.alias("make"))
        child = live.select(F.col("parent").alias("node"), F.col("node").alias("low"), F.col("way").alias("from"))
        link = cut(single.join(child.hint("merge"), "node").select("node", "low", F.transform("from", lambda v: F.get("make", v)).alias("table")))
        steps = 1
        while steps <= most:
            on = link.select(F.col("node").alias("low"), F.col("low").alias("far"), F.col("table").alias("deep"))
            further = link.join(on.hint("merge"), "low", "left").select("node", "low", F.coalesce("far", "low").alias("new"), F.when(F.col("far").isNull(), F.col("table")).otherwise(F.transform("deep", lambda v: F.get("table", v))).alias("table"), F.col("far").isNotNull().alias("moved"))
            link = cut(further)
            more = not link.where("moved").isEmpty()
            link, steps = link.select("node", F.col("new").alias("low"), "table"), 2 * steps
            if not more:
                break
        else:  # what still moves flows in a circle
            link = link.join(link.select(F.col("node").alias("low")).hint("merge"), "low", "left_anti").select("node", "low", "table")
        runs.append(link)
        # the top of a run hands its place to the run's low end
        out = live.join(link.hint("merge"), "node").select("node", "parent", "low", F.transform("table", lambda v: F.get("way", v)).alias("way"))
        tops = out.join(live.where("open = 1").select(F.col("node").alias("parent")).hint("merge"), "parent", "left_anti").select(F.col("low").alias("node"), F.col("parent").alias("_p"), F.col("way").alias("_w"))
        kept = live.where("open != 1").join(tops.hint("merge"), "node", "left")
        live = cut(kept.select("node", F.when(F.col("_w").isNull(), F.col("parent")).otherwise(F.col("_p")).alias("parent"), "open", "m", "c", F.coalesce("_w", "way").alias("way")))
    known = cut(known)
    for link in runs[::-1]:
        known = known.unionByName(cut(link.join(known.withColumnRenamed("node", "low").hint("merge"), "low").select("node", F.get("table", F.col("ord")).alias("ord"))))
    return known
