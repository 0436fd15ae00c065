"""Documents joined by the Jaccard similarity of their word shingles, with signature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm.common import connected_components, deleted, documents, map_batches, shuffles_dropped, texts_as_bytes, written
from arealis.llm.decontamination import SHINGLES_SQL, WORDS_SQL
from arealis.llm.signature_tree import DEN, NUM, Sketch, bitmap, possible_links

#: Shingles whose bitmaps one tree holds, about.
TREE_SHINGLES = 1 << 24
#: How far above the limit a pair's estimated similarity must be for it to stand for others until it is checked.
MARGIN = 0.02
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``n``-word runs; fewer words are one run."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.array([xxhash.xxh64_intdigest(x) for x in words], dtype=np.uint64)
    if len(w) < n:
        w, n = w[None, :], len(w)
        run = np.zeros(1, dtype=np.uint64)
        for k in range(n):
            run = run * _K + w[:, k]
        return _mix(run + np.uint64(n))
    run = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        run = run * _K + w[k : len(w) - n + 1 + k]
    return np.unique(_mix(run))


def signature(s: np.ndarray, hot: np.ndarray, few: int | None = None) -> np.ndarray:
    """Shingles of which any two linked sets share one.

    In one fixed order of all shingles, frequent ones last and hash values otherwise, a
    link leaves the first quarter of either set a common shingle (prefix filter), so the
    whole quarter misses no link. ``few`` cuts it in sets with few frequent shingles: 24
    of them would miss a link with a chance below 1e-11.
    """
    n = len(s)
    prefix = n - -(-NUM * n // DEN) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        is_hot = hot[at] == s
        s = np.concatenate([s[~is_hot], s[is_hot]])
        if is_hot.sum() * 10 > n:
            return s[:prefix]
    return s[: min(prefix, few or prefix)]


def _set_rows(hot, few):
    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        frequent = hot.value if hot is not None else np.zeros(0, dtype=np.uint64)
        n, d, sig, bits = [], [], [], []
        for text in texts_as_bytes(b.column("text")):
            s = shingle_set(text)
            n.append(len(s))
            d.append(xxhash.xxh3_128_digest(s.tobytes()))
            sig.append(signature(s, frequent, few).view(np.int64))
            bits.append(bitmap(s))
        digests = np.frombuffer(b"".join(d), dtype="<i8").reshape(-1, 2)
        ends = np.cumsum([0, *map(len, sig)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sig)))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists, pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "signature", "bits"])

    return rows


def _frequent(docs: DataFrame, rate: int = 16, least: int = 5, most: int = 100_000) -> np.ndarray:
    """Shingles that look frequent in a sample of the rows, sorted; ``most`` at most.

    They only set the order in ``signature``. Any set of them gives the same links.
    """

    def tokens(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in texts_as_bytes(b.column("text"))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["t"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rate)) == 0).select("text")
    counts = map_batches(sample, tokens, "t long").groupBy("t").count().where(F.col("count") >= least)
    top = counts.orderBy(F.desc("count"), "t").limit(most).select("t").toPandas()["t"].to_numpy(dtype=np.int64)
    return np.sort(top.view(np.uint64))


def _places(members: DataFrame, full: bool) -> DataFrame:
    """``(t, size, i, j, node, side)``: which trees the members of each group go to.

    ``members`` has ``(t, node, n, component)``. A group that fits one tree has one.
    Others are split by size first (sets that link are in one of two neighbouring
    levels), and these by hash. In the first pass a block is searched by itself, with one
    set of every other block in it, so that a group of near copies is connected across
    its blocks. The ``full`` pass pairs all blocks; a component that takes up a block or
    more has blocks of its own, which are not paired with each other.
    """
    zero = F.lit(0).cast("long")
    # few rows, each of which stands for more than TREE_SHINGLES; mostly none, and then no group needs what follows
    crowded = written(members.groupBy("t").agg(F.sum("n").alias("all")).where(F.col("all") > TREE_SHINGLES), "crowded")
    if crowded.isEmpty():
        return members.select("t", zero.alias("size"), zero.alias("i"), zero.alias("j"), "node", zero.alias("side"))
    level = F.floor(F.log(F.col("n")) / F.log(F.lit(DEN / NUM))).cast("long")
    members = members.join(crowded, "t", "left").withColumn("level", F.when(F.col("all").isNotNull(), level))
    small = members.where("level is null").select("t", zero.alias("size"), zero.alias("i"), zero.alias("j"), "node", zero.alias("side"))
    large = members.where("level is not null").withColumn("size", F.explode(F.array(F.col("level"), F.col("level") + 1))).select("t", "size", "node", "n", "component")
    if full:
        alone = large.groupBy("t", "size", "component").agg(F.sum("n").alias("c")).where(F.col("c") > TREE_SHINGLES).select("t", "size", "component", F.col("component").alias("own"))
        large = large.join(alone, ["t", "size", "component"], "left").select("t", "size", "node", "n", F.coalesce("own", F.lit(-1)).alias("own"))
    else:
        large = large.withColumn("own", F.lit(-1).cast("long"))
    blocks = large.groupBy("t", "size", "own").agg(F.ceil(F.sum("n") / TREE_SHINGLES).alias("blocks"))
    large = large.join(blocks, ["t", "size", "own"]).withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")))
    at = ["t", "size", "own", "k"]
    if not full:
        lead = large.groupBy("t", "size", "k").agg(F.min_by("node", F.xxhash64("node", F.lit(3))).alias("node"), F.max("blocks").alias("blocks"))
        lead = lead.select("t", "size", "k", "node", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("i")).where("i != k").select("t", "size", "i", F.col("i").alias("j"), "node", zero.alias("side"))
        return small.unionByName(large.select("t", "size", F.col("k").alias("i"), F.col("k").alias("j"), "node", zero.alias("side"))).unionByName(lead)
    number = F.row_number().over(Window.partitionBy("t", "size").orderBy("own", "k")).cast("long")  # blocks, of which a group has few
    numbered = written(blocks.withColumn("k", F.explode(F.sequence(zero, F.col("blocks") - 1))).select(*at, number.alias("b")), "blocks")
    pairs = numbered.alias("x").join(numbered.alias("y"), ["t", "size"]).where("x.b <= y.b and (x.own != y.own or x.own = -1)")
    pairs = written(pairs.select("t", "size", F.col("x.b").alias("i"), F.col("y.b").alias("j")), "block-pairs")
    sides = pairs.select("t", "size", "i", "j", F.col("i").alias("b"), zero.alias("side")).unionByName(pairs.where("i != j").select("t", "size", "i", "j", F.col("j").alias("b"), F.lit(1).cast("long").alias("side")))
    return small.unionByName(large.join(numbered, at).join(sides, ["t", "size", "b"]).select("t", "size", "i", "j", "node", "side"))


_GROUP = ["t", "size", "i", "j"]


def _tree_pairs(margin: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Possible links of each group of a partition sorted by group; one group is held at a time."""

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = possible_links(sides[0], sides[1] if key[2] != key[3] else None, known, margin)
            for lo in range(0, len(pairs), 50_000):
                u, v, sure = zip(*pairs[lo : lo + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sure)], names=["u", "v", "sure"])

        key, sides, known = None, ([], []), {}
        for b in batches:
            for *this, node, side, component, n, bits in zip(*(b.column(c).to_pylist() for c in (*_GROUP, "node", "side", "component", "n", "bits"))):
                if this != key:
                    if key and (len(sides[0]) > 1 or sides[1]):
                        yield from flush()
                    key, sides, known = this, ([], []), {}
                known[node] = component
                sides[side].append(Sketch(node, n, 8 * len(bits), int.from_bytes(bits, "little")))
        if key and (len(sides[0]) > 1 or sides[1]):
            yield from flush()

    return run


def _possible(members: DataFrame, classes: DataFrame, found: DataFrame, full: bool, trust: bool) -> DataFrame:
    """``(u, v, sure)`` with ``u > v``: what the trees of all groups leave possible.

    A pair may come from each group that has both its ends; the pairs are then made one.
    """
    sketches = classes.select("node", F.col("n_shingles").alias("n"), "bits").where("node is not null")
    placed = _with_components(_places(members, full).join(sketches, "node"), found)
    pairs = placed.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_tree_pairs(MARGIN if trust else None), "u long, v long, sure boolean")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), "sure").where("u != v")
    return written(pairs.groupBy("u", "v").agg(F.max("sure").alias("sure")), "possible")


def _with_components(rows: DataFrame, found: DataFrame, node: str = "node", name: str = "component") -> DataFrame:
    """``rows`` with the component of ``node`` as ``name``, itself where it has no link yet."""
    of = found.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(of, node, "left").withColumn(name, F.coalesce(name, node))


def _check_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether pairs of texts are linked by their whole sets; rows come in the order of ``v``."""
    last, tokens = None, np.zeros(0, dtype=np.uint64)
    for b in batches:
        found = []
        for x, y in zip(texts_as_bytes(b.column("text_u")), texts_as_bytes(b.column("text_v"))):
            if y != last:
                last, tokens = y, shingle_set(y)
            mine = shingle_set(x)
            common = len(np.intersect1d(mine, tokens, assume_unique=True))
            found.append(bool(common) and DEN * common >= NUM * (len(mine) + len(tokens) - common))
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(found)], names=["u", "v", "linked"])


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(u, v, linked)`` for ``(u, v)``."""
    both = pairs.select("u", "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    rows = both.mapInArrow(_check_rows, "u long, v long, linked boolean")
    return rows.groupBy("u", "v").agg(F.max("linked").alias("linked"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``(u, v, cu, cv)``: pairs whose ends are not known to be connected, with the components of the ends."""
    return _with_components(_with_components(pairs.select("u", "v"), found, "u", "cu"), found, "v", "cv").where("cu != cv")


def _settled(possible: DataFrame, texts: DataFrame, checked: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(checked, found)`` with every possible pair checked unless its ends are known to be connected."""
    todo = written(_apart(possible.join(checked, ["u", "v"], "left_anti"), found).select("u", "v"), "unchecked")
    if todo.isEmpty():
        return checked, found
    ends = todo.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = written(texts.join(ends, "node", "left_semi"), "near-texts")
    checked = written(checked.unionByName(_checked(todo, texts)), "checked")
    found = written(connected_components(checked.where("linked"), "links"), "components")
    deleted(todo, texts)
    return checked, found


def _connected_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(node, component)`` of the class representatives that have links.

    First each set goes to the groups of its first two shared shingles, which connects
    most near copies; then all groups that still hold several components are searched.
    """
    spark = docs.sparkSession
    held = classes.where("node is not null").select("node", F.col("n_shingles").alias("n"), F.xxhash64("d1", "d2").alias("key"), F.posexplode("signature").alias("place", "t"))
    tokens = held.groupBy("t").agg(F.count("*").alias("c"), F.bit_xor("key").alias("x"), F.sum(F.hash("key").cast("long")).alias("s"), F.min("place").alias("p")).where("c > 1")
    one = tokens.groupBy("c", "x", "s").agg(F.min(F.struct("p", "t")).alias("m")).select("m.t")  # of shingles that the same sets hold the first in their order
    members = written(held.drop("key").join(one, "t"), "members")
    del tokens, one
    shuffles_dropped(spark)
    nodes = members.select("node").distinct()
    # the one time that texts are shuffled; sorted, since at scale no side of this fits a broadcast
    texts = written(docs.hint("merge").join(nodes, F.col("doc_id") == F.col("node")).select("node", "text"), "texts")
    shuffles_dropped(spark)
    checked, found = spark.createDataFrame([], "u long, v long, linked boolean"), spark.createDataFrame([], "node long, component long")

    def search(now: DataFrame, full: bool, trust: bool) -> DataFrame:
        nonlocal checked, found
        now = _with_components(now, found)
        if full:
            several = now.groupBy("t").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("n").alias("least")).where("a != b").select("t", "least")
            # two linked sets are found at their first common shingle; there at most n - place others can be common
            enough = (NUM + DEN) * (F.col("n") - F.col("place")) >= NUM * (F.col("n") + F.col("least"))
            now = written(now.join(several, "t").where(enough).drop("least"), "open-members")
        possible = _possible(now, classes, found, full, trust)
        shuffles_dropped(spark)
        checked, found = _settled(possible, texts, checked, found)
        return possible

    first = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "t", "n"))), 1, 2).alias("m"))
    first = written(first.select("node", F.inline("m")).select("t", "node", "n"), "first-members")
    trusted = search(first, full=False, trust=True).unionByName(search(members, full=True, trust=True))
    # a trusted pair may turn out to be no link: what it kept from being looked at lies between components of such ends
    wrong = _apart(trusted.where("sure").join(checked.where("not linked"), ["u", "v"], "left_semi"), found)
    wrong = written(wrong.select(F.explode(F.array("cu", "cv")).alias("component")).distinct(), "wrong")
    if not wrong.isEmpty():
        near = _with_components(members, found).join(wrong, "component", "left_semi").select(*members.columns)
        search(near, full=True, trust=False)
    deleted(members, first, texts)
    return found


def jaccard_components(docs: DataFrame, few: int | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: what links of similar shingle sets connect.

    Documents with equal sets fall into one class first. Classes that share a signature
    shingle meet in a group; what travels to it is a bitmap of four to eight bits a
    shingle. In each group a signature tree finds the pairs that can link by size and
    bitmap, and whole texts confirm them, only as many as it takes to connect what links
    connect. Groups too large for one tree are split by size and dealt out as blocks.
    The prefix filter is complete unless ``few`` cuts signatures (see ``signature``).
    Shingles are compared as 64-bit hashes.

    Nulls and edges: null and empty texts have no shingles and are linked with nothing;
    a row whose ``doc_id`` is null gets the component of its copies, or null, and makes
    no links; rows that share a ``doc_id`` are one document with the links of all their
    texts; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hot = docs.sparkSession.sparkContext.broadcast(_frequent(docs))
    sets = written(map_batches(docs, _set_rows(hot, few), "doc_id long, n_shingles long, d1 long, d2 long, signature array<long>, bits binary"), "sets")
    classes = sets.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bits").alias("bits"))
    classes = written(classes, "classes")
    rows = written(sets.select("doc_id", "n_shingles", "d1", "d2"), "rows")
    deleted(sets)
    shuffles_dropped(docs.sparkSession)
    found = _connected_classes(docs, classes)
    named = written(classes.select("d1", "d2", "node").join(found, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component_id")), "class-components")
    deleted(classes)
    out = rows.join(named, ["d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, all columns; null ids stay."""
    drop = written(jaccard_components(docs).where("component_id != doc_id").select(F.col("doc_id").alias("copy_id")).distinct(), "near-copies")
    return docs.join(drop, F.col("doc_id").cast("long") == F.col("copy_id"), "left_anti")


def op9(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest({SHINGLES_SQL}) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
l AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.v FROM r JOIN l ON r.seen = l.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""
